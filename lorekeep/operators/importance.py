"""Importance of a model's weights from its gradients, and updates that spare important ones.

A logistic model is fitted by Newton steps, each one aggregate of fixed size over the rows; the diagonal of the Fisher information
is the mean square of the examples' gradients at the fitted weights. Partial sums are combined map-side, so rows are never moved.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _score(x: list[Column], w: list[float]) -> Column:
    z = F.lit(0.0)
    for c, k in zip(x, w, strict=True):
        z = z + c * F.lit(float(k))
    return z


def _probability(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def moments(rows: DataFrame, x: list[Column], y: Column, w: list[float], keys: list[str] | None = None) -> DataFrame:
    """n, g0.. and f0..: of the examples' gradients (p - y) x at given weights the means and the mean squares, for each key."""
    e = _probability(_score(x, w)) - y
    means = [F.avg(e * c).alias(f"g{k}") for k, c in enumerate(x)] + [F.avg(e * c * e * c).alias(f"f{k}") for k, c in enumerate(x)]
    return rows.groupBy(*(keys or [])).agg(F.count("*").alias("n"), *means)


def fitted(rows: DataFrame, x: list[Column], y: Column, ridge: float = 1e-3, rounds: int = 15, least: float = 1e-8) -> list[float]:
    """Weights of a logistic model by Newton steps with a ridge; the driver sees len(x) + len(x)**2 sums a round."""
    d, w = len(x), np.zeros(len(x))
    for _ in range(rounds):
        p = _probability(_score(x, w.tolist()))
        v = p * (F.lit(1.0) - p)
        sums = [F.sum((y - p) * c) for c in x] + [F.sum(v * x[i] * x[j]) for i in range(d) for j in range(i, d)]
        got = rows.agg(F.count("*"), *sums).first()
        if not got[0]:
            return w.tolist()
        g = np.array(got[1 : d + 1], float) - ridge * w
        h = np.zeros((d, d))
        h[np.triu_indices(d)] = np.array(got[d + 1 :], float)
        h = h + h.T - np.diag(np.diag(h)) + ridge * np.eye(d)
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < least:
            break
    return w.tolist()


def protected(w: list[float], gradient: list[float], fisher: list[float], rate: float, strength: float) -> list[float]:
    """One step against a gradient, each weight's step damped by its importance: d / (1 + strength * fisher * d^2)."""
    out = []
    for k, g, f in zip(w, gradient, fisher, strict=True):
        step = -rate * g
        out.append(k + step / (1 + strength * f * step * step))
    return out


def penalty(old: list[float], new: list[float], fisher: list[float], strength: float) -> float:
    """What leaving the old weights costs: half the strength times the importance-weighted square of the distance."""
    return 0.5 * strength * sum(f * (a - b) ** 2 for a, b, f in zip(old, new, fisher, strict=True))
