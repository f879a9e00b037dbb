"""The hash embedder: words, word pairs and triples hashed to signed places of a short vector."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Dimensions, the sections for words, pairs and triples, and the hash's prefix.
DIMENSIONS = 128
SECTIONS = {b"uni": (0, 42), b"bi": (42, 84), b"tri": (84, 128)}
PREFIX = b"ruvector-shf:"


def place(data: bytes, salt: bytes, size: int) -> tuple[int, float]:
    h = hashlib.shake_256(PREFIX + salt + b":" + data).digest(5)
    return int.from_bytes(h[:4], "little") % size, -1.0 if h[4] & 1 else 1.0


def embed(text: str) -> list[float]:
    """The embedding of a text; texts of one or two words also count character triples, by half."""
    v = [0.0] * DIMENSIONS
    low = text.lower()
    words = low.split()
    for n, (salt, (a, z)) in enumerate(SECTIONS.items(), 1):
        for i in range(len(words) - n + 1):
            k, sign = place(" ".join(words[i : i + n]).encode(), salt, z - a)
            v[a + k] += sign
    if len(words) <= 2:
        chars = "".join(c for c in low if c.isalnum())
        a, z = SECTIONS[b"tri"]
        for i in range(len(chars) - 2):
            k, sign = place(chars[i : i + 3].encode(), b"ctri", z - a)
            v[a + k] += 0.5 * sign
    size = sum(x * x for x in v) ** 0.5
    return [max(-1.0, min(1.0, x / size)) for x in v] if size > 1e-10 else v


def embedded(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def f(rows: pd.Series) -> pd.Series:
        return rows.fillna("").map(embed)

    return f(text)


def low_rank(v: Column, a: list[list[float]], b: list[list[float]], alpha: float) -> Column:
    """A low-rank adapter: the normalised sum of x and alpha * B (A x), a matrix product on each Arrow batch."""

    @F.pandas_udf("array<double>")
    def f(rows: pd.Series) -> pd.Series:
        import numpy as np

        x = np.stack(rows.to_list()) if len(rows) else np.zeros((0, len(b)))
        y = x + alpha * (x @ np.array(a).T) @ np.array(b).T
        size = np.linalg.norm(y, axis=1, keepdims=True)
        return pd.Series(list(np.where(size > 1e-10, y / np.maximum(size, 1e-10), y)), index=rows.index)

    return f(v)
