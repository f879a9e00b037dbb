"""Vector functions on array<double> columns, in built-in array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10
RIM = 0.99


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > EPSILON, dot(a, b) / n).otherwise(F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def scaled(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def normalized(a: Column) -> Column:
    return F.when(norm(a) > EPSILON, scaled(a, F.lit(1.0) / norm(a))).otherwise(a)


def is_normalized(a: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(norm(a) - 1) < tolerance


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def to_ball(a: Column) -> Column:
    """A Euclidean vector inside the Poincare ball."""
    n = norm(a)
    return F.when(n > EPSILON, scaled(a, F.tanh(n / 2) * RIM / n)).otherwise(a)


def project_ball(a: Column) -> Column:
    n = norm(a)
    return F.when(n > RIM, scaled(a, F.lit(RIM) / n)).otherwise(a)


def poincare(u: Column, v: Column) -> Column:
    d = (F.lit(1.0) - dot(u, u)) * (F.lit(1.0) - dot(v, v))
    return F.when(d < 1e-15, F.lit(1.7976931348623157e308)).otherwise(F.acosh(F.greatest(F.lit(1.0), squared_l2(u, v) * 2 / d + 1)))


def mobius_add(u: Column, v: Column) -> Column:
    uv, uu, vv = dot(u, v), dot(u, u), dot(v, v)
    a, b, d = uv * 2 + 1 + vv, F.lit(1.0) - uu, uv * 2 + 1 + uu * vv
    return F.zip_with(u, v, lambda x, y: (x * a + y * b) / d)


def conformal(a: Column) -> Column:
    return F.lit(2.0) / F.greatest(F.lit(1.0) - dot(a, a), F.lit(EPSILON))


def transported(x: Column, y: Column, v: Column) -> Column:
    """A tangent vector at x brought to y: scaled by the ratio of the conformal factors."""
    return scaled(v, conformal(x) / conformal(y))


def lorentz(a: Column) -> Column:
    return F.lit(1.0) / F.sqrt(F.greatest(F.lit(1.0) - dot(a, a), F.lit(EPSILON)))


def mobius_scale(r: float, v: Column) -> Column:
    n = norm(v)
    return F.when(n > EPSILON, scaled(v, F.tanh(F.atanh(F.least(n, F.lit(RIM))) * r) / n)).otherwise(v)


def exp_map_origin(v: Column) -> Column:
    n = norm(v)
    return F.when(n > EPSILON, scaled(v, F.tanh(n) / n)).otherwise(v)


def log_map_origin(v: Column) -> Column:
    n = norm(v)
    return F.when(n > EPSILON, scaled(v, F.atanh(F.least(n, F.lit(RIM))) / n)).otherwise(v)


def hierarchy_distance(d: Column, depth_a: Column, depth_b: Column) -> Column:
    return d * (F.abs(depth_a - depth_b) * 0.5 + 1)
