"""Forecasts from evidence: weighted probability, confidence, agreement, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S


def from_evidence(e: DataFrame, key: str, enough: int = 10, smoothing: float = 0.1) -> DataFrame:
    """(key, n, probability, confidence, low, high) from evidence rows (key, success_rate, weight, confidence)."""
    g = e.groupBy(key).agg(
        F.count("*").alias("n"),
        F.sum(F.col("success_rate") * F.col("weight")).alias("sw"),
        F.sum("weight").alias("w"),
        F.avg("confidence").alias("c"),
        F.var_pop("success_rate").alias("var"),
    )
    p = F.when(F.col("w") > 0, F.col("sw") / F.col("w")).otherwise(0.5) * (1 - smoothing) + 0.5 * smoothing
    agree = F.when(F.col("n") < 2, 0.5).otherwise(F.lit(1.0) - F.least(F.col("var") / 0.25, F.lit(1.0)))
    conf = S.clamp(F.least(F.col("n") / F.lit(float(enough)), F.lit(1.0)) * 0.3 + F.col("c") * 0.3 + F.least(F.col("w") / F.col("n"), F.lit(1.0)) * 0.2 + agree * 0.2, 0.1, 0.95)
    x = g.select(key, "n", p.alias("p"), conf.alias("c"))
    half = (F.lit(1.0) - F.col("c")) * 0.5
    return x.select(key, "n", F.round("p", 6).alias("probability"), F.round("c", 6).alias("confidence"), F.round(F.greatest(F.col("p") - half, F.lit(0.0)), 6).alias("low"), F.round(F.least(F.col("p") + half, F.lit(1.0)), 6).alias("high"))


def timeline(rows: DataFrame, key: str, days: str, fence: float = 1.5) -> DataFrame:
    """Bounds of resolution times by key: interpolated percentiles after values beyond the quartile fences are left out."""
    cut = rows.groupBy(key).agg(F.count("*").alias("total"), F.percentile(days, F.lit(0.25)).alias("q1"), F.percentile(days, F.lit(0.75)).alias("q3"))
    j = rows.join(cut, key)
    spread = (F.col("q3") - F.col("q1")) * fence
    inside = j.where((F.col("total") <= 3) | F.col(days).between(F.col("q1") - spread, F.col("q3") + spread))
    return inside.groupBy(key).agg(
        F.count("*").alias("n"),
        (F.first("total") - F.count("*")).alias("outliers"),
        F.round(F.avg(days), 6).alias("mean"),
        F.round(F.when(F.count("*") > 1, F.stddev_samp(days)).otherwise(0.0), 6).alias("std"),
        F.round(F.percentile(days, F.lit(0.1)), 6).alias("p10"),
        F.round(F.percentile(days, F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile(days, F.lit(0.9)), 6).alias("p90"),
    )
