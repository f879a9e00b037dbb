"""Running sums and places within keys that no task holds whole: rows dealt by range, sums of the ranges added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows dealt by ranges of keys and order, with the range's number as _part: within a key it grows with the order.

    Written: how ranges are cut depends on a sample, which a repeated task might draw otherwise.
    """
    return written(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The rows with the sum of a value up to and including each, in an order within the keys that has no ties.

    A key with many rows is in many ranges. A window sums each range of a key, another one the ranges' totals, one row a range.
    """
    dealt = ranged(rows.withColumn("_v", value), keys, order)
    totals = dealt.groupBy(*keys, "_part").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    here = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys] + [F.col("d._part") == F.col("t._part")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    out = dealt.withColumn("_here", F.sum("_v").over(here)).alias("d").join(totals.alias("t"), on)
    return out.select(*[F.col(f"d.{c}").alias(c) for c in rows.columns], (F.col("t._before") + F.col("d._here")).alias(name))


def clamped(rows: DataFrame, key: str, order: list[str], step: Column, start: float) -> DataFrame:
    """(key, value): a running value in [0, 1] under steps in order, each clamped; the bounds make the order matter.

    Steps of a range compose to one function x -> min(high, max(low, x + sum)), and so do ranges, whatever the value before
    them. A list holds the steps of a key in one range, another one the functions of its ranges.
    """
    some = ranged(rows.select(key, *order, step.alias("_step")), [key], order)
    g = some.groupBy(key, "_part").agg(F.array_sort(F.collect_list(F.struct(*order, "_step"))).alias("s"))
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    inf = F.lit(float("inf"))
    none = F.struct(F.lit(0.0).alias("sum"), (-inf).alias("low"), inf.alias("high"))
    one = lambda a, e: F.struct((a["sum"] + e["_step"]).alias("sum"), unit(a["low"] + e["_step"]).alias("low"), unit(a["high"] + e["_step"]).alias("high"))
    parts = g.select(key, "_part", F.aggregate("s", none, one).alias("f")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_part", "f"))).alias("p"))
    return parts.select(key, F.aggregate("p", F.lit(start), lambda x, e: F.least(F.greatest(x + e["f"]["sum"], e["f"]["low"]), e["f"]["high"])).alias("value"))
