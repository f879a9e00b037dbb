"""Ordered rows: windows, chains, transitions, drift, interleaving, change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .ranks import clamped as clamped_fold  # noqa: F401  an operator on ordered rows too


def drift_distances(vectors: DataFrame) -> DataFrame:
    """Distance of each vector to the one before it in its domain."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return vectors.withColumn("before", F.lag("v").over(w)).where("before IS NOT NULL").select("label", "vec_id", V.l2(F.col("v"), F.col("before")).alias("distance"))


def drift_trend(distances: DataFrame, recent: int = 5) -> DataFrame:
    """Coefficient of variation by domain, and whether the last distances stand above or below the mean."""
    last = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id")))
    g = distances.withColumn("k", last).groupBy("label").agg(F.count("*").alias("n"), F.avg("distance").alias("m"), F.stddev_pop("distance").alias("s"), F.avg(F.when(F.col("k") <= recent, F.col("distance"))).alias("r"))
    trend = F.when(F.col("n") < recent, "insufficient").when(F.col("r") > F.col("m") * 1.3, "increasing").when(F.col("r") < F.col("m") * 0.7, "decreasing").otherwise("stable")
    return g.select("label", "n", F.round("m", 6).alias("mean"), F.round(F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(0.0), 6).alias("variation"), trend.alias("trend"))


def chains(rows: DataFrame, key: str, order: list[str], item: str, n: int) -> DataFrame:
    """Runs of n consecutive items inside each key, with how often they occur."""
    w = Window.partitionBy(key).orderBy(*order)
    cols = [F.col(item).alias("i0")] + [F.lead(item, k).over(w).alias(f"i{k}") for k in range(1, n)]
    return rows.select(*cols).where(f"i{n - 1} IS NOT NULL").groupBy(F.concat_ws(">", *[f"i{k}" for k in range(n)]).alias("chain")).agg(F.count("*").alias("n"))


def transitions(rows: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """How often an item follows another, and as a share of what follows it."""
    nxt = F.lead(item).over(Window.partitionBy(key).orderBy(*order))
    c = rows.select(F.col(item).alias("a"), nxt.alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    return c.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 6))


def co_occurrence(rows: DataFrame, key: str, item: str, least: int = 1) -> DataFrame:
    """Pairs of distinct items of one key, in canonical order.

    The pairs of a key are made in its own row from the sorted set of its items: a key must hold a bounded number of distinct items (a session, an order).
    """
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice(F.col("x"), i + 2, F.size("x")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def lift(rows: DataFrame, item: str, good: Column, least: int) -> DataFrame:
    """Success share of each item against the share of all."""
    whole = rows.agg(F.avg(good.cast("double")).alias("base"))
    g = rows.groupBy(item).agg(F.count("*").alias("n"), F.avg(good.cast("double")).alias("rate")).where(F.col("n") >= least)
    return g.join(F.broadcast(whole)).select(item, "n", F.round("rate", 6).alias("rate"), F.round(F.col("rate") / F.col("base"), 6).alias("lift"))


def ema(rows: DataFrame, key: str, order: list[str], x: str, alpha: float, start: float) -> DataFrame:
    """Exponential moving average at the end of each key's sequence, in closed form: a value weighs by how many follow it."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    keep = F.lit(1.0 - alpha)
    w = rows.select(key, F.col(x).alias("_x"), back.alias("_k"))
    return w.groupBy(key).agg((F.sum(F.col("_x") * alpha * F.pow(keep, F.col("_k") - 1)) + F.lit(start) * F.pow(keep, F.count("*"))).alias("ema"))


def interleaved(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two ranked lists in turn, a first; an item of both keeps its first place."""
    both = a.select(key, "rank", F.lit(0).alias("src")).unionByName(b.select(key, "rank", F.lit(1).alias("src")))
    first = both.groupBy(key).agg(F.min(F.struct("rank", "src")).alias("at"))
    return first.select(key, F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


def chained(entries: DataFrame) -> DataFrame:
    """(chain, seq, prev, hash, body) of entries (chain, seq, body): each hash covers the one before. A chain is one after the other by its nature; chains are shared among tasks."""

    def link(rows):
        import hashlib

        rows = rows.sort_values("seq")
        prev, before, hashes = "", [], []
        for body in rows["body"]:
            before.append(prev)
            prev = hashlib.sha256(f"{prev}|{body}".encode()).hexdigest()
            hashes.append(prev)
        return rows.assign(prev=before, hash=hashes)[["chain", "seq", "prev", "hash", "body"]]

    return entries.select("chain", "seq", "body").groupBy("chain").applyInPandas(link, "chain long, seq long, prev string, hash string, body string")


def chain_checked(log: DataFrame) -> DataFrame:
    """A hash chain (chain, seq, prev, hash, body) with bad: whether an entry's link or hash is wrong."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("chain").orderBy("seq")), F.lit(""))
    return log.withColumn("bad", (F.col("prev") != before) | (F.col("hash") != F.sha2(F.concat_ws("|", "prev", "body"), 256)))


def chain_breaks(log: DataFrame) -> DataFrame:
    """The first wrong place of each hash chain."""
    return chain_checked(log).groupBy("chain").agg(F.count("*").alias("n"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_bad"))


def boundaries(rows: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """Rows whose item differs from the one before, with that one."""
    return rows.withColumn("before", F.lag(item).over(Window.partitionBy(key).orderBy(*order))).where(F.col("before").isNotNull() & (F.col("before") != F.col(item)))


def changed_fields(old: Column, new: Column) -> Column:
    """Fields of two maps that differ, as structs (field, old, new) in the order of names."""
    keys = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    each = F.transform(keys, lambda k: F.struct(k.alias("field"), F.try_element_at(old, k).alias("old"), F.try_element_at(new, k).alias("new")))
    return F.filter(each, lambda e: ~e["old"].eqNullSafe(e["new"]))


def replayed(diffs: DataFrame, key: str, order: str, field: str, value: str) -> DataFrame:
    """State of every field after all changes; a null value deletes the field."""
    last = diffs.groupBy(key, field).agg(F.max_by(F.struct(F.col(value)), F.col(order)).alias("v"))
    return last.select(key, field, F.col("v")[value].alias(value)).where(F.col(value).isNotNull())
