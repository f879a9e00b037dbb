"""Aggregations: statistics, histograms, calibration, experiments, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from .ranks import running


def mean(x, places: int = 6) -> Column:
    return F.round(F.avg(x), places)


def pattern_stats(p: DataFrame) -> DataFrame:
    return p.agg(
        F.count("*").alias("n"),
        mean("reward").alias("avg_reward"),
        mean("confidence").alias("avg_confidence"),
        F.round(F.count_if(F.col("success_rate") > 0.5) / F.count("*"), 6).alias("success_share"),
        F.sum("usage_count").alias("usage"),
        mean("usage_count").alias("avg_usage"),
    )


def rolled_up(p: DataFrame, least: int = 1) -> DataFrame:
    """Counts by domain and all its ancestors: a row counts at each level of its path."""
    each = p.select(F.explode(T.domain_levels(F.col("domain"))).alias("domain"), "reward", "success_rate")
    return each.groupBy("domain").agg(F.count("*").alias("n"), mean("reward").alias("avg_reward"), mean("success_rate").alias("avg_success")).where(F.col("n") >= least)


def histogram(df: DataFrame, x: str, buckets: int = 10) -> DataFrame:
    """Counts in equal buckets of [0, 1], empty ones too; 1 falls into the last."""
    b = F.least(F.floor(F.col(x) * buckets), F.lit(buckets - 1))
    n = df.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def upper_median(x: str) -> Column:
    """The element at n / 2 of the sorted values, counted from 0: from above it is the first at half of all."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)")


def duplicate_groups(p: DataFrame) -> DataFrame:
    """Groups of equal content: the canonical row (best reward, most reuse, least id), sums over the group."""
    best = F.max_by("id", F.struct("reward", "reuse_count", -F.col("id")))
    g = p.groupBy("content_hash").agg(F.count("*").alias("n"), best.alias("canonical"), F.round(F.sum("reward"), 6).alias("combined_reward"), F.sum("reuse_count").alias("total_reuse"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    return g.where("n > 1")


def merged_duplicates(p: DataFrame) -> DataFrame:
    """One row for each content, the canonical, with the group's reuse."""
    w = Window.partitionBy("content_hash")
    r = F.row_number().over(w.orderBy(F.desc("reward"), F.desc("reuse_count"), "id"))
    return p.withColumn("total", F.sum("reuse_count").over(w)).withColumn("_r", r).where("_r = 1").select("id", "content_hash", F.col("total").alias("reuse_count"))


def calibration_buckets(p: DataFrame) -> DataFrame:
    """Resolved forecasts in ten buckets: how many, how many came true, the sum of Brier scores."""
    done = p.where("status = 'resolved'")
    b = F.least(F.floor(F.col("probability") * 10), F.lit(9))
    return done.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("outcome").alias("positive"), F.round(F.sum(S.brier(F.col("probability"), F.col("outcome"))), 6).alias("brier"))


def calibration_report(buckets: DataFrame) -> DataFrame:
    rate = F.col("positive") / F.col("n")
    off = F.abs((F.col("bucket") + 0.5) / 10.0 - rate)
    return buckets.agg(F.sum("n").alias("n"), F.round(F.sum("brier") / F.sum("n"), 6).alias("avg_brier"), F.round(F.avg(off), 6).alias("calibration_error"), F.round(F.sum("positive") / F.sum("n"), 6).alias("positive_rate"), F.count_if((F.col("bucket") + 0.5) / 10.0 > rate).alias("overconfident"))


def isotonic(buckets: DataFrame) -> DataFrame:
    """Bucket rates made non-decreasing by pooling neighbours: the largest mean of a run that ends here or before, of the least such means from here on.

    At most ten rows a model: the min-max formula over all runs, in array expressions of one row.
    """
    rows = buckets.agg(F.sort_array(F.collect_list(F.struct("bucket", (F.col("positive") / F.col("n")).alias("rate")))).alias("x"))
    n = F.size("x")
    run = lambda i, j: F.aggregate(F.slice(F.transform("x", lambda e: e["rate"]), i, j - i + 1), F.lit(0.0), lambda a, b: a + b) / (j - i + 1)
    level = lambda k: F.array_max(F.transform(F.sequence(F.lit(1), k), lambda i: F.array_min(F.transform(F.sequence(k, n), lambda j: run(i, j)))))
    out = F.transform("x", lambda e, k: F.struct(e["bucket"].alias("bucket"), F.round(e["rate"], 6).alias("rate"), F.round(level(k + 1), 6).alias("pooled")))
    return rows.select(F.explode(out).alias("r")).select("r.*")


def variant(session: Column, salt: str, treated: float) -> Column:
    """Assignment by the first 64 bits of an md5: the absolute value as a share of 2^63 below the split is treated."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), session)), 1, 16), 16, 10).cast("decimal(20,0)")
    half, whole = F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    v = F.when(u >= half, whole - u).otherwise(u)
    return F.when(v.cast("double") / F.lit(float(2**63)) < treated, "treatment").otherwise("control")


def variant_stats(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Statistics by key; the order statistics (counted from 0: n / 2, 0.95 n, 0.99 n) come from counts by value, added up range by range."""
    by = rows.groupBy(*keys, F.col(x).alias("_x")).agg(F.count("*").alias("_n"))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), mean(x).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))
    placed = running(by.where("_x IS NOT NULL"), keys, ["_x"], F.col("_n"), "_upto").join(whole.select(*keys, "n"), keys)
    at = lambda share: F.round(F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("n") * share), F.col("n") - 1), F.col("_x"))), 6)
    places = placed.groupBy(*keys).agg(at(0.5).alias("median_upper"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    return whole.join(places, keys).select(*keys, "n", "mean", "std", "median_upper", "p95", "p99", "low", "high")


def percentiles(x: str, shares: list[float]) -> list[Column]:
    return [F.round(F.expr(f"percentile_cont({s}) WITHIN GROUP (ORDER BY {x})"), 6).alias(f"p{int(s * 100)}") for s in shares]


def change_severity(change: Column) -> Column:
    return F.when(change >= 0.2, "critical").when(change >= 0.1, "warning").otherwise("ok")


def tags_counted(p: DataFrame, text: str) -> DataFrame:
    """Tag frequencies where tags are a JSON list or a comma list in one text column."""
    tags = F.when(F.col(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, ","))
    return p.select(F.explode(tags).alias("tag")).select(F.trim("tag").alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("n"))


def daily(df: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """Rows by day, days without any too."""
    days = df.sparkSession.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}', INTERVAL 1 DAY)) AS d")
    n = df.groupBy(F.to_date(ts).alias("d")).agg(F.count("*").alias("n"))
    return days.join(n, "d", "left").select(F.col("d").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def fisher_by_domain(p: DataFrame, updates: DataFrame) -> DataFrame:
    """Importance of patterns from their summed changes, normalised in the domain."""
    raw = updates.groupBy("pattern_id").agg(F.sum("delta").alias("d"), F.count("*").alias("n"))
    x = p.join(raw, p["id"] == raw["pattern_id"]).select("id", "domain", (F.least(F.abs("d"), F.lit(1.0)) * (F.col("n") + 1)).alias("raw"))
    return x.withColumn("share", F.round(F.col("raw") / F.sum("raw").over(Window.partitionBy("domain")), 6)).select("id", "domain", "share")


def consolidated(p: DataFrame, key: list[str], max_tags: int = 3) -> DataFrame:
    """Groups merged into their best row: rewards by four strategies, tags by the primary's first and then by frequency."""
    best = F.struct("reward", -F.col("id"))
    g = p.groupBy(*key).agg(
        F.max_by("id", best).alias("primary"),
        F.max_by("tags", best).alias("own"),
        F.count("*").alias("n"),
        mean("reward").alias("reward_avg"),
        F.round(F.max("reward"), 6).alias("reward_max"),
        F.round(F.min("reward"), 6).alias("reward_min"),
        F.round(F.when(F.sum("reuse_count") == 0, F.avg("reward")).otherwise(F.sum(F.col("reward") * F.col("reuse_count")) / F.sum("reuse_count")), 6).alias("reward_weighted"),
        mean("effectiveness").alias("effectiveness"),
        F.sum("reuse_count").alias("reuse"),
    )
    tags = p.select(*key, F.explode(F.array_except("tags", F.array(F.lit("__archived__"), F.lit("imported")))).alias("tag")).groupBy(*key, "tag").agg(F.count("*").alias("f"))
    boosted = tags.join(g.select(*key, "own"), key).withColumn("score", F.col("f") + F.when(F.array_contains("own", F.col("tag")), 1000).otherwise(0))
    ranked = boosted.groupBy(*key).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "tag"))), 1, max_tags).alias("x"))
    return g.join(ranked.select(*key, F.array_join(F.transform("x", lambda e: e["tag"]), ",").alias("tags")), key).drop("own")
