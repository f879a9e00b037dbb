"""Scans, filters and paging over stored patterns; upserts and merges of row sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SORTABLE = {"id", "reward", "confidence", "effectiveness", "usage_count", "reuse_count", "created_days", "updated_days"}


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def recent(df: DataFrame, n: int) -> DataFrame:
    """The n rows updated last; ties by id."""
    return df.orderBy("updated_days", "id").limit(n)


def best(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(by), "id").limit(n)


def in_tiers(df: DataFrame, tiers: list[str], default: str = "booster") -> DataFrame:
    return df.where(F.coalesce("tier", F.lit(default)).isin(tiers))


def listing(df: DataFrame, domain: str | None = None, tier: str | None = None, search: str | None = None, sort: str = "id", descending: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of patterns: optional equality filters, a substring in any of three columns, a column from a fixed list to sort by."""
    if sort not in SORTABLE:
        raise ValueError(f"cannot sort by {sort}")
    if domain:
        df = df.where(F.col("domain") == domain)
    if tier:
        df = df.where(F.lower("tier") == tier.lower())
    if search:
        s = search.lower()
        df = df.where(F.lower("problem").contains(s) | F.lower("solution").contains(s) | F.lower("domain").contains(s))
    order = F.desc(sort) if descending else F.asc(sort)
    return df.orderBy(order, "id").offset(offset).limit(min(limit, 500))


def all_tags(df: DataFrame, tags: list[str]) -> DataFrame:
    return df.where(F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0)


def any_tag(df: DataFrame, tags: list[str]) -> DataFrame:
    return df.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def not_in_session(df: DataFrame, session: str) -> DataFrame:
    """Rows of other sessions and of none."""
    return df.where(~F.col("session_id").eqNullSafe(F.lit(session)))


def all_words(df: DataFrame, words: str) -> DataFrame:
    """Every word of the query occurs in the problem or the solution."""
    has = [F.lower("problem").contains(w) | F.lower("solution").contains(w) for w in words.lower().split()]
    return df.where(reduce(lambda a, b: a & b, has, F.lit(True)))


def low_reward(df: DataFrame, below: float = 0.3, uses: int = 5) -> DataFrame:
    """Patterns often used and little rewarded, with what to do about them and why."""
    advice = F.when(F.col("reward") < 0.1, "archive").when(F.col("effectiveness") < 0.3, "review").otherwise("monitor")
    reasons = F.array_compact(F.array(F.when(F.col("reward") < 0.1, "very low reward"), F.when(F.col("effectiveness") < 0.3, "low effectiveness"), F.when(F.col("confidence") < 0.3, "low confidence")))
    return df.where((F.col("reward") < below) & (F.col("reuse_count") >= uses)).withColumns({"advice": advice, "reasons": reasons})


def stale(df: DataFrame, days: int, uses: int) -> DataFrame:
    return df.where((F.col("updated_days") > days) & (F.col("reuse_count") < uses))


def archived(df: DataFrame, note: str) -> DataFrame:
    """Marks rows: a tag that says so, and a note after what the critique said."""
    return df.withColumns({"tags": F.array_union("tags", F.array(F.lit("__archived__"))), "critique": F.concat_ws("\n---\n", "domain", F.lit(note))})


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both; of those with one key the latest version, new before old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def without_known(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Import: one row for each key that is not there yet."""
    return new.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def changed_since(df: DataFrame, days: int, limit: int, offset: int = 0) -> DataFrame:
    return df.where(F.col("updated_days") < days).orderBy("updated_days", "id").offset(offset).limit(limit)


def kept_latest(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """Retention: the n latest rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def granted(df: DataFrame, grants: DataFrame, mode: str, key: str) -> DataFrame:
    """Row access: all rows, those granted, or those not excluded."""
    if mode == "all":
        return df
    return df.join(grants.select(key).distinct(), key, "left_semi" if mode == "include" else "left_anti")


def overlapping(df: DataFrame, low: int, high: int) -> DataFrame:
    return df.where((F.col("min_days") <= high) & (F.col("max_days") >= low))


def in_domain(df: DataFrame, asked: str, how: str = "both") -> DataFrame:
    """Domain filters: both ways along the hierarchy, the domain and below, or any prefix."""
    d = F.col("domain")
    test = {"both": lambda: T.domain_matches(d, asked), "within": lambda: T.domain_within(d, asked), "prefix": lambda: d.startswith(asked)}[how]()
    return df.where(test)


#: Rows of a pulled page at most.
PAGE = 500


def pulled(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of a change feed, PAGE rows at most, and has_more: whether rows follow. One row more than the page is read."""
    n = min(limit, PAGE)
    page = df.orderBy(*order).offset(offset).limit(n + 1)
    numbered = page.withColumn("_k", F.row_number().over(Window.orderBy(*order))).withColumn("has_more", F.count("*").over(Window.partitionBy()) > n)
    return numbered.where(F.col("_k") <= n).drop("_k")
