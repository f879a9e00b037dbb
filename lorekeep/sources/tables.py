"""The driver's tables and the entities derived from them.

Every derived column is a pure expression of stored columns; AS_OF stands for "now", so results do not depend on the clock.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"


def days_before(days) -> F.Column:
    """AS_OF less a number of days, as a timestamp without zone."""
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'") - F.make_dt_interval(days)


def patterns(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored problem-solution patterns: the first line is the problem, the text the solution, language and source the domain."""
    d = documents.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    k = F.col("doc_id")
    usage = k * 13 % 40
    return d.select(
        k.alias("id"),
        F.split("text", "\n").getItem(0).alias("problem"),
        F.col("text").alias("solution"),
        F.concat_ws(".", "lang", "source").alias("domain"),
        F.array("lang", "source", F.when(F.col("n_chars") > 1000, "long").otherwise("short")).alias("tags"),
        (k * 37 % 101 / F.lit(100.0)).alias("reward"),
        (k * 53 % 97 / F.lit(96.0)).alias("confidence"),
        (k * 29 % 89 / F.lit(88.0)).alias("effectiveness"),
        usage.alias("usage_count"),
        (k * 7 % (usage + 1)).alias("success_count"),
        F.when(usage > 0, k * 7 % (usage + 1) / usage.cast("double")).otherwise(0.0).alias("success_rate"),
        (k * 11 % 130).alias("reuse_count"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("success"),
        (k % 11 / F.lit(10.0)).alias("surprise"),
        F.when(k % 17 != 0, F.concat(F.lit("s"), (k % 50).cast("string"))).alias("session_id"),
        F.when(k % 7 != 0, F.floor(k / 2)).alias("parent_id"),
        (k * 17 % 400).cast("int").alias("created_days"),
        (k * 5 % 200).cast("int").alias("updated_days"),
        days_before((k * 17 % 400).cast("int")).alias("created_at"),
        days_before((k * 5 % 200).cast("int")).alias("updated_at"),
        (k % 23 == 0).alias("archived"),
        F.when(k % 19 != 0, F.element_at(F.array(F.lit("reflex"), F.lit("crystal"), F.lit("booster")), (k % 3 + 1).cast("int"))).alias("tier"),
        F.md5(F.concat_ws("\n", F.split("text", "\n").getItem(0), "text")).alias("content_hash"),
        F.col("n_chars"),
        F.col("quality"),
        F.col("toxic"),
    )


def outcomes(events: DataFrame) -> DataFrame:
    """Usage events as outcomes of the user's session: purchase succeeds, error fails, signup is partial, the rest neutral."""
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "success").when(kind == "error", "failure").when(kind == "signup", "partial").otherwise("neutral")
    return events.select(
        F.col("event_id"), F.col("ts"), F.col("user_id"), kind.alias("event_type"), F.col("value"), F.col("props"), outcome.alias("outcome"), (F.col("event_id") % 97).alias("pattern_id"), F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("session_id")
    )


def predictions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Forecasts of a document's quality from its length; resolved where a label tells the outcome."""
    k = F.col("doc_id")
    return documents.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        k.alias("id"),
        F.col("lang").alias("domain"),
        ((k * 31 + F.col("n_chars")) % 1000 / F.lit(1000.0)).alias("probability"),
        (k * 17 % 101 / F.lit(100.0)).alias("confidence"),
        F.when(F.col("quality").isNull(), F.when(k % 9 == 0, "expired").otherwise("pending")).otherwise("resolved").alias("status"),
        (F.col("quality") == 1).alias("outcome"),
        (k * 3 % 20 + 1).alias("min_days"),
        (k * 3 % 20 + 1 + k % 45).alias("max_days"),
        (k * 7 % 60 + 1).alias("resolution_days"),
        (k * 5 % 90).alias("age_days"),
        (k % 6).alias("n_evidence"),
    )


#: Rows of a task that groups by keys which hardly repeat.
TASK_ROWS = 500_000


def tasks(rows: DataFrame) -> int:
    """In how many tasks rows are to be grouped, so that none holds more the more there are; of stored tables the count reads no rows."""
    return max(rows.count() // TASK_ROWS + 1, rows.sparkSession.sparkContext.defaultParallelism)


def edges(lineitem: DataFrame) -> DataFrame:
    """A weighted directed graph: part p to supplier s where s has delivered p, over one space of ids."""
    # Pairs hardly repeat, so nothing is gained by grouping a file's part before the rows are dealt.
    dealt = lineitem.select("l_partkey", "l_suppkey").repartition(tasks(lineitem), "l_partkey", "l_suppkey")
    ps = dealt.groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("n")).filter("src <> dst")
    total = F.col("src") + F.col("dst")
    kind = F.when(total % 3 == 0, "similar").when(total % 3 == 1, "depends").otherwise("refines")
    return ps.select("src", "dst", kind.alias("kind"), (F.col("n") / (F.col("n") + F.lit(2.0))).alias("strength"), ((F.col("src") * 7 + F.col("dst")) % 180).alias("age_days"), (total % 2 == 0).alias("auto_created"))


class Tables:
    """All tables of a folder, each read when first asked for."""

    NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "clicks", "sales", "sale_lines", "clients", "client_changes", "vendors", "items", "stamps")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise AttributeError(name)
        out = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, out)
        return out

    @cached_property
    def patterns(self) -> DataFrame:
        return patterns(self.documents, self.labels)

    @cached_property
    def outcomes(self) -> DataFrame:
        return outcomes(self.events)

    @cached_property
    def predictions(self) -> DataFrame:
        return predictions(self.documents, self.labels)

    @cached_property
    def edges(self) -> DataFrame:
        return edges(self.lineitem)

    @cached_property
    def vectors(self) -> DataFrame:
        """Stored vectors as doubles, with their label as domain."""
        return self.embeddings.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
