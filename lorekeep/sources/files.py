"""File and database sources and sinks: JSON documents, seed lines, text folders, snapshots, notifications, JDBC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = "problem string, solution string, domain string, context string, tags array<string>, reward double, effectiveness double, confidence double, success_rate double, reuse_count long, tier string"
DOCUMENT = f"version string, exported_at string, source string, pattern_count long, patterns array<struct<{', '.join(x.replace(' ', ': ', 1) for x in PATTERN.split(', '))}>>"
SEED = "problem string, solution string, domain string, tags array<string>, reward double"


def export_lines(df: DataFrame, path: str, gzip: bool = False) -> None:
    """One JSON object a line, as many files as the table has partitions."""
    df.write.option("compression", "gzip" if gzip else "none").mode("overwrite").json(path)


def import_document(spark: SparkSession, path: str) -> DataFrame:
    """Patterns of versioned export documents (one JSON object a file)."""
    d = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return d.select("version", F.explode("patterns").alias("p")).select("version", "p.*")


def import_seed(spark: SparkSession, path: str, known: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """Seed lines: broken lines are left out, the domain gets a prefix, contents seen before or twice are dropped."""
    s = spark.read.schema(SEED).option("mode", "DROPMALFORMED").json(path).where("problem IS NOT NULL")
    s = s.withColumn("domain", F.concat(F.lit(prefix), F.coalesce("domain", F.lit("general"))))
    s = s.withColumn("content_hash", F.sha2(F.concat_ws("\n", "problem", "solution"), 256)).dropDuplicates(["content_hash"])
    return s if known is None else s.join(known.select("content_hash"), "content_hash", "left_anti")


def seed_rows(patterns: DataFrame, include: str, exclude: str, redact: Callable[[Column], Column]) -> DataFrame:
    """Rows for a seed export: domains by two patterns, one row for each start of a problem and domain, texts redacted."""
    p = patterns.where(F.col("domain").rlike(include) & ~F.col("domain").rlike(exclude))
    key = F.md5(F.concat_ws("|", F.substring("problem", 1, 200), "domain"))
    g = p.groupBy(key.alias("k")).agg(F.min_by(F.struct("id", "problem", "solution", "domain", "reward"), "id").alias("r"))
    return g.select("r.id", redact(F.col("r.problem")).alias("problem"), redact(F.col("r.solution")).alias("solution"), "r.domain", "r.reward")


def text_folder(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """(path, text) of every file below a folder."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(path, wholetext=True)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def snapshot(df: DataFrame, path: str, number: int) -> None:
    """A full copy or an increment, as a numbered part of a backup."""
    df.write.mode("overwrite").parquet(f"{path}/part={number}")


def restored(spark: SparkSession, path: str, key: str, version: str, upto: int) -> DataFrame:
    """State after the parts up to a number: of each key its last version."""
    d = spark.read.option("mergeSchema", True).parquet(path).where(F.col("part") <= upto)
    cols = [c for c in d.columns if c != "part"]
    return d.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct("part", version)).alias("r")).select("r.*")


def notifications(raw: DataFrame, schema: str) -> DataFrame:
    """Events of (channel, payload) rows whose payload is JSON; payloads that are not stay out. Works on streams too."""
    return raw.select("channel", F.from_json("payload", schema).alias("e")).where("e IS NOT NULL").select("channel", "e.*")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; partitionColumn, lowerBound, upperBound and numPartitions split the read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
