"""Tables that live between the steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on one machine an own one where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lorekeep-scratch-"))
    return f"file://{_own[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table: cuts the lineage and outlives any executor."""
    path = f"{folder(df.sparkSession)}/scratch-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def written_by(df: DataFrame, name: str, *columns: str) -> str:
    """The rows as a table whose folders are values of columns, so that a filter on these opens no others; returns its path."""
    path = f"{folder(df.sparkSession)}/scratch-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*columns).parquet(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared one."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._scratch_path)
