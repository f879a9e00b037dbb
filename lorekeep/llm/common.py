"""What the operators share: the folder all machines see, written tables, word rules, Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of every operator here, as a Java regular expression; bytes.split() of Python cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Documents that a worker looks at together: with texts of 100 KB some 50 MB.
BATCH_ROWS = 400

_own_dir: list[str] = []


def ready(spark: SparkSession) -> SparkSession:
    """Workers find this package where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, with its file system's scheme; on one machine an own one where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="lorekeep-"))
        named = f"file://{_own_dir[0]}"
    path = sc._jvm.org.apache.hadoop.fs.Path(named)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return re.sub("^file:/(?!/)", "file:///", full)  # the form that pyarrow reads too


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under the application's own folder there."""
    return f"{shared_dir(spark)}/lorekeep-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, and outlives any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lorekeep_path = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Removes a path and all below it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lorekeep_path", None)
        if path:
            removed(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder, once its results are read."""
    removed(spark, f"{shared_dir(spark)}/lorekeep-{spark.sparkContext.applicationId}")


#: A key with more rows than this, and more than a fair share of them, is joined on its own.
HOT_ROWS = 100_000


def hot_keys(counts: DataFrame, key: str, rows: int, least: int | None = None) -> list:
    """Keys of a table (key, n) with many of the `rows`: at most 4 for each shuffle partition, whatever the input."""
    fair = rows // (4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    least = HOT_ROWS if least is None else least
    return [r[0] for r in counts.filter(F.col("n") > max(least, fair)).select(key).collect()] if rows > least else []


def joined(many: DataFrame, one: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join of a table with a table of one row a key. Rows of the hot keys stay where they are: their few partners are broadcast."""
    if not hot:
        return many.join(one, key)
    rest = many.filter(~F.col(key).isin(hot)).join(one, key)
    return rest.unionByName(many.filter(F.col(key).isin(hot)).join(F.broadcast(one.filter(F.col(key).isin(hot))), key))


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text as a string; null counts as empty, bytes that are not UTF-8 as U+FFFD."""
    return F.coalesce(F.make_valid_utf8(docs[text].cast("string")), F.lit(""))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of BATCH_ROWS at most, whatever the session's setting."""
    ready(df.sparkSession)
    return df.mapInArrow(lambda batches: f(_sliced(batches, BATCH_ROWS)), schema)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column of a batch as bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
