"""A stored full-text index: postings by term, delta-coded with positions, in buckets that a query opens by name.

A segment holds the documents of one load. Its documents fall in shards of some SHARD documents and WORDS words at most by a hash of their
key, and a task turns one shard after the other into rows, so texts are dealt once and words and places never; a row
of the postings is one term in one shard: keys in order as differences, how often each has the term, its length, the term's
positions as differences, and the most that any document of the row has (its block maximum). Rows lie in buckets by a checksum of the
term's first letters, sorted by term, so a word, a phrase and a prefix of that many letters each open one bucket or two, and
inside it the row groups that may hold the term. Texts are read when a segment is made and never again.

A document that comes again in a later segment replaces its earlier form. merged() rewrites all segments as one.
"""

from __future__ import annotations

import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import folder
from .fulltext import COLUMNS, K1, B, parsed, terms

#: Documents of a shard, buckets of a segment, letters of a term that name its bucket.
SHARD, BUCKETS, LETTERS = 4096, 64, 2
#: Words of a shard, which one task holds; shards whose rows of one bucket share a file.
WORDS, FILED = 1 << 20, 32

_ROW = "term string, shard long, keys array<long>, tf array<long>, len array<long>, at array<array<long>>, most long"


class TextIndex(NamedTuple):
    path: str
    key: str
    column: str
    segments: int
    shards: tuple[int, ...]

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings")

    def documents(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/documents")


def bucket(start: str) -> int:
    """The bucket of all terms that start so."""
    return zlib.crc32(start[:LETTERS].encode()) % BUCKETS


def _steps(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What each number is above the one before it; the first of each group counts from zero."""
    out = np.diff(x, prepend=0)
    out[starts] = x[starts]
    return out


def _rows(shard: int, terms: pa.Array, code: np.ndarray, key: np.ndarray, length: np.ndarray, at: pa.ListArray) -> pa.Table:
    """Rows of postings of a shard from its entries, which lie by code (a place in terms) and key."""
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    offsets = pa.array(np.append(starts, len(code)).astype(np.int32))
    listed = lambda values: pa.ListArray.from_arrays(offsets, values)
    tf = np.diff(at.offsets.to_numpy()).astype(np.int64)
    columns = {
        "term": terms.take(pa.array(code[starts])),
        "shard": pa.array(np.full(len(starts), shard, np.int64)),
        "keys": listed(pa.array(_steps(key, starts))),
        "tf": listed(pa.array(tf)),
        "len": listed(pa.array(length)),
        "at": listed(at),
        "most": pa.array(np.maximum.reduceat(tf, starts) if len(starts) else tf),
    }
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return pa.Table.from_batches([batch.slice(a, 8192) for a in range(0, len(starts), 8192)], batch.schema)


def _inverted(docs: pa.Table) -> pa.Table:
    """Postings of a shard's documents (shard, key, terms)."""
    docs = docs.sort_by("key")
    words, key = docs.column("terms").combine_chunks(), docs.column("key").to_numpy()
    length = np.diff(words.offsets.to_numpy()).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(key)), length)
    pos = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    order = np.argsort(code, kind="stable")
    code, doc, pos = code[order], doc[order], pos[order]
    # An entry is a term in a document.
    starts = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    at = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)).astype(np.int32)), pa.array(_steps(pos, starts)))
    return _rows(docs.column("shard")[0].as_py(), coded.dictionary, code[starts], key[doc[starts]], length[doc[starts]], at)


def _joined(rows: pa.Table, gone: pa.Table) -> pa.Table:
    """Postings (shard, term, segment, keys, len, at) of several shards as those of one, without documents (segment, key) that are gone."""
    none = np.zeros(0, np.int64)
    if not rows.num_rows:
        return _rows(0, pa.array([], pa.string()), none, none, none, pa.array([], pa.list_(pa.int64())))
    column = lambda name: rows.column(name).combine_chunks()
    keys = column("keys")
    n = np.diff(keys.offsets.to_numpy())
    # Running sums within each row.
    key, first = np.cumsum(keys.flatten().to_numpy(zero_copy_only=False)), np.cumsum(n) - n
    key = key - np.repeat(np.where(first > 0, key[first - 1], 0), n)
    segment = np.repeat(column("segment").to_numpy(), n)
    coded = column("term").dictionary_encode()
    code = np.repeat(coded.indices.to_numpy(zero_copy_only=False), n)
    dead, dead_in = gone.column("key").to_numpy(), gone.column("segment").to_numpy()
    live = np.ones(len(key), bool)
    for s in np.unique(dead_in):
        live &= ~((segment == s) & np.isin(key, dead[dead_in == s]))
    kept = np.flatnonzero(live)
    order = kept[np.lexsort((key[kept], code[kept]))]
    length = column("len").flatten().to_numpy(zero_copy_only=False)
    at = column("at").flatten().take(pa.array(order))
    return _rows(rows.column("shard")[0].as_py(), coded.dictionary, code[order], key[order], length[order], at)


def _sums(x: Column | str) -> Column:
    @F.pandas_udf("array<long>")
    def f(rows: pd.Series) -> pd.Series:
        import numpy as np

        return rows.map(lambda d: np.cumsum(d, dtype=np.int64))

    return f(x)


def _less(places: Column, k: int) -> Column:
    return F.transform(places, lambda p: p - k)


def _written(docs: DataFrame, key: str, column: str, path: str, segment: int) -> int:
    if column not in COLUMNS:
        raise ValueError(f"{column} cannot be searched")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(column, F.lit("")).alias("_text")).where("key IS NOT NULL")
    sizes = f"{path}/documents/segment={segment}"
    rows.select("key", F.size(terms(F.col("_text"))).cast("long").alias("len")).write.parquet(sizes)
    shards = _shards(spark.read.parquet(sizes))
    # One exchange, of texts: a shard's documents stay together from here to its rows of postings.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard")
    block = dealt.select("shard", "key", terms(F.col("_text")).alias("terms")).groupBy("shard").applyInArrow(_inverted, _ROW)
    _filed(block, shards, f"{path}/postings/segment={segment}")
    spark.catalog.refreshByPath(path)
    return shards


def _shards(documents: DataFrame) -> int:
    n, words = documents.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    return max(n // SHARD, words // WORDS) + 1


def _filed(block: DataFrame, shards: int, path: str) -> None:
    """Writes rows of postings in their buckets, sorted by term."""
    code = (F.crc32(F.substring("term", 1, LETTERS).cast("binary")) % BUCKETS).cast("int")
    # A bucket's rows are parted by shards, so no frequent term or bucket is one task's, and nothing is computed twice to find ranges.
    dealt = block.withColumn("bucket", code).repartition("bucket", F.col("shard") % (shards // FILED + 1))
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def built(docs: DataFrame, key: str, column: str, path: str | None = None) -> TextIndex:
    """An index of a text column; a key must be a number and one document's."""
    spark = docs.sparkSession
    path = path or f"{folder(spark)}/scratch-{spark.sparkContext.applicationId}/text-index-{uuid.uuid4().hex}"
    return TextIndex(path, key, column, 1, (_written(docs, key, column, path, 0),))


def added(index: TextIndex, docs: DataFrame) -> TextIndex:
    """With another segment; documents whose keys are known already replace those."""
    shards = _written(docs, index.key, index.column, index.path, index.segments)
    return index._replace(segments=index.segments + 1, shards=(*index.shards, shards))


def _valid(index: TextIndex, spark: SparkSession) -> DataFrame:
    """(key, len, segment) of each document's latest form."""
    docs = index.documents(spark)
    if index.segments == 1:
        return docs
    latest = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("segment")))
    return docs.withColumn("_k", latest).where("_k = 1").drop("_k")


def _opened(rows: DataFrame) -> DataFrame:
    """(term, key, tf, len, at, segment): a row for each document of the postings."""
    rows = rows.withColumn("keys", _sums("keys"))
    return rows.select("term", "segment", F.explode(F.arrays_zip("keys", "tf", "len", "at")).alias("p")).select("term", "segment", F.col("p.keys").alias("key"), F.col("p.tf").alias("tf"), F.col("p.len").alias("len"), F.col("p.at").alias("at"))


def merged(index: TextIndex, spark: SparkSession, path: str | None = None) -> TextIndex:
    """All segments as one, replaced forms of documents gone; made from the postings, not from texts."""
    path = path or f"{folder(spark)}/scratch-{spark.sparkContext.applicationId}/text-index-{uuid.uuid4().hex}"
    live = _valid(index, spark)
    live.select("key", "len").write.parquet(f"{path}/documents/segment=0")
    shards = _shards(spark.read.parquet(f"{path}/documents/segment=0"))
    # Whole shards are put together, so rows of postings are dealt once and never taken apart; a document that is gone goes to its shard.
    of = lambda numbers: F.element_at(F.lit(list(numbers)), F.col("segment") + 1)
    before = np.cumsum((0, *index.shards[:-1])).tolist()
    to = ((of(before) + F.col("shard")) % shards).cast("long").alias("shard")
    gone = index.documents(spark).join(live.select("key", "segment"), ["key", "segment"], "left_anti").withColumn("shard", F.pmod(F.xxhash64("key"), of(index.shards)))
    rows = index.postings(spark).select(to, "term", "segment", "keys", "len", "at")
    block = rows.groupBy("shard").cogroup(gone.select(to, "segment", "key").groupBy("shard")).applyInArrow(_joined, _ROW)
    _filed(block, shards, f"{path}/postings/segment=0")
    return TextIndex(path, index.key, index.column, 1, (shards,))


def _leaves(tree, ranked: bool = True) -> list[tuple]:
    if tree[0] in ("word", "prefix", "phrase"):
        return [(*tree, ranked)]
    return _leaves(tree[1], ranked) + _leaves(tree[2], ranked and tree[0] != "not")


def postings_of(index: TextIndex, spark: SparkSession, leaves: list[tuple]) -> DataFrame:
    """The postings of the leaves' terms: filters on buckets and terms, which the scan knows before it opens a file."""
    buckets, tests = set(), []
    for kind, w, _ in leaves:
        for one in w if kind == "phrase" else [w]:
            # A prefix shorter than the letters of a bucket may be in any.
            buckets |= set(range(BUCKETS)) if kind == "prefix" and len(one) < LETTERS else {bucket(one)}
            tests.append(F.col("term").startswith(one) if kind == "prefix" else F.col("term") == one)
    test = tests[0]
    for t in tests[1:]:
        test = test | t
    return index.postings(spark).where(F.col("bucket").isin(sorted(buckets)) & test)


def _found(index: TextIndex, spark: SparkSession, leaves: list[tuple]) -> DataFrame:
    """(key, len, tf0, tf1, ...): of every document with any of the leaves' terms, how often each leaf is met."""
    rows = _opened(postings_of(index, spark, leaves))
    if index.segments > 1:
        rows = rows.join(_valid(index, spark).select("key", "segment"), ["key", "segment"], "left_semi")
    phrases = sorted({x for kind, w, _ in leaves if kind == "phrase" for x in w})
    places = [F.flatten(F.collect_list(F.when(F.col("term") == x, F.col("at")))).alias(f"_at{i}") for i, x in enumerate(phrases)]
    once = lambda kind, w: F.sum(F.when(F.col("term") == w if kind == "word" else F.col("term").startswith(w), F.col("tf")).otherwise(0))
    counts = [once(kind, w).alias(f"tf{i}") for i, (kind, w, _) in enumerate(leaves) if kind != "phrase"]
    g = rows.groupBy("key").agg(F.max("len").alias("len"), *counts, *places)
    for i, x in enumerate(phrases):
        g = g.withColumn(f"_at{i}", _sums(F.col(f"_at{i}")))
    for i, (kind, w, _) in enumerate(leaves):
        if kind == "phrase":
            # A phrase starts where each of its words stands as far behind as in the phrase.
            starts = [_less(F.col(f"_at{phrases.index(x)}"), k) for k, x in enumerate(w)]
            both = starts[0]
            for s in starts[1:]:
                both = F.array_intersect(both, s)
            g = g.withColumn(f"tf{i}", F.size(both).cast("long"))
    return g.select("key", "len", *[f"tf{i}" for i in range(len(leaves))])


def search(index: TextIndex, spark: SparkSession, query: str, least_rank: float | None = None) -> DataFrame:
    """(key, rank): what fulltext.matched() gives, from the index; the rank is negated BM25, lower is better."""
    scope, tree = parsed(query)
    if scope and scope != [index.column]:
        raise ValueError(f"{scope} is not indexed")
    leaves = _leaves(tree)
    found = _found(index, spark, leaves)
    whole = _valid(index, spark).agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    stats = found.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(leaves))])
    at = iter(range(len(leaves)))

    def condition(node) -> Column:
        if node[0] in ("word", "prefix", "phrase"):
            return F.col(f"tf{next(at)}") > 0
        a, b = condition(node[1]), condition(node[2])
        return a | b if node[0] == "or" else a & (~b if node[0] == "not" else b)

    score = F.lit(0.0)
    for i, (_, _, ranked) in enumerate(leaves):
        if ranked:
            tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
            score = score + F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1) * tf * (K1 + 1) / (tf + (F.lit(1 - B) + F.col("len") / F.col("avg") * B) * K1)
    out = found.join(F.broadcast(whole)).join(F.broadcast(stats)).where(condition(tree)).select(F.col("key").alias(index.key), F.round(-score, 6).alias("rank"))
    return out if least_rank is None else out.where(F.col("rank") <= least_rank)
