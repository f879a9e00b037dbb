"""Near-duplicate documents by SimHash: pigeonhole blocks, a join on blocks, Hamming distance verified.

A fingerprint has 64 bits in four blocks of 16. Two fingerprints at distance 2 or less differ in two blocks at most, so they
share two blocks of the four; each fingerprint goes under its six pairs of blocks. Fingerprints, not documents, are joined:
copies share one. In a pair of blocks shared by more than BUCKET fingerprints no pairs are made: there a fingerprint meets
others at the values one flipped bit away, and any two that meet are at distance 2 or less, in links that grow with the bucket.
Rows of a fingerprint or a block key with a large share of all are not dealt by it: the one row they meet is broadcast.

Defined results: null and empty texts have fingerprint zero and are linked like any other; a text of fewer words than a
shingle has one shingle, all its words. Rows that repeat an id are linked by their fingerprints like other rows. A null id is
kept, and is a component's id only where the component has no other. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, dropped, hot_keys, joined, map_batches, text_of, utf8, written
from .graph import components

SHINGLE = 3
DISTANCE = 2
BUCKET = 64
BLOCK_BITS = 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text in UTF-8; repeated shingles count as often as they occur."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and the six ASCII spaces
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    joined = b" ".join(words)
    starts = [0, *(e + 1 for e in ends[:-1])]
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = [fingerprint(t, shingle) for t in utf8(b.column(1))]
        signed = pa.array([x - (1 << 64) if x >> 63 else x for x in fp], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), signed], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text, as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return map_batches(rows, partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def links(values: DataFrame, bucket: int = BUCKET, hot: int = HOT_ROWS) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that connect all pairs at distance 2 or less, each pair itself within it."""
    keys = []
    for t, (i, j) in enumerate(combinations(range(64 // BLOCK_BITS), 2)):
        part = lambda k: F.shiftrightunsigned("fp", k * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1)
        key = F.shiftleft(F.lit(t).cast("long"), 2 * BLOCK_BITS) + F.shiftleft(part(i), BLOCK_BITS) + part(j)
        fixed = sum(((1 << BLOCK_BITS) - 1) << (k * BLOCK_BITS) for k in (i, j))
        free = [k for k in range(64) if not fixed >> k & 1]
        keys.append((key, [(1 << k) - (1 << 64) if k == 63 else 1 << k for k in free]))
    blocks = values.select("fp", F.posexplode(F.array(*[k for k, _ in keys])).alias("t", "key"))
    sizes = written(blocks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    sized = joined(blocks, sizes, "key", hot_keys(sizes, "key", sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], hot))
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= DISTANCE
    # Small buckets: every pair inside, at most bucket^2 / 2 of them, verified before it becomes a row.
    groups = sized.filter(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("f"))
    pairs = F.flatten(F.transform("f", lambda x, i: F.transform(F.filter(F.slice(F.col("f"), F.lit(1), i), lambda y: near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    small = groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    # Large buckets: each member goes to itself and to the values one flipped free bit away; at most 33 members meet there.
    flips = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in f]) for _, f in keys]), F.col("t") + 1)
    hubs = sized.filter(F.col("n") > bucket).select("fp", F.explode(F.concat(F.array("fp"), F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x)))).alias("hub"))
    met = hubs.groupBy("hub").agg(F.collect_set("fp").alias("f")).filter(F.size("f") > 1)
    large = met.select(F.element_at("f", 1).alias("a"), F.explode(F.slice("f", F.lit(2), F.size("f"))).alias("b")).filter(near(F.col("a"), F.col("b")))
    return small.unionByName(large).distinct()


def grouped(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET, hot: int = HOT_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id reachable over links."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    values = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "values")
    near = written(links(values.select("fp"), bucket, hot), "links")
    roots = components(near, hot)
    of = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(of.join(least, "root").select("fp", "component_id"), "components")
    frequent = hot_keys(values, "fp", values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], hot)
    dropped(near, roots, values)
    return joined(fps, named, "fp", frequent).select("doc_id", "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
