"""Approximate neighbours: an inverted file of product-quantised residuals, stored by list and searched by probing lists.

Coarse centroids and code books are fitted on SAMPLE rows at most, those with the least hash of their id, so every part of the
table is drawn from; every row is then indexed. A row lies in the partition of its nearest centroid, as one byte for each few
dimensions of what it differs by. A search reads only the lists nearest to its queries (partition pruning), ranks a list's rows by
the codes, and decides the best of them on the vectors themselves, in the task that has the list: a task has several small lists,
and gives its few nearest rows a query. How many lists it takes is measured when the index is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import written_by

#: Rows that centroids and code books are fitted on; dimensions of a code byte.
SAMPLE, SUB = 65_536, 4
#: Rows and queries that one task compares.
LIST_ROWS, LIST_QUERIES = 65_536, 16_384
#: Candidates of a list decided on their vectors, for each neighbour asked for; share of true neighbours that the probed lists must hold.
RERANK, RECALL = 40, 0.93


class Index(NamedTuple):
    """Where the codes lie, and the model: centroids, code books, shards that a list's rows are dealt in and the first of them, lists to probe."""

    path: str
    centroids: np.ndarray
    books: np.ndarray
    parts: np.ndarray
    first: np.ndarray
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def _means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k centres of a sample; one that nothing is near goes to the row worst served."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        far = (c * c).sum(1)[None, :] - 2 * x @ c.T
        of = far.argmin(1)
        n = np.bincount(of, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        for empty, row in zip(np.flatnonzero(n == 0), np.argsort(-far.min(1)), strict=False):
            c[empty] = x[row]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


def _coded(residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.stack([_nearest(residual[:, k * SUB : (k + 1) * SUB], b) for k, b in enumerate(books)], axis=1).astype(np.uint8)


def _decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([b[codes[:, k]] for k, b in enumerate(books)], axis=1)


def _units(column: pa.Array, width: int | None = None) -> np.ndarray:
    x = np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
    return x if width is None or x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def built(vectors: DataFrame, lists: int | None = None, k: int = 10, recall: float = RECALL) -> Index:
    """An index of (vec_id, v); rows without a vector are left out, v must have one length."""
    spark = vectors.sparkSession
    rows = vectors.where("v IS NOT NULL").select("vec_id", "v")
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    if not n:
        raise ValueError("no vectors to index")
    x = _units(drawn.column("v").combine_chunks())
    width = -(-x.shape[1] // SUB) * SUB
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    lists = min(len(x), lists or max(1, min(int(n**0.5), len(x) // 32)))
    centroids = _means(x, lists)
    of = _nearest(x, centroids)
    rest = x - centroids[of]
    books = np.stack([_means(rest[:, a : a + SUB], min(256, len(x))) for a in range(0, width, SUB)])

    # Lists to probe: the fewest with the wanted share of the sample's own neighbours.
    asked = x[:: max(1, len(x) // 256)]
    near = np.argsort(-(asked @ x.T), axis=1)[:, 1 : k + 1]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    at = place[np.arange(len(asked))[:, None], of[near]]
    probes = int(np.quantile(at, recall, method="higher")) + 1 if at.size else 1

    model = spark.sparkContext.broadcast((centroids, books))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, b = model.value
        for batch in batches:
            if batch.num_rows:
                u = _units(batch.column(1), width)
                home = _nearest(u, c)
                codes = _coded(u - c[home], b)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(home.astype(np.int32))], names=["vec_id", "v", "codes", "list"])

    kind = rows.schema["v"].dataType.simpleString()
    table = rows.mapInArrow(coded, f"vec_id long, v {kind}, codes binary, list int")
    # Dealt by range: a list that holds many rows is several files, a task writes few lists.
    path = written_by(table.repartitionByRange("list", "vec_id"), "vector-lists", "list")
    sizes = {r["list"]: r["n"] for r in spark.read.parquet(path).groupBy("list").agg(F.count("*").alias("n")).collect()}
    return Index(path, centroids, books, *shards(np.array([sizes.get(i, 0) for i in range(lists)])), min(probes, lists))


def shards(sizes: np.ndarray, most: int = LIST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Of each list in how many shards its rows are dealt, and the first of them: small lists share one, a large one has several."""
    parts, first, at, held = sizes // most + 1, [], 0, 0
    for n, p in zip(sizes.tolist(), parts.tolist(), strict=True):
        if held and held + n > most:
            at, held = at + 1, 0
        first.append(at)
        at, held = (at + p, 0) if p > 1 else (at, held + n)
    return parts, np.array(first)


def _best(qids: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first rows of each query, by similarity and then by id."""
    order = np.lexsort((ids, -sim, qids))
    q = qids[order]
    few = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
    return qids[few], ids[few], sim[few]


def search(spark: SparkSession, index: Index, queries: DataFrame, k: int, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """(qid, vec_id, sim, rank): of each query (qid, q) the k nearest rows that its lists hold, itself left out; ties by id."""
    probes = min(probes or index.probes, len(index.centroids))
    most, width = rerank * k, index.centroids.shape[1]
    asked = queries.where("q IS NOT NULL").select(F.col("qid").cast("long").alias("qid"), V.normalized(F.col("q").cast("array<double>")).alias("u"))
    model = spark.sparkContext.broadcast(index)

    def near_lists(u: pa.Array) -> np.ndarray:
        return np.argsort(-(_units(u, width) @ model.value.centroids.T), axis=1, kind="stable")[:, :probes]

    def wanted_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(near_lists(batch.column(1))).astype(np.int32))], names=["list"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                batch, row, shard, lists = whole.slice(a, 64), [], [], []
                for k, one in enumerate(near_lists(batch.column(1))):
                    each = np.repeat(one, m.parts[one])
                    of = m.first[each] + np.concatenate([np.arange(p) for p in m.parts[one]])
                    order = np.argsort(of, kind="stable")
                    which, at = np.unique(of[order], return_index=True)
                    row += [k] * len(which)
                    shard += which.tolist()
                    lists += np.split(each[order].astype(np.int32), at[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(shard, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["qid", "u", "shard", "lists"])

    blocks = asked.count() // LIST_QUERIES + 1
    asks = asked.mapInArrow(probed, "qid long, u array<double>, shard int, lists array<int>").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    rows = index.rows(spark)
    if probes < len(index.centroids):
        # Which lists are asked for at all: at most as many as there are centroids. Others' files are not opened.
        rows = rows.where(F.col("list").isin([r["list"] for r in asked.mapInArrow(wanted_lists, "list int").distinct().collect()]))
    of_list = lambda x: F.element_at(F.lit(x.tolist()), F.col("list") + 1)
    shard = (of_list(index.first) + F.pmod(F.xxhash64("vec_id"), of_list(index.parts))).cast("int")
    mine = rows.select("vec_id", "codes", "list", V.normalized(F.col("v").cast("array<double>")).alias("u"), shard.alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        m = model.value
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        out = [none]
        if left.num_rows and right.num_rows:
            left = left.sort_by([("list", "ascending"), ("vec_id", "ascending")])
            homes, start = np.unique(left.column("list").to_numpy(), return_index=True)
            ids, qids = left.column("vec_id").to_numpy(), right.column("qid").to_numpy()
            x, codes, u = np.stack(left.column("u").to_numpy()), left.column("codes"), np.stack(right.column("u").to_numpy())
            asking = np.zeros((len(qids), len(m.centroids)), bool)
            lists = right.column("lists").combine_chunks()
            asking[np.repeat(np.arange(len(qids)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
            for a in range(0, len(qids), 1024):
                found = [none]
                for home, i, j in zip(homes.tolist(), start.tolist(), [*start[1:].tolist(), len(ids)], strict=True):
                    those = a + np.flatnonzero(asking[a : a + 1024, home])
                    some = max(1, (1 << 21) // (j - i))
                    rough = None
                    if j - i > most:
                        own = np.frombuffer(b"".join(codes.slice(i, j - i).to_pylist()), np.uint8).reshape(j - i, -1)
                        rough = (_decoded(own, m.books) + m.centroids[home])[:, : x.shape[1]]
                    for b in range(0, len(those), some):
                        q = those[b : b + some]
                        sim = np.round(u[q] @ x[i:j].T, 6)
                        sim[qids[q][:, None] == ids[i:j]] = -np.inf
                        if rough is not None:  # those that the codes put last are not candidates
                            near = u[q].astype(np.float32) @ rough.T
                            near[np.isinf(sim)] = -np.inf
                            np.put_along_axis(sim, np.argpartition(-near, most, axis=1)[:, most:], -np.inf, axis=1)
                        if sim.shape[1] > k:
                            sim[sim < np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k, None]] = -np.inf
                        r, c = np.nonzero(np.isfinite(sim))
                        found.append(_best(qids[q][r], ids[i:j][c], sim[r, c], k))
                out.append(_best(*(np.concatenate(f) for f in zip(*found, strict=True)), k))
        return pa.table({name: np.concatenate(f) for name, f in zip(("qid", "vec_id", "sim"), zip(*out, strict=True), strict=True)})

    near = mine.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(ranked, "qid long, vec_id long, sim double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "vec_id"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(queries, asked, found): how many of the true neighbours (qid, vec_id) were found."""
    j = truth.select("qid", "vec_id").join(found.select("qid", "vec_id", F.lit(1).alias("_f")), ["qid", "vec_id"], "left")
    return j.agg(F.count_distinct("qid").alias("queries"), F.count("*").alias("asked"), F.count("_f").alias("found"))
