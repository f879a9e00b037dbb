"""Quality classifier: hashed word n-grams, logistic regression trained with follow-the-regularised-leader updates.

Features of a text are counts of hashed n-grams of three kinds, scaled to length one: the words in lower case (1 and 2), the
shapes of tokens (1 to 3; a shape keeps case, digits and symbols and folds letters), and whether a token equals the one before
it (as part of the shape). A score is the logistic of a sparse dot product with the weights, 2^BITS of them at most.

Training sees at most MAX_TRAIN labels, those with the least hash of their id, in that order, and one text for each, so what is
learnt never depends on partitions; their features are made on the executors and one task runs the updates. Everything else is linear: each
document is scored alone with the broadcast weights.

Defined results: null and empty texts have no features and the score of the bias. Labels other than 0 and 1, null ids in
labels and labels without a document are left out; a document labelled twice is used once for each of its labels, and of rows
that repeat an id the least text. Labels of equal hash go by id and label. Without any training row every score is 0.5.
Repeated rows are scored each; very long texts are read whole; further columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, remainder, text_of, utf8

BITS = 18
#: The bound on labelled rows used in training.
MAX_TRAIN = 4096
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
THRESHOLD = 0.7

_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0d]+")
_FOLD = bytes.maketrans(bytes(range(256)), bytes(ord("d") if 48 <= c <= 57 else ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 or c == 95 else c for c in range(256)))


class _Tokens(dict):
    """Token to a small number; by number, hashes of the lower-case word and of the shape."""

    def __init__(self):
        super().__init__()
        self.words, self.shapes = array("Q"), array("Q")

    def __missing__(self, token: bytes) -> int:
        import xxhash

        k = self[token] = len(self.words)
        shape = re.sub(rb"(.)\1{2,}", rb"\1\1", token.translate(_FOLD))
        self.words.append(xxhash.xxh64_intdigest(token.lower(), 1))
        self.shapes.append(xxhash.xxh64_intdigest(shape, 2))
        return k

    def of(self, tokens: list[bytes]):
        import numpy as np

        if len(self) > 500_000:
            self.clear()
            self.words, self.shapes = array("Q"), array("Q")
        ids = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        return ids, np.frombuffer(self.words, dtype=np.uint64)[ids], np.frombuffer(self.shapes, dtype=np.uint64)[ids]


def _mix(h):
    import numpy as np

    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def features(text: bytes, known: _Tokens, bits: int = BITS):
    """(indices, values) of a text: distinct hashed n-grams and their share, as a vector of length one."""
    import numpy as np

    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    ids, word, shape = known.of(tokens)
    shape[1:] += np.uint64(0x51ED270B0) * (ids[1:] == ids[:-1]).astype(np.uint64)
    a, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    grams = [word, _mix(word[:-1] * a + word[1:]), shape, _mix(shape[:-1] * a + shape[1:]), _mix(shape[:-2] * c + shape[1:-1] * a + shape[2:])]
    at = np.concatenate([_mix(g + np.uint64(k)) for k, g in enumerate(grams)]) >> np.uint64(64 - bits)
    idx, n = np.unique(at.astype(np.int64), return_counts=True)
    n = np.sqrt(n)  # common n-grams of a long text do not drown the others
    return idx, n / np.sqrt((n * n).sum())


def _featured(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    known = _Tokens()
    for b in batches:
        rows = [features(t, known, bits) for t in utf8(b.column(3))]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:3], pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))],
            names=["at", "id", "y", "idx", "val"],
        )


def ftrl(rows, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
    """Weights of a logistic regression by per-coordinate FTRL-proximal updates over (indices, values, label); the last one is the bias."""
    import numpy as np

    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rows = [(np.append(i, size - 1), np.append(v, 0.3), y) for i, v, y in rows]
    for _ in range(epochs):
        for i, v, y in rows:
            w = weight(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / alpha * w
            n[i] += g2
    every = np.arange(size)
    return weight(every)


def _trained(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    rows = []
    for b in batches:
        idx, val = b.column(3), b.column(4)
        for k, (at, i, y) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
            rows.append(((at, i, y), idx[k].values.to_numpy(zero_copy_only=False).astype(np.int64), val[k].values.to_numpy(zero_copy_only=False).astype(np.float64), y))
    rows.sort(key=lambda r: r[0])
    w = ftrl([r[1:] for r in rows], bits) if rows else np.zeros(0)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["idx", "w"])


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_train: int = MAX_TRAIN):
    """The weights (numpy, 2^bits + 1) learnt from at most max_train labelled rows outside the held-out quarter."""
    import numpy as np

    y = F.col("quality").cast("int")
    chosen = labels.select(F.col("doc_id").cast("long").alias("id"), y.alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    chosen = chosen.filter(remainder(F.col("id"), 4) != 2).withColumn("at", F.xxhash64("id", "y"))
    chosen = chosen.distinct().orderBy("at", "id", "y").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_of(docs).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("at", "id", "y").agg(F.min("text").alias("text"))  # max_train rows of 20 bytes
    made = map_batches(rows, partial(_featured, bits=bits), "at long, id long, y int, idx array<int>, val array<float>")
    got = map_batches(made.repartition(1), partial(_trained, bits=bits), "idx long, w double").collect()  # at most 2^bits + 1 rows
    w = np.zeros((1 << bits) + 1)
    for r in got:
        w[r["idx"]] = r["w"]
    return w


def _scored(batches: Iterator[pa.RecordBatch], weights, bits: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    w, known = weights.value, _Tokens()
    for b in batches:
        dots = []
        for t in utf8(b.column(2)):
            i, v = features(t, known, bits)
            dots.append(w[i] @ v + 0.3 * w[-1])
        score = 1.0 / (1.0 + np.exp(-np.clip(np.array(dots, dtype=float), -35, 35)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def scored(docs: DataFrame, weights, bits: int = BITS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(docs["doc_id"], 4) == 2).alias("held_out"), text_of(docs).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits doubles
    return map_batches(rows, partial(_scored, weights=shared, bits=bits), "doc_id long, held_out boolean, score double, predicted int")


def op1_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, train(docs, labels))
