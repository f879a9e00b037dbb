"""Benchmark decontamination: a BM25 index of test items, queried by every passage of every text.

The items are indexed: a posting holds a term's BM25 share of the item's score against itself, so scores run from 0 to 1 and
THRESHOLD means the same for every item. Items lie in blocks of BLOCK, in the order of their words; the index keeps, for
each term, its greatest share in any item and its greatest in each block. A passage is a window of twice an item's length
class, every such length apart, so each occurrence of an item lies whole in a passage.

Block-max WAND, on a batch of passages at once. The commonest terms, which together can give no block half the threshold, are
never opened; what they can give a block is its floor. Pivot: a passage whose other terms' greatest shares do not reach the threshold above the least
floor is passed over. For the others the shares by block are added up; a block is opened only where these and
its floor reach the threshold, and only there items are looked at. No item of sufficient score can be lost on the way. Those items are
scored in full, and all above the threshold are verified: 5-word shingles of the question (all but the last sentence) and
of the answer (the shingles that reach into the last sentence) must be in the passage, MIN_OVERLAP of all and half of each.

Items are broadcast in shards of at most SHARD_BYTES of text, whose number follows the benchmark's size; one pass over the
documents goes through SHARDS of them. Documents are never shuffled. Words are lower-cased (A-Z) and ASCII punctuation is a space.

Defined results: null and empty texts or items match nothing; an item of fewer than five words must occur whole. Rows that repeat an
id, or have none (of documents or items), are matched each. Further columns are not read by `matches` and kept by `clean`. An empty benchmark
or table of documents matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import batched, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of, utf8

K1, B = 1.2, 0.75
THRESHOLD = 0.5
MIN_OVERLAP = 0.8
PART_OVERLAP = 0.5
SHINGLE = 5
BLOCK = 16
SHARD_BYTES = 16 << 20
SHARDS = 8

_PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def shingles(words: list[bytes], n: int = SHINGLE) -> list[bytes]:
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


class Item:
    def __init__(self, item_id, text: bytes):
        self.id = item_id
        self.words = words_of(text)
        self.shingles = shingles(self.words)
        ends = [m.end() for m in re.finditer(rb"[.!?\n]+\s*", text) if words_of(text[m.end() :])]
        n_answer = len(words_of(text[ends[-1] :])) if ends else max(1, len(self.words) // 4)
        # Shingles that reach into the answer; where there is no other, they are the question too.
        k = max(1, min(len(self.shingles), n_answer))
        self.answer = set(self.shingles[-k:])
        self.question = set(self.shingles[:-k]) or self.answer

    def overlaps(self, found: set[bytes]) -> tuple[float, float, float]:
        """Shares of the shingles, the question's and the answer's that a passage has."""
        every = set(self.shingles)
        return len(every & found) / len(every), len(self.question & found) / len(self.question), len(self.answer & found) / len(self.answer)


class Index:
    """Items of one length class: postings in rows by term, bounds by block."""

    def __init__(self, items: list[Item], length: int):
        import numpy as np

        self.items, self.length = items, length
        n, avg = len(items), sum(len(x.words) for x in items) / len(items)
        df: dict[bytes, int] = {}
        for x in items:
            for t in set(x.words):
                df[t] = df.get(t, 0) + 1
        # Common terms first, so that the unopened ones are a prefix.
        terms = sorted(df, key=lambda t: (-df[t], t))
        self.term = {t: k for k, t in enumerate(terms)}
        idf = np.log(1 + (n - np.array([df[t] for t in terms]) + 0.5) / (np.array([df[t] for t in terms]) + 0.5))
        self.impact: list[dict[int, float]] = []
        for x in items:
            tf: dict[int, int] = {}
            for w in x.words:
                tf[self.term[w]] = tf.get(self.term[w], 0) + 1
            raw = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x.words) / avg)) for t, c in tf.items()}
            whole = sum(raw.values())
            self.impact.append({t: v / whole for t, v in raw.items()})
        rows = sorted((t, i, v) for i, d in enumerate(self.impact) for t, v in d.items())
        self.post_item = np.array([r[1] for r in rows], np.int64)
        self.post_value = np.array([r[2] for r in rows])
        self.post_at = np.searchsorted(np.array([r[0] for r in rows]), np.arange(len(terms) + 1))
        self.block = np.arange(n) // BLOCK
        self.blocks = int(self.block[-1]) + 1
        # Greatest shares: of a term in a block (rows by term, like the postings), and of a term anywhere.
        rows = np.repeat(np.arange(len(terms)), np.diff(self.post_at)) * self.blocks + self.block[self.post_item]
        order = np.argsort(rows, kind="stable")
        cell, first = np.unique(rows[order], return_index=True)
        self.top_value = np.maximum.reduceat(self.post_value[order], first)
        self.top_block = cell % self.blocks
        self.top_at = np.searchsorted(cell // self.blocks, np.arange(len(terms) + 1))
        self.top = np.maximum.reduceat(self.post_value, self.post_at[:-1])
        # The commonest terms stay unopened as long as no block can gain half the threshold from them.
        self.floor = np.zeros(self.blocks)
        self.first_open = 0
        for t in range(len(terms)):
            a, z = self.top_at[t], self.top_at[t + 1]
            more = self.floor.copy()
            more[self.top_block[a:z]] += self.top_value[a:z]
            if more.max() > THRESHOLD / 2:
                break
            self.floor, self.first_open = more, t + 1
        #: Of passages and of blocks: how many there were and how many were looked into.
        self.seen = {"passages": 0, "pivots": 0, "blocks": 0, "opened": 0}

    @staticmethod
    def _spread(at, some):
        """The rows of a table by term that belong to some terms, and which of these terms each belongs to."""
        import numpy as np

        n = at[some + 1] - at[some]
        of = np.repeat(np.arange(len(some)), n)
        return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[some], n), of

    def candidates(self, words: list[bytes], bounds):
        """(text, passage, item) that may reach the threshold, from all words of a batch of texts."""
        import numpy as np

        ids = np.fromiter(map(self.term.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        at = np.flatnonzero(ids >= self.first_open)
        if not len(at):
            return []
        text = np.searchsorted(bounds, at, side="right") - 1
        passages = np.maximum(1, -(-np.diff(bounds) // self.length))
        base = np.concatenate(([0], np.cumsum(passages)))
        k = (at - bounds[text]) // self.length
        here = base[text] + k
        before = k > 0
        passage = np.concatenate((here, here[before] - 1))
        term = np.concatenate((ids[at], ids[at][before]))
        enough = THRESHOLD - 1e-9
        self.seen["passages"] += int(base[-1])
        # Pivot, first with repeated words counted each time, which can only raise the sum.
        reach = np.bincount(passage, weights=self.top[term], minlength=int(base[-1]))
        on = reach[passage] + self.floor.max() >= enough
        key = np.unique(passage[on] * len(self.term) + term[on])
        passage, term = key // len(self.term), key % len(self.term)
        reach = np.bincount(passage, weights=self.top[term], minlength=int(base[-1]))
        on = reach[passage] + self.floor.max() >= enough
        passage, term = passage[on], term[on]
        self.seen["pivots"] += int((reach + self.floor.max() >= enough).sum())
        # Blocks: the sum of their terms' greatest shares.
        row, of = self._spread(self.top_at, term)
        cell, inverse = np.unique(passage[of] * self.blocks + self.top_block[row], return_inverse=True)
        most = np.bincount(inverse, weights=self.top_value[row], minlength=len(cell)) + self.floor[cell % self.blocks]
        opened = cell[most >= enough]
        self.seen["blocks"] += len(cell)
        self.seen["opened"] += len(opened)
        # Items of the opened blocks.
        on = np.isin(passage, opened // self.blocks)
        passage, term = passage[on], term[on]
        row, of = self._spread(self.post_at, term)
        passage, item = passage[of], self.post_item[row]
        on = np.isin(passage * self.blocks + self.block[item], opened)
        pair, inverse = np.unique(passage[on] * len(self.items) + item[on], return_inverse=True)
        total = np.bincount(inverse, weights=self.post_value[row[on]], minlength=len(pair))
        item = pair % len(self.items)
        on = total + self.floor[self.block[item]] >= enough
        passage = pair[on] // len(self.items)
        text = np.searchsorted(base, passage, side="right") - 1
        return zip(text.tolist(), (passage - base[text]).tolist(), item[on].tolist(), strict=True)

    def matches(self, words: list[bytes], bounds) -> dict[tuple[int, int], tuple[float, float, float, float]]:
        """(text, item) to the best passage's overlap, score, question's and answer's overlap."""
        out: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        seen: tuple[int, int] | None = None
        terms: set[int] = set()
        found: set[bytes] = set()
        for text, passage, item in self.candidates(words, bounds):
            if (text, passage) != seen:
                seen = (text, passage)
                a = int(bounds[text]) + passage * self.length
                part = words[a : min(a + 2 * self.length, int(bounds[text + 1]))]
                terms, found = {self.term[w] for w in part if w in self.term}, set()
            x = self.items[item]
            score = sum(v for t, v in self.impact[item].items() if t in terms)
            if score < THRESHOLD:
                continue
            if not found:
                for n in {SHINGLE} | {len(y.words) for y in self.items if len(y.words) < SHINGLE}:
                    found |= {b" ".join(part[i : i + n]) for i in range(len(part) - n + 1)}
            whole, question, answer = x.overlaps(found)
            if whole >= MIN_OVERLAP and question >= PART_OVERLAP and answer >= PART_OVERLAP:
                out[text, item] = max(out.get((text, item), (0.0, 0.0, 0.0, 0.0)), (whole, score, question, answer))
        return out


def indexes(rows: list[tuple]) -> list[Index]:
    """An index for each length class (powers of two, 32 words at least) of (item_id, text)."""
    by: dict[int, list[Item]] = {}
    for item_id, text in rows:
        x = Item(item_id, (text or "").encode())
        if x.words:
            by.setdefault(max(32, 1 << (len(x.words) - 1).bit_length()), []).append(x)
    return [Index(sorted(v, key=lambda x: x.words), n) for n, v in sorted(by.items())]


def _found(texts: list[bytes], made: list[Index]) -> list[tuple[int, Item, tuple]]:
    import numpy as np

    split = [words_of(t) for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in split], dtype=np.int64)))
    words = [w for x in split for w in x]
    return sorted(((t, x.items[i], m) for x in made for (t, i), m in x.matches(words, bounds).items()), key=lambda r: (r[0], str(r[1].id), r[1].words))


def _all(shards) -> list[Index]:
    return [x for made in shards for x in made.value]


def _matched(batches: Iterator[pa.RecordBatch], shards) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs = b.column(0).to_pylist()
        rows = [(docs[t], x.id, round(m[1], 6), m[0], m[2], m[3]) for t, x, m in _found(utf8(b.column(1)), _all(shards))]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.float64()] * 4), strict=True)],
            names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"],
        )


def _clean(batches: Iterator[pa.RecordBatch], shards, column: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bad = {t for t, _, _ in _found([t or b"" for t in utf8(b.column(column))], _all(shards))}
        yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))


def _passes(benchmark: DataFrame):
    """Lists of broadcast indexes of the items, for one pass over the documents each; an index has a bounded part of the benchmark."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of(benchmark).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // SHARD_BYTES + 1

    def shards():
        for k in range(n):
            part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # about SHARD_BYTES
            made = indexes([tuple(r) for r in part])
            if made:
                yield spark.sparkContext.broadcast(made)

    return batched(shards(), SHARDS)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): every text with every item it holds, by its best passage."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    out = None
    for shards in _passes(benchmark):
        one = map_batches(rows, partial(_matched, shards=shards), schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds no item, all columns as they were."""
    for shards in _passes(benchmark):
        docs = map_batches(docs, partial(_clean, shards=shards, column=docs.columns.index(text)), docs.schema)
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
