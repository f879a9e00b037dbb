"""Periodic runs of words: maximal stretches that repeat a period at least three times, by divide and conquer.

Words become numbers. A segment of a text is cut at its midpoint; the Z-functions of its halves give, for every distance at
once, how far the words right and left of the midpoint agree with those at that distance, and so every repetition that crosses
it; then both halves are cut in turn. A repetition that reaches a segment's end and goes on behind it was found whole at an
earlier midpoint and is left out here. Of equal intervals the smallest period stays.

A run that crosses a midpoint agrees with itself at its period over at least `agree(longest, times)` words beside it, so
midpoints next to which no such stretch of words occurs elsewhere in the segment are passed by without a Z-function.

Defined results: a null or empty text has no words and no runs, a null id counts as the empty text in the checksum; texts are
whole however long; repeated rows each give a row; ties go to the smallest start, then period; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of, utf8

#: Least words of a run, and least repeats of its period.
LEAST, TIMES = 24, 3
RUNS = "doc_id long, words array<binary>, runs array<struct<start: long, length: long, period: long>>"


def z_function(s: list[int]) -> np.ndarray:
    """For every place of a sequence, how many of its items from there on equal those from its start; the first counts all."""
    n = len(s)
    z = [0] * n
    z[0] = n
    l = r = 0  # noqa: E741
    for i in range(1, n):
        k = 0
        if i < r:
            k = z[i - l]
            if k < r - i:
                z[i] = k
                continue
            k = r - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > r:
            l, r = i, i + k  # noqa: E741
    return np.array(z, np.int64)


def agree(least: int, times: int) -> int:
    """A run has at least half its words, and so at least this many behind its first period, on one side of any cut."""
    return max(1, min(max(-(-least // 2), -(-times * q // 2)) - q for q in range(1, least + 1)))


def _grams(x: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the stretches of `size` words that start at each word; equal stretches have equal numbers."""
    g = x.astype(np.int64)
    for k in range(1, size):
        if len(g) < 2:
            return g[:0]
        g = np.unique(g[:-1] * (int(x.max()) + 1) + x[k:], return_inverse=True)[1]
    return g


def find_runs(x: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n, size = len(x), agree(least, times)
    if n < least:
        return []
    gram = _grams(x, size)
    order = np.argsort(gram, kind="stable")
    first = np.searchsorted(gram[order], np.arange(int(gram.max()) + 2))
    if int(np.diff(first).max()) < 2:
        return []
    words, found = x.tolist(), {}

    def meets(at: int, lo: int, hi: int) -> bool:
        """Whether the stretch that starts at a word also starts at one of lo to hi - 1."""
        if not 0 <= at < len(gram):
            return False
        here = order[first[gram[at]] : first[gram[at] + 1]]
        return len(here) > 1 and np.searchsorted(here, hi) > np.searchsorted(here, lo)

    def note(start: np.ndarray, end: np.ndarray, period: np.ndarray, l: int, r: int) -> None:  # noqa: E741
        for k in np.flatnonzero(end - start >= np.maximum(least, times * period)):
            s, e, q = int(start[k]), int(end[k]), int(period[k])
            before, behind = s > 0 and words[s - 1] == words[s - 1 + q], e < n and words[e] == words[e - q]
            if not before and not behind:
                found[s, e] = min(q, found.get((s, e), q))

    segments = [(0, n)]
    while segments:
        l, r = segments.pop()  # noqa: E741
        if r - l < max(least, 2):
            continue
        m = (l + r) // 2
        segments += [(l, m), (m, r)]
        right, left = meets(m, m + 1, r - size + 1), meets(m - size, l, m - size)
        if not right and not left:
            continue
        ahead, back = words[m:r], words[l:m][::-1]
        if right:  # the word at distance q to the right of the midpoint
            q = np.arange(1, r - m)
            fore = z_function(ahead)[q]
            z = z_function([*back, -1, *words[l:r][::-1]])
            aft = z[m - l + 1 + (r - m) - q]
            note(m - aft, m + q + fore, q, l, r)
        if left:
            q = np.arange(1, m - l)
            aft = z_function(back)[q]
            z = z_function([*ahead, -1, *words[l:r]])
            fore = z[r - m + 1 + (m - l) - q]
            note(m - q - aft, m + fore, q, l, r)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        gone[s + q] += 1
        gone[s + length] -= 1
    return [w for w, k in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not k]


def with_repeats(words: list[bytes], h: int) -> list[bytes]:
    """Every tenth text by its checksum gets a run of the length and period that the checksum says."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _numbers(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The words of several texts as numbers, each text an array."""
    flat = pa.array([w for t in texts for w in t], pa.binary())
    ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    return np.split(ids, np.cumsum([len(t) for t in texts])[:-1]) if texts else []


def _batches(batches: Iterator[pa.RecordBatch], planted: bool) -> Iterator[tuple[list, list[list[bytes]], list[list[tuple[int, int, int]]]]]:
    for b in batches:
        ids = b.column(0).to_pylist()
        texts = [t.split() for t in utf8(b.column(1))]
        if planted:
            texts = [with_repeats(t, zlib.crc32(b"" if i is None else str(i).encode())) for i, t in zip(ids, texts, strict=True)]
        yield ids, texts, [find_runs(x) for x in _numbers(texts)]


def _runs(batches: Iterator[pa.RecordBatch], planted: bool) -> Iterator[pa.RecordBatch]:
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for ids, texts, runs in _batches(batches, planted):
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.list_(pa.binary())), pa.array(rows, pa.list_(one))], names=["doc_id", "words", "runs"])


def _best(runs: list[tuple[int, int, int]]) -> tuple:
    """The run of greatest exact exponent, ties to the smallest start, then period."""
    best = None
    for s, n, q in runs:  # by start, then period
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])


_DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch], planted: bool) -> Iterator[pa.RecordBatch]:
    for ids, texts, runs in _batches(batches, planted):
        best = list(zip(*map(_best, runs), strict=True)) if runs else [()] * 4
        lines = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in runs]
        left = [hashlib.sha256(b" ".join(kept_words(t, r))).hexdigest() for t, r in zip(texts, runs, strict=True)]
        numbers = [pa.array(x, pa.int64()) for x in (ids, [len(r) for r in runs], *best)]
        yield pa.RecordBatch.from_arrays([*numbers, pa.array(lines, pa.string()), pa.array(left, pa.string())], names=[x.split()[0] for x in _DIGESTS.split(", ")])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))


def runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """(doc_id, words, runs) of every whole text; `planted` gives every tenth text a run of its own first."""
    return map_batches(_texts(docs), partial(_runs, planted=planted), RUNS)


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each text's words, those of a run only for its first period, joined by one space."""

    def f(batches):
        for ids, texts, found in _batches(batches, False):
            left = [b" ".join(kept_words(t, r)).decode() for t, r in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(left, pa.string())], names=["doc_id", "text"])

    return map_batches(_texts(docs), f, "doc_id long, text string")


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return map_batches(_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), partial(_digests, planted=True), _DIGESTS)
