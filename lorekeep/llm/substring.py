"""Exact removal of repeated passages: 20-word windows dealt out as super-k-mers.

A window is 20 consecutive words of one document. Its minimiser is the least hash among the 18 word triples in it, so equal
windows have equal minimisers. Consecutive windows with one minimiser travel as one packed string (their words, joined by a
space) to the minimiser's bucket; there the windows of a minimiser are sorted, and all but the first of each run of equal
ones, in the order of (doc_id, start), are marked. The words under marked windows go. Strings travel in compressed blocks, one
for each bucket from some ten megabytes of text.

Skew: equal packed strings of one task are combined before they travel: all but the earliest are marked on the spot, as every
window in them starts earlier too. So a passage of a third of all documents reaches its bucket once a task. A minimiser
that many different strings share (the edge of such a passage, a boilerplate phrase) is found by a first pass over all
documents, which counts minimisers; windows of those few go one by one, by the hash of their own words, which spreads them.
The first pass also tells how many strings there are, and so how many buckets, some BUCKET_STRINGS in each. Should a bucket
still hold more than MOST_STRINGS, its task keeps none of them but sends their windows on, each by its own hash, to a
second round. Which way a window goes changes the route only, never the result.

Defined results: a null text has no words (n_words 0, kept_sha256 of the empty text). A document is an id with a text: rows that
repeat both are one document, and words marked in one are marked in all at the same places; rows that share an id (or have
none) but differ in their texts are documents of their own, in the order of a hash of the text. A null id sorts first. Texts
shorter than a window stay whole. Further columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_batches, text_of, utf8, written

WINDOW = 20
GRAM = 3
#: A minimiser with more than this share of all packed strings goes by windows; at most HOT_PARTS of them can.
HOT_PARTS = 2000
#: Packed strings that a task holds to combine equal ones.
HELD = 200_000
#: Packed strings meant for a bucket, and the most that a task looks at together.
BUCKET_STRINGS = 50_000
MOST_STRINGS = 400_000
PLACE = "doc long, tag long, at int, upto int"
NO_ID = -(1 << 63)


class _Words(dict):
    """Word to a small number, and by number the word's 64-bit hash; computed once a task."""

    def __init__(self):
        super().__init__()
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        import xxhash

        k = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, 7))
        return k

    def hashed(self, words: list[bytes]):
        import numpy as np

        if len(self) > 1_000_000:
            self.__init__()
            self.clear()
        ids = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return np.frombuffer(self.hashes, dtype=np.uint64)[ids] if len(words) else np.zeros(0, np.uint64)


def _runs(texts: list[bytes], known: _Words, window: int, gram: int):
    """Of a batch of texts: all words, the first word of each text, gram hashes, and runs of windows with one minimiser.

    A run is (first window, windows, minimiser, text); windows do not cross texts.
    """
    import numpy as np

    split = [t.split() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in split], dtype=np.int64)))
    words = [w for x in split for w in x]
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < window:
        return words, bounds, np.zeros(0, np.uint64), (none, none, np.zeros(0, np.uint64), none)
    h = known.hashed(words)
    g = h[: n - gram + 1].copy()
    for k in range(1, gram):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g ^= h[k : n - gram + 1 + k]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    m, size, w = g, 1, window - gram + 1
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[: len(g) - w + 1], m[w - size : len(g) - size + 1])
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    whole = text[: n - window + 1] == text[window - 1 :]
    cut = np.ones(len(m), dtype=bool)
    cut[1:] = (m[1:] != m[:-1]) | (text[1 : len(m)] != text[: len(m) - 1]) | (whole[1:] != whole[:-1])
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.concatenate((starts, [len(m)])))
    real = whole[starts]
    starts, lengths = starts[real], lengths[real]
    return words, bounds, g, (starts, lengths, m[starts], text[starts])


def _count_minimisers(batches: Iterator[pa.RecordBatch], window: int, gram: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(least, n, total): minimisers with a marked share of this task's distinct packed strings."""
    import numpy as np

    known, found, total = _Words(), [], 0

    def counted():
        a = np.unique(np.concatenate(found).view("u8,u8"))
        keys, n = np.unique(a["f0"], return_counts=True)
        often = n >= max(2, len(a) // (4 * parts))
        keys, n = keys[often].view(np.int64), n[often]
        return pa.RecordBatch.from_arrays([pa.array([0, *keys.tolist()]), pa.array([0, *n.tolist()]), pa.array([len(a)] + [0] * len(n))], names=["least", "n", "total"])

    for b in batches:
        _, _, g, (starts, n, least, _) = _runs(utf8(b.column(0)), known, window, gram)
        if len(starts):
            ends = g[starts + n + window - gram - 1]
            found.append(np.stack([least, g[starts] * np.uint64(31) + ends * np.uint64(17) + n.astype(np.uint64)], axis=1))
            total += len(starts)
        if total > 500_000:
            yield counted()
            found, total = [], 0
    if found:
        yield counted()


def hot_minimisers(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, parts: int = HOT_PARTS) -> tuple[list[int], int]:
    """Minimisers with at least 1/parts of all packed strings: fewer than 2 * parts of them, whatever the input; and the number of strings."""
    counts = map_batches(docs.select(text_of(docs).alias("text")), partial(_count_minimisers, window=window, gram=gram, parts=parts), "least long, n long, total long")
    by = counts.groupBy("least").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    by = written(by.filter("n >= 64 or total > 0"), "minimisers")
    total = by.agg(F.sum("total")).first()[0] or 0
    hot = by.filter(F.col("n") >= max(64, total // parts)).select("least").collect()
    dropped(by)
    return sorted(r[0] for r in hot), total


def _packed(rows: list[tuple[int, bytes, tuple[int, int], int, int]]) -> bytes:
    """Rows (key, words, (doc, tag), start, n) by column, compressed: a block for one bucket."""
    import numpy as np
    import zstandard

    rows.sort()
    key, words, doc, start, n = zip(*rows, strict=True)
    head = np.array([len(rows)], "<i8").tobytes() + b"".join(np.array([d[k] for d in doc], "<i8").tobytes() for k in (0, 1))
    head += b"".join(np.array(x, "<i4").tobytes() for x in (start, n, [len(w) for w in words]))
    # 32 bits of a key sort the rows of a bucket; should two keys share them, their windows are merely sorted together.
    keys = (np.array(key, np.uint64) >> np.uint64(32)).astype("<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + keys + b"".join(words))


def _unpacked(block: bytes):
    """(keys, docs, tags, starts, n, word offsets, bytes) of a block."""
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    doc, tag = (np.frombuffer(raw, "<i8", k, 8 + 8 * k * i) for i in range(2))
    start, n, size = (np.frombuffer(raw, "<i4", k, 8 + 16 * k + 4 * k * i) for i in range(3))
    key = np.frombuffer(raw, "<u4", k, 8 + 28 * k)
    return key, doc, tag, start, n, 8 + 32 * k + np.concatenate(([0], np.cumsum(size, dtype=np.int64))), raw


class _Outgoing:
    """Strings on their way to buckets: of equal ones the earliest goes, the others are marked."""

    def __init__(self, buckets: int, window: int):
        self.buckets, self.window = buckets, window
        self.first: dict[bytes, tuple] = {}
        self.marked: list[tuple[tuple[int, int], int, int]] = []

    def __len__(self) -> int:
        return len(self.first) + len(self.marked)

    def put(self, key: int, packed: bytes, doc: tuple[int, int], start: int, n: int) -> None:
        at = self.first.get(packed)
        if at is None:
            self.first[packed] = (key, doc, start, n)
        elif (doc, start) < at[1:3]:
            self.first[packed] = (key, doc, start, n)
            self.marked.append((at[1], at[2], abs(n)))
        elif (doc, start) > at[1:3]:
            self.marked.append((doc, start, abs(n)))

    def put_windows(self, words: list[bytes], doc: tuple[int, int], start: int) -> None:
        """Every window of a run of words by its own hash."""
        import xxhash

        for i in range(len(words) - self.window + 1):
            one = b" ".join(words[i : i + self.window])
            self.put(xxhash.xxh64_intdigest(one, 11), one, doc, start + i, 1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, block, doc, tag, at, upto): a block of strings for a bucket, or words marked."""
        by: dict[int, list] = defaultdict(list)
        for p, (key, d, s, n) in self.first.items():
            by[key % self.buckets].append((key, p, d, s, n))
        self.first.clear()
        spans: list[list] = []
        for d, s, n in sorted(self.marked):
            if spans and spans[-1][0] == d and spans[-1][1] + spans[-1][2] >= s:
                spans[-1][2] = max(spans[-1][2], s + n - spans[-1][1])
            else:
                spans.append([d, s, n])
        self.marked.clear()
        out = [(k, _packed(by.pop(k)), None, None, None, None) for k in sorted(by)]
        out += [((d[0] ^ d[0] >> 32) % self.buckets, None, *d, s, s + n + self.window - 1) for d, s, n in spans]
        if out:
            types = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "block", "doc", "tag", "at", "upto"])


def _super_kmers(batches: Iterator[pa.RecordBatch], hot: list[int], window: int, gram: int, held: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of _Outgoing from rows (doc_id, tag, text); a string has n windows from `start` on, -n if it may hold equal ones."""
    import numpy as np

    known, out = _Words(), _Outgoing(buckets, window)
    hot_set = np.array(hot, dtype=np.int64).view(np.uint64)
    for b in batches:
        docs = [(NO_ID if d is None else d, t) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        words, bounds, g, (starts, lengths, least, text) = _runs(utf8(b.column(2)), known, window, gram)
        if not len(starts):
            continue
        # Equal windows in one packed string are less than a window apart: some gram occurs twice in that distance.
        again = np.zeros(len(g) + 1, dtype=np.int64)
        for k in range(1, min(window - gram + 1, len(g))):
            again[1:][: len(g) - k] |= g[k:] == g[:-k]
        again = np.cumsum(again)
        twice = (again[starts + lengths + window - gram] > again[starts]) | (lengths > window - gram + 1)
        is_hot = np.isin(least, hot_set) if len(hot_set) else np.zeros(len(starts), bool)
        for s, n, key, t, o, tw, ho in zip(starts.tolist(), lengths.tolist(), least.tolist(), text.tolist(), (starts - bounds[text]).tolist(), twice.tolist(), is_hot.tolist(), strict=True):
            if ho:
                out.put_windows(words[s : s + n + window - 1], docs[t], o)
            else:
                out.put(key, b" ".join(words[s : s + n + window - 1]), docs[t], o, -n if tw else n)
        if len(out) > held:
            yield from out.rows()
    yield from out.rows()


def _marked(group: list[tuple], window: int) -> list[tuple[tuple[int, int], int, int]]:
    """Windows of one bucket key that equal an earlier one, as (doc, start, n)."""
    every = []
    for packed, doc, start, n in group:
        w = packed.split()
        every += [(b" ".join(w[i : i + window]), doc, start + i) for i in range(abs(n))]
    every.sort()
    late = sorted(_later_equal(every))
    out: list[tuple] = []
    for d, s in late:
        if out and out[-1][0] == d and out[-1][1] + out[-1][2] == s:
            out[-1] = (d, out[-1][1], out[-1][2] + 1)
        else:
            out.append((d, s, 1))
    return out


def _later_equal(every: list[tuple]) -> set[tuple]:
    """Of sorted (words, doc, start): the places of each run of equal words, but for its first place."""
    out, head = set(), None
    for w, d, s in every:
        if head is None or head[0] != w:
            head = (w, d, s)
        elif (d, s) != head[1:]:
            out.add((d, s))
    return out


def _repeats_in(parts: list[tuple], window: int) -> list[tuple[tuple[int, int], int, int]]:
    """Windows of one bucket that equal an earlier one, as (doc, start, n)."""
    import numpy as np

    key, doc, tag, start, n = (np.concatenate([p[k] for p in parts]) for k in range(5))
    at = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    order = np.argsort(key, kind="stable")
    ks = key[order]
    edge = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1])))
    size = np.diff(np.concatenate((edge, [len(ks)])))
    out = []
    # A string alone under its key, without equal windows in itself, needs no look.
    for a, k in zip(*(x[(size > 1) | (n[order[edge]] < 0)].tolist() for x in (edge, size)), strict=True):
        group = []
        for i in order[a : a + k].tolist():
            p = int(np.searchsorted(at, i, side="right")) - 1
            off, raw = parts[p][5], parts[p][6]
            j = i - int(at[p])
            group.append((raw[off[j] : off[j + 1]], (int(doc[i]), int(tag[i])), int(start[i]), int(n[i])))
        out += _marked(group, window)
    return out


def _sorted_buckets(batches: Iterator[pa.RecordBatch], window: int, most: int, held: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket, which may span batches: marked places, and blocks of windows of buckets beyond `most` strings."""
    bucket, parts, size = None, [], 0
    over = _Outgoing(buckets, window)

    def places(found) -> pa.RecordBatch:
        k = len(found)
        cols = [pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())]
        cols += [pa.array([f[0][i] for f in found], pa.int64()) for i in range(2)]
        cols += [pa.array([f[1] for f in found], pa.int32()), pa.array([f[1] + f[2] + window - 1 for f in found], pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["bucket", "block", "doc", "tag", "at", "upto"])

    def sent_on(some: list[tuple]) -> Iterator[pa.RecordBatch]:
        for _, doc, tag, start, n, off, raw in some:
            for i in range(len(n)):
                over.put_windows(raw[off[i] : off[i + 1]].split(), (int(doc[i]), int(tag[i])), int(start[i]))
                if len(over) > held:
                    yield from over.rows()

    for b in batches:
        here = b.filter(b.column(1).is_null())
        if here.num_rows:
            yield here
        sent = b.filter(b.column(1).is_valid())
        for k, block in zip(sent.column(0).to_pylist(), sent.column(1).to_pylist(), strict=True):
            if k != bucket and parts:
                yield places(_repeats_in(parts, window))
            if k != bucket:
                bucket, parts, size = k, [], 0
            parts.append(_unpacked(block))
            size += len(parts[-1][0])
            if size > most:
                yield from sent_on(parts)
                parts = []
    if parts:
        yield places(_repeats_in(parts, window))
    yield from over.rows()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, kept) from (doc_id, text, places)."""
    for b in batches:
        rows = []
        for doc, t, places in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
            words = t.split()
            if not places:
                rows.append((doc, len(words), 0, b" ".join(words)))
                continue
            gone = [0] * (len(words) + 1)
            for p in places:
                gone[p["at"]] += 1
                gone[min(p["upto"], len(words))] -= 1
            left = [w for w, c in zip(words, accumulate(gone), strict=False) if not c]
            rows.append((doc, len(words), len(words) - len(left), b" ".join(left)))
        doc, n, r, k = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _kept_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _kept(batches):
        digest = [hashlib.sha256(x).hexdigest() for x in utf8(b.column(3))]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): a row's document is its id and tag, a hash of the text; 0 where every id is there once and so tells enough."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    alone = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()
    return rows.select("doc_id", (F.lit(0).cast("long") if alone else F.xxhash64("text")).alias("tag"), "text")


def marked_places(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, held: int = HELD, parts: int = HOT_PARTS, most: int = MOST_STRINGS) -> DataFrame:
    """(doc, tag, at, upto): word places of rows (doc_id, tag, text) under windows that start earlier elsewhere; a null id is NO_ID."""
    schema = f"bucket int, block binary, {PLACE}"
    hot, total = hot_minimisers(rows, window, gram, parts)
    buckets = max(8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_STRINGS + 1)
    sent = map_batches(rows, partial(_super_kmers, hot=hot, window=window, gram=gram, held=held, buckets=buckets), schema)
    look = partial(_sorted_buckets, window=window, held=held, buckets=buckets)
    found = written(map_batches(sent.repartition("bucket").sortWithinPartitions("bucket"), partial(look, most=most), schema), "places")
    places = found.filter("block is null")
    on = found.filter("block is not null")
    if not on.isEmpty():
        # Only equal windows share a key now, and equal ones of one task are one: a bucket is never too large.
        more = map_batches(on.repartition("bucket").sortWithinPartitions("bucket"), partial(look, most=1 << 62), schema)
        places = places.unionByName(more)
    return places.select("doc", "tag", "at", "upto")


def _with_places(docs: DataFrame, window: int, **how) -> DataFrame:
    rows = identified(docs)
    places = marked_places(rows, window, **how).groupBy("doc", F.col("tag").alias("of")).agg(F.collect_list(F.struct("at", "upto")).alias("places"))
    return rows.join(places, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc")) & (F.col("tag") == F.col("of")), "left").select("doc_id", "text", "places")


def without_repeats(docs: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left of every text, joined by one space."""
    return map_batches(_with_places(docs, window, **how), _kept, "doc_id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return map_batches(_with_places(docs, WINDOW), _kept_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
