"""Groups of near copies: SimHash links, and texts whose 5-word shingles are alike (Jaccard 0.8 or more).

At a similarity of 0.8 about ten of a SimHash's 64 bits differ, too many for pigeonhole blocks, so the second kind of link has
blocks of another fingerprint: 250 min-hashes of a text's shingles in 50 blocks of 5. A pair at 0.8 shares a block with
probability 1 - (1 - 0.8^5)^50 > 0.999999997. The 250 min-hashes also estimate a similarity (standard error 0.025 at 0.8).
Pairs whose estimate is MARGIN, six standard errors, below 0.8 are passed over; of all others the shingles themselves are compared.

Texts equal in their words are one node. Every pair of a block is looked at, in two steps. First each text is compared with
pivots, the block's text with the most neighbours over all blocks and that with the least hash: pairs whose estimate is
MARGIN above 0.8 are links, and of the others a text's best is decided on the shingles. That joins most of a large family.
Then all pairs of a block that are not yet in one component are looked at, in tiles of some TILE texts by TILE, so that a large
block is shared among tasks: a tile first tells which of its texts have a partner by the estimate in another component,
then these texts are fetched and compared there. A pair belongs to the first block that both have. A tile
returns the links of a spanning forest, so rows grow with texts and not with pairs. Pairs inside a component need no look: they
cannot change it.

Defined results: null and empty texts are equal texts. A text of fewer words than a shingle has one shingle. Rows with equal
texts are one node, rows that share an id but not the text are linked as any, and so are null ids; a component has a null id
only where it has no other. Of a component `one_of_each` keeps one row: that with the least id (a null is the greatest), of
several texts with that id the one with the least hash, of equal rows any, of rows that differ elsewhere the least. Columns pass through whatever their names.
An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, dropped, hot_keys, joined, map_batches, text_of, utf8, written
from .graph import components
from .simhash import fingerprint, links

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 50
MARGIN = 0.15
#: Texts on a side of a tile: 650 bytes each.
TILE = 1024


def _multipliers(n: int):
    import numpy as np

    x, out = 0x2545F4914F6CDD1D, []
    for _ in range(2 * n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x ^ x >> 31)
    a = np.array(out, dtype=np.uint64)
    return a[:n] | np.uint64(1), a[n:]


def shingles(words: list[bytes], known: dict, shingle: int = SHINGLE):
    """64-bit hashes of all shingles, in order."""
    import numpy as np
    import xxhash

    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) >= shingle:
        g = h[: len(h) - shingle + 1].copy()
        for k in range(1, shingle):
            g *= np.uint64(0x9E3779B97F4A7C15)
            g ^= h[k : len(h) - shingle + 1 + k]
    else:
        g = np.array([xxhash.xxh64_intdigest(b" ".join(words), 5)], dtype=np.uint64)
    g ^= g >> np.uint64(32)
    return g


def sketch(text: bytes, known: dict, a, b, shingle: int = SHINGLE):
    """(two hashes of the words, min-hashes) of a text; a min-hash has 32 bits."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    g = shingles(words, known, shingle)
    least = np.full(len(a), 0xFFFFFFFF, dtype=np.uint64)
    for k in range(0, len(g), 1024):
        least = np.minimum(least, ((g[k : k + 1024, None] * a + b) >> np.uint64(32)).min(axis=0))
    whole = b" ".join(words)
    return xxhash.xxh64_intdigest(whole, 9), xxhash.xxh64_intdigest(whole, 10), least.astype("<u4")


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 3)
        return h


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(s1, s2, fp, bands, marks) of the texts, after the row's key (doc_id, h1, h2)."""
    import xxhash

    a, b = _multipliers(ROWS * BANDS)
    known = _Words()
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    for batch in batches:
        s1, s2, prints, bands, marks = [], [], [], [], []
        for t in utf8(batch.column(3)):
            one, two, least = sketch(t, known, a, b, shingle)
            s1.append(sign(one))
            s2.append(sign(two))
            prints.append(sign(fingerprint(t)))
            raw = least.tobytes()
            bands.append([sign(xxhash.xxh64_intdigest(raw[4 * ROWS * k : 4 * ROWS * (k + 1)], k)) for k in range(BANDS)])
            marks.append(least.astype("u1").tobytes())
        cols = [*batch.columns[:3], pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h1", "h2", "s1", "s2", "fp", "bands", "marks"])


def _estimated(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of (a, b, marks, marks) with their estimated similarity, if it reaches a bound; marks are single bytes, so one in 256 agrees by chance."""
    import numpy as np

    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 3))
        likely = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(likely)], names=["a", "b", "likely"]).filter(pa.array(likely >= least))


class _Tile:
    """Members of a tile, from a struct array (part, node, root, marks, bands, ...) and the parts i and j that meet in it."""

    def __init__(self, key: int, i: int, j: int, members: pa.StructArray, least: float):
        import numpy as np

        self.key, self.i, self.j = key, i, j
        part, self.node, self.root = (members.field(k).to_numpy() for k in range(3))
        n = len(part)
        self.marks = np.frombuffer(b"".join(members.field(3).to_pylist()), np.uint8).reshape(n, -1)
        self.bands = members.field(4).flatten().to_numpy().reshape(n, -1)
        self.need = np.ceil(self.marks.shape[1] * (least * (1 - 1 / 256) + 1 / 256) - 1e-9)
        at = np.arange(n)
        self.rows, self.cols = (at, at) if i == j else (at[part == i], at[part == j])

    def partners(self, r: int):
        """Members that r may resemble, in other components, whose first common block is this tile's."""
        import numpy as np

        c = self.cols[self.root[self.cols] != self.root[r]]
        if self.i == self.j:
            c = c[c > r]
        c = c[(self.marks[c] == self.marks[r]).sum(axis=1) >= self.need]
        if not len(c):
            return c
        common = self.bands[c] == self.bands[r]
        return c[self.bands[r][np.argmax(common, axis=1)] == self.key]


def _tiles(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[tuple[_Tile, pa.StructArray]]:
    """The tiles of rows (key, i, j, members)."""
    for b in batches:
        for k, i, j, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            yield _Tile(k, i, j, x.values, least), x.values


def _wanted(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(key, i, j, part, id, root) of the members of tiles that have a partner."""
    import numpy as np

    for tile, members in _tiles(batches, least):
        some = np.zeros(len(tile.node), bool)
        for r in tile.rows.tolist():
            c = tile.partners(r)
            if len(c):
                some[c] = some[r] = True
        keep = np.flatnonzero(some)
        if len(keep):
            fixed = [pa.array(np.full(len(keep), x), pa.int64()) for x in (tile.key, tile.i, tile.j)]
            cols = [*fixed, members.field(0).take(pa.array(keep)), pa.array(tile.node[keep]), pa.array(tile.root[keep])]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "i", "j", "part", "id", "root"])


def _alike(x, y, similarity: float) -> bool:
    """Whether two sorted sets are alike by a Jaccard similarity."""
    import numpy as np

    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _compared(batches: Iterator[pa.RecordBatch], least: float, shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of tiles whose members have their texts: pairs alike by their shingles, of a spanning forest."""
    import numpy as np

    known = _Words()
    for tile, members in _tiles(batches, least):
        sets = [np.unique(shingles(t.lower().split(), known, shingle)) for t in utf8(members.field(5))]
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:  # noqa: B023
                x = top[x]  # noqa: B023
            return x

        out = []
        for r in tile.rows.tolist():
            for c in tile.partners(r).tolist():
                x, y = find(int(tile.root[r])), find(int(tile.root[c]))
                if x != y and _alike(sets[r], sets[c], similarity):
                    top[x] = y
                    out.append(sorted((int(tile.node[r]), int(tile.node[c]))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _jaccard(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of texts (ta, tb) whose sets of shingles are alike."""
    import numpy as np

    known, held = _Words(), {}

    def of(node, text):
        if node not in held:
            if len(held) > 2000:
                held.clear()
            held[node] = np.unique(shingles(text.lower().split(), known, shingle))
        return held[node]

    for batch in batches:
        keep = [_alike(of(a, ta), of(b, tb), similarity) for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _row_key(docs: DataFrame, text: str = "text") -> list[Column]:
    """What tells a row's id and text: the id, and two hashes of the text."""
    t = text_of(docs, text)
    return [docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2")]


def clustered(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE, hot: int = HOT_ROWS) -> DataFrame:
    """(doc_id, h1, h2, root) of every row, a written table: root is the node that stands for its component."""
    rows = docs.select(*_row_key(docs), text_of(docs).alias("text"))
    made = "doc_id long, h1 long, h2 long, s1 long, s2 long, fp long, bands array<long>, marks binary"
    made = written(map_batches(rows, partial(_sketches, shingle=shingle), made), "sketches")
    # One node for each text; equal texts have equal sketches. Its id is one hash, but where another text has the same one, both together.
    nodes = made.groupBy("s1", "s2").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    nodes = written(nodes, "nodes")
    shared_hash = nodes.groupBy("s1").agg(F.count("*").alias("n"), F.min("s2").alias("s")).filter("n > 1").collect()  # some n^2 / 2^65 of n texts
    node_id = F.col("s1")
    for r in shared_hash:
        node_id = F.when((F.col("s1") == r["s1"]) & (F.col("s2") != r["s"]), F.xxhash64("s1", "s2")).otherwise(node_id)
    keyed = written(made.select("doc_id", "h1", "h2", node_id.alias("id")), "rows")
    dropped(made)
    nodes_of = nodes.select(node_id.alias("id"), "fp", "bands", "marks")
    first, roots = _pivot_links(nodes_of, keyed, docs, shingle, similarity, hot)
    shared, texts = first["shared"], first["texts"]
    # What the pivots left apart: all pairs of a block in different components.
    rooted = shared.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("m")).filter("r <> s").select("key", "m")
    left = rooted.select("key", "id", "root").join(mixed, "key").withColumn("parts", F.ceil(F.col("m") / tile)).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    left = left.select("key", "id", "root", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    left = left.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "root")

    def gathered(members: DataFrame, *more: str) -> DataFrame:
        return members.groupBy("key", "i", "j").agg(F.collect_list(F.struct("part", "id", "root", "marks", "bands", *more)).alias("x"))

    seen = nodes_of.select("id", "marks", "bands")
    wanted = map_batches(gathered(left.join(seen, "id")), partial(_wanted, least=similarity - MARGIN), "key long, i long, j long, part long, id long, root long")
    wanted = written(wanted, "wanted")
    links_made = [first["links"]]
    if not wanted.isEmpty():
        full = gathered(wanted.join(seen, "id").join(texts, "id"), "text")
        second = written(map_batches(full, partial(_compared, least=similarity - MARGIN, shingle=shingle, similarity=similarity), "a long, b long").distinct(), "links")
        links_made.append(second)
    every = links_made[0] if len(links_made) == 1 else links_made[0].unionByName(links_made[1])
    final = roots if len(links_made) == 1 else components(every, hot).withColumnRenamed("node", "id")
    out = written(keyed.join(final, "id", "left").select("doc_id", "h1", "h2", F.coalesce("root", "id").alias("root")), "clusters")
    dropped(shared, texts, wanted, nodes, keyed, *links_made)
    return out


def _texts_of(ids: DataFrame, keyed: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of nodes, a written table: each from one of its rows."""
    one = keyed.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("r")).select("id", "r.*")
    one = written(one, "asked")  # its size known, Spark can tell whether to send it to the texts or the texts to it
    d, a, b = _row_key(docs)
    rows = docs.select(d.alias("d"), a.alias("a"), b.alias("b"), text_of(docs).alias("text"))
    found = rows.join(one, rows["d"].eqNullSafe(one["doc_id"]) & (rows["a"] == one["h1"]) & (rows["b"] == one["h2"]))
    out = written(found.groupBy("id").agg(F.first("text").alias("text")), "texts")
    dropped(one)
    return out


def _pivot_links(nodes: DataFrame, keyed: DataFrame, docs: DataFrame, shingle: int, similarity: float, hot: int):
    """Links by fingerprint and to pivots beside the blocks that several nodes share and the texts of these (written tables), and the components so far."""
    firsts = nodes.groupBy("fp").agg(F.min("id").alias("first"))
    close = links(firsts.select("fp"), hot=hot)
    of = lambda side: firsts.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_id"))
    by_print = nodes.select("fp", "id").join(firsts, "fp").select(F.col("id").alias("a"), F.col("first").alias("b"))
    by_link = close.join(of("a"), "a").join(of("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    blocks = nodes.select("id", F.explode("bands").alias("key"))
    sizes = written(blocks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    frequent = hot_keys(sizes, "key", sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], hot)
    shared = written(joined(blocks, sizes, "key", frequent), "blocks")
    # Only texts that share a block are ever compared: they are fetched once, for pivots and tiles.
    texts = _texts_of(shared.select("id").distinct(), keyed, docs)
    central = shared.groupBy("id").agg(F.sum("n").alias("c"))
    pivots = shared.select("key", "id").join(central, "id").groupBy("key").agg(F.max_by("id", F.struct("c", "id")).alias("p1"), F.min("id").alias("p2"))
    pairs = joined(shared.select("key", "id"), pivots, "key", frequent).select("id", F.explode(F.array("p1", "p2")).alias("p")).filter("id <> p")
    pairs = pairs.select(F.col("id").alias("a"), F.col("p").alias("b")).distinct()
    marks = lambda side: nodes.select(F.col("id").alias(side), F.col("marks").alias(f"m{side}"))
    checked = pairs.join(marks("a"), "a").join(marks("b"), "b").select("a", "b", "ma", "mb")
    likely = written(map_batches(checked, partial(_estimated, least=similarity - MARGIN), "a long, b long, likely double"), "likely")
    # Alike beyond doubt; or a text's best pivot, to be decided on the shingles.
    best = likely.groupBy("a").agg(F.max_by("b", F.struct("likely", "b")).alias("b"), F.max("likely").alias("likely"))
    sure = likely.filter(F.col("likely") >= similarity + MARGIN).select("a", "b")
    unsure = written(best.filter(F.col("likely") < similarity + MARGIN).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "unsure")
    side = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias(f"t{k}"))
    both = unsure.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    decided = map_batches(both, partial(_jaccard, shingle=shingle, similarity=similarity), "a long, b long")
    first = written(by_print.unionByName(by_link).unionByName(sure).unionByName(decided).filter("a <> b"), "links")
    dropped(sizes, likely, unsure)
    return {"links": first, "shared": shared, "texts": texts}, components(first, hot).withColumnRenamed("node", "id")


def grouped(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, tile: int = TILE, hot: int = HOT_ROWS) -> DataFrame:
    """(doc_id, component_id) of every row; component_id is the least doc_id reachable over links."""
    rows = clustered(docs, shingle, similarity, tile, hot)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One whole row of each component, as the module says; all columns as they were."""
    rows = clustered(docs, **how)
    by = rows.groupBy("root", "doc_id", "h1", "h2").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h1", "h2", "n")
    kept = written(by.groupBy("root").agg(F.min(rank).alias("k")).select("k.doc_id", "k.h1", "k.h2", "k.n"), "kept")
    dropped(rows)
    d, a, b = _row_key(docs)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), d.alias("d"), a.alias("a"), b.alias("b"))
    on = lambda k: whole["d"].eqNullSafe(k["doc_id"]) & (whole["a"] == k["h1"]) & (whole["b"] == k["h2"])
    single, several = kept.filter("n = 1"), kept.filter("n > 1")
    out = whole.join(single, on(single), "left_semi").select("row.*")
    if not several.isEmpty():
        again = whole.join(several, on(several), "left_semi").groupBy("d", "a", "b").agg(F.min("row").alias("row"))
        out = out.unionByName(again.select("row.*"))
    return out
