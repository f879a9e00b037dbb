"""Similarity join of token sets: each set with every one of its block that is of like size, in tiles that count what two chunks share.

At low thresholds nearly all of a set is its prefix and pairs met by token are far more than pairs, so the join makes no candidates: a
chunk of sets is a file in the shared folder, a tile reads two of them, and only pairs that are alike leave it. `candidates` is the prefix,
length and position filter by itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, folder, remove, written

#: Tokens are counted in so many slots, which only orders them; a slot's tokens share its count, so the table has one size.
SLOTS = 1 << 20
#: Sets and tokens of a chunk at most (one set may have more), its sets that are compared at once, and pairs of a set and a token that are counted at once.
CHUNK_SETS, CHUNK_TOKENS, SLICE, STEPS = 4096, 1 << 20, 512, 1 << 22
#: A token that one in so many pairs of two chunks share, or more, is a column of a matrix product; pairs that share a rarer one are counted.
DENSE = 256


def classes(rows: DataFrame, block: str) -> tuple[DataFrame, DataFrame]:
    """((class, block, x), (class, id)): one row for each distinct set of a block, and which rows have it.

    Rows are (id, block, x) with x an array of distinct tokens. A class is named by its least id; rows without tokens have none.
    """
    # A set goes by the SHA-256 of block and tokens, so only these and ids are dealt to find copies; one row of each set brings the tokens.
    x = rows.where(F.size("x") > 0).select("id", F.col(block).alias("block"), F.array_sort("x").alias("x"))
    keyed = written(x.withColumn("key", F.unhex(F.sha2(F.to_json(F.struct("block", "x")), 256))).withColumn("row", F.monotonically_increasing_id()), "sets")
    least = written(keyed.groupBy("key").agg(F.min(F.struct("id", "row")).alias("m")).select("key", F.col("m.id").alias("class"), "m.row"), "least")
    member = written(keyed.where("block IS NOT NULL").select("key", "id").join(least.select("key", "class"), "key").select("class", "id"), "members")
    sets = written(keyed.join(least.select("row"), "row", "left_semi").select("block", "x", F.col("id").alias("class")), "sets")
    dropped(keyed, least)
    return sets, member


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of classes a < b of a block that may be alike by the threshold or more; none that are is missing.

    Tokens go by the counts of their slots, about from the rarest to the most frequent. Two sets alike by t share at least t of
    the larger one's tokens, so they share one among the first (1 - t) of each, are of like size, and at a shared place have
    enough tokens left.
    """
    # Tokens are numbers of 64 bits that name the block too: two of one number could only add candidates.
    numbers = sets.where("block IS NOT NULL").select("class", F.transform("x", lambda x: F.xxhash64("block", x)).alias("h"))
    slots = numbers.select(F.explode("h").alias("token")).groupBy(F.pmod("token", F.lit(SLOTS)).alias("slot")).agg(F.count("*").alias("df"))
    held = sets.sparkSession.sparkContext.broadcast(_counts(slots))

    def front(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for rows in batches:
            out = []
            for h in rows["h"]:
                h = np.asarray(h, np.int64)
                df = held.value[h % SLOTS]
                order = np.lexsort((h, df))[: len(h) - int(np.ceil(threshold * len(h) - 1e-9)) + 1]
                order = order[np.searchsorted(df[order], 2) :], len(order)
                out.append((h[order[0]], order[1] - len(order[0])))
            yield pd.DataFrame({"class": rows["class"], "n": [len(h) for h in rows["h"]], "lone": [k for _, k in out], "h": [x for x, _ in out]})

    # Tokens that no other set has come first in the order: they use up the front, and join nothing.
    kind = f"class {dict(sets.dtypes)['class']}, n int, lone int, h array<bigint>"
    first = numbers.mapInPandas(front, kind).select("class", "n", "lone", F.posexplode("h").alias("k", "token"))
    first = written(first.select("class", "n", (F.col("lone") + F.col("k")).alias("at"), "token"), "prefixes")
    a, b = first.alias("a"), first.alias("b")
    t = F.lit(threshold)
    share = t / (1 + t) * (F.col("a.n") + F.col("b.n"))
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    like = (F.least("a.n", "b.n") >= t * F.greatest("a.n", "b.n") - 1e-9) & (left >= share - 1e-9)
    return a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.class") < F.col("b.class")) & like).select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct()


def _counts(slots: DataFrame):
    """The counts of all slots as one array, whose size is fixed."""
    import numpy as np

    got = slots.toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy(np.int64)] = got["df"].to_numpy(np.int64)
    return out


def _number(token: F.Column, salt: int) -> F.Column:
    return F.xxhash64(F.lit(salt), token)


def _numbering(sets: DataFrame) -> tuple[int, int]:
    """(salt, tokens): a salt with which no two tokens have one number, so sets of numbers share what the sets do; and how many tokens all sets have."""
    words = written(sets.where("block IS NOT NULL").select(F.explode("x").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "words")
    for salt in range(100):
        most, total = words.groupBy(_number(F.col("token"), salt)).agg(F.count("*").alias("k"), F.sum("n").alias("n")).agg(F.max("k"), F.sum("n")).first()
        if (most or 1) == 1:
            dropped(words)
            return salt, total or 0
    raise ValueError("tokens have no numbers of their own")


def _chunks(sets: DataFrame) -> DataFrame:
    """(number, path, low, high, least, most): chunks of sets in the order of block and size, each a file of (block, class, h) in the shared folder; first and last block, and sizes."""
    spark = sets.sparkSession
    salt, tokens = _numbering(sets)
    kinds = dict(sets.dtypes)
    rows = sets.where("block IS NOT NULL").select("block", "class", F.size("x").alias("n"), F.transform("x", lambda x: _number(x, salt)).alias("h"))
    parts = max(tokens // (4 * CHUNK_TOKENS) + 1, spark.sparkContext.defaultParallelism)
    dealt = rows.repartitionByRange(parts, "block", "n", "class").sortWithinPartitions("block", "n", "class")
    place = f"{folder(spark)}/scratch-{spark.sparkContext.applicationId}/chunks-{uuid.uuid4().hex}"
    most_sets, most_tokens = CHUNK_SETS, CHUNK_TOKENS

    def put(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        system, path = fs.FileSystem.from_uri(place)
        system.create_dir(path, recursive=True)
        number, held, sizes = TaskContext.get().partitionId() << 32, [], []

        def done():
            nonlocal number, held, sizes
            # A task tried again writes under other names; only those that it gives are read.
            name = f"{path}/{uuid.uuid4().hex}.arrow"
            table = pa.Table.from_batches(held)
            with system.open_output_stream(name) as out, pa.ipc.new_stream(out, table.schema) as sink:
                sink.write_table(table)
            first, last = table["block"].slice(0, 1).combine_chunks(), table["block"].slice(len(sizes) - 1, 1).combine_chunks()
            out = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([name]), first, last, pa.array([int(min(sizes))]), pa.array([int(max(sizes))])], names=["number", "path", "low", "high", "least", "most"])
            number, held, sizes = number + 1, [], []
            return out

        for batch in batches:
            n, at = batch["n"].to_numpy().astype(np.int64), 0
            ends = np.cumsum(n)
            while at < len(n):
                room = most_tokens - sum(sizes)
                k = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, "right")) - at
                k = min(max(k, 0 if sizes else 1), most_sets - len(sizes))
                if k:
                    held.append(batch.slice(at, k).select(["block", "class", "h"]))
                    sizes += n[at : at + k].tolist()
                    at += k
                if at < len(n) or len(sizes) >= most_sets:
                    yield done()
        if sizes:
            yield done()

    out = written(dealt.mapInArrow(put, f"number long, path string, low {kinds['block']}, high {kinds['block']}, least long, most long"), "chunks")
    out._place = place
    return out


def _shared(left: tuple, right: tuple, threshold: float, same: bool) -> Iterator[tuple]:
    """(i, j, similarity) of pairs of sets at the threshold or above; a side is (sizes in rising order, its tokens set by set). Of one side with itself i < j."""
    import numpy as np

    (n, h), (m, g) = left, right
    kinds = np.intersect1d(h, g)
    if not len(kinds):
        return
    sides = []
    for sizes, x in (left, right):
        k = np.searchsorted(kinds, x)
        k[k == len(kinds)] = 0
        there = kinds[k] == x
        sides.append((np.repeat(np.arange(len(sizes)), sizes)[there], k[there]))
    (i, k), (j, q) = sides
    da, db = np.bincount(k, minlength=len(kinds)), np.bincount(q, minlength=len(kinds))
    heavy = da * db * DENSE > len(n) * len(m)
    column = np.cumsum(heavy) - 1
    width = int(heavy.sum())
    dense = heavy[q]
    y = np.zeros((len(m), width), np.float32)
    y[j[dense], column[q[dense]]] = 1
    # Of rare tokens: the right side's sets by token.
    order = np.argsort(q[~dense], kind="stable")
    holders, first = j[~dense][order], np.concatenate([[0], np.cumsum(np.where(heavy, 0, db))])
    starts = np.searchsorted(i, np.arange(0, len(n) + SLICE, SLICE))
    for piece, a in enumerate(range(0, len(n), SLICE)):
        b = min(a + SLICE, len(n))
        # Sets of unlike sizes are not alike.
        lo, hi = np.searchsorted(m, threshold * n[a] - 1e-6), np.searchsorted(m, n[b - 1] / threshold + 1e-6, "right")
        lo = max(lo, a) if same else lo
        if lo >= hi:
            continue
        rows, words = i[starts[piece] : starts[piece + 1]] - a, k[starts[piece] : starts[piece + 1]]
        of = heavy[words]
        x = np.zeros((b - a, width), np.float32)
        x[rows[of], column[words[of]]] = 1
        count = (x @ y[lo:hi].T).ravel()
        rows, words = rows[~of], words[~of]
        ends = np.cumsum(db[words])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEPS, "right")))
            times = db[words[at:to]]
            partner = holders[np.repeat(first[words[at:to]] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            near = (partner >= lo) & (partner < hi)
            count += np.bincount((np.repeat(rows[at:to], times) * (hi - lo) + partner - lo)[near], minlength=len(count)).astype(np.float32)
            at = to
        least = (threshold / (1 + threshold)) * (n[a:b, None] + m[None, lo:hi]) - 1e-6
        found = np.flatnonzero(count >= least.ravel())
        s, t, both = a + found // (hi - lo), lo + found % (hi - lo), count[found].astype(np.int64)
        similarity = both / (n[s] + m[t] - both)
        keep = (similarity >= threshold) & ((s < t) if same else True)
        yield s[keep], t[keep], similarity[keep]


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs of distinct sets of a block whose Jaccard similarity is the threshold or more.

    Tiles are two chunks, or one with itself, that have a block in common and sizes that can be alike; a task holds one tile at a time.
    """
    chunks = _chunks(sets)
    x, y = (chunks.select(*[F.col(c).alias(f"{c}_{side}") for c in chunks.columns]) for side in "xy")
    t = F.lit(threshold)
    meet = (F.col("number_x") <= F.col("number_y")) & (F.col("low_x") <= F.col("high_y")) & (F.col("low_y") <= F.col("high_x"))
    # A chunk of one block has its sets by size.
    meet &= (F.col("most_x") >= t * F.col("least_y") - 1e-6) & (F.col("most_y") >= t * F.col("least_x") - 1e-6)
    tiles = written(x.join(y, meet).select("path_x", "path_y"), "tiles")
    kind, place = dict(sets.dtypes)["class"], folder(sets.sparkSession)

    def pairs(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(place)

        def chunk(path: str):
            with system.open_input_stream(path) as f:
                table = pa.ipc.open_stream(f).read_all().combine_chunks()
            h = table["h"].chunk(0)
            n = np.diff(h.offsets.to_numpy())
            return table["block"].chunk(0), table["class"].chunk(0), n, np.concatenate([[0], np.cumsum(n)]), h.flatten().to_numpy()

        def runs(block) -> dict:
            """(first, after the last) row of each block."""
            each = pc.run_end_encode(block)
            ends = each.run_ends.to_pylist()
            return dict(zip(each.values.to_pylist(), zip([0, *ends[:-1]], ends, strict=True), strict=True))

        for batch in batches:
            for p, q in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                left = chunk(p)
                right = left if p == q else chunk(q)
                here, there = runs(left[0]), runs(right[0])
                for k in here.keys() & there.keys():
                    (a, b), (c, d) = here[k], there[k]
                    for i, j, s in _shared((left[2][a:b], left[4][left[3][a] : left[3][b]]), (right[2][c:d], right[4][right[3][c] : right[3][d]]), threshold, p == q):
                        if len(s):
                            u, v = left[1].take(pa.array(a + i)), right[1].take(pa.array(c + j))
                            less = pc.less(u, v)
                            yield pa.RecordBatch.from_arrays([pc.if_else(less, u, v), pc.if_else(less, v, u), pa.array(s)], names=["a", "b", "similarity"])

    # Tiles are few rows of much work each, so they are dealt by number.
    dealt = tiles.repartition(max(sets.sparkSession.sparkContext.defaultParallelism, tiles.count() // 4 + 1))
    out = written(dealt.mapInArrow(pairs, f"a {kind}, b {kind}, similarity double"), "alike")
    dropped(chunks, tiles)
    remove(sets.sparkSession, chunks._place)
    return out


def expanded(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """(a, b, similarity) of rows a < b: pairs of classes for all their members, and members of one class, at 1."""
    m = lambda k: member.select(F.col("class").alias(f"c{k}"), F.col("id").alias(k))
    across = pairs.withColumnsRenamed({"a": "ca", "b": "cb"}).join(m("a"), "ca").join(m("b"), "cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    x, y = member.alias("x"), member.alias("y")
    within = x.join(y, (F.col("x.class") == F.col("y.class")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within)
