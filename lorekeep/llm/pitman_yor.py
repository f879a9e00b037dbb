"""Language-model scores by a hierarchical Pitman-Yor model of words.

Restaurants: one for each word before, whatever its count (the end token stands before a text's first word). Dishes are words. All share the root restaurant, whose
base is uniform: half of it for the known words, half for the unknown one. The customers of the root are the tables of the
others.

Seating is sampled by Gibbs steps. The root's share of each dish, and each restaurant's weight of new tables, are drawn from their conditionals (gamma variables,
whose totals over the corpus count at their mean); given these, every dish in every restaurant is independent, and its c customers sit at t tables with
probability in proportion to a^t S(c, t), with a the product of both and S the generalised Stirling numbers. One customer has one table. Up to EXACT
customers that law is drawn exactly. Beyond, where few tables are likely, the ratios S(c, t) / S(c, 1) come from rows of exact
numbers at customers' numbers GRID apart, linear in c^-d between them and towards their known limit; where many are, the number is normal with
the mean and variance of the saddle point (t is a sum of independent indicators, so its distribution function is within 0.56 over its
standard deviation of the normal one). A task has whole dishes and samples them independently; what they share, tables per
restaurant, is brought up to date by rounds over all. After each round strength and discount of both levels are
drawn from their conditionals on a grid: the strength from how many restaurants have each number of customers and of tables, the discount from these and from how many dishes have c customers at t tables (c up to
TELLING). Random numbers are hashes of word, context, round and step: results do not depend on partitions.
Predictive probabilities are averaged over the samples of the last round; what a restaurant's averaged counts leave of
one goes to its parent.

Work is dealt by a grid (Grid). A block has the cells (pairs of word before and word, with their count) of a share of the words and a share of the words before, so neither a
frequent word nor a frequent pair is one task's; chunks of texts send it each distinct pair once, as packed vectors. For the seating only cells of several customers go on, to the task
that has the word's dish whole (a task holds at most as many cells of a dish as there are words before it twice or more); the task of each word before adds up its tables and answers those that have cells of it.
Nothing is broadcast but the parameters; histograms of numbers are all that the driver sees.

Scoring: chunks of texts send blocks their distinct pairs with the texts that have them; pairs that are no cell go on to the tasks of both words, as their probability is the product of the weight of the root after one
and the root's share of the other. A chunk's sums over blocks come together at last. Logarithms and sums of a block are rounded to 32 bits, so a score does not depend on chunks. Words are told apart by 64-bit hashes.

Defined results: null and empty texts are one end token. Each row is scored and, if in the training share, counted,
also where an id repeats; a null id counts as the empty text in choosing the share. Very long texts are scored whole. Further columns are not read. Without
training rows all words are unknown, N and V are 0 and scores those of the bare base. An empty table gives an empty table.
"""

from __future__ import annotations

import gc
import math
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh_path, map_batches, ready, remainder, text_of, utf8, written

#: Random numbers of the root and of restaurants' weights are told apart by numbers from here on.
CONTEXTS = 128
#: Texts of a chunk at most (their places in it have 16 bits), and tokens from which one ends.
DENSE = 65_536
TOKENS = 4_400_000
#: Bytes of text of a block.
BLOCK = 18 << 20
EXACT = 512
#: Beyond EXACT customers: exact rows at numbers this far apart, up to a last one; tables in a row, and the mean from which the number is normal.
GRID, LAST = 1.06, 8_192
WIDTH, WIDE = 192, 64.0
#: Where strengths and discounts may lie, and the most customers of a dish that tells of the discount.
STRENGTHS = (0.01, 10_000.0, 240)
DISCOUNTS = tuple(k / 100 for k in range(5, 96))
TELLING = 64
ROUNDS = 3
BURN_IN, SAMPLES = 3, 4
#: Hash of the end token: no word holds a line feed.
END = b"\n"
CELLS = 300_000


class _Words(dict):
    """Word to a small number; by number, its hash as a signed long."""

    def __init__(self):
        super().__init__()
        self.hashes = array("q")
        self[END]

    def __missing__(self, word: bytes) -> int:
        import xxhash

        k = self[word] = len(self.hashes)
        h = xxhash.xxh64_intdigest(word, 0)
        self.hashes.append(h - (1 << 64) if h >> 63 else h)
        return k

    def tokens(self, texts: list[bytes]):
        """Ids of all tokens of the texts (an end after each), and the place of each text's first."""
        import numpy as np

        split = [t.lower().split() for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(w) + 1 for w in split], dtype=np.int64)))
        out = np.zeros(int(bounds[-1]), dtype=np.int64)
        for w, a in zip(split, bounds.tolist(), strict=False):
            out[a : a + len(w)] = np.fromiter(map(self.__getitem__, w), dtype=np.int64, count=len(w))
        return out, bounds

    def table(self):
        import numpy as np

        return np.frombuffer(self.hashes, dtype=np.int64).copy()


#: All tables of packed vectors: to which task, what, from where, and the vectors.
FORM = "to int, kind string, src long, a binary, b binary, c binary, d binary, e binary, f binary"
FIELDS = pa.schema([("to", pa.int32()), ("kind", pa.string()), ("src", pa.int64()), *[(x, pa.binary()) for x in "abcdef"]])


def _pack(x) -> bytes:
    """A vector, its bytes by their place in a number."""
    import numpy as np

    x = np.ascontiguousarray(x)
    head = x.dtype.str.encode() + len(x).to_bytes(8, "little")
    return head + pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(x) else head


def _unpack(x: bytes):
    import numpy as np

    kind, n = np.dtype(x[:3].decode()), int.from_bytes(x[3:11], "little")
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(x[11:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()


def _small(x) -> bytes:
    import numpy as np

    return _pack(x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)))


def _hashes(x) -> bytes:
    """Hashes by their differences, modulo 2^64."""
    import numpy as np

    return _pack(np.diff(x, prepend=np.uint64(0)))


def _of_hashes(x: bytes):
    import numpy as np

    return np.cumsum(_unpack(x), dtype=np.uint64)


class _Sent:
    """Rows of FORM to be."""

    def __init__(self):
        self.rows = []

    def add(self, to: int, kind: str, src: int, *vectors: bytes):
        self.rows.append((int(to), kind, int(src), *vectors, *[None] * (6 - len(vectors))))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in FIELDS]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, FIELDS, strict=True)], schema=FIELDS)


def _exchanged(df: DataFrame, f: Callable[[dict[str, list[dict]], _Sent], None], key: str = "to") -> DataFrame:
    """f over the rows of each task by kind, in the order of their sources."""

    def group(table):
        by: dict[str, list[dict]] = defaultdict(list)
        for r in table.to_pylist():
            by[r["kind"]].append(r)
        for rows in by.values():
            rows.sort(key=lambda r: (r["src"], r["to"]))
        out = _Sent()
        f(by, out)
        return pa.Table.from_batches([out.batch()])

    ready(df.sparkSession)
    return df.groupBy(key).applyInArrow(group, FORM)


class Grid:
    """Where pairs of words go: a block has a share of the words and one of the words before; dishes and words have side^2 tasks."""

    def __init__(self, size: int):
        """For texts of so many bytes."""
        self.side = max(2, math.ceil(math.sqrt(max(size / BLOCK, min(36, size / (BLOCK / 16))))))
        self.tasks = self.side * self.side

    def task(self, h):
        import numpy as np

        return (h % np.uint64(self.tasks)).astype(np.int64)

    def block(self, w, u):
        import numpy as np

        return self.task(w) // self.side * self.side + (u >> np.uint64(40)).astype(np.int64) % self.side


def _cells(w, u, n) -> tuple[bytes, ...]:
    """Cells in the order of word and word before: words, cells of each, words before, the place of each cell's, customers."""
    import numpy as np

    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
    us, at = np.unique(u, return_inverse=True)
    return _hashes(w[first]), _small(np.diff(first, append=len(w))), _hashes(us), _small(at), _small(n)


def _of_cells(r: dict):
    """(words, cells of each, words before, places, customers)."""
    import numpy as np

    return _of_hashes(r["a"]), _unpack(r["b"]).astype(np.int64), _of_hashes(r["c"]), _unpack(r["d"]).astype(np.int64), _unpack(r["e"]).astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch], grid: Grid, rows: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a word and the word before of a chunk of texts, to their blocks; with rows also in which texts, and a head for the texts."""
    import numpy as np
    from pyspark import TaskContext

    sent, part = _Sent(), TaskContext.get().partitionId()

    def out(known, held, lengths, heads, chunk):
        hashes = known.table().view(np.uint64)
        order = np.argsort(hashes)
        hashes, rank = hashes[order], np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        v, w = len(hashes), rank[np.concatenate(held)]
        held.clear()
        u = np.concatenate((rank[:1], w[:-1]))  # an end, whose number is 0, stands before each text
        task, sub = grid.task(hashes) // grid.side * grid.side, grid.block(np.zeros(1, np.uint64), hashes)
        key = task[w]
        key += sub[u]
        key *= v
        key += w
        key *= v
        key += u
        size = len(w)
        del w, u
        docs = np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)
        if rows:
            order = np.argsort(key, kind="stable")
            key, docs = key[order], docs[order]
        else:
            key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, n = key[first], np.diff(first, append=len(key))
        first = np.append(first, size)
        bounds = np.searchsorted(key, np.arange(grid.tasks + 1) * (v * v))
        src = (part << 32) + chunk
        for b, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if i < j:
                k = key[i:j] - b * v * v
                sent.add(b, "query" if rows else "pairs", src, *_cells(hashes[k // v], hashes[k % v], n[i:j]), *([_pack(docs[first[i] : first[j]])] if rows else []))
        if rows:
            ids, out_of, empty = (np.array(x) for x in zip(*heads, strict=True))
            sent.add(src % grid.tasks, "head", src, _pack(ids.astype(np.int64)), _small(out_of), _small(np.array(lengths)), _small(empty))
        return sent.batch()

    known, held, lengths, heads, chunk = _Words(), [], [], [], 0
    for b in batches:
        step = min(b.num_rows, DENSE)
        for k in range(0, b.num_rows, step):
            if held and (sum(lengths) > TOKENS or len(known) > 1_000_000 or len(lengths) + step > DENSE):
                yield out(known, held, lengths, heads, chunk)
                known, held, lengths, heads, chunk = _Words(), [], [], [], chunk + 1
            some = b.slice(k, step)
            ids, bounds = known.tokens(utf8(some.column(0)))
            held.append(ids)
            lengths += np.diff(bounds).tolist()
            if rows:
                heads += [(i or 0, h, i is None) for i, h in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)]
    if held:
        yield out(known, held, lengths, heads, chunk)


def _split(task):
    """(task, where) of the rows of each task."""
    import numpy as np

    order = np.argsort(task, kind="stable")
    tasks, first = np.unique(task[order], return_index=True)
    return zip(tasks.tolist(), np.split(order, first[1:]), strict=True) if len(order) else []


def _joined(rows: list[dict]):
    """All cells of rows, in order of word and word before, equal ones added."""
    import numpy as np

    parts = [_of_cells(r) for r in rows]
    w, u, n = np.concatenate([np.repeat(p[0], p[1]) for p in parts]), np.concatenate([p[2][p[3]] for p in parts]), np.concatenate([p[4] for p in parts])
    order = np.lexsort((u, w))
    w, u, n = w[order], u[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (u[1:] != u[:-1])))) if len(w) else np.zeros(0, np.int64)
    return w[first], u[first], np.add.reduceat(n, first) if len(first) else n


def _block(by: dict, out: _Sent, grid: Grid) -> None:
    """Cells of a block; its dishes' cells of several customers and how many have one; its words, and words before with their cells of one customer."""
    import numpy as np

    w, u, n = _joined(by["pairs"])
    out.add(by["pairs"][0]["to"], "cells", 0, *_cells(w, u, n))
    block = by["pairs"][0]["to"]
    for task, mine in _split(grid.task(w)):
        words, at = np.unique(w[mine], return_inverse=True)
        many = mine[n[mine] > 1]
        out.add(task, "dish", block, *_cells(w[many], u[many], n[many]))
        out.add(task, "single", block, _hashes(words), _small(np.bincount(at[n[mine] == 1], minlength=len(words))))
    us, at = np.unique(u, return_inverse=True)
    one = np.bincount(at[n == 1], minlength=len(us))
    for task, k in _split(grid.task(us)):
        out.add(task, "before", block, _hashes(us[k]), _small(one[k]))
@lru_cache(maxsize=4)
def _log_stirling(d: float, most: int = EXACT):
    """Logarithms of the generalised Stirling numbers S(c, t) of discount d, for c and t up to a bound."""
    import numpy as np

    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        stay = np.log(c - d * t) + out[c, 1 : c + 1]
        out[c + 1, 1 : c + 1] = np.logaddexp(out[c, 0:c], stay)
        out[c + 1, c + 1] = out[c, c]
    return out


@lru_cache(maxsize=4)
def _ratio_rows(d: float):
    """(x, A): for customers c with x = c^-d, rising, the rows A[t - 1] = log S(c, t) / S(c, 1), t up to WIDTH; the first row is the limit of many customers."""
    import numpy as np

    t = np.arange(1, WIDTH + 1)
    wanted, c = [], float(EXACT)
    while c < LAST:
        wanted.append(int(c))
        c *= GRID
    wanted.append(LAST)
    row = _log_stirling(d)[EXACT, 1 : WIDTH + 1].copy()
    rows = {EXACT: row - row[0]}
    for c in range(EXACT, LAST):
        new = np.log(c - d * t) + row
        new[1:] = np.logaddexp(new[1:], row[:-1])
        row = new
        if c + 1 in wanted:
            rows[c + 1] = row - row[0]
        if row[0] > 1e12:
            row = row - row[0]
    limit = -(t - 1) * math.log(d) - np.array([math.lgamma(k) for k in t])
    at = sorted(rows, reverse=True)
    return np.array([0.0, *(float(k) ** -d for k in at)]), np.stack([limit, *(rows[k] for k in at)])


def _saddle(c, a, d: float):
    """Mean and variance of the number of tables of many customers, where many tables are likely, to the second order."""
    import numpy as np

    def point(a):
        low, high = np.full(len(c), -745.0), np.zeros(len(c))
        for _ in range(60):  # log y with a (1 - y) y^(d - 1) = c
            mid = (low + high) / 2
            more = a * -np.expm1(mid) * np.exp(np.minimum((d - 1) * mid, 700.0)) > c
            low, high = np.where(more, mid, low), np.where(more, high, mid)
        y, z = np.exp(high), -np.expm1(high)
        return a / d * -np.expm1(d * high), a * z * (y ** (d - 1) + z * (1 - d) * y ** (d - 2))

    mean, spread = point(a)
    slope = (np.log(point(a * 1.001)[1]) - np.log(point(a * 0.999)[1])) / 0.002
    return mean - slope / 2, np.maximum(mean - c * c / spread, 0.0)


def _uniform(w, u, step: int):
    """Numbers in (0, 1), a hash of word, context and step."""
    import numpy as np

    x = w.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (u.astype(np.uint64) + np.uint64(1)) + np.uint64((0xD1B54A32D192ED03 * (step + 1)) & (2**64 - 1))
    for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _gamma(shape, w, u, step: int):
    """Gamma variables of given shapes (Marsaglia and Tsang), from numbers that are hashes of word, context and step."""
    import numpy as np

    big = np.where(shape < 1, shape + 1, shape)
    d = big - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, left = d.copy(), np.arange(len(shape))
    for k in range(40):
        one, two, three = (_uniform(w[left], u[left], step * 1000 + 3 * k + i) for i in range(3))
        x = np.sqrt(-2 * np.log(one)) * np.cos(2 * math.pi * two)
        v = (1 + c[left] * x) ** 3
        good = v > 0
        good[good] = np.log(three[good]) < x[good] ** 2 / 2 + d[left][good] * (1 - v[good] + np.log(v[good]))
        out[left[good]] = d[left][good] * v[good]
        left = left[~good]
        if not len(left):
            break
    return np.where(shape < 1, out * _uniform(w, u, step * 1000 + 999) ** (1 / np.maximum(shape, 1e-9)), out)


def draw_tables(c, a, d: float, r):
    """Tables of c customers, given the weight a of a new table and uniform numbers r."""
    import numpy as np

    t = np.ones(len(c), dtype=np.int64)
    if not len(c):
        return t
    log_s = _log_stirling(d)
    many = []
    order = np.argsort(c, kind="stable")
    cs = c[order]
    values, first = np.unique(cs, return_index=True)
    for n, at, upto in zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(cs)], strict=True):
        if n < 2:
            continue
        rows = order[at:upto]
        if n > EXACT:
            many.append(rows)
            continue
        most = float(a[rows].max() / d)
        width = min(n, int(most + 8 * math.sqrt(most) + 24))
        logs = np.log(a[rows])[:, None] * np.arange(1, width + 1) + log_s[n, 1 : width + 1]
        p = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
        t[rows] = 1 + (p < (r[rows] * p[:, -1])[:, None]).sum(axis=1)
    if many:
        rows = np.concatenate(many)
        wide = a[rows] / d > WIDE
        for k in range(0, len(rows), 4096):
            some = rows[k : k + 4096][~wide[k : k + 4096]]
            x, table = _ratio_rows(d)
            own = c[some].astype(np.float64) ** -d
            at = np.clip(np.searchsorted(x, own), 1, len(x) - 1)
            part = ((own - x[at - 1]) / (x[at] - x[at - 1]))[:, None]
            logs = table[at - 1] * (1 - part) + table[at] * part + np.log(a[some])[:, None] * np.arange(WIDTH)
            p = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            t[some] = 1 + (p < (r[some] * p[:, -1])[:, None]).sum(axis=1)
        some = rows[wide]
        mean, var = _saddle(c[some].astype(np.float64), a[some], d)
        normal = NormalDist().inv_cdf
        t[some] = np.maximum(1, np.rint(mean + np.sqrt(var) * np.array([normal(u) for u in r[some].tolist()]))).astype(np.int64)
    return np.minimum(t, c)


def _seated(w, dish, u, n, g: dict, steps: int, keep: int, stage: int):
    """Samples the seating of whole dishes: tables per cell and dish of the last step, and averages over the last `keep` steps.

    Averages: per cell the discounted count over the restaurant's customers, per dish the discounted count and
    the customers of the root.
    """
    import numpy as np

    dishes = len(g["words"]) if "words" in g else int(dish[-1]) + 1 if len(dish) else 0
    wd = g["words"] if "words" in g else w[np.searchsorted(dish, np.arange(dishes))]
    t = np.ones(len(n), dtype=np.int64)
    t0 = np.ones(dishes, dtype=np.int64)
    c_u, t_u, d, d0, s, s0 = g["c_u"], g["t_u"], g["d"], g["d0"], g["s"], g["s0"]
    fresh = (s0 + d0 * g["T0"]) / (s0 + g["C0"]) * g["base"]
    part, root, customers = np.zeros(len(n)), np.zeros(dishes), np.zeros(dishes)
    # Without names a restaurant's number is its name. Cells of one customer always have one table: they may come as a number per dish.
    rooms, alone = g.get("names", np.arange(len(t_u))), g.get("alone", np.zeros(dishes, dtype=np.int64))
    counts, name = np.bincount(dish, weights=n, minlength=dishes) + alone, rooms[u]
    for k in range(steps):
        c0 = np.bincount(dish, weights=t, minlength=dishes).astype(np.int64) + alone
        step = stage * 100 + k
        # The root's share of a dish and a restaurant's weight of new tables are drawn from their laws; given these, the cells are independent.
        # The first step has no seating yet: there the share is that of the tokens.
        share = (_gamma(c0 - d0 * t0, wd, np.full(dishes, CONTEXTS + 2), step) / (s0 + g["C0"]) if k else counts / g.get("N", c_u.sum())) + fresh
        room = _gamma(s / d + t_u, rooms, rooms + CONTEXTS + 3, step)
        a = d * room[u] * share[dish]
        t = draw_tables(n, a, d, _uniform(w, name, stage * 100 + k))
        c0 = np.bincount(dish, weights=t, minlength=dishes).astype(np.int64) + alone
        a0 = np.full(dishes, (s0 + d0 * g["T0"]) * g["base"])
        t0 = draw_tables(c0, a0, d0, _uniform(wd, np.full(dishes, CONTEXTS), stage * 100 + k))
        if k >= steps - keep:
            part += (n - d * t) / (s + c_u[u]) / keep
            root += (c0 - d0 * t0) / keep
            customers += c0 / keep
    return t, t0, part, root, customers


def _lgamma(x):
    """log Gamma for arrays of positive numbers."""
    import numpy as np

    x = np.asarray(x, dtype=np.float64)
    small = np.maximum(8 - np.floor(x), 0).astype(int)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.where(k < small, np.log(x + k), 0.0)
    y = x + small
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _seating_weight(s: float, d: float, customers, tables, times=(1.0, 1.0)) -> float:
    """Log probability of restaurants' numbers of tables, less what does not depend on strength or discount. times: how many restaurants have each number of customers, and of tables."""
    import numpy as np

    c, t = np.asarray(customers, dtype=np.float64), np.asarray(tables, dtype=np.float64)
    m, k = (np.broadcast_to(np.asarray(x, dtype=np.float64), y.shape) for x, y in zip(times, (c, t), strict=True))
    c, m, t, k = c[c > 0], m[c > 0], t[t > 0], k[t > 0]  # who has customers has tables
    return float((k * (t * math.log(d) + _lgamma(s / d + t))).sum() - k.sum() * _lgamma([s / d])[0] - (m * _lgamma(s + c)).sum() + m.sum() * _lgamma([s])[0])


def draw_parameters(s: float, d: float, customers, tables, seats: dict[tuple[int, int], int], r: tuple[float, float], times=(1.0, 1.0)) -> tuple[float, float]:
    """Strength and discount of a level, each drawn from its conditional on a grid; the priors are exponential of mean 10 and uniform."""
    import numpy as np

    def pick(values, logs, u: float) -> float:
        p = np.cumsum(np.exp(np.array(logs) - max(logs)))
        return float(values[int((p < u * p[-1]).sum())])

    strengths = np.geomspace(*STRENGTHS)
    s = pick(strengths, [_seating_weight(x, d, customers, tables, times) - x / 10 + math.log(x) for x in strengths.tolist()], r[0])
    c, t = (np.array([k[i] for k in seats], dtype=np.int64) for i in range(2))
    n = np.array(list(seats.values()), dtype=np.float64)
    logs = [_seating_weight(s, x, customers, tables, times) + (float((n * _log_stirling.__wrapped__(x, TELLING)[c, t]).sum()) if len(c) else 0.0) for x in DISCOUNTS]
    return s, pick(DISCOUNTS, logs, r[1])


def _dishes(by: dict, out: _Sent, grid: Grid) -> None:
    """A task's dishes, each whole: cells of several customers and how many have one. Words before are in the order of their tasks, which answer in it."""
    import numpy as np

    w, u, n = _joined(by["dish"])
    words, at = np.unique(np.concatenate([_of_hashes(r["a"]) for r in by["single"]]), return_inverse=True)
    alone = np.bincount(at, weights=np.concatenate([_unpack(r["b"]) for r in by["single"]]), minlength=len(words)).astype(np.int64)
    dish = np.searchsorted(words, w)
    me = by["dish"][0]["to"]
    us, at = np.unique(u, return_inverse=True)
    order = np.lexsort((us, grid.task(us)))
    place = np.empty(len(us), np.int64)
    place[order] = np.arange(len(us))
    at = place[at]
    out.add(me, "dishes", me, _hashes(words), _small(np.bincount(dish, minlength=len(words))), _hashes(us[order]), _small(at), _small(n), _small(alone))
    out.add(me, "count", me, _hashes(words), _small(alone + np.bincount(dish, weights=n, minlength=len(words)).astype(np.int64)))
    _send_tables(out, grid, me, us[order], np.bincount(at, minlength=len(us)))


def _send_tables(out: _Sent, grid: Grid, me: int, us, tables) -> None:
    for task, k in _split(grid.task(us)):
        out.add(task, "tables", me, _hashes(us[k]), _pack(tables[k]))


def _histogram(out: _Sent, kind: str, x) -> None:
    import numpy as np

    values, n = np.unique(x, return_counts=True)
    out.add(-1, kind, 0, _pack(values), _pack(n))


def _rooms(by: dict, out: _Sent) -> None:
    """A task's words before: customers (each word is a word before as often as a word), and cells of one customer."""
    import numpy as np

    (r,) = by["count"]
    words, c = _of_hashes(r["a"]), _unpack(r["b"]).astype(np.int64)
    one = np.zeros(len(words), np.int64)
    for x in by["before"]:
        one[np.searchsorted(words, _of_hashes(x["a"]))] += _unpack(x["b"])
    out.add(r["to"], "rooms", r["to"], r["a"], r["b"], _small(one))
    _histogram(out, "customers", c)


def _all_tables(by: dict):
    """(words, customers, tables) of a task's restaurants."""
    import numpy as np

    (r,) = by["rooms"]
    words, c, t = _of_hashes(r["a"]), _unpack(r["b"]).astype(np.int64), _unpack(r["c"]).astype(np.float64)
    for x in by["tables"]:
        t[np.searchsorted(words, _of_hashes(x["a"]))] += _unpack(x["b"])
    return words, c, t


def _answers(by: dict, out: _Sent) -> None:
    """To each task of dishes, customers and tables of the restaurants that it has cells of."""
    import numpy as np

    words, c, t = _all_tables(by)
    t = np.rint(t).astype(np.int64)
    for x in by["tables"]:
        at = np.searchsorted(words, _of_hashes(x["a"]))
        out.add(x["src"], "answer", x["to"], _small(c[at]), _small(t[at]))
    _histogram(out, "histogram", t)


def _seat(by: dict, out: _Sent, grid: Grid, g: dict, steps: int, keep: int, stage: int, last: bool) -> None:
    """Seats a task's dishes, some CELLS cells at a time; tables by restaurant, and what the parameters need or, at last, what the scores do."""
    import numpy as np

    (r,) = by["dishes"]
    words, k, us, at, n = _of_cells(r)
    alone = _unpack(r["f"]).astype(np.int64)
    c_u, t_u = (np.concatenate([_unpack(x[f]) for x in by["answer"]] or [np.zeros(0)]).astype(np.float64) for f in "ab")
    ends = np.cumsum(k)
    dish = np.repeat(np.arange(len(words)), k)
    own, tables = np.zeros(len(n), np.float32), np.zeros(len(us))
    root, total = np.zeros(len(words)), np.zeros(3)
    side = TELLING + 1
    seats = [np.zeros(side * side, dtype=np.int64) for _ in range(2)]
    names = us.view(np.int64)
    i = 0
    while i < len(words):
        a = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, a + CELLS, side="right")))
        j = min(j, i + CELLS, len(words))
        b = int(ends[j - 1])
        some, u = np.unique(at[a:b], return_inverse=True)
        here = g | {"words": words[i:j].view(np.int64), "alone": alone[i:j], "names": names[some], "c_u": c_u[some], "t_u": t_u[some]}
        t, t0, part, roots, customers = _seated(here["words"][dish[a:b] - i], dish[a:b] - i, u, n[a:b], here, steps, keep, stage)
        if last:
            mine = part * (g["s"] + here["c_u"][u])
            own[a:b], root[i:j] = mine, roots
            t = (n[a:b] - mine) / g["d"]
            total += (roots.sum(), customers.sum(), 0)
        else:
            c0 = np.bincount(dish[a:b] - i, weights=t, minlength=j - i).astype(np.int64) + alone[i:j]
            total += (t0.sum(), c0.sum(), 0)
            for x, (customers, taken) in enumerate(((n[a:b], t), (c0, t0))):
                few = customers <= TELLING
                seats[x] += np.bincount(customers[few] * side + taken[few], minlength=side * side)
        tables += np.bincount(at[a:b], weights=t, minlength=len(us))
        i = j
    _send_tables(out, grid, r["to"], us, tables)
    out.add(-1, "total", r["to"], _pack(total), *(_pack(x) for x in seats))
    if last:
        out.add(r["to"], "root", r["to"], _pack(root))
        sub = grid.block(np.zeros(1, np.uint64), us)[at]
        row = r["to"] // grid.side * grid.side
        # Blocks have a task's cells in the same order.
        order = np.lexsort((us[at], dish))
        for x, rest in _split(sub[order]):
            out.add(row + x, "own", r["to"], _pack(own[order][rest]))


def _words(by: dict, out: _Sent, grid: Grid, g: dict) -> None:
    """A task's words with count, weight of the root and share of the root; and these to the blocks that have them."""
    import numpy as np

    words, c, t = _all_tables(by)
    weight = (g["s"] + g["d"] * t) / (g["s"] + c)
    root = _unpack(by["root"][0]["a"]) / (g["s0"] + g["customers"]) + g["unknown"] / g["v"]
    me = by["rooms"][0]["to"]
    out.add(me, "words", me, by["rooms"][0]["a"], by["rooms"][0]["b"], _pack(weight), _pack(root))
    for kind, rows, x in (("restaurant", by["before"], weight), ("share", by["single"], root)):
        for r in rows:
            at = np.searchsorted(words, _of_hashes(r["a"]))
            out.add(r["src"], kind, me, _small(c[at]), _pack(x[at].astype(np.float32)))


class Model:
    """Tables of packed vectors (cells by block, words by task) and the numbers all share."""

    def __init__(self, grid: Grid, cells: DataFrame | None, words: DataFrame | None, g: dict, n: int, v: int):
        self.grid, self.cells, self.words, self.g, self.n, self.v = grid, cells, words, g, n, v


def _discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def _summed(rows: DataFrame, kind: str):
    """A histogram from its parts: as many values as there are different numbers."""
    import numpy as np

    got = rows.filter(F.col("kind") == kind).select("a", "b").collect()
    values, at = np.unique(np.concatenate([_unpack(bytes(r["a"])) for r in got]), return_inverse=True)
    return values, np.bincount(at, weights=np.concatenate([_unpack(bytes(r["b"])) for r in got]))


def _by_kind(df: DataFrame, name: str) -> Callable[[str], DataFrame]:
    """Written with a folder for each kind, to be read or removed by itself."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)

    def of(kind: str) -> DataFrame:
        out = spark.read.schema(df.schema).option("basePath", path).parquet(f"{path}/kind={kind}").select(*df.columns)
        out._lorekeep_path = f"{path}/kind={kind}"
        return out

    return of


def _only(rows: DataFrame, *kinds: str) -> DataFrame:
    return rows.filter(F.col("kind").isin(*kinds))


def _freed(spark) -> None:
    """Shuffled files of jobs that are over go when the driver's garbage does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def train(texts: DataFrame) -> Model:
    """The model of a table (text)."""
    import numpy as np

    spark = texts.sparkSession
    texts = texts.select(text_of(texts).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0]
    grid = Grid(size or 0)
    if not size:
        return Model(grid, None, None, {"unknown": 0.5, "s": 1.0, "d": 0.5}, 0, 0)
    pairs = map_batches(texts, partial(_pairs, grid=grid, rows=False), FORM)
    cells = _by_kind(_exchanged(pairs, partial(_block, grid=grid)), "cells")
    _freed(spark)
    dishes = written(_exchanged(cells("dish").union(cells("single")), partial(_dishes, grid=grid)), "dishes")
    rooms = written(_exchanged(cells("before").union(_only(dishes, "count")), _rooms), "rooms")
    values, times = _summed(rooms, "customers")
    n, v = int((values * times).sum()), int(times.sum())
    answers = written(_exchanged(_only(rooms, "rooms").union(_only(dishes, "tables")), _answers), "answers")
    tables, tables_times = _summed(answers, "histogram")
    # At first each cell has one table.
    once, twice = (int(times[values == k].sum()) for k in (1, 2))
    g = {"d": 0.5, "d0": _discount(once, twice), "s": 1.0, "s0": 1.0, "C0": float((tables * tables_times).sum()), "T0": float(v), "base": 0.5 / v, "N": float(n), "v": v}
    for k in range(ROUNDS + 1):
        last = k == ROUNDS
        steps, keep = (BURN_IN + SAMPLES, SAMPLES) if last else (BURN_IN, 1)
        seats = written(_exchanged(_only(dishes, "dishes").union(answers.filter("kind = 'answer'")), partial(_seat, grid=grid, g=g, steps=steps, keep=keep, stage=k, last=last)), "seats")
        totals = _only(seats, "total").select("a", "b", "c").orderBy("src").collect()
        total = sum(_unpack(bytes(r["a"])) for r in totals)
        dropped(answers)
        if last:
            break
        answers = written(_exchanged(_only(rooms, "rooms").union(_only(seats, "tables")), _answers), "answers")
        tables, tables_times = _summed(answers, "histogram")
        dropped(seats)
        side = TELLING + 1
        taken = []
        for f in "bc":
            x = sum(_unpack(bytes(r[f])) for r in totals)
            taken.append({(int(i) // side, int(i) % side): int(x[i]) for i in np.flatnonzero(x)})
        g = g | {"C0": float(total[1]), "T0": float(total[0])}
        chance = _uniform(np.arange(4), np.full(4, CONTEXTS + 1), k).tolist()
        g["s"], g["d"] = draw_parameters(g["s"], g["d"], values, tables, taken[0], (chance[0], chance[1]), (times, tables_times))
        g["s0"], g["d0"] = draw_parameters(g["s0"], g["d0"], np.array([g["C0"]]), np.array([g["T0"]]), taken[1], (chance[2], chance[3]))
    # What the averaged counts leave is the mass of new tables: so every restaurant's probabilities sum to one.
    g = g | {"customers": float(total[1]), "unknown": 0.5 * (1.0 - float(total[0]) / (g["s0"] + float(total[1])))}
    asked = _only(rooms, "rooms").union(_only(seats, "tables", "root")).union(cells("before")).union(cells("single"))
    words = written(_exchanged(asked, partial(_words, grid=grid, g=g)), "words")
    dropped(rooms, dishes, cells("before"), cells("single"), cells("dish"))
    _freed(spark)
    blocks = cells("cells").union(_only(seats, "own")).union(_only(words, "restaurant", "share"))
    return Model(grid, blocks, _only(words, "words"), g, n, v)


def _by_chunk(out: _Sent, me: int, kind: str, chunk: int, known, base, score) -> None:
    import numpy as np

    out.add(me, kind, chunk, _small(known.astype(np.int64)), _pack(base), _pack(score.astype(np.float32)))


def _score(by: dict, out: _Sent, grid: Grid, g: dict, whole: float) -> None:
    """Sums over a block's cells by text; words and words before of pairs that are not cells go to their tasks."""
    import numpy as np

    for r in by["head"]:
        out.add(r["to"], "head", r["src"], r["a"], r["b"], r["c"], r["d"])
    if by["cells"]:
        (r,) = by["cells"]
        words, k, us, at, n = _of_cells(r)
        word = np.repeat(np.arange(len(words)), k)
        own = (n - g["d"]).astype(np.float32)
        task = grid.task(words)[word]
        for x in by["own"]:
            own[np.flatnonzero((n > 1) & (task == x["src"]))] = _unpack(x["a"])

        def told(kind, h):
            order = np.lexsort((h, grid.task(h)))
            a, b = (np.concatenate([_unpack(x[f]) for x in by[kind]]).astype(np.float64) for f in "ab")
            c, y = np.empty(len(h)), np.empty(len(h))
            c[order], y[order] = a, b
            return c, y

        (c_u, weight), (c, root) = told("restaurant", us), told("share", words)
        p = np.log10(own / (g["s"] + c_u[at]) + weight[at] * root[word]).astype(np.float32).astype(np.float64)
        base, cell = np.log10((c + 0.1) / whole), word * len(us) + at
    missing = []
    for number, r in enumerate(by["query"]):
        qw, qk, qu, qat, qn = _of_cells(r)
        rows = _unpack(r["f"]).astype(np.int64)
        m = int(rows.max()) + 1
        if by["cells"]:
            wi, ui = np.searchsorted(words, qw), np.searchsorted(us, qu)
            w_in, u_in = words[np.minimum(wi, len(words) - 1)] == qw, us[np.minimum(ui, len(us) - 1)] == qu
            wi, w_in = np.repeat(wi, qk), np.repeat(w_in, qk)
            key = np.where(w_in & u_in[qat], wi * len(us) + ui[qat], -1)
            place = np.minimum(np.searchsorted(cell, key), len(cell) - 1)
            found = cell[place] == key
            hit = np.repeat(found, qn)
            mine, pair = rows[hit], np.repeat(place[found], qn[found])
            _by_chunk(out, r["to"], "sums", r["src"], np.bincount(mine, minlength=m), np.bincount(mine, weights=base[word[pair]], minlength=m), np.bincount(mine, weights=p[pair], minlength=m))
        else:
            found, hit = np.zeros(len(qn), bool), np.zeros(len(rows), bool)
        if not found.all():
            lost = ~found
            n = qn[lost]
            missing.append((np.repeat(np.repeat(qw, qk)[lost], n), np.repeat(qu[qat[lost]], n), np.full(int(n.sum()), number), rows[~hit]))
    if missing:
        w, u, chunk, rows = (np.concatenate(x) for x in zip(*missing, strict=True))
        chunks = np.array([r["src"] for r in by["query"]])
        for kind, h in (("lost word", w), ("lost before", u)):
            for task, k in _split(grid.task(h)):
                k = k[np.lexsort((rows[k], chunk[k], h[k]))]
                some, i = np.unique(chunk[k], return_inverse=True)
                out.add(task, kind, by["query"][0]["to"], _hashes(h[k]), _small(i), _small(rows[k]), _pack(chunks[some]))


def _lost(by: dict, out: _Sent, g: dict, whole: float) -> None:
    """Of pairs that are not cells: the weight of the root after the word before, and the share of the word in the root, by text."""
    import numpy as np

    words = np.zeros(0, np.uint64)
    c = weight = root = np.zeros(0)
    if by["words"]:
        (r,) = by["words"]
        words, c, weight, root = _of_hashes(r["a"]), *(_unpack(r[f]).astype(np.float64) for f in "bcd")
    c, weight = np.append(c, 0.0), np.append(weight, 1.0)
    root = np.append(root, g["unknown"])
    parts = []
    for kind in ("lost word", "lost before"):
        for r in by[kind]:
            h, chunk = _of_hashes(r["a"]), _unpack(r["d"])[_unpack(r["b"])]
            at = np.searchsorted(words, h)
            if len(words):
                at = np.where(words[np.minimum(at, len(words) - 1)] == h, at, len(words))
            if kind == "lost word":
                parts.append((chunk, _unpack(r["c"]).astype(np.int64), c[at] > 0, np.log10((c[at] + 0.1) / whole), np.log10(root[at])))
            else:
                parts.append((chunk, _unpack(r["c"]).astype(np.int64), np.zeros(len(at)), np.zeros(len(at)), np.log10(weight[at])))
    if not parts:
        return
    chunk, rows, known, base, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    me = next(r["to"] for rs in by.values() for r in rs)
    for x, k in _split(chunk):
        _by_chunk(out, me, "lost", x, *(np.bincount(rows[k], weights=y[k].astype(np.float64)) for y in (known, base, score)))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _texts(table: pa.Table, n: int) -> pa.Table:
    """The texts of a chunk with the sums over all blocks."""
    import numpy as np

    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["to"]))
    (head,) = (r for r in rows if r["kind"] == "head")
    ids, held, length, empty = (_unpack(head[f]) for f in "abcd")
    total = [np.zeros(len(ids)) for _ in range(3)]
    for r in rows:
        if r["kind"] != "head":
            for f, x in zip("abc", total, strict=True):
                y = _unpack(r[f])
                x[: len(y)] += y
    columns = [pa.array(ids, mask=empty.astype(bool)), pa.array(held.astype(bool)), pa.array(length.astype(np.int64)), pa.array(total[0].astype(np.int64)), pa.array(np.full(len(ids), n, np.int64)), pa.array(total[1]), pa.array(total[2])]
    return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def scored(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text; held_out is a condition on docs."""
    whole, grid, n = model.n + 0.1 * (model.v + 1), model.grid, model.n
    rows = docs.select(text_of(docs).alias("text"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"))
    asked = map_batches(rows, partial(_pairs, grid=grid, rows=True), FORM)
    if model.cells is not None:
        asked = asked.union(model.cells)
    g = {k: model.g[k] for k in ("s", "d", "unknown")}
    sums = written(_exchanged(asked, partial(_score, grid=grid, g=g, whole=whole)), "sums")
    lost = _only(sums, "lost word", "lost before")
    if model.words is not None:
        lost = lost.union(model.words)
    lost = _exchanged(lost, partial(_lost, g=g, whole=whole))
    return _only(sums, "head", "sums").union(lost).groupBy("src").applyInArrow(lambda table: _texts(table, n), RESULT)


def perplexity(rows: DataFrame) -> DataFrame:
    """(held_out, n_tokens, base_perplexity, perplexity) of scored texts."""
    by = rows.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("base_score").alias("b"), F.sum("score").alias("s"))
    return by.select("held_out", "n_tokens", F.pow(F.lit(10.0), -F.col("b") / F.col("n_tokens")).alias("base_perplexity"), F.pow(F.lit(10.0), -F.col("s") / F.col("n_tokens")).alias("perplexity"))


def op9_pitman_yor(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder(docs["doc_id"], 10) == 0
    texts = docs.filter(~held_out).select(text_of(docs).alias("text"))
    return scored(docs, train(texts), held_out)
