"""SimHash, near copies, repeated passages, decontamination and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest
import xxhash

from lorekeep.llm import decontaminate, graph, near_copies, simhash, substring

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "null id"), (4, "twice twice"), (4, "twice twice"), (5, "word " * 30_000), (6, "Two Words")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 3, "k") for i, t in rows], "doc_id long, text string, fp long, key string")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)


@pytest.mark.parametrize("bucket", [64, 2])
def test_simhash_components(spark, bucket):
    rng = random.Random(1)
    voc = [f"w{k}" for k in range(200)]
    rows = list(ODD)
    for f in range(12):
        base = [rng.choice(voc) for _ in range(400)]
        for c in range(8):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(voc)
            rows.append((100 + f * 10 + c, " ".join(w)))
    got = simhash.grouped(frame(spark, rows), bucket=bucket).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted((str(r["doc_id"]), r["fp"]) for r in got) == sorted((str(i), signed(f)) for i, f in fps)
    sets = Sets()
    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if a is not None and b is not None and (x ^ y).bit_count() <= 2:
                sets.join(a, b)
    assert all(r["component_id"] == sets.find(r["doc_id"]) for r in got if r["doc_id"] is not None)


def test_simhash_links_in_large_buckets(spark):
    rng = random.Random(2)
    values = set()
    for _ in range(3):
        base = rng.getrandbits(64)
        for _ in range(120):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(signed(x),) for x in values], "fp long")
    for bucket in (64, 3):
        sets = Sets()
        for i, x in enumerate(values):
            for y in values[:i]:
                if (x ^ y).bit_count() <= 2:
                    sets.join(signed(x), signed(y))
        got = {r["node"]: r["root"] for r in graph.components(simhash.links(df, bucket)).collect()}
        assert all(got.get(signed(x), signed(x)) == sets.find(signed(x)) for x in values)


def test_components_of_a_long_path(spark):
    n = 200
    order = list(range(n))
    random.Random(4).shuffle(order)
    e = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(e).collect()}
    assert got == dict.fromkeys(range(n), 0)
    assert graph.components(e.limit(0)).count() == 0


def test_components_of_hubs(spark):
    """Stars whose centres are joined on their own, bound in a chain."""
    e = [(1000 * c, 1000 * c + k) for c in range(1, 5) for k in range(1, 60)] + [(1000 * c + 7, 1000 * c + 1009) for c in range(1, 4)] + [(9001, 9000)]
    df = spark.createDataFrame(e, "a long, b long")
    want = {x: 9000 if x >= 9000 else 1000 for p in e for x in p}
    for hub in (5, 10**6):
        assert {r["node"]: r["root"] for r in graph.components(df, hub).collect()} == want


def test_hot_fingerprints_change_nothing(spark):
    rows = [(i, "") for i in range(60)] + [(100 + i, f"text number {i} of some words") for i in range(20)] + [(None, "")]
    plain, hot = (sorted(map(str, simhash.grouped(frame(spark, rows), hot=h).collect())) for h in (10**6, 5))
    assert plain == hot and simhash.grouped(frame(spark, [])).count() == 0


def shingles(t, n=5):
    w = (t or "").lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))


def test_near_copies_are_found_and_others_left(spark):
    rng = random.Random(5)
    voc = [f"word{k}" for k in range(5000)]
    rows = []
    for f in range(40):
        base = [rng.choice(voc) for _ in range(200)]
        for c in range(4):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(200)] = rng.choice(voc)
            rows.append((f * 10 + c, " ".join(w)))
    rows += [(1000 + k, " ".join(rng.choice(voc) for _ in range(150))) for k in range(60)] + [(2000 + k, t) for k, (_, t) in enumerate(ODD)]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.grouped(frame(spark, rows)).collect()}
    sets, text = [shingles(t) for _, t in rows], [i for i, _ in rows]
    pairs = [(a, b, len(x & y) / len(x | y)) for i, (a, x) in enumerate(zip(text, sets, strict=True)) for b, y in zip(text[:i], sets[:i], strict=True)]
    near = [(a, b) for a, b, j in pairs if j >= 0.85]
    assert near and sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near)
    assert not [1 for a, b, j in pairs if j < 0.3 and got[a] == got[b] and a // 10 != b // 10]
    assert all(got[1000 + k] == 1000 + k for k in range(60))


def brute_components(rows):
    """Least id of each text's component, by SimHash and by all pairs of shingle sets."""
    sets, prints, found = [shingles(t) for _, t in rows], [plain_fingerprint(t) for _, t in rows], Sets()
    near = []
    for i, (a, _) in enumerate(rows):
        for k in range(i):
            both = len(sets[i] & sets[k])
            if both >= 0.8 * (len(sets[i]) + len(sets[k]) - both) - 1e-9:
                near.append((rows[k][0], a))
            elif (prints[i] ^ prints[k]).bit_count() > 2:
                continue
            found.join(a, rows[k][0])
    return {i: found.find(i) for i, _ in rows}, near


def edited(rng, words, n):
    w = list(words)
    for k in range(n):
        at = rng.randrange(len(w) // n) + k * (len(w) // n)
        w[at] = f"new{rng.randrange(10**9)}"
    return w


@pytest.mark.parametrize("tile", [1024, 16])
def test_near_copies_of_templated_texts_are_found_in_large_blocks(spark, tile):
    """Texts of one template share every block; each has a copy that it resembles, and neither resembles the rest."""
    rng = random.Random(15)
    template = [f"t{k}" for k in range(300)]
    rows = []
    for f in range(120):
        one = edited(rng, template, 6)
        rows += [(2 * f, " ".join(one)), (2 * f + 1, " ".join(edited(rng, one, 6)))]
    want, near = brute_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.grouped(frame(spark, rows), tile=tile).collect()}
    assert len(near) >= 60 and len(set(want.values())) > 60
    assert got == want


def test_near_copies_are_decided_on_the_shingles(spark):
    """Pairs about the limit: the estimate of a good number of them is on the other side of it."""
    rng = random.Random(16)
    rows = []
    for f in range(150):
        base = [f"f{f}w{k}" for k in range(220)]
        rows += [(2 * f, " ".join(base)), (2 * f + 1, " ".join(edited(rng, base, 4 + f % 3)))]
    rows += [(900, "a a a a a"), (901, "a a a a a a")]
    want, near = brute_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.grouped(frame(spark, rows)).collect()}
    assert 40 <= len(near) <= 120
    assert got == want


def as_documents(spark, rows):
    return spark.createDataFrame([(i, t, "k", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, h1 string, root long")


def test_one_row_of_each_component(spark):
    long = [" ".join(f"{x}{k}" for k in range(100)) for x in "abcde"]
    rows = [(1, long[0]), (1, long[1]), (2, long[0] + " tail"), (None, long[0]), (None, long[2]), (None, long[2]), (3, long[3]), (3, long[3]), (None, long[4]), (9, long[4] + " end"), (10, None), (11, ""), (12, " ")]
    docs = as_documents(spark, rows)
    out = near_copies.one_of_each(docs)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == docs.columns
    kept = sorted((r[0] or 0, r[1] or "") for r in got)
    # Texts that share an id are documents of their own; a null id goes before a named copy; equal rows leave one.
    assert kept == sorted([(1, long[0]), (1, long[1]), (0, long[2]), (3, long[3]), (9, long[4] + " end"), (10, "")])
    assert {r[3] for r in got if r[0] == 3} == {6} and {r[3] for r in got if r[1] == long[2]} == {4}
    assert near_copies.one_of_each(docs.limit(0)).count() == 0
    assert near_copies.grouped(docs.limit(0)).count() == 0


def plain_removal(rows, window=20):
    """A document is an id with its text; those of one id go by a hash of the text that no test depends on."""
    words = {}
    for i, t in rows:
        words[i is not None, i or 0, t or ""] = (t or "").encode().split()
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), (i, j))
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] != (i, j):
                gone |= set(range(j, j + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def passages():
    rng = random.Random(6)
    free = lambda n: [f"x{rng.randrange(10**6)}" for _ in range(n)]
    shared = [free(60) for _ in range(3)]
    rows = []
    for i in range(150):
        w = free(rng.randrange(60))
        for s in shared:
            if rng.random() < 0.4:
                a = rng.randrange(20)
                w += s[a : a + rng.randrange(15, 45)] + free(rng.randrange(20))
        rows.append((400 + i, " ".join(w)))
    rows += [(200 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(15, 90)))) for i in range(30)]
    rows += [(300 + i, "same " * 50) for i in range(5)]
    return rows


@pytest.mark.parametrize("how", [{}, {"parts": 3, "held": 40}, {"most": 10}, {"most": 3, "held": 7, "parts": 5}])
def test_repeated_passages(spark, how):
    rows = passages() + [(1000 + k, t) if i is not None and i != 4 else (i, t) for k, (i, t) in enumerate(ODD) if i != 5] + [(1005, "word " * 3000)]
    rng = random.Random(7)
    rng.shuffle(rows)
    got = substring.without_repeats(frame(spark, rows).repartition(7), **how).collect()
    want = plain_removal(rows)
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault((i is not None, i or 0), t or "")
    for r in got:
        i = (r["doc_id"] is not None, r["doc_id"] or 0)
        assert (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) == want[*i, texts[i]], i


def test_rows_without_an_id_are_documents_of_their_own(spark):
    """Marks of one row do not reach another that has the same id, or none."""
    once = " ".join(f"u{k}" for k in range(60))
    twice = " ".join([f"v{k % 30}" for k in range(60)])
    for one, two in ((None, None), (7, 7)):
        got = {r["n_words"]: r for r in substring.without_repeats(frame(spark, [(one, once + " z"), (two, twice), (8, "x"), (8, "x")])).collect()}
        assert got[61]["n_removed"] == 0 and got[61]["kept"] == once + " z"
        assert got[60]["n_removed"] == 30 and got[1]["n_removed"] == 0
    # Equal rows are one document: the repeated half goes from both. A passage in two texts of one id stays in one of them.
    got = substring.without_repeats(frame(spark, [(7, twice), (7, twice), (9, once + " a"), (9, once + " b")])).collect()
    assert [r["n_removed"] for r in got if r["doc_id"] == 7] == [30, 30]
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 9) == [0, 60]


def test_repeated_passages_of_an_empty_table(spark):
    assert substring.without_repeats(frame(spark, [])).count() == 0


def item(rng, n):
    w = [f"q{rng.randrange(3000)}" for _ in range(n)]
    return " ".join(w[: n - 6]).capitalize() + ". " + " ".join(w[n - 6 :]).capitalize() + "."


def test_decontamination_finds_items_and_nothing_else(spark):
    rng = random.Random(8)
    items = [(k, item(rng, rng.randrange(12, 90))) for k in range(60)] + [(900, None), (901, ""), (902, "one two")]
    free = lambda n: " ".join(f"q{rng.randrange(3000)}" if rng.random() < 0.3 else f"z{rng.randrange(500)}" for _ in range(n))
    rows, want = list(ODD), set()
    for i in range(200):
        t = free(rng.randrange(10, 300))
        if i % 3 == 0:
            k, x = items[rng.randrange(60)]
            t = t + " " + (x if i % 2 else x.upper().replace(".", " !")) + "\n" + free(50)
            want.add((100 + i, k))
        rows.append((100 + i, t))
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    assert got == want
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == len(rows) - len({d for d, _ in want})
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def passages_of(index, words):
    n = len(words)
    return [words[p * index.length : (p + 2) * index.length] for p in range(max(1, -(-n // index.length)))]


def brute_matches(texts, items):
    """Every text against every item, passage by passage, without an index."""
    out = {}
    for index in decontaminate.indexes(items):
        for x, impact in zip(index.items, index.impact, strict=True):
            share = {t: impact[k] for t, k in index.term.items() if k in impact}
            for d, text in enumerate(texts):
                for part in passages_of(index, decontaminate.words_of(text)):
                    score = sum(v for t, v in share.items() if t in set(part))
                    found = {b" ".join(part[i : i + n]) for n in {5, len(x.words)} if n <= 5 for i in range(len(part) - n + 1)}
                    whole, question, answer = x.overlaps(found)
                    if score >= decontaminate.THRESHOLD and whole >= 0.8 and question >= 0.5 and answer >= 0.5:
                        out[d, x.id] = max(out.get((d, x.id), (0.0,) * 4), (whole, score, question, answer))
    return out


def test_rows_against_brute_force(spark):
    rng = random.Random(18)
    voc = [f"t{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(voc) for _ in range(rng.randrange(3, 70))).capitalize() + ". " + " ".join(rng.choice(voc) for _ in range(rng.randrange(1, 9)))) for k in range(70)]
    texts = []
    for _ in range(60):
        w = [rng.choice(voc) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            x = items[rng.randrange(70)][1].split()
            for _ in range(rng.randrange(4)):
                x[rng.randrange(len(x))] = rng.choice(voc)
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        texts.append(" ".join(w))
    docs = frame(spark, list(enumerate(texts)))
    got = {(r["doc_id"], r["item_id"]): (r["overlap"], r["score"], r["question_overlap"], r["answer_overlap"]) for r in decontaminate.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_matches([t.encode() for t in texts], items)
    assert len(want) > 20 and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    assert decontaminate.matches(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_many_shards_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(19)
    items = spark.createDataFrame([(k, item(rng, rng.randrange(12, 40))) for k in range(40)] + [(None, "no id at all here. but five words more")], "item_id long, text string")
    docs = frame(spark, [(r["item_id"], "before " + r["text"] + " after") for r in items.collect()])
    one = sorted(map(str, decontaminate.matches(docs, items).select("doc_id", "item_id").collect()))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 400)
    monkeypatch.setattr(decontaminate, "SHARDS", 2)
    assert sorted(map(str, decontaminate.matches(docs, items).select("doc_id", "item_id").collect())) == one and len(one) == 41
    assert decontaminate.clean(docs, items).count() == 0


def test_block_bounds_lose_no_item():
    """All passages that score enough are candidates, and passages and blocks are passed over."""
    rng = random.Random(9)
    for voc, n in ((60, 80), (4000, 300)):
        rows = [(k, " ".join(f"t{min(rng.randrange(voc), rng.randrange(voc))}" for _ in range(25))) for k in range(n)]
        (index,) = decontaminate.indexes(rows)
        texts = [[f"t{min(rng.randrange(voc), rng.randrange(voc))}".encode() for _ in range(n)] for n in (250, 0, 350)]
        texts.append(rows[7][1].encode().split() + texts[0][:30])
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        found = set(index.candidates([w for t in texts for w in t], bounds))
        for d, t in enumerate(texts):
            for p, part in enumerate(passages_of(index, t)):
                have = {index.term.get(w) for w in part}
                for k, impact in enumerate(index.impact):
                    if sum(v for t, v in impact.items() if t in have) >= decontaminate.THRESHOLD:
                        assert (d, p, k) in found
        if voc > 1000:
            assert index.seen["pivots"] < index.seen["passages"] and index.seen["opened"] < index.seen["blocks"]
            assert any(d == 3 for d, _, _ in found)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    from lorekeep.llm import bpe, surrogates

    key = surrogates.session_key(spark)

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        by[name] = out.collect()
        if name != "tokens":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(by[name], docs.schema)
    kept = {r["doc_id"] for r in by["quality rules"]}
    assert 0 < len(kept) < len(rows)
    one = {r["doc_id"] for r in by["near copies"]}
    texts = {}
    for i in sorted(kept):
        texts.setdefault(rows[i].lower(), i)
    assert one <= set(texts.values())
    items = [decontaminate.Item(k, t.encode()) for k, t in ((r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())]
    bad = {i for i in one for x in items if x.overlaps(set(decontaminate.shingles(decontaminate.words_of(rows[i].encode()))))[0] >= 0.9}
    clean = {r["doc_id"] for r in by["decontamination"]}
    assert bad and not bad & clean and len(one - clean) <= len(bad) + 2
    private = {r["doc_id"]: r["text"] for r in by["personal data"]}
    assert set(private) == clean
    assert all(private[i] == surrogates.replaced(rows[i], key)[0] for i in clean)
    coder = bpe.Coder(bpe.model_text())
    ids = dict(zip(private, coder.encode_batch(list(private.values())), strict=True))
    for r in by["tokens"]:
        want = np.array(ids[r["doc_id"]], "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(private[r["doc_id"]].encode()).hexdigest()
    assert {r["doc_id"] for r in by["tokens"]} == clean


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as cp

    long = " ".join(f"word{k}" for k in range(400))
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2) for i, t in [*ODD, (50, long), (50, long), (None, long + " tail"), (51, long)]], "doc_id long, text string, lang string, source string, n_chars long, n_words long")
    for _, stage in cp.STAGES:
        rows = stage(spark, docs, SF).collect()
        docs = spark.createDataFrame(rows, stage(spark, docs, SF).schema) if rows else docs.limit(0)
    # The odd texts are too short or repeat one word; of the four alike the least id is left.
    assert [r["doc_id"] for r in rows] == [50] and rows[0]["n_tokens"] > 400
