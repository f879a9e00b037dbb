"""Quality rules, quality model and language model against plain versions, and their odd inputs."""

from __future__ import annotations

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import pitman_yor, quality_model, quality_rules
from lorekeep.llm.common import remainder

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "null id"), (4, "twice twice"), (4, "twice twice"), (5, "word " * 30_000), (6, "é ü \x0b x\x85y")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1.5) for i, t in rows], "doc_id long, text string, n_words string, score double")


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(tri)
    covered = set()
    for i, x in enumerate(tri):
        if n[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rules_against_plain_version(spark):
    texts = ["a b c a b c", "x y x y x y x", "one line\none line\n \nother", "a | b # c", "the quick brown fox " * 20, "a a a a", "b\n\nb\n", "A\tB\x0bC", "w " * 60]
    rows = [*ODD, *[(100 + k, t) for k, t in enumerate(texts)]]
    docs = frame(spark, rows)
    got = quality_rules.ledger(docs).collect()
    want = collections.Counter((i, *measured(t)) for i, t in rows)
    # The caller's row is whole, whatever its columns are named.
    assert collections.Counter(map(str, (r["row"] for r in got))) == collections.Counter(map(str, docs.collect()))
    assert collections.Counter((r["row"]["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want


def test_rules_on_an_empty_table(spark):
    assert quality_rules.apply_policy(quality_rules.ledger(frame(spark, []))).count() == 0


def test_policies_and_ablation_agree(spark):
    rows = quality_rules.ledger(frame(spark, [(1, "a"), (2, "word " * 60), (3, " ".join(f"word{k}" for k in range(60))), (4, " ".join(f"word{k} # # #" for k in range(60)))]))
    kept = {r["row"]["doc_id"] for r in quality_rules.apply_policy(rows).filter("kept").collect()}
    assert kept == {3}
    alone = {r["row"]["doc_id"]: r["only"] for r in rows.withColumn("only", quality_rules.only_rule(rows["failures"])).collect()}
    by = {r["rule"]: r["n_failed_alone"] for r in quality_rules.ablation(rows).collect()}
    assert alone[3] is None and collections.Counter(x for x in alone.values() if x) == {k: n for k, n in by.items() if n}
    by = {r["rule"]: r for r in quality_rules.ablation(rows).collect()}
    assert by["few_words"]["n_failed"] == 1 and by["symbols"]["n_failed"] >= 1
    for name, r in by.items():
        policy = tuple(x for x in quality_rules.POLICIES[quality_rules.CURRENT] if x != name)
        m = quality_rules.mask(policy)
        assert r["n_kept_without"] == sum(1 for x in rows.collect() if not x["failures"] & m)


def test_filter_on_the_verdict_stays_cheap(spark):
    kept = quality_rules.apply_policy(quality_rules.ledger(frame(spark, ODD))).filter("kept")
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_quality_model_learns_and_scores_all(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 90}" for k in range(60))) for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{k}!!###" for k in range(40))) for i in range(100)]
    docs = frame(spark, [*good, *bad, *[(5000 + k, t) for k, (_, t) in enumerate(ODD)]])
    labels = spark.createDataFrame([*[(i, 1, "en") for i, _ in good], *[(i, 0, "en") for i, _ in bad], (None, 1, "en"), (77777, 0, "en")], "doc_id long, quality int, lang string")
    w = quality_model.train(docs, labels)
    got = {r["doc_id"]: r for r in quality_model.scored(docs, w).collect()}
    assert len(got) == 408
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    right = [got[i]["predicted"] == (i < 1000) for i in held if i < 5000]
    assert sum(right) / len(right) > 0.95


def test_quality_model_without_training_rows(spark):
    docs = frame(spark, ODD)
    w = quality_model.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_model.scored(docs, w).collect()} == {0.5}


def plain_ftrl(rows, epochs=quality_model.EPOCHS):
    """Follow the regularised leader, coordinate by coordinate, from (features, label)."""
    alpha, beta, l1, l2 = quality_model.ALPHA, quality_model.BETA, quality_model.L1, quality_model.L2
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v, w in [(i, v, weight(i)) for i, v in x.items()]:
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_quality_model_against_brute_force(spark):
    """Labels in the order of their hash, one text each: ids that repeat, ties and orders of arrival change nothing."""
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(5 + i % 7))) for i in range(60)] + [(7, "a second text of seven"), (8, None)]
    labels = [(i, i % 2) for i in range(60)] + [(3, 1), (3, 0), (9, 5), (None, 1)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    w = quality_model.train(docs, marks)
    again = quality_model.train(docs.repartition(5).orderBy(F.desc("text")), marks.repartition(3))
    assert (w == again).all()
    at = {(r["doc_id"], r["quality"]): r["at"] for r in marks.select("doc_id", "quality", F.xxhash64("doc_id", "quality").alias("at")).collect() if r["doc_id"] is not None}
    used = sorted({(at[k], *k) for k in labels if k[0] is not None and k[1] in (0, 1) and zlib.crc32(str(k[0]).encode()) % 4 != 2})
    import numpy as np

    known, train = quality_model._Tokens(), []
    for _, i, y in used:
        text = min((t or "").encode() for k, t in rows if k == i)
        idx, val = quality_model.features(text, known)
        train.append(({**dict(zip(idx.tolist(), val.astype(np.float32).astype(float).tolist(), strict=True)), 1 << quality_model.BITS: 0.3}, y))
    plain = plain_ftrl(train)
    assert {i for i, x in plain.items() if abs(x) > 1e-9} == set(w.nonzero()[0].tolist())
    assert all(w[i] == pytest.approx(x, abs=1e-9) for i, x in plain.items())
    got = {r["doc_id"]: r["score"] for r in quality_model.scored(docs, w).collect() if r["doc_id"] == 11}
    idx, val = quality_model.features(rows[11][1].encode(), known)
    dot = sum(plain.get(i, 0.0) * v for i, v in zip(idx.tolist(), val.tolist(), strict=True)) + 0.3 * plain[1 << quality_model.BITS]
    assert got[11] == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-6)
    assert quality_model.scored(docs.limit(0), w).count() == 0


def test_training_rows_are_bounded(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    few = quality_model.train(docs, labels, max_train=5)
    assert (few != 0).sum() <= 5 * 20


@pytest.mark.parametrize("dense", [3, 65_536])
def test_language_model_base_scores(spark, monkeypatch, dense):
    monkeypatch.setattr(pitman_yor, "DENSE", dense)
    rows = [*[(i, " ".join(f"w{(i * 3 + k * k) % 40}" for k in range(i % 25))) for i in range(120)], *[(1000 + k, t) for k, (_, t) in enumerate(ODD)]]
    docs = frame(spark, rows)
    held = remainder(docs["doc_id"], 10) == 0
    model = pitman_yor.train(docs.filter(~held))
    got = {r["doc_id"]: r for r in pitman_yor.scored(docs, model, held).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in rows}
    out = {i for i in tokens if zlib.crc32(str(i).encode()) % 10 == 0}
    c = collections.Counter(w for i, x in tokens.items() if i not in out for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(x), sum(c[w] > 0 for w in x), n, i in out)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), rel=1e-9)
        assert r["score"] < 0


def test_language_model_is_a_distribution(spark):
    """The probabilities of all words after an end, the unknown one and the end included, sum to one."""
    import numpy as np

    texts = ["a b a c", "b a a", "c c b a", "a b"] * 5
    words = ["a", "b", "c", "zzz"]
    model = pitman_yor.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    probes = ["", *words, *[f"{x} {y}" for x in words for y in words]]
    df = spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string")
    p = {probes[r["doc_id"]]: 10 ** r["score"] for r in pitman_yor.scored(df, model, F.lit(False)).collect()}
    # p(w) = P(w) P(end | w) and p(x y) = P(x) P(y | x) P(end | y). With u_w = 1 / P(end | w), the row of x sums to one:
    # sum over y of p(x y) u_y / p(x), plus 1 / u_x, is 1; times u_x with P(x) = p(x) u_x that is linear in u.
    grid = np.array([[p[f"{x} {y}"] / p[x] for y in words] for x in words])
    u = np.linalg.solve(np.eye(4) - grid, np.ones(4))
    assert sum(p[w] * u[k] for k, w in enumerate(words)) + p[""] == pytest.approx(1.0, abs=1e-4)


def test_table_draws_follow_their_law():
    import numpy as np

    n, a, d = 6, 0.7, 0.4
    r = (np.arange(20_000) + 0.5) / 20_000
    t = pitman_yor.draw_tables(np.full(20_000, n), np.full(20_000, a), d, r)
    s = np.exp(pitman_yor._log_stirling(d)[n, 1 : n + 1]) * a ** np.arange(1, n + 1)
    assert np.bincount(t, minlength=n + 1)[1:] / 20_000 == pytest.approx(s / s.sum(), abs=1e-3)


@pytest.mark.parametrize(("c", "a", "d"), [(600, 500.0, 0.5), (2000, 500.0, 0.5), (600, 500.0, 0.8), (600, 3.0, 0.5), (2000, 20.0, 0.7), (2000, 40.0, 0.5), (1500, 0.01, 0.9)])
def test_table_draws_of_many_customers_follow_their_law(c, a, d):
    """Beyond the exact rows: against the whole row of Stirling numbers."""
    import numpy as np

    n = 4000
    logs = pitman_yor._log_stirling(d, 2000)[c, 1 : c + 1] + math.log(a) * np.arange(1, c + 1)
    p = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
    t = pitman_yor.draw_tables(np.full(n, c), np.full(n, a), d, (np.arange(n) + 0.5) / n)
    assert t.mean() == pytest.approx((p * np.arange(1, c + 1)).sum(), rel=2e-3)
    have = np.searchsorted(np.sort(t), np.arange(1, c + 1), side="right") / n
    assert abs(have - np.cumsum(p)).max() < 0.015


def test_parameters_follow_the_seating():
    """Tables of restaurants seated at a known strength and discount bring the draws near these."""
    import random

    rng = random.Random(5)
    s, d, rooms, seats = 20.0, 0.6, [], {}
    for _ in range(60):
        tables, dishes = [], []
        for i in range(400):
            if rng.random() < (s + d * len(tables)) / (s + i):
                tables.append(1)
                dishes.append(rng.randrange(5000))
            else:
                k = rng.choices(range(len(tables)), [x - d for x in tables])[0]
                tables[k] += 1
        rooms.append((400, len(tables)))
        by = {}
        for x, n in zip(dishes, tables, strict=True):
            c, t = by.get(x, (0, 0))
            by[x] = (c + n, t + 1)
        for ct in by.values():
            if ct[0] <= pitman_yor.TELLING:
                seats[ct] = seats.get(ct, 0) + 1
    import numpy as np

    c, t = (np.array(x) for x in zip(*rooms, strict=True))
    draws = [pitman_yor.draw_parameters(s, d, c, t, seats, (rng.random(), rng.random())) for _ in range(20)]
    assert 10 < np.mean([x for x, _ in draws]) < 35
    assert abs(np.mean([x for _, x in draws]) - d) < 0.08


def brute_gibbs(texts, s, d, s0, d0, base, burn, samples, seed):
    """The same model, one customer at a time: averaged probabilities of a word after a word."""
    import random

    rng = random.Random(seed)
    rooms, root, customers = {}, {}, []
    total = lambda tables: sum(map(len, tables.values()))

    def p_root(w):
        c = sum(sum(x) for x in root.values())
        own = sum(root.get(w, [])) - d0 * len(root.get(w, []))
        return (own + (s0 + d0 * total(root)) * base) / (s0 + c)

    def p(u, w):
        room = rooms.get(u, {})
        c = sum(sum(x) for x in room.values())
        own = sum(room.get(w, [])) - d * len(room.get(w, []))
        return (own + (s + d * total(room)) * p_root(w)) / (s + c)

    def seat(tables, w, new):
        own = tables.setdefault(w, [])
        k = rng.choices(range(len(own) + 1), [*[x - dd for x in own], new])[0]
        if k == len(own):
            own.append(1)
            return True
        own[k] += 1
        return False

    def unseat(tables, w):
        own = tables[w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            return True
        return False

    for text in texts:
        prev = "\n"
        for w in [*text.split(), "\n"]:
            customers.append((prev, w))
            prev = w
    out = collections.Counter()
    words = sorted({w for _, w in customers})
    for step in range(burn + samples):
        for u, w in customers:
            room = rooms.setdefault(u, {})
            if step and unseat(room, w):
                unseat(root, w)
            dd = d
            if seat(room, w, (s + d * total(room)) * p_root(w)):
                dd = d0
                seat(root, w, (s0 + d0 * total(root)) * base)
        if step >= burn:
            for u in words:
                for w in words:
                    out[u, w] += p(u, w) / samples
    return out


def test_seating_against_brute_force_gibbs():
    """Averaged probabilities of blocked steps, all restaurants of a dish at once, against one customer at a time."""
    import numpy as np
    import xxhash

    texts = ["a b a c", "b a a", "c c b a", "a b", "a a a a b", "c b c b"] * 12
    s, d, s0, d0 = 30.0, 0.4, 20.0, 0.3
    want = brute_gibbs(texts, s, d, s0, d0, 0.5 / 4, 30, 250, 1)
    words, seen = ["\n", "a", "b", "c"], collections.Counter()
    for text in texts:
        chain = ["\n", *text.split(), "\n"]
        seen.update(zip(chain[1:], chain, strict=False))
    cells = sorted((words.index(w), words.index(u), n) for (w, u), n in seen.items())
    dish, u, n = (np.array(x, np.int64) for x in zip(*cells, strict=True))
    hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 0) for w in words], np.uint64).view(np.int64)
    size = pitman_yor.CONTEXTS
    c_u, t_u = np.bincount(u, weights=n, minlength=size), np.bincount(u, minlength=size).astype(float)
    g = {"c_u": c_u, "t_u": t_u, "d": d, "d0": d0, "s": s, "s0": s0, "C0": t_u.sum(), "T0": 4.0, "base": 0.5 / 4}
    got, rounds = np.zeros((4, 4)), 400
    for k in range(30 + rounds):
        t, t0, part, root, customers = pitman_yor._seated(hashes[dish], dish, u, n, g, 6, 1, k)
        t_u = np.bincount(u, weights=t, minlength=size)
        g |= {"t_u": t_u, "C0": t_u.sum(), "T0": float(t0.sum())}
        if k >= 30:
            p = root / (s0 + customers.sum()) + (s0 + d0 * t0.sum()) / (s0 + customers.sum()) * 0.5 / 4
            got += ((s + d * t_u[:4]) / (s + c_u[:4]))[:, None] * p / rounds
            np.add.at(got, (u, dish), part / rounds)
    for i, x in enumerate(words):
        assert [got[i, j] for j in range(4)] == pytest.approx([want[x, y] for y in words], abs=0.025), x


def test_scores_do_not_depend_on_the_broadcast(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 5 + k * k) % 30}" for k in range(i % 20))) for i in range(80)]
    docs = frame(spark, [*rows, *ODD])
    model = pitman_yor.train(docs)
    whole = {str(r) for r in pitman_yor.scored(docs, model, F.lit(False)).select("doc_id", "n_tokens", F.round("score", 5)).collect()}
    monkeypatch.setattr(pitman_yor, "DENSE", 4)
    assert {str(r) for r in pitman_yor.scored(docs, model, F.lit(False)).select("doc_id", "n_tokens", F.round("score", 5)).collect()} == whole


def test_every_word_before_has_its_restaurant(spark):
    """300 words before, each followed by one word only, in texts where all words are equally frequent: what follows is expected after its own word and nowhere else."""
    pairs = [(f"a{k}", f"b{k}") for k in range(300)]
    texts = [" ".join(f"{a} {b}" for a, b in pairs[i % 30 :: 30]) for i in range(600)]
    model = pitman_yor.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    probes = [*(f"{a} {b}" for a, b in pairs), *(f"{a} {pairs[(k + 7) % 300][1]}" for k, (a, _) in enumerate(pairs))]
    df = spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in pitman_yor.scored(df, model, F.lit(False)).collect()}
    assert len(s) == 600 and all(s[k] > s[300 + k] + 1.5 for k in range(300))


@pytest.mark.parametrize("block", [4096, 32 << 20])
def test_scores_follow_the_definition(spark, monkeypatch, block):
    """Scores from the model's own tables, word by word: what a restaurant has of a dish, and its weight of the root's share."""
    import numpy as np
    import xxhash

    monkeypatch.setattr(pitman_yor, "BLOCK", block)
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % (20 + i)}" for k in range(i % 30))) for i in range(150)]
    docs = frame(spark, rows)
    held = remainder(docs["doc_id"], 10) == 0
    model = pitman_yor.train(docs.filter(~held))
    name = lambda w: xxhash.xxh64_intdigest(w, 0)
    of, un = pitman_yor._of_hashes, pitman_yor._unpack
    weight, root, own, c_u = {}, {}, {}, {}
    for r in model.words.collect():
        for w, c, x, y in zip(of(bytes(r["a"])).tolist(), *(un(bytes(r[f])).tolist() for f in "bcd"), strict=True):
            c_u[w], weight[w], root[w] = c, x, y
    got = [r.asDict() | {f: bytes(r[f]) if r[f] is not None else None for f in "abcdef"} for r in model.cells.collect()]
    for r in (x for x in got if x["kind"] == "cells"):
        words, k, us, at, n = pitman_yor._of_cells(r)
        w, u = np.repeat(words, k), us[at]
        left = {x["src"]: un(x["a"]).tolist() for x in got if x["kind"] == "own" and x["to"] == r["to"]}
        for a, b, m in zip(w.tolist(), u.tolist(), n.tolist(), strict=True):
            own[b, a] = left[a % model.grid.tasks].pop(0) if m > 1 else 1 - model.g["d"]
        assert not any(left.values())
    chains = {i: [name(w) for w in [b"\n", *t.encode().split(), b"\n"]] for i, t in rows}
    seen = collections.Counter(p for i, x in chains.items() if zlib.crc32(str(i).encode()) % 10 for p in zip(x, x[1:], strict=False))
    assert set(own) == set(seen) and all(0 < own[p] < n for p, n in seen.items())
    g = model.g
    for r in pitman_yor.scored(docs, model, held).collect():
        x = chains[r["doc_id"]]
        want = sum(math.log10(own.get((u, w), 0.0) / (g["s"] + c_u.get(u, 0)) + weight.get(u, 1.0) * root.get(w, g["unknown"])) for u, w in zip(x, x[1:], strict=False))
        assert r["score"] == pytest.approx(want, rel=1e-5, abs=1e-5)
    assert any((u, w) not in own for x in chains.values() for u, w in zip(x, x[1:], strict=False))
    for u in weight:  # each restaurant's probabilities sum to one
        assert sum(x for (b, _), x in own.items() if b == u) / (g["s"] + c_u[u]) + weight[u] == pytest.approx(1.0, abs=1e-6)
    assert sum(root.values()) + g["unknown"] == pytest.approx(1.0, abs=1e-6)


def test_language_model_of_nothing(spark):
    docs = frame(spark, ODD)
    none = pitman_yor.train(docs.limit(0))
    got = pitman_yor.scored(docs, none, F.lit(True)).collect()
    assert len(got) == len(ODD) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] < 0 for r in got)
    assert pitman_yor.scored(docs.limit(0), pitman_yor.train(docs), F.lit(True)).count() == 0


def test_stirling_numbers_count_partitions():
    """S(3, t) for discount d: (1 - d)(2 - d), 3(1 - d), 1."""
    import numpy as np

    d = 0.3
    assert np.exp(pitman_yor._log_stirling(d)[3, 1:4]) == pytest.approx([(1 - d) * (2 - d), 3 * (1 - d), 1.0])


def test_language_model_beats_its_base_on_held_out_texts(spark):
    rows = [(i, " ".join(("the", f"n{(i + k) % 30}", "of")[k % 3] if k % 3 != 1 else f"n{(i + k) % 30}" for k in range(30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = remainder(docs["doc_id"], 10) == 0
    got = pitman_yor.scored(docs, pitman_yor.train(docs.filter(~held)), held)
    by = {r["held_out"]: r for r in pitman_yor.perplexity(got).collect()}
    assert by[True]["perplexity"] < 0.8 * by[True]["base_perplexity"]
