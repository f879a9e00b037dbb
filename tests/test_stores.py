"""Stored indexes, set joins, running sums by range, best paths, and keyed streams over several micro-batches."""

from __future__ import annotations

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep import plans
from lorekeep.functions import personal, statements
from lorekeep.operators import ann, cuts, detectors, fulltext, importance, paths, ranks, setjoin, textindex
from lorekeep.operators.aggregates import variant_stats
from lorekeep.operators.retrieval import nearest_each
from lorekeep.plans import detail
from lorekeep.sources import files
from lorekeep.streaming import streams


def clustered(spark, n=900, d=10, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = centres[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, d))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n, None)], "vec_id long, v array<double>")


def test_ann_recall_grows_with_probes_not_rows(spark):
    v = clustered(spark)
    q = v.where("vec_id % 50 = 0 AND v IS NOT NULL").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    index = ann.built(v)
    assert index.rows(spark).count() == 900 and index.probes < len(index.centroids)
    truth = nearest_each(v, q, 5)
    r = ann.recall(ann.search(spark, index, q, 5), truth).first()
    assert r["queries"] == 18 and r["asked"] == 90 and r["found"] >= 81
    # All lists and candidates: the exact rows. One list: only its folder is read.
    every = lambda df: sorted((r["qid"], r["vec_id"], r["sim"], r["rank"]) for r in df.collect())
    assert every(ann.search(spark, index, q, 5, probes=99, rerank=200)) == every(truth)
    one = ann.search(spark, index, q.limit(1), 5, probes=1)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan or "PartitionFilters: [isnotnull(list" in plan
    assert one.count() == 5


def test_ann_tasks_give_few_rows_a_query(spark):
    """A task takes several small lists or a part of a large one, and gives k rows a query, not all candidates of all lists."""
    parts, first = ann.shards(np.array([3, 4, 0, 5, 25, 1, 2]), 10)
    assert parts.tolist() == [1, 1, 1, 1, 3, 1, 1] and first.tolist() == [0, 0, 0, 1, 2, 5, 5]
    v = clustered(spark)
    q = v.where("vec_id % 50 = 0 AND v IS NOT NULL").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    index = ann.built(v)
    sizes = {r["list"]: r["count"] for r in index.rows(spark).groupBy("list").count().collect()}
    every = lambda df: sorted((r["qid"], r["vec_id"], r["sim"], r["rank"]) for r in df.collect())
    truth = every(nearest_each(v, q, 5))
    for most in (40, 400):
        parts, first = ann.shards(np.array([sizes.get(i, 0) for i in range(len(index.centroids))]), most)
        found = ann.search(spark, index._replace(parts=parts, first=first), q, 5, probes=99, rerank=200)
        assert every(found) == truth
        assert "near" not in found._jdf.queryExecution().analyzed().toString()


def test_ann_small_and_odd(spark):
    one = spark.createDataFrame([(7, [1.0, 2.0, 3.0])], "vec_id long, v array<double>")
    index = ann.built(one)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, None)], "qid long, q array<double>")
    assert [(r["qid"], r["vec_id"]) for r in ann.search(spark, index, q, 3).collect()] == [(1, 7)]
    with pytest.raises(ValueError, match="no vectors"):
        ann.built(one.limit(0))
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], "vec_id long, v array<double>")
    got = ann.search(spark, ann.built(same), spark.createDataFrame([(0, [1.0, 0.0])], "qid long, q array<double>"), 3).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2, 3]  # ties go by id


TEXTS = ["the license of the work", "of the of the of THE", "", None, "a work of art, tioning and tional", "license tion of the", "über straße of the tiò", "x " * 50 + "of the"]
QUERIES = ["license", "of OR work", '"of the"', "tio*", '"of the" AND (tio* NOT license)', "t*", 'über OR "of the of"', "(work OR x) NOT art", "absent", '"of absent"']


def test_text_index_gives_what_a_scan_gives(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plain = docs.withColumn("text", F.coalesce("text", F.lit("")))
    index = textindex.built(docs, "doc_id", "text")
    for q in QUERIES:
        want = {tuple(r) for r in fulltext.matched(plain, "doc_id", q, ["text"]).collect()}
        assert {tuple(r) for r in textindex.search(index, spark, q).collect()} == want, q
    with pytest.raises(ValueError, match="not indexed"):
        textindex.search(index, spark, "title: x")
    with pytest.raises(ValueError, match="cannot be searched"):
        textindex.built(docs.withColumnRenamed("text", "secret"), "doc_id", "secret")


def test_text_index_opens_its_buckets_only(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    index = textindex.built(docs, "doc_id", "text")
    plan = textindex.search(index, spark, "license")._jdf.queryExecution().toString()
    assert "bucket#" in plan and "PartitionFilters: [isnotnull(bucket" in plan and "(term,license)" in plan
    opened = textindex.postings_of(index, spark, [("word", "license", True)]).select(F.input_file_name().alias("f")).distinct().collect()
    assert opened and all(f"bucket={textindex.bucket('license')}/" in r["f"] for r in opened)


def test_text_index_in_segments(spark):
    first = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    new = spark.createDataFrame([(1, "tional license"), (20, "of the tion"), (0, "")], "doc_id long, text string")
    now = spark.createDataFrame([(i, t or "") for i, t in enumerate(TEXTS) if i > 1] + [(1, "tional license"), (20, "of the tion"), (0, "")], "doc_id long, text string")
    index = textindex.added(textindex.built(first, "doc_id", "text"), new)
    whole = textindex.merged(index, spark)
    for q in QUERIES[2::3]:
        want = {tuple(r) for r in fulltext.matched(now, "doc_id", q, ["text"]).collect()}
        assert {tuple(r) for r in textindex.search(index, spark, q).collect()} == want, q
        assert {tuple(r) for r in textindex.search(whole, spark, q).collect()} == want, q


def test_text_index_of_many_shards(spark, monkeypatch):
    """A shard has so many words at most, and what is dealt before its rows are made are texts, not words with their places."""
    monkeypatch.setattr(textindex, "WORDS", 12)
    first = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    new = spark.createDataFrame([(1, "tional license"), (20, "of the tion"), (7, "of"), (30, "work of " * 9)], "doc_id long, text string")
    now = spark.createDataFrame([(i, t or "") for i, t in enumerate(TEXTS) if i not in (1, 7)] + [tuple(r) for r in new.collect()], "doc_id long, text string")
    index = textindex.added(textindex.built(first, "doc_id", "text"), new)
    whole = textindex.merged(index, spark)
    assert min(index.shards) > 1 and whole.postings(spark).select("shard").distinct().count() > 1
    for q in QUERIES[1:5]:
        want = {tuple(r) for r in fulltext.matched(now, "doc_id", q, ["text"]).collect()}
        assert {tuple(r) for r in textindex.search(whole, spark, q).collect()} == want, q


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_set_join_loses_no_pair(spark, threshold):
    rng = random.Random(int(threshold * 10))
    sets = [sorted(rng.sample(range(30), rng.randrange(0, 12))) for _ in range(80)]
    sets += sets[:20]
    rows = [(i, i % 2, [str(x) for x in s]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, g long, x array<string>")
    classes, member = setjoin.classes(df, "g")
    pairs = setjoin.similar_classes(classes, threshold)
    got = {(r["a"], r["b"], round(r["similarity"], 9)) for r in setjoin.expanded(pairs, member).collect()}
    want = set()
    for (i, g, x), (j, h, y) in itertools.combinations(rows, 2):
        if g == h and x and y:
            s = len({*x} & {*y}) / len({*x} | {*y})
            if s >= threshold:
                want.add((i, j, round(s, 9)))
    assert got == want
    assert {r["id"] for r in member.collect()} == {i for i, _, x in rows if x}


def test_set_join_deals_no_texts_to_find_copies(spark):
    """Copies are found by a key of fixed size: what is left to read later holds no exchange of whole sets."""
    df = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", ["y", "x"]), (3, None, ["x"])], "id long, g string, x array<string>")
    classes, member = setjoin.classes(df, "g")
    assert "Exchange" not in classes._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["class"], r["id"]) for r in member.collect()) == [(1, 1), (1, 2)]
    assert sorted((r["class"], r["block"] or "", *r["x"]) for r in classes.collect()) == [(1, "a", "x", "y"), (3, "", "x")]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_set_join_of_many_chunks_deals_no_pairs(spark, monkeypatch, threshold):
    """Pairs of chunks are compared whole, so nothing is met by token and dealt; tokens of one number get others."""
    monkeypatch.setattr(setjoin, "CHUNK_SETS", 7)
    monkeypatch.setattr(setjoin, "CHUNK_TOKENS", 40)
    given = setjoin._number
    monkeypatch.setattr(setjoin, "_number", lambda token, salt: F.length(token).cast("long") if salt == 0 else given(token, salt))
    rng = random.Random(5)
    rows = [(i, rng.choice("abcdef") if i % 3 else "g", [str(x) for x in rng.sample(range(9 if i % 5 else 90), rng.randrange(1, 9))]) for i in range(150)]
    rows.append((150, "g", [str(x) for x in range(60)]))
    sets = spark.createDataFrame(rows, "class long, block string, x array<string>")
    chunks = setjoin._chunks(sets)
    assert chunks.count() >= 150 / 7 and chunks.agg(F.max("most")).first()[0] == 60
    pairs = setjoin.similar_classes(sets, threshold)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan
    alike = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = {(i, j, alike(x, y)) for (i, g, x), (j, h, y) in itertools.combinations(rows, 2) if g == h and alike(x, y) >= threshold}
    assert sorted(map(tuple, pairs.collect())) == sorted(want)


@pytest.mark.parametrize(("dense", "slice_", "steps"), [(0, 3, 2), (4, 5, 7), (1 << 40, 64, 1 << 20)])
def test_shared_tokens_counted_or_multiplied(monkeypatch, dense, slice_, steps):
    for name, value in (("DENSE", dense), ("SLICE", slice_), ("STEPS", steps)):
        monkeypatch.setattr(setjoin, name, value)
    rng = random.Random(8)
    side = lambda n: sorted(([*rng.sample(range(-9, 9 if k % 2 else 40), rng.randrange(1, 12))] for k in range(n)), key=len)
    flat = lambda x: (np.array([len(s) for s in x]), np.array([t for s in x for t in s], np.int64))
    x, y = side(20), side(31)
    for left, right, same in ((x, y, False), (x, x, True)):
        got = {(int(i), int(j), float(s)) for a, b, c in setjoin._shared(flat(left), flat(right), 0.3, same) for i, j, s in zip(a, b, c, strict=True)}
        alike = lambda s, t: len({*s} & {*t}) / len({*s} | {*t})
        assert got == {(i, j, alike(s, t)) for i, s in enumerate(left) for j, t in enumerate(right) if alike(s, t) >= 0.3 and (i < j or not same)}
    assert not [*setjoin._shared(flat([[1]]), flat([[2]]), 0.3, False)]


def test_conflict_by_traits_as_by_texts(spark):
    """What the traits of two statements say is what their texts say, and where they leave it open is said."""
    words = ["use", "avoid", "always", "never", "should not", "sync", "async", "tables", "graphs", "indexes", "vectors", "streams", "unsafe", "the", "prefer"]
    rng = random.Random(3)
    rows = [(" ".join(rng.sample(words, rng.randrange(1, 7))), " ".join(rng.sample(words, rng.randrange(1, 7))), rng.choice([0.3, 0.55, 0.65, 0.8, 0.97])) for _ in range(600)]
    rows += [("prefer " + " ".join(f"a{i:02d}x{k}" for i in range(30)), "prefer " + " ".join(f"b{i:02d}x{k}" for i in range(30)) + " zzzz" * k, 0.7) for k in (0, 1)]
    rows += [("apply tables zzzz", "apply " + " ".join(f"a{i:02d}x" for i in range(9)) + " zzzz", 0.7)]
    df = spark.createDataFrame(rows, "a string, b string, s double")
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    severity, left = statements.conflict_by_traits(statements.traits(a), statements.traits(b), s)
    got = df.select(statements.conflict(a, b, s).alias("want"), severity.alias("severity"), left.alias("left")).collect()
    assert all(r["left"] or r["want"] == r["severity"] for r in got)
    assert {r["want"] for r in got if r["left"]} == {None, "minor"} and sum(r["left"] for r in got) < len(got) / 4


def test_write_gate_deals_no_texts_for_alike_pairs(spark, tmp_path):
    """Texts meet for parents and for the few pairs that traits leave open; ids of several rows stand for each of them."""
    duck = duckdb.connect()
    duck.execute("CREATE TABLE labels AS SELECT * FROM '/root/testdata/sf0.001/labels.parquet'")
    # One text many times, its words in another order, alike ones, a text of several ids, and an id of several texts.
    text = "'Use tables and never graphs ' || chr(10) || 'prefer indexes ' || CASE WHEN doc_id % 3 = 0 THEN 'always' ELSE 'streams vectors ' || (doc_id % 4) END"
    duck.execute(f"CREATE TABLE documents AS SELECT doc_id, CASE WHEN doc_id < 60 THEN {text} ELSE text END AS text, CASE WHEN doc_id < 60 THEN 'en' ELSE lang END AS lang, CASE WHEN doc_id < 60 THEN 'src' || (doc_id % 2) ELSE source END AS source, n_chars FROM '/root/testdata/sf0.001/documents.parquet'")
    duck.execute("INSERT INTO documents SELECT doc_id, text || ' do use', 'de', source, n_chars FROM documents WHERE doc_id IN (4, 5, 21, 70)")
    for table in ("documents", "labels"):
        duck.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    df = plans.QUERIES["write_gate"](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLES['write_gate']})").fetchall()
    got = [(r["id"], r["conflicts"], r["supports"], r["energy"], r["action"]) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r[1] > 2 for r in got)
    alike = spark.createDataFrame([(0, 2, 0.5)], "a long, b long, similarity double")
    advice = spark.createDataFrame([(k, "x", True, f"words {k}", f"use words {k}") for k in (0, 2)], "id long, root string, success boolean, solution string, s string")
    p = detail._alike_advice(alike, advice)
    assert [tuple(r)[:3] for r in p.collect()] == [(0, 2, 0.5)]


def test_running_sums_across_ranges(spark):
    rows = [(k, i, (i * 7) % 5) for k in (None, 1, 2) for i in range(400 if k == 1 else 9)]
    df = spark.createDataFrame(rows, "k long, i long, n long")
    got = {(r["k"], r["i"]): r["s"] for r in ranks.running(df, ["k"], ["i"], F.col("n"), "s").collect()}
    want = {}
    for k in (None, 1, 2):
        total = 0
        for key, i, n in rows:
            if key == k:
                total += n
                want[k, i] = total
    assert got == want


def test_order_statistics_of_one_large_variant(spark):
    rows = [("a", float(i % 997)) for i in range(3000)] + [("b", 1.0), ("b", None)]
    r = {x["v"]: x for x in variant_stats(spark.createDataFrame(rows, "v string, x double"), ["v"], "x").collect()}
    s = sorted(x for v, x in rows if v == "a")
    assert (r["a"]["median_upper"], r["a"]["p95"], r["a"]["p99"]) == (s[1500], s[math.floor(3000 * 0.95)], s[math.floor(3000 * 0.99)])


def brute_paths(edges, start, hops):
    best = {}
    link = {}
    for a, b, s in edges:
        link.setdefault(a, {})[b] = max(s, link.get(a, {}).get(b, 0))

    def walk(path, total):
        for b, s in sorted(link.get(path[-1], {}).items()):
            if b not in path:
                text = "".join(f"{x}>" for x in [*path, b])
                key = (-round(total * s, 12), len(path), text)
                best.setdefault(b, []).append((key, round(total * s, 9)))
                if len(path) < hops:
                    walk([*path, b], total * s)

    walk([start], 1.0)
    return best


def test_best_paths_with_cycles_and_ties(spark):
    rng = random.Random(5)
    edges = [(a, b, rng.choice([0.5, 0.5, 0.8, 0.25])) for a in range(12) for b in range(12) if a != b and rng.random() < 0.3]
    df = spark.createDataFrame(edges, "src long, dst long, strength double")
    best = brute_paths(edges, 0, 5)
    strong = {r["node"]: (r["hops"], round(r["total"], 9), r["path"]) for r in paths.strongest(df, 0, 5).collect()}
    short = {r["node"]: (r["hops"], round(r["total"], 9), r["path"]) for r in paths.shortest(df, 0, 5).collect()}
    assert strong == {n: (min(x)[0][1], min(x)[1], min(x)[0][2]) for n, x in best.items()}
    by_hops = {n: min(x, key=lambda y: (y[0][1], y[0][0], y[0][2])) for n, x in best.items()}
    assert short == {n: (k[1], total, k[2]) for n, (k, total) in by_hops.items()}
    assert [r["node"] for r in paths.strongest(df, 0, 5, end=7).collect()] == ([7] if 7 in best else [])


def parts(spark, tmp_path, rows, schema):
    """Each list of rows a file of its own, in this order, one to a micro-batch."""
    for k, some in enumerate(rows):
        spark.createDataFrame(some, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"part={k}"))
    kind = spark.read.parquet(str(tmp_path / "part=0")).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part=*"))


def test_alerts_outlive_their_cooldown(spark, tmp_path):
    day = lambda d, h: f"2024-01-{d:02d} {h:02d}:00:00"
    rows = [[("r", 1, day(1, 0), 99.0), ("q", 2, day(1, 1), 1.0)], [("r", 3, day(1, 12), 95.0)], [("r", 4, day(3, 0), 5.0), ("r", 5, day(3, 1), 96.0)], [("r", 6, day(9, 0), 5.0), ("q", 7, day(9, 1), 97.0), ("r", 8, day(3, 2), 99.0)]]
    stream = parts(spark, tmp_path, rows, "rule string, id long, ts string, x double")
    got = {(r["rule"], r["id"]) for r in streams.finished(streams.alerts(stream, "rule", "x", 90.0, 86_400, "1 hour")).collect()}
    assert got == {("r", 1), ("r", 5), ("q", 7)}  # 3 within the cooldown, 8 later than the watermark


def test_error_rate_over_micro_batches(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    rows = [[("r", 1, at(0), True), ("r", 2, at(1), False)], [("r", 3, at(2), True), ("r", 4, at(3), True)], [("r", 5, at(30), True)]]
    stream = parts(spark, tmp_path, rows, "rule string, id long, ts string, x boolean")
    got = {r["id"] for r in streams.finished(streams.alerts(stream, "rule", "x", cooldown_s=60, rate=0.6, window_s=600)).collect()}
    assert got == {1, 3, 4, 5}


def test_change_log_states(spark, tmp_path):
    schema = "key long, seq long, op string, fields map<string, string>, ts string"
    t = "2024-01-01 00:00:00"
    rows = [[(1, 1, "set", {"a": "1", "b": None}, t), (1, 2, "set", {"a": "1"}, t)], [(1, 3, "set", {"b": "2"}, t), (2, 1, "delete", None, t)], [(1, 4, "delete", {}, t)], [(1, 5, "set", {"c": "3"}, t), (1, 6, "set", {"c": "4"}, t)]]
    log = streams.finished(streams.versions(parts(spark, tmp_path, rows, schema), "key", 2))
    assert sorted((r["version"], r["seq"], r["changed"], r["gone"], r["snapshot"]) for r in log.collect()) == [(1, 1, {"a": "1"}, [], None), (2, 3, {"b": "2"}, [], {"a": "1", "b": "2"}), (3, 4, {}, ["a", "b"], None), (4, 5, {"c": "3"}, [], {"c": "3"}), (5, 6, {"c": "4"}, [], None)]
    want = {1: {"a": "1"}, 2: {"a": "1", "b": "2"}, 3: {}, 4: {"c": "3"}, 5: {"c": "4"}, 9: {"c": "4"}}
    for v, fields in want.items():
        assert [(r["version"], r["fields"]) for r in streams.at_version(log, v).collect()] == [(min(v, 5), fields)]
    short = streams.compacted(log, 5)
    assert short.count() == 2 and [r["fields"] for r in streams.at_version(short, 5).collect()] == [{"c": "4"}]


def test_keys_of_a_change_log_share_states(spark, tmp_path, monkeypatch):
    """A micro-batch reads and puts a state for each bucket of keys, not for each key; what it gives is that of a walk key by key."""
    monkeypatch.setattr(streams, "BUCKETS", 16)
    rng = random.Random(4)
    rows, log, state = [], [], {}
    for at in range(3):
        some = [(rng.randrange(-400, 400), at * 500 + i, rng.choice(["set", "set", "delete"]), {k: rng.choice(["x", "y", "ä\"", None]) for k in "ab"}) for i in range(500)]
        rows.append([(*r, "2024-01-01 00:00:00") for r in some])
        for key, seq, op, new in some:
            version, old = state.get(key, (0, {}))
            now = {} if op == "delete" else old | {k: v for k, v in new.items() if v is not None}
            if now != old:
                state[key] = version + 1, now
                log.append((key, version + 1, seq, {k: v for k, v in now.items() if old.get(k) != v}, sorted(old.keys() - now.keys()), now if (version + 1) % 3 == 0 else None))
    stream = streams.versions(parts(spark, tmp_path / "in", rows, "key long, seq long, op string, fields map<string, string>, ts string"), "key", 3)
    got = []
    q = stream.writeStream.foreachBatch(lambda batch, _: got.extend(map(tuple, batch.collect()))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    q.awaitTermination()
    plain = lambda rows: sorted(repr([sorted(x.items()) if isinstance(x, dict) else x for x in r]) for r in rows)
    assert plain(got) == plain(log) and len(state) > 300
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len(states) == 3 and 0 < max(states) <= 16


@pytest.mark.parametrize("name", ["stream_versions", "state_at_versions", "stream_error_rate", "stream_alerts", "stream_alerts_below", "stream_near_dedup"])
def test_streams_of_uneven_files_and_tied_times(spark, tmp_path, name):
    """Sorted files of unlike size leave unlike numbers of files in the parts of a replay; events share their hours."""
    duck = duckdb.connect()
    order = {"events": "ts", "client_changes": "seq", "embeddings": "vec_id"}
    for table, by in order.items():
        (tmp_path / f"{table}.parquet").mkdir()
        columns = "* REPLACE (date_trunc('hour', ts) AS ts)" if table == "events" else "*"
        duck.execute(f"CREATE TABLE {table} AS SELECT {columns}, row_number() OVER (ORDER BY {by}) / (count(*) OVER () + 1.0) AS place FROM '/root/testdata/sf0.001/{table}.parquet'")
        cuts = [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.7, 1]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            duck.execute(f"COPY (SELECT * EXCLUDE (place) FROM {table} WHERE place >= {a} AND place < {b}) TO '{tmp_path}/{table}.parquet/part-{k}.parquet' (FORMAT parquet)")
    df = plans.QUERIES[name](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({plans.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


SOURCES = {
    "errors.rs": "#[derive(Debug, Error)]\nenum E {}\nimpl std::error::Error for E {}\nf().map_err(|e| E::from(e))?;\n",
    "tasks.rs": "tokio::spawn(async {});\ntokio::select! { _ = a => {} }\nlet (a, b) = mpsc::channel(1);\nMutex::new(0);\n",
    "api.rs": 'Router::new().route("/a", get(h)).layer(trace);\n#[get("/b")]\n',
    "tests.rs": "#[test]\nfn a() {}\n#[tokio::test]\nproptest! { }\nMockClock::new()\n",
    "db.rs": "sqlx::query_as!(X, \"\"); pool.begin(); PgPool::connect(u)\n",
    "plain.txt": "nothing of the kind, though it says impl and Mock",
}


def test_detectors_on_a_folder(spark, tmp_path):
    import re

    for name, text in SOURCES.items():
        (tmp_path / name).write_text(text)
    texts = files.text_folder(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    got = {(r["path"], r["name"]): (r["domain"], r["n"], r["first"], r["hit"]) for r in detectors.found(texts, "path", "text", detectors.RUST).collect()}
    want = {}
    for name, text in SOURCES.items():
        for d in detectors.RUST:
            hits = list(re.finditer(d.pattern, text))
            if hits:
                want[name, d.name] = (d.domain, len(hits), hits[0].start(), hits[0].group())
    assert got == want and {k[1] for k in got} == {d.name for d in detectors.RUST}
    summary = {r["name"]: r["texts"] for r in detectors.learned(detectors.found(texts, "path", "text", detectors.RUST), "path", 0.8).collect()}
    assert summary["test"] == 1 and "map_err" not in summary
    assert detectors.found(texts.select("path", F.lit(None).cast("string").alias("text")), "path", "text", detectors.RUST).count() == 0


def test_importance_as_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    columns = [F.lit(1.0), F.col("a"), F.col("b")]
    w = importance.fitted(df, columns, F.col("y"), ridge=1e-3)
    m = np.column_stack([np.ones(400), x])
    v = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-m @ v))
        v = v + np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(3), m.T @ (y - p) - 1e-3 * v)
    assert np.allclose(w, v, atol=1e-6)
    r = importance.moments(df, columns, F.col("y"), w).first()
    g = (1 / (1 + np.exp(-m @ np.array(w))) - y)[:, None] * m
    assert np.allclose([r["g0"], r["g1"], r["g2"]], g.mean(0)) and np.allclose([r["f0"], r["f1"], r["f2"]], (g * g).mean(0))
    moved = importance.protected([0.0, 0.0], [1.0, 1.0], [0.0, 5.0], 0.1, 100.0)
    assert moved[0] == -0.1 and moved[1] == pytest.approx(-0.1 / 6) and importance.penalty([0, 0], moved, [0.0, 5.0], 2.0) == pytest.approx(5 * (0.1 / 6) ** 2)


def test_shortcuts_and_distances(spark):
    edges = [(i, i + 1) for i in range(8)] + [(0, 20), (20, 21)]
    df = spark.createDataFrame(edges, "src long, dst long")
    pairs = spark.createDataFrame([(0, 3), (0, 8), (21, 5), (1, 2), (4, 4), (3, 99)], "a long, b long")
    got = {(r["a"], r["b"]): r["hops"] for r in paths.distances(pairs, df, 7).collect()}
    assert got == {(0, 3): 3, (21, 5): 7, (1, 2): 1}
    used = [(s, x) for s in range(3) for x in (0, 3, 1)] + [(7, x) for x in (0, 8)] + [(8, x) for x in (0, 8)] + [(9, x) for x in range(30)] + [(None, 0)]
    u = spark.createDataFrame(used, "session long, x long")
    small = {(r["a"], r["b"]): (r["n"], r["hops"], r["score"]) for r in paths.shortcuts(u, df).collect()}
    large = {(r["a"], r["b"]): (r["n"], r["hops"], r["score"]) for r in paths.shortcuts(u, df, large=10).collect()}
    assert small == large == {(0, 3): (4, 3, round(0.6 + 0.4 * 2 / 3, 6)), (0, 8): (3, 8, round(0.6 * 3 / 4 + 0.4 * 7 / 8, 6))}
    known = spark.createDataFrame([(3, 0)], "a long, b long")
    assert {(r["a"], r["b"]) for r in paths.shortcuts(u, df, known).collect()} == {(0, 8)}


def test_many_addresses_in_one_text(spark):
    text = " ".join(f"user{i}@mail.example.org and 203.0.113.{i % 200}" for i in range(1500))
    df = spark.createDataFrame([(text,)], "text string")
    rows = df.select(F.explode(personal.spans(F.col("text"))).alias("m")).select("m.*").collect()
    assert len(rows) == 3000 and all(text[r["from"] : r["upto"]] == r["text"] for r in rows)


def test_descendants_of_a_cycle(spark):
    from lorekeep.operators import graph

    rows = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 3), (4, 3)], "id long, parent_id long")
    assert sorted(tuple(r) for r in graph.descendants(rows, 1, 10).collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def brute_cut(nodes, link):
    """(weight, fewest nodes on the smaller side) over all ways to part some nodes in two."""
    first, *rest = sorted(nodes)
    best = (math.inf, 0)
    for k in range(1 << len(rest)):
        side = {first, *(x for i, x in enumerate(rest) if k >> i & 1)}
        if len(side) < len(nodes):
            w = sum(s for (a, b), s in link.items() if a in nodes and b in nodes and (a in side) != (b in side))
            best = min(best, (round(w, 6), min(len(side), len(nodes) - len(side))))
    return best


def brute_parts(nodes, link):
    left, out = set(nodes), []
    while left:
        part, front = set(), {min(left)}
        while front:
            part |= front
            front = {y for (a, b) in link for x, y in ((a, b), (b, a)) if x in front} - part
        out.append(part)
        left -= part
    return out


def test_cuts_of_components_over_all_subsets(spark):
    rng = random.Random(11)
    edges = []
    for base, n, p in ((0, 9, 0.5), (20, 8, 0.3), (40, 7, 0.9), (60, 2, 1.0)):
        edges += [(base + a, base + b, round(rng.uniform(0.05, 1), 3)) for a in range(n) for b in range(n) if a < b and (rng.random() < p or b == a + 1)]
    edges += [(b, a, 0.001 * k) for k, (a, b, _) in enumerate(edges[:10])] + [(3, 3, 9.0)]
    df = spark.createDataFrame(edges, "src long, dst long, strength double")
    link = {}
    for a, b, s in edges:
        if a != b:
            link[min(a, b), max(a, b)] = link.get((min(a, b), max(a, b)), 0) + s
    parts_ = brute_parts({x for pair in link for x in pair}, link)
    got = {r["component"]: (r["weight"], r["smaller_side"]) for r in cuts.least_cuts(df).collect()}
    assert got == {min(p): brute_cut(p, link) for p in parts_}

    def split(nodes):
        if len(nodes) > 1:
            first, *rest = sorted(nodes)
            options = []
            for k in range(1 << len(rest)):
                side = {first, *(x for i, x in enumerate(rest) if k >> i & 1)}
                if len(side) < len(nodes):
                    options.append((sum(s for (a, b), s in link.items() if a in nodes and b in nodes and (a in side) != (b in side)), sorted(side)))
            w, side = min(options)
            if w < 0.8:
                return split(set(side)) + split(set(nodes) - set(side))
        return [nodes]

    want = {(min(p), min(c), x) for p in parts_ for c in split(p) for x in c}
    assert {tuple(r) for r in cuts.clusters(df, 0.8).collect()} == want


def test_nearest_of_a_few_queries_at_once(spark, monkeypatch):
    from lorekeep.operators import retrieval

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "vec_id long, v array<double>")
    asked = rows.select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    want = {tuple(r) for r in retrieval.nearest_each(rows, asked, 3).collect()}
    monkeypatch.setattr(retrieval, "AT_ONCE", 3)
    assert {tuple(r) for r in retrieval.nearest_each(rows, asked, 3).collect()} == want and len(want) == 120


def test_more_rows_of_a_graph_are_more_tasks(spark, monkeypatch):
    from lorekeep.sources import tables

    rows = spark.range(3000).select((F.col("id") % 700).alias("l_partkey"), (F.col("id") % 9).alias("l_suppkey"))
    want = {tuple(r) for r in tables.edges(rows).collect()}
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    e = tables.edges(rows)
    assert e.rdd.getNumPartitions() == 31 and {tuple(r) for r in e.collect()} == want


def test_cuts_by_a_share_of_the_paths(spark, monkeypatch):
    from lorekeep.operators import graph

    rng = random.Random(5)
    edges = [(100 + p, s, round(rng.uniform(0.3, 0.9), 3)) for p in range(150) for s in rng.sample(range(30), 9)]
    df = spark.createDataFrame(edges, "src long, dst long, strength double")
    want = graph.min_cut(df.withColumn("component", F.lit(0).cast("long")), "component").first()
    shares, bonds = [], cuts._bonds
    monkeypatch.setattr(cuts, "PATHS", 1000)
    monkeypatch.setattr(cuts, "_bonds", lambda e, d, share: (shares.append((share, bonds(e, d, share).count(), bonds(e, d, 1).count())), bonds(e, d, share))[1])
    got = cuts.least_cuts(df).first()
    assert (got["component"], got["weight"], got["nodes"]) == (0, want["weight"], 180)
    assert shares[0][0] > 1 and shares[0][1] < shares[0][2]  # a round looks at some of the paths, the result is that of all
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (600, 601)], "src long, dst long")
    assert {tuple(r) for r in cuts.components(chain).collect()} == {(k, 0) for k in range(201)} | {(500, 500), (600, 600), (601, 600)}


def test_cuts_by_groups_of_edges(spark, monkeypatch):
    """A large graph is first contracted group by group, in tasks that see a part of its edges each; the cut is that of the whole."""
    from lorekeep.operators import graph

    monkeypatch.setattr(cuts, "SMALL", 0)
    monkeypatch.setattr(cuts, "GROUP", 300)
    met, local = [], cuts._local
    monkeypatch.setattr(cuts, "_local", lambda e, bound: (met.append((e.count(), local(e, bound).where("NOT merged").count())), local(e, bound))[1])
    rng = random.Random(6)
    # Two dense halves with few edges between them, parallel ones, a loop, and a small component of its own.
    edges = [(1000 * h + 100 + p, 1000 * h + s, round(rng.uniform(0.3, 0.9), 3)) for h in (0, 1) for p in range(60) for s in rng.sample(range(20), 11)]
    edges += [(3, 1105, 0.4), (1105, 3, 0.4), (104, 1008, 0.7), (7, 7, 5.0)] + [(5000, 5001, 0.2), (5001, 5002, 0.9), (5002, 5000, 0.1)]
    df = spark.createDataFrame(edges, "src long, dst long, strength double")
    got = {r["component"]: (r["weight"], r["smaller_side"], r["nodes"]) for r in cuts.least_cuts(df).collect()}
    one = graph.min_cut(df.where("src < 5000 AND src <> dst").withColumn("component", F.lit(0).cast("long")), "component").first()
    assert one["weight"] == 1.5 and got == {0: (1.5, 80, 160), 5000: (0.3, 1, 3)}
    assert met[0][0] == len(edges) - 1 and met[0][1] < met[0][0] / 2
    # What a merged node takes in is held to it by the bound in every cut.
    for seed in range(40):
        rng = random.Random(seed)
        pairs = rng.sample(list(itertools.combinations(range(7), 2)), rng.randrange(6, 20))
        x, y = np.array(pairs).T
        w = np.array([rng.choice([0.25, 0.5, 1.0]) for _ in pairs])
        label = cuts._grown(7, x, y, w, 1.0)
        for cut in range(1, 64):
            side = np.array([cut >> k & 1 for k in range(7)])
            if w[side[x] != side[y]].sum() < 1.0 - 1e-9:
                assert all(side[k] == side[label[k]] for k in range(7))


def test_clamped_steps_across_ranges(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([0.3, -0.45, 0.05, -0.1])) for k in ("a", "b") for i in range(700 if k == "a" else 5)]
    df = spark.createDataFrame(rows, "k string, i long, s double").repartition(6)
    got = {r["k"]: r["value"] for r in ranks.clamped(df, "k", ["i"], F.col("s"), 0.5).collect()}
    for k in ("a", "b"):
        x = 0.5
        for key, _, s in rows:
            if key == k:
                x = min(max(x + s, 0.0), 1.0)
        assert got[k] == pytest.approx(x, abs=1e-9)
