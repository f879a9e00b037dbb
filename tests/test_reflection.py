"""The store's view of itself, scenarios and findings, on small tables made for each rule."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lorekeep.operators import scenarios as N
from lorekeep.operators import selfmodel as M

SCHEMA = "id long, domain string, reward double, effectiveness double, reuse_count long, created_days int, updated_days int"


def store(spark, rows, vectors=()):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(v,) for v in vectors], "id long")


def found(spark, rows, vectors=()):
    return {(r["rule"], r["domain"]): r for r in M.vulnerabilities(*store(spark, rows, vectors)).collect()}


def test_healthy_store_has_no_vulnerability(spark):
    rows = [(k, f"d{k % 2}", 0.9, 0.9, 9, k % 90, 1) for k in range(240)]
    p, v = store(spark, rows, [*range(240), 3, 3, None, 999])
    h = M.health(p, v).first()
    assert (h["n"], h["embedded"], h["high"], h["medium"], h["low"], h["stale"]) == (240, 240, 240, 0, 0, 0)
    got = M.vulnerabilities(p, v)
    assert got.count() == 0
    assert M.verdict(got).first().asDict() == {"low": 0, "medium": 0, "high": 0, "critical": 0, "quick_status": "healthy", "status": "healthy"}
    assert M.recommendations(got).count() == 0


def test_each_rule_and_its_severity(spark):
    old = lambda n, of: [(k, "a", 0.6, 0.5, 0, 60, 31 if k < n else 30) for k in range(of)]
    for n, level in ((2, None), (3, 2), (4, 3), (5, 3), (6, 4)):
        got = found(spark, old(n, 10), range(10))
        assert (got[1, None]["level"] if (1, None) in got else None) == level, n
    for n, level in ((8, None), (7, 2), (5, 2), (4, 3)):
        got = found(spark, old(0, 10), range(n))
        assert (got[2, None]["level"] if (2, None) in got else None) == level, n
    low = found(spark, [(k, "a", 0.1 if k < 6 else 0.9, 0.5, 0, 60, 0) for k in range(10)], range(10))
    assert low[7, None]["level"] == 3 and low[7, None]["reason"] == "6 patterns (60%) have low reward"
    assert low[3, "a"]["severity"] == "high" and low[3, "a"]["reason"] == "Domain a has low coverage 7.1%"
    fading = found(spark, [(k, "a", 0.5 if k < 3 else 0.9, 0.5, 0, 5 if k < 3 else 60, 0) for k in range(10)], range(10))
    assert {4, 5} <= {rule for rule, _ in fading} and fading[5, None]["reason"] == "30d avg reward 0.50 below overall"
    wide = found(spark, [(k, f"d{k}" if k < 3 else "big", 0.9, 0.5, 0, 60, 0) for k in range(20)], range(20))
    assert wide[6, "big"]["level"] == 1 and abs(wide[6, "big"]["impact"] - 0.35) < 1e-12
    three = found(spark, [(k, f"d{k}" if k < 2 else "big", 0.9, 0.5, 0, 60, 0) for k in range(20)], range(20))
    assert (6, "big") not in three


def test_advice_is_ranked_and_neighbours_with_one_action_become_one(spark):
    rows = [
        (3, "coverage_gap", 3, "b", 0.9, "x"), (3, "coverage_gap", 3, "a", 0.8, "y"), (3, "coverage_gap", 2, "c", 0.5, "z"),
        (5, "quality_degradation", 3, None, 0.4, "q"), (7, "quality_degradation", 3, None, 0.6, "r"), (1, "knowledge_decay", 4, None, 0.6, "s"),
        (6, "overspecialization", 1, "m", 0.3, "t"), (4, "quality_degradation", 2, None, 0.2, "u"),
    ]
    f = spark.createDataFrame(rows, "rule int, category string, level int, domain string, impact double, reason string")
    got = [(r["rank"], r["priority"], r["action"], r["domain"], r["goal"]) for r in M.recommendations(f).orderBy("rank").collect()]
    assert got == [
        (1, 10, "refresh_stale_patterns", None, "refresh stale knowledge"),
        (2, 7, "fill_coverage_gap", "a", "improve a knowledge coverage"),
        (3, 7, "archive_low_quality", None, "improve pattern quality"),
        (4, 7, "fill_coverage_gap", "c", "improve c knowledge coverage"),
        (5, 4, "archive_low_quality", None, "improve pattern quality"),
        (6, 3, "research_topic", "m", "diversify knowledge base"),
    ]
    assert M.verdict(f).first()["status"] == "critical"


def test_status_of_both_checks(spark):
    for levels, quick, status in (([2], "warning", "healthy"), ([2, 2, 2], "warning", "warning"), ([3], "warning", "warning"), ([3, 3], "degraded", "degraded"), ([1, 4], "critical", "critical"), ([1], "healthy", "healthy")):
        r = M.verdict(spark.createDataFrame([(x,) for x in levels], "level int")).first()
        assert (r["quick_status"], r["status"]) == (quick, status), levels


def test_empty_and_null_stores(spark):
    p, v = store(spark, [])
    h = M.health(p, v).first()
    assert (h["n"], h["avg_reward"], h["total_reuse"], h["week_trend"]) == (0, 0.0, 0, "stable")
    assert M.vulnerabilities(p, v).count() == 0 and M.coverage(p).count() == 0
    nulls = store(spark, [(None, None, None, None, None, None, None)] * 7)
    assert {r["rule"] for r in M.vulnerabilities(*nulls).collect()} == {2, 3}


def brute(expected, context, solution, domain, asked):
    find = lambda x: [w for w in re.findall(r"[^\W_]+", (x or "").lower()) if len(w.encode()) >= 3]
    e, k, s = find(expected), find(context), (solution or "").lower()
    share = lambda ws: sum(w in s for w in ws) / len(ws) if ws else 0.5
    keyword = share(e) * 0.7 + share(k) * 0.3 if e else 0.5
    a, b = (domain or "").lower(), (asked or "").lower()
    match = 1.0 if a == b else 0.7 if a.startswith(b) or b.startswith(a) else 0.2
    complete = min(len((solution or "").encode()) / 100, 1.0)
    return keyword, complete, match, keyword * 0.4 + complete * 0.3 + match * 0.3


def test_scenarios_against_brute_force(spark):
    rng = random.Random(5)
    some = ["Retry", "the", "é", "ñe", "request", "quest", "with", "back-off", "a", "42", "123", "x_y", "RETRYING", "`code`"]
    text = lambda: rng.choice([None, "", " ".join(rng.choices(some, k=rng.randrange(1, 30)))])
    rows = [(k, text(), text(), text(), rng.choice([None, "", "en", "en.web", "EN", "de"]), rng.choice([None, "en", "en.web", "fr"])) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, expected string, context string, solution string, domain string, asked_domain string")
    got = {r["id"]: r for r in N.evaluated(df.withColumn("score", F.lit("clash"))).collect()}
    assert len(got) == 200
    for k, *x in rows:
        want = brute(*x)
        assert all(abs(got[k][n] - w) < 1e-12 for n, w in zip(("keyword", "completeness", "domain_match", "score"), want, strict=True)), (x, want)
        assert got[k]["passed"] == (round(want[3], 9) >= 0.7)
    assert N.evaluated(df.limit(0)).count() == 0


def test_a_long_scenario_takes_time_by_its_length(spark):
    import time

    words = " ".join(f"word{k}" for k in range(100_000))
    df = spark.createDataFrame([(words, words, words[: len(words) // 2], "a", "a")], "expected string, context string, solution string, domain string, asked_domain string")
    start = time.time()
    r = N.evaluated(df).first()
    assert time.time() - start < 30
    assert 0.5 < r["keyword"] < 0.6 and r["completeness"] == 1.0


def test_a_worker_holds_few_texts_as_objects():
    import tracemalloc

    import pyarrow as pa

    words = [[f"w{i}x{j}" for j in range(50)] for i in range(2000)]
    columns = (pa.array(words), pa.array(words), pa.array([" ".join(w) for w in words]))
    tracemalloc.start()
    (out,) = N._present.func(iter([columns]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [[50, 50]] * 2000 and peak < 4_000_000


def test_statistics_of_scenarios(spark):
    rows = [(1, 0.8, True, True, "easy"), (1, 0.5, False, True, "hard"), (1, 0.9, True, False, "medium"), (2, 0.1, False, False, "easy")]
    r = {x["p"]: x for x in N.statistics(spark.createDataFrame(rows, "p long, score double, passed boolean, holdout boolean, difficulty string"), "p").collect()}
    assert (r[1]["evaluated"], r[1]["n_passed"], r[1]["n_holdout"], r[1]["holdout_rate"]) == (3, 2, 2, 0.5)
    assert abs(r[1]["weighted_score"] - (0.8 + 1.0 + 1.35) / 3) < 1e-12 and (r[2]["n_holdout"], r[2]["holdout_rate"]) == (0, 0.0)


def test_contrast(spark):
    rows = [(None, None), ("", 0.5), ("Plain.", 0.5), ("SUCH AS this", 0.7), ("use `x`", 0.7), ("3 of", 0.6), ("for example `x` 3", 1.0)]
    got = spark.createDataFrame(rows, "text string, want double").select(N.contrast(F.col("text")).alias("got"), "want").collect()
    assert all((g is None and w is None) or abs(g - w) < 1e-12 for g, w in got)
