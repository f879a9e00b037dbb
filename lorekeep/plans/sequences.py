"""Queries on ordered rows, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import sequences as Q
from ..operators import setjoin as J
from .registry import query

DRIFT = """d AS (SELECT label, vec_id, list_distance(v, lag(v) OVER (PARTITION BY label ORDER BY vec_id)) AS distance FROM vectors), e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS k FROM d WHERE distance IS NOT NULL)"""


@query("drift_distances", f"WITH {DRIFT} SELECT label, vec_id, round(distance, 6) AS distance FROM e")
def drift_distances(t):
    return Q.drift_distances(t.vectors).withColumn("distance", F.round("distance", 6))


@query(
    "drift_trend",
    f"""WITH {DRIFT}, g AS (SELECT label, count(*) AS n, avg(distance) AS m, stddev_pop(distance) AS s, avg(distance) FILTER (WHERE k <= 5) AS r FROM e GROUP BY 1)
SELECT label, n, round(m, 6) AS mean, round(s / m, 6) AS variation, CASE WHEN n < 5 THEN 'insufficient' WHEN r > m * 1.3 THEN 'increasing' WHEN r < m * 0.7 THEN 'decreasing' ELSE 'stable' END AS trend FROM g""",
)
def drift_trend(t):
    return Q.drift_trend(Q.drift_distances(t.vectors))


@query("bounded_history", "SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS k FROM vectors) WHERE k <= 20")
def bounded_history(t):
    k = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id")))
    return t.vectors.withColumn("k", k).where("k <= 20").select("label", "vec_id")


@query("topk_by_group", "SELECT domain, id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY reward DESC, id) AS k FROM patterns) WHERE k <= 3")
def topk_by_group(t):
    k = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("reward"), "id"))
    return t.patterns.withColumn("k", k).where("k <= 3").select("domain", "id")


@query("rank_position_score", "SELECT id, round(1 - (k - 1) / 20.0::DOUBLE, 6) AS score FROM (SELECT id, row_number() OVER (ORDER BY reward DESC, id) AS k FROM (SELECT * FROM patterns ORDER BY reward DESC, id LIMIT 20))")
def rank_position_score(t):
    top = t.patterns.orderBy(F.desc("reward"), "id").limit(20)
    return top.select("id", F.round(F.lit(1.0) - (F.row_number().over(Window.orderBy(F.desc("reward"), "id")) - 1) / 20.0, 6).alias("score"))


@query("minmax_rank", "WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE event_type = 'click') SELECT event_id, round(greatest(0.1, least(1, 1 - (value - lo) / (hi - lo))), 6) AS score FROM events, b WHERE event_type = 'click'")
def minmax_rank(t):
    e = t.events.where("event_type = 'click'")
    b = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = F.lit(1.0) - (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return e.join(F.broadcast(b)).select("event_id", F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), x)), 6).alias("score"))


@query(
    "softmax_weights",
    "WITH x AS (SELECT id, domain, exp((reward - max(reward) OVER (PARTITION BY domain)) / 0.5) AS e FROM patterns) SELECT id, round(e / sum(e) OVER (PARTITION BY domain), 6) AS weight FROM x",
)
def softmax_weights(t):
    w = Window.partitionBy("domain")
    x = t.patterns.select("id", "domain", F.exp((F.col("reward") - F.max("reward").over(w)) / 0.5).alias("e"))
    return x.select("id", F.round(F.col("e") / F.sum("e").over(w), 6).alias("weight"))


@query("running_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 10) AS mean FROM events")
def running_mean(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.round(F.avg("value").over(w), 10).alias("mean"))


@query("effectiveness_ema", "WITH s AS (SELECT pattern_id, list(CASE outcome WHEN 'success' THEN 1.0::DOUBLE WHEN 'failure' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END ORDER BY ts, event_id) AS x FROM outcomes GROUP BY 1) SELECT pattern_id, round(list_reduce(list_prepend(0.5::DOUBLE, x), lambda a, b: a * 0.9::DOUBLE + b * 0.1::DOUBLE), 6) AS ema FROM s")
def effectiveness_ema(t):
    x = F.when(F.col("outcome") == "success", 1.0).when(F.col("outcome") == "failure", 0.0).otherwise(0.5)
    return Q.ema(t.outcomes.withColumn("x", x), "pattern_id", ["ts", "event_id"], "x", 0.1, 0.5).select("pattern_id", F.round("ema", 6).alias("ema"))


@query("reward_fold", "WITH s AS (SELECT pattern_id, list(CASE outcome WHEN 'success' THEN 0.1::DOUBLE WHEN 'partial' THEN 0.05::DOUBLE WHEN 'failure' THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END ORDER BY ts, event_id) AS x FROM outcomes GROUP BY 1) SELECT pattern_id, round(list_reduce(list_prepend(0.5::DOUBLE, x), lambda a, b: least(greatest(a + b, 0.0::DOUBLE), 1.0::DOUBLE)), 6) AS value FROM s")
def reward_fold(t):
    return Q.clamped_fold(t.outcomes, "pattern_id", ["ts", "event_id"], S.reward_step(F.col("outcome")), 0.5).select("pattern_id", F.round("value", 6).alias("value"))


@query("snapshot_sequence", "SELECT event_id, seq, seq % 10 = 0 AS snapshot FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)")
def snapshot_sequence(t):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return t.events.select("event_id", seq.alias("seq")).withColumn("snapshot", F.col("seq") % 10 == 0)


@query("domain_boundaries", "SELECT event_id, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type")
def domain_boundaries(t):
    return Q.boundaries(t.events, "user_id", ["ts", "event_id"], "event_type").select("event_id", "before")


def _chain_sql(n: int) -> str:
    leads = ", ".join(f"lead(event_type, {k}) OVER w AS i{k}" for k in range(1, n))
    name = " || '>' || ".join(["event_type", *(f"i{k}" for k in range(1, n))])
    return f"SELECT {name} AS chain, count(*) AS n FROM (SELECT event_type, {leads} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE i{n - 1} IS NOT NULL GROUP BY 1"


@query("hot_paths_2", _chain_sql(2))
def hot_paths_2(t):
    return Q.chains(t.events, "user_id", ["ts", "event_id"], "event_type", 2)


@query("hot_paths_3", _chain_sql(3))
def hot_paths_3(t):
    return Q.chains(t.events, "user_id", ["ts", "event_id"], "event_type", 3)


@query("success_chains", "SELECT a, b, count(*) AS n, round(avg(good::INT), 6) AS rate FROM (SELECT pattern_id AS a, lead(pattern_id) OVER w AS b, outcome = 'success' AS good FROM outcomes WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)) WHERE b IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2")
def success_chains(t):
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    x = t.outcomes.select(F.col("pattern_id").alias("a"), F.lead("pattern_id").over(w).alias("b"), (F.col("outcome") == "success").alias("good"))
    return x.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg(F.col("good").cast("int")), 6).alias("rate")).where("n >= 2")


@query("transition_probabilities", "WITH x AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT a, b, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY 1, 2) SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM c")
def transition_probabilities(t):
    return Q.transitions(t.events, "user_id", ["ts", "event_id"], "event_type")


@query("co_occurrence", "WITH s AS (SELECT DISTINCT session_id, pattern_id AS x FROM outcomes) SELECT p.x AS a, q.x AS b, count(*) AS n FROM s p JOIN s q ON p.session_id = q.session_id AND p.x < q.x GROUP BY 1, 2")
def co_occurrence(t):
    return Q.co_occurrence(t.outcomes.withColumnRenamed("pattern_id", "x"), "session_id", "x")


@query("pattern_lift", "WITH b AS (SELECT avg((outcome = 'success')::INT) AS base FROM outcomes) SELECT pattern_id, count(*) AS n, round(avg((outcome = 'success')::INT), 6) AS rate, round(avg((outcome = 'success')::INT) / any_value(base), 6) AS lift FROM outcomes, b GROUP BY 1 HAVING count(*) >= 50")
def pattern_lift(t):
    return Q.lift(t.outcomes, "pattern_id", F.col("outcome") == "success", 50)


@query("week_over_week", "WITH w AS (SELECT event_type, weekofyear(ts)::BIGINT AS week, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, week, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY week) AS change FROM w")
def week_over_week(t):
    w = t.events.groupBy("event_type", F.weekofyear("ts").cast("long").alias("week")).agg(F.count("*").alias("n"))
    return w.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("week")))


@query(
    "interleave",
    """WITH a AS (SELECT id, row_number() OVER (ORDER BY reward DESC, id) AS r FROM patterns), b AS (SELECT id, row_number() OVER (ORDER BY effectiveness DESC, id) AS r FROM patterns),
u AS (SELECT id, min(r * 2 + s) AS place_at FROM (SELECT id, r, 0 AS s FROM a WHERE r <= 20 UNION ALL SELECT id, r, 1 FROM b WHERE r <= 20) GROUP BY 1) SELECT id, row_number() OVER (ORDER BY place_at) AS place FROM u""",
)
def interleave(t):
    def top(x):
        best = t.patterns.orderBy(F.desc(x), "id").limit(20).select("id", x)
        return best.select("id", F.row_number().over(Window.orderBy(F.desc(x), "id")).alias("rank"))

    return Q.interleaved(top("reward"), top("effectiveness"), "id")


@query("json_field_changes", "WITH x AS (SELECT event_id, json_extract_string(props, '$.k') AS k, lag(json_extract_string(props, '$.k')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id, 'k' AS field, p AS old, k AS new FROM x WHERE p IS NOT NULL AND p <> k")
def json_field_changes(t):
    m = F.from_json("props", "map<string,string>")
    x = t.events.select("event_id", m.alias("new"), F.lag(m).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("old")).where("old IS NOT NULL")
    return x.select("event_id", F.explode(Q.changed_fields(F.col("old"), F.col("new"))).alias("d")).select("event_id", "d.field", "d.old", "d.new")


@query("json_replay", "SELECT user_id, event_type AS field, arg_max(json_extract_string(props, '$.k'), {'a': ts, 'b': event_id}) AS value FROM events GROUP BY 1, 2")
def json_replay(t):
    d = t.events.select("user_id", F.col("event_type").alias("field"), F.get_json_object("props", "$.k").alias("value"), F.struct("ts", "event_id").alias("at"))
    return Q.replayed(d, "user_id", "at", "field", "value")


@query("as_of_state", "SELECT user_id, arg_max(value, {'a': ts, 'b': event_id}) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1")
def as_of_state(t):
    return t.events.where("ts <= TIMESTAMP_NTZ '2024-01-15'").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("delta_summary", "SELECT event_type AS op, count(*) AS n, CAST(min(ts) AS VARCHAR)[:10] AS first_day, CAST(max(ts) AS VARCHAR)[:10] AS last_day, round(count(*) / 30.0::DOUBLE, 6) AS per_day FROM events GROUP BY 1")
def delta_summary(t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.events.groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("n"), day(F.min("ts")).alias("first_day"), day(F.max("ts")).alias("last_day"), F.round(F.count("*") / 30.0, 6).alias("per_day"))


# Joins


@query("related_in_category", "SELECT id, count(*) OVER (PARTITION BY domain) - 1 AS n FROM patterns")
def related_in_category(t):
    """Other patterns of the same category: a count over the category, not a self-join."""
    return t.patterns.select("id", (F.count("*").over(Window.partitionBy("domain")) - 1).alias("n"))


@query("left_join_counts", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, count_if(o_orderkey IS NULL) AS without FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join_counts(t):
    j = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_mktsegment").agg(F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.count_if(F.col("o_orderkey").isNull()).alias("without"))


@query("null_safe_join", "SELECT coalesce(a.tier, '-') AS tier, count(*) AS n FROM patterns a JOIN (SELECT DISTINCT tier FROM patterns) b ON a.tier IS NOT DISTINCT FROM b.tier GROUP BY 1")
def null_safe_join(t):
    b = t.patterns.select(F.col("tier").alias("other")).distinct()
    return t.patterns.join(b, F.col("tier").eqNullSafe(F.col("other"))).groupBy(F.coalesce("tier", F.lit("-")).alias("tier")).agg(F.count("*").alias("n"))


@query(
    "unlinked_pairs",
    """WITH s AS (SELECT DISTINCT session_id, pattern_id AS x FROM outcomes), p AS (SELECT p.x AS a, q.x AS b, count(*) AS n FROM s p JOIN s q ON p.session_id = q.session_id AND p.x < q.x GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT a, b, n FROM p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE (e.src = a AND e.dst = b) OR (e.src = b AND e.dst = a))""",
)
def unlinked_pairs(t):
    """Pairs often seen together without an edge either way: both sides in canonical order, then an equality anti-join."""
    p = Q.co_occurrence(t.outcomes.withColumnRenamed("pattern_id", "x"), "session_id", "x", 10)
    e = t.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return p.join(e, ["a", "b"], "left_anti")


@query("orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def orphans(t):
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("semi_join_links", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def semi_join_links(t):
    return t.orders.join(t.lineitem.where("l_quantity >= 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query(
    "contradiction_pairs",
    """WITH w AS (SELECT id, domain, list_distinct(regexp_extract_all(lower(solution), '[\\p{L}\\p{N}'']+')) AS x FROM patterns)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))::DOUBLE, 6) AS similarity FROM w a JOIN w b ON a.domain = b.domain AND a.id < b.id
WHERE len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))::DOUBLE > 0.3""",
)
def contradiction_pairs(t):
    sets, member = J.classes(t.patterns.select("id", "domain", T.tokens(F.col("solution")).alias("x")), "domain")
    pairs = J.expanded(J.similar_classes(sets, 0.3).where("similarity > 0.3"), member)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


# Set operations: monthly snapshots of customers as epochs


def _epoch(t, month: str):
    return t.orders.where(F.date_format("o_orderdate", "yyyy-MM") == month).select("o_custkey").distinct()


def _epoch_sql(month: str) -> str:
    return f"SELECT o_custkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '{month}'"


@query("epoch_added", f"{_epoch_sql('1995-06')} EXCEPT {_epoch_sql('1995-05')}")
def epoch_added(t):
    return _epoch(t, "1995-06").subtract(_epoch(t, "1995-05"))


@query("epoch_removed", f"{_epoch_sql('1995-05')} EXCEPT {_epoch_sql('1995-06')}")
def epoch_removed(t):
    return _epoch(t, "1995-05").subtract(_epoch(t, "1995-06"))


@query("epoch_common", f"SELECT count(*) AS n FROM ({_epoch_sql('1995-05')} INTERSECT {_epoch_sql('1995-06')})")
def epoch_common(t):
    return _epoch(t, "1995-05").intersect(_epoch(t, "1995-06")).agg(F.count("*").alias("n"))


@query("epoch_snapshot", f"SELECT 'e1' AS epoch_id, count(*) AS n, min(o_custkey) AS low, max(o_custkey) AS high FROM (SELECT DISTINCT * FROM ({_epoch_sql('1995-05')}))")
def epoch_snapshot(t):
    return _epoch(t, "1995-05").withColumn("epoch_id", F.lit("e1")).groupBy("epoch_id").agg(F.count("*").alias("n"), F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"))


@query("union_of_sources", "SELECT src, count(*) AS n FROM (SELECT 'doc' AS src, text FROM documents UNION ALL SELECT 'talk', text FROM conversations UNION ALL SELECT 'page', html FROM pages) GROUP BY 1")
def union_of_sources(t):
    one = lambda df, name, c: df.select(F.lit(name).alias("src"), F.col(c).alias("text"))
    u = one(t.documents, "doc", "text").unionByName(one(t.conversations, "talk", "text")).unionByName(one(t.pages, "page", "html"))
    return u.groupBy("src").agg(F.count("*").alias("n"))
