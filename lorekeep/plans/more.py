"""Further queries: composite retrieval, dashboards, health, trajectories, nested rows, table functions and views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import vectors as V
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import sequences as Q
from ..sources import files
from .registry import query
from .retrieval import KNN, picks_sql

c = F.col


@query(
    "retrieval_pipeline",
    f"""WITH {KNN}, near AS (SELECT vec_id, v, sim FROM k WHERE sim >= 0 ORDER BY sim DESC, vec_id LIMIT 100), cand AS (SELECT n.* FROM near n JOIN patterns p ON p.id = n.vec_id WHERE (p.domain = 'en' OR starts_with(p.domain, 'en.') OR starts_with('en', p.domain || '.')) AND p.reward >= 0.1),
{picks_sql(10, 0.7, False)} SELECT p.id, round(greatest(0, least(1, (c.sim * 0.5 + exp(-(updated_days * 24) / 720.0::DOUBLE) * 0.1
  + ((confidence * 0.4 + success_rate * 0.6) * (least(usage_count, 10) / 10.0::DOUBLE) + confidence * (1 - least(usage_count, 10) / 10.0::DOUBLE)) * 0.2 + reward * 0.1
  + (CASE WHEN usage_count > 0 THEN least(ln(usage_count) / ln(100), 1) ELSE 0 END) * 0.1))), 6) AS score, (SELECT count(*) FROM near) AS n_similar, (SELECT count(*) FROM cand) AS n_filtered FROM p10 JOIN cand c USING (vec_id) JOIN patterns p ON p.id = c.vec_id""",
)
def retrieval_pipeline(t):
    """Similar rows, the best 100, domain and reward filters, diversity, five factors: with how many rows each stage left."""
    p = t.patterns.select("id", "domain", "reward", "confidence", "success_rate", "usage_count", "updated_days")
    near = R.nearest(t.vectors, R.query_vector(t.vectors, 0), 100, 0.0).withColumnRenamed("vec_id", "id")
    rows = near.join(p, "id").where(T.domain_matches(c("domain"), "en") & (c("reward") >= 0.1))
    chosen = R.diverse(rows.select(c("id").alias("vec_id"), "v", "sim"), 10, 0.7, None).withColumnRenamed("vec_id", "id")
    s = S.five_factor(c("sim"), S.recency_exponential(c("updated_days")), S.reliability_by_usage(c("confidence"), c("success_rate"), c("usage_count")), c("reward"), S.reuse_log100(c("usage_count")))
    counts = near.agg(F.count("*").alias("n_similar")).join(F.broadcast(rows.agg(F.count("*").alias("n_filtered"))))
    return rows.join(chosen, "id").select("id", F.round(s, 6).alias("score")).join(F.broadcast(counts))


@query("query_router", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'when') OR regexp_matches(lower(text), '\\d{4}') THEN 'temporal' WHEN contains(lower(text), 'related') THEN 'graph' WHEN len(string_split(trim(text), ' ')) <= 3 THEN 'keyword' WHEN contains(text, '?') THEN 'semantic' ELSE 'hybrid' END AS mode FROM conversations")
def query_router(t):
    low = F.lower("text")
    mode = F.when(low.contains("when") | low.rlike(r"\d{4}"), "temporal").when(low.contains("related"), "graph").when(F.size(F.split(F.trim("text"), " ")) <= 3, "keyword").when(c("text").contains("?"), "semantic").otherwise("hybrid")
    return t.conversations.select("conv_id", "turn", mode.alias("mode"))


@query("lookup_join_category", "SELECT v.vec_id, p.domain FROM vectors v JOIN patterns p ON v.vec_id = p.id WHERE v.vec_id IN (3, 14, 15, 92)")
def lookup_join_category(t):
    return t.vectors.where(c("vec_id").isin(3, 14, 15, 92)).join(t.patterns.select("id", "domain"), c("vec_id") == c("id")).select("vec_id", "domain")


@query("contradictions_by_category", "SELECT p.domain, count(*) AS n FROM predictions f JOIN patterns p ON f.id = p.id WHERE f.probability > 0.8 AND f.outcome = FALSE GROUP BY 1")
def contradictions_by_category(t):
    wrong = t.predictions.where("probability > 0.8 AND outcome = FALSE").select("id")
    return wrong.join(t.patterns.select("id", "domain"), "id").groupBy("domain").agg(F.count("*").alias("n"))


@query("optional_link_filter", "SELECT conv_id, count(*) AS n_turns FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = 'user' AND length(d.text) > 100) GROUP BY 1 ORDER BY n_turns DESC, conv_id LIMIT 20")
def optional_link_filter(t):
    long = t.conversations.where("role = 'user' AND length(text) > 100").select("conv_id")
    return t.conversations.join(long, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("n_turns")).orderBy(F.desc("n_turns"), "conv_id").limit(20)


# Nested trajectories


def _trajectories(t):
    step = F.struct("turn", "role", F.length("text").cast("long").alias("size"))
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))


@query("trajectory_stats", "WITH s AS (SELECT conv_id, count(*) AS n, sum(length(text))::BIGINT AS size, count_if(role = 'user') AS asked FROM conversations GROUP BY 1) SELECT count(*) AS n, round(avg(n), 6) AS avg_steps, round(avg(size), 6) AS avg_size, sum(asked)::BIGINT AS asked FROM s")
def trajectory_stats(t):
    s = _trajectories(t)
    size = F.aggregate(F.transform("steps", lambda x: x["size"]), F.lit(0).cast("long"), lambda a, b: a + b)
    return s.agg(F.count("*").alias("n"), F.round(F.avg(F.size("steps")), 6).alias("avg_steps"), F.round(F.avg(size), 6).alias("avg_size"), F.sum(F.size(F.filter("steps", lambda x: x["role"] == "user"))).alias("asked"))


@query("trajectory_nested", "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, round(avg(length(text)) FILTER (WHERE role = 'user'), 6) AS user_size FROM conversations GROUP BY 1")
def trajectory_nested(t):
    mine = F.filter("steps", lambda x: x["role"] == "user")
    total = F.aggregate(F.transform(mine, lambda x: x["size"]), F.lit(0).cast("long"), lambda a, b: a + b)
    roles = F.array_sort(F.array_distinct(F.transform("steps", lambda x: x["role"])))
    return _trajectories(t).select("conv_id", F.array_join(roles, ",").alias("roles"), F.round(F.when(F.size(mine) > 0, total / F.size(mine)), 6).alias("user_size"))


@query("trajectory_replay", "SELECT conv_id, turn, role, length(text) AS size FROM conversations")
def trajectory_replay(t):
    return _trajectories(t).select("conv_id", F.explode("steps").alias("s")).select("conv_id", "s.*")


# Dashboards and health


@query("dashboard", "SELECT count(*) AS n, count(DISTINCT domain) AS domains, count_if(tier IS NULL) AS untiered, count_if(created_days <= 7) AS fresh, count_if(archived) AS archived, round(avg(reward), 6) AS avg_reward, max(reuse_count) AS most_reused, round(sum(CASE WHEN success THEN 1 ELSE 0 END) / count(*), 6) AS success FROM patterns")
def dashboard(t):
    return t.patterns.agg(F.count("*").alias("n"), F.count_distinct("domain").alias("domains"), F.count_if(c("tier").isNull()).alias("untiered"), F.count_if(c("created_days") <= 7).alias("fresh"), F.count_if("archived").alias("archived"), A.mean("reward").alias("avg_reward"), F.max("reuse_count").alias("most_reused"), F.round(F.count_if("success") / F.count("*"), 6).alias("success"))


@query("dashboard_domains", "SELECT p.domain, count(*) AS n, round(avg(reward), 6) AS avg_reward, count(v.vec_id) AS with_embedding FROM patterns p LEFT JOIN vectors v ON v.vec_id = p.id GROUP BY 1")
def dashboard_domains(t):
    j = t.patterns.join(t.vectors.select("vec_id"), c("vec_id") == c("id"), "left")
    return j.groupBy("domain").agg(F.count("*").alias("n"), A.mean("reward").alias("avg_reward"), F.count("vec_id").alias("with_embedding"))


@query("coherence_health", "SELECT count(*) AS n, round(count_if(outcome = FALSE AND probability > 0.5) / count_if(outcome IS NOT NULL), 6) AS contradiction_rate, round(count_if(outcome AND probability > 0.5) / count_if(probability > 0.5 AND outcome IS NOT NULL), 6) AS consistency, (SELECT domain FROM predictions WHERE outcome IS NOT NULL GROUP BY 1 ORDER BY avg((NOT outcome)::INT) DESC, domain DESC LIMIT 1) AS worst FROM predictions")
def coherence_health(t):
    p = t.predictions
    high, known = c("probability") > 0.5, c("outcome").isNotNull()
    worst = p.where(known).groupBy("domain").agg(F.avg((~c("outcome")).cast("int")).alias("x")).agg(F.max_by("domain", F.struct("x", "domain")).alias("worst"))
    a = p.agg(F.count("*").alias("n"), F.round(F.count_if(~c("outcome") & high) / F.count_if(known), 6).alias("contradiction_rate"), F.round(F.count_if(c("outcome") & high) / F.count_if(high & known), 6).alias("consistency"))
    return a.join(F.broadcast(worst))


@query("wormhole_stats", "SELECT count_if(strength >= 0.3) AS active, count_if(strength < 0.3) AS inactive, round(avg(strength), 6) AS avg_strength, round(sum(strength * age_days), 4) AS saved, (SELECT count(*) FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE kind = 'similar' EXCEPT SELECT least(src, dst), greatest(src, dst) FROM edges WHERE kind = 'depends')) AS pending FROM edges")
def wormhole_stats(t):
    pair = lambda k: t.edges.where(c("kind") == k).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pending = pair("similar").subtract(pair("depends")).agg(F.count("*").alias("pending"))
    return t.edges.agg(F.count_if(c("strength") >= 0.3).alias("active"), F.count_if(c("strength") < 0.3).alias("inactive"), A.mean("strength").alias("avg_strength"), F.round(F.sum(c("strength") * c("age_days")), 4).alias("saved")).join(F.broadcast(pending))


@query("ewc_strength", "SELECT domain, round(least(10000, greatest(100, 1000 * (0.5 + avg(abs(reward - effectiveness))))), 6) AS strength FROM patterns GROUP BY 1")
def ewc_strength(t):
    return t.patterns.groupBy("domain").agg(F.round(S.clamp((F.avg(F.abs(c("reward") - c("effectiveness"))) + 0.5) * 1000, 100.0, 10000.0), 6).alias("strength"))


@query("principle_adherence", "SELECT event_type AS principle, count(*) AS total, count_if(value >= 50) AS adhered, round(count_if(value >= 50) / count(*), 6) AS rate FROM events GROUP BY 1")
def principle_adherence(t):
    ok = F.count_if(c("value") >= 50)
    return t.events.groupBy(c("event_type").alias("principle")).agg(F.count("*").alias("total"), ok.alias("adhered"), F.round(ok / F.count("*"), 6).alias("rate"))


@query("router_lanes", "SELECT CASE WHEN value < 1 THEN 'reflex' WHEN value < 10 THEN 'retrieval' ELSE 'heavy' END AS lane, count(*) AS n, round(avg(value), 6) AS avg_latency FROM events GROUP BY 1")
def router_lanes(t):
    lane = F.when(c("value") < 1, "reflex").when(c("value") < 10, "retrieval").otherwise("heavy")
    return t.events.groupBy(lane.alias("lane")).agg(F.count("*").alias("n"), A.mean("value").alias("avg_latency"))


@query("profiler_snapshot", "SELECT event_type AS operation, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def profiler_snapshot(t):
    return t.events.groupBy(c("event_type").alias("operation")).agg(F.count("*").alias("n"), *A.percentiles("value", [0.5, 0.95, 0.99]))


@query("conflict_stats", "SELECT status, count(*) AS n, min(age_days) AS newest, max(age_days) FILTER (WHERE n_evidence = 0) AS oldest_bare FROM predictions GROUP BY 1")
def conflict_stats(t):
    return t.predictions.groupBy("status").agg(F.count("*").alias("n"), F.min("age_days").alias("newest"), F.max(F.when(c("n_evidence") == 0, c("age_days"))).alias("oldest_bare"))


@query("activity_summary", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1")
def activity_summary(t):
    last = t.events.agg(F.max("ts").alias("m"))
    return t.events.join(F.broadcast(last)).where("ts >= m - INTERVAL 1 DAY").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("agreement_of_findings", "WITH x AS (SELECT DISTINCT domain, tier FROM patterns WHERE tier IS NOT NULL), s AS (SELECT domain, list(tier) AS l FROM x GROUP BY 1) SELECT round(avg(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l)))::DOUBLE), 6) AS agreement FROM s a JOIN s b ON a.domain < b.domain AND split_part(a.domain, '.', 1) = split_part(b.domain, '.', 1)")
def agreement_of_findings(t):
    """Mean pairwise overlap of findings: pairs of domains of one root, of which there are few."""
    s = t.patterns.where("tier IS NOT NULL").groupBy("domain").agg(F.collect_set("tier").alias("l")).withColumn("root", T.domain_root(c("domain")))
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, (c("a.root") == c("b.root")) & (c("a.domain") < c("b.domain")))
    return j.agg(F.round(F.avg(T.jaccard(c("a.l"), c("b.l"), 1.0)), 6).alias("agreement"))


@query("insight_trend", "WITH w AS (SELECT avg(reward) FILTER (WHERE updated_days <= 7) AS s, avg(reward) FILTER (WHERE updated_days <= 30) AS l, avg(success_rate) FILTER (WHERE updated_days <= 7) AS ss, avg(success_rate) FILTER (WHERE updated_days <= 30) AS ls FROM patterns) SELECT round((s - l) / l * 100, 6) AS reward_change, round((ss - ls) / ls * 100, 6) AS success_change, CASE WHEN (s - l) / l * 40 + (ss - ls) / ls * 30 > 5 THEN 'improving' WHEN (s - l) / l * 40 + (ss - ls) / ls * 30 < -5 THEN 'declining' ELSE 'stable' END AS trend FROM w")
def insight_trend(t):
    of = lambda x, d: F.avg(F.when(c("updated_days") <= d, c(x)))
    w = t.patterns.agg(of("reward", 7).alias("s"), of("reward", 30).alias("l"), of("success_rate", 7).alias("ss"), of("success_rate", 30).alias("ls"))
    r, k = (c("s") - c("l")) / c("l"), (c("ss") - c("ls")) / c("ls")
    x = r * 40 + k * 30
    return w.select(F.round(r * 100, 6).alias("reward_change"), F.round(k * 100, 6).alias("success_change"), F.when(x > 5, "improving").when(x < -5, "declining").otherwise("stable").alias("trend"))


# Text, time and vectors


@query("text_overlap", "SELECT p.id, round(len(list_intersect(a, b)) / greatest(len(a), 1)::DOUBLE, 6) AS overlap FROM (SELECT id, list_distinct(regexp_extract_all(lower(problem), '[\\p{L}\\p{N}'']+')) AS a, list_distinct(regexp_extract_all(lower(solution), '[\\p{L}\\p{N}'']+')) AS b FROM patterns) p")
def text_overlap(t):
    a, b = T.tokens(c("problem")), T.tokens(c("solution"))
    return t.patterns.select("id", F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)).cast("double"), 6).alias("overlap"))


@query("scenario_score", "WITH w AS (SELECT conv_id, turn, text, list_filter(['answer', 'reason', 'list', 'the', 'and'], lambda k: contains(lower(text), k)) AS hit FROM conversations) SELECT conv_id, turn, round(len(hit) / 5.0::DOUBLE * 0.7 + least(length(text) / 200.0::DOUBLE, 1) * 0.3, 6) AS score FROM w")
def scenario_score(t):
    keys = F.array(*map(F.lit, ("answer", "reason", "list", "the", "and")))
    hit = F.size(F.filter(keys, lambda k: F.lower("text").contains(k)))
    return t.conversations.select("conv_id", "turn", F.round(hit / 5.0 * 0.7 + F.least(F.length("text") / 200.0, F.lit(1.0)) * 0.3, 6).alias("score"))


@query("self_contrast", "SELECT conv_id, turn, regexp_matches(text, '[0-9]')::INT + contains(text, '`')::INT + (length(text) > 80)::INT AS marks FROM conversations")
def self_contrast(t):
    return t.conversations.select("conv_id", "turn", (c("text").rlike("[0-9]").cast("int") + c("text").contains("`").cast("int") + (F.length("text") > 80).cast("int")).alias("marks"))


@query("log_redaction", "SELECT event_id, regexp_replace(props, '\"k\": *[0-9]+', '\"k\": \"[REDACTED]\"', 'g') AS props FROM events")
def log_redaction(t):
    return t.events.select("event_id", F.regexp_replace("props", '"k": *[0-9]+', '"k": "[REDACTED]"').alias("props"))


@query("anonymised_customers", "SELECT md5(c_name) AS who, floor(c_acctbal / 1000)::BIGINT * 1000 AS balance_band, CASE WHEN count(*) OVER (PARTITION BY c_mktsegment) >= 5 THEN c_mktsegment END AS segment FROM customer")
def anonymised_customers(t):
    n = F.count("*").over(Window.partitionBy("c_mktsegment"))
    return t.customer.select(F.md5("c_name").alias("who"), (F.floor(c("c_acctbal") / 1000) * 1000).alias("balance_band"), F.when(n >= 5, c("c_mktsegment")).alias("segment"))


@query("julian_ages", "SELECT id, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) / 86400000000.0::DOUBLE, 6) AS age FROM patterns")
def julian_ages(t):
    us = lambda x: F.unix_micros(x.cast("timestamp"))
    return t.patterns.select("id", F.round((us(F.lit("2024-02-01 00:00:00")) - us(c("created_at"))) / 86400000000.0, 6).alias("age"))


@query("session_efficiency", "SELECT session_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds, round(count_if(outcome = 'success') * 1000 / sum(value), 6) AS per_1000 FROM outcomes GROUP BY 1")
def session_efficiency(t):
    us = lambda x: F.unix_micros(x.cast("timestamp"))
    return t.outcomes.groupBy("session_id").agg(F.floor((us(F.max("ts")) - us(F.min("ts"))) / 1000000).alias("seconds"), F.round(F.count_if(c("outcome") == "success") * 1000 / F.sum("value"), 6).alias("per_1000"))


@query("hyperbolic_hierarchy", "SELECT a.vec_id, sqrt(list_dot_product(a.v, a.v)) > sqrt(list_dot_product(b.v, b.v)) AS deeper, round(list_distance(a.v, b.v) * (1 + 0.5 * abs((a.vec_id % 5) - (b.vec_id % 5)) / 5.0::DOUBLE), 6) AS d FROM vectors a, vectors b WHERE b.vec_id = 4")
def hyperbolic_hierarchy(t):
    q = t.vectors.where("vec_id = 4").select(c("v").alias("q"), (c("vec_id") % 5 / 5.0).alias("dq"))
    j = t.vectors.join(F.broadcast(q))
    return j.select("vec_id", (V.norm(c("v")) > V.norm(c("q"))).alias("deeper"), F.round(V.hierarchy_distance(V.l2(c("v"), c("q")), c("vec_id") % 5 / 5.0, c("dq")), 6).alias("d"))


@query("dimension_cut", "SELECT vec_id, round(sqrt(list_dot_product(v[:16], v[:16])), 6) AS norm FROM vectors")
def dimension_cut(t):
    return t.vectors.select("vec_id", F.round(V.norm(F.slice("v", 1, 16)), 6).alias("norm"))


@query("training_triplets", "WITH s AS (SELECT domain, arg_max(id, {'a': reward, 'b': -id}) AS anchor FROM patterns GROUP BY 1) SELECT s.domain, anchor, count_if(p.reward >= 0.6) * count_if(p.reward < 0.4) AS triplets FROM s JOIN patterns p ON p.domain = s.domain AND p.id <> anchor GROUP BY 1, 2")
def training_triplets(t):
    p = t.patterns.select("id", "domain", "reward")
    s = p.groupBy("domain").agg(F.max_by("id", F.struct("reward", -c("id"))).alias("anchor"))
    return p.join(s, "domain").where("id <> anchor").groupBy("domain", "anchor").agg((F.count_if(c("reward") >= 0.6) * F.count_if(c("reward") < 0.4)).alias("triplets"))


@query("beta_samples")
def beta_samples(t):
    """Thompson sampling with a fixed seed: a draw for each arm, and the arm that wins."""
    import pandas as pd

    n = lambda o: F.count_if(c("outcome") == o) + F.lit(1.0)
    arms = t.outcomes.groupBy("pattern_id").agg(n("success").alias("a"), n("failure").alias("b"))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = [np.random.default_rng([11, int(k)]).beta(a, b) for k, a, b in zip(rows["pattern_id"], rows["a"], rows["b"], strict=True)]
        return rows[["pattern_id"]].assign(sample=x)

    return arms.mapInPandas(lambda it: (draw(x) for x in it), "pattern_id long, sample double").orderBy(F.desc("sample")).limit(10)


# Graph compositions, orchestration, functions and views


@query("light_cone", "SELECT 'past' AS cone, count(DISTINCT src) AS n FROM edges WHERE dst = 9 UNION ALL SELECT 'future', count(DISTINCT dst) FROM edges WHERE src = 9 UNION ALL SELECT 'core', 1")
def light_cone(t):
    past = G.neighbours(t.edges, 9, "in").agg(F.lit("past").alias("cone"), F.count_distinct("node").alias("n"))
    future = G.neighbours(t.edges, 9, "out").agg(F.lit("future").alias("cone"), F.count_distinct("node").alias("n"))
    core = t.spark.range(1).select(F.lit("core").alias("cone"), F.lit(1).cast("long").alias("n"))
    return past.unionByName(future).unionByName(core)


@query("dream_cycle", "SELECT 'archive' AS phase, count(*) AS n FROM patterns WHERE reward < 0.1 AND NOT archived UNION ALL SELECT 'refresh', count(*) FROM patterns WHERE updated_days > 120 UNION ALL SELECT 'merge', count(*) FROM (SELECT content_hash FROM patterns GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'calibrate', count(*) FROM predictions WHERE status = 'resolved'")
def dream_cycle(t):
    one = lambda name, df: df.agg(F.lit(name).alias("phase"), F.count("*").alias("n"))
    p = t.patterns
    out = one("archive", p.where("reward < 0.1 AND NOT archived")).unionByName(one("refresh", p.where("updated_days > 120")))
    return out.unionByName(one("merge", A.duplicate_groups(p))).unionByName(one("calibrate", t.predictions.where("status = 'resolved'")))


@query("graduation", "SELECT id, CASE WHEN reward >= 0.9 AND usage_count >= 20 THEN 'reflex' WHEN reward >= 0.7 AND usage_count >= 5 THEN 'crystal' ELSE 'booster' END AS tier FROM patterns WHERE coalesce(tier, 'booster') <> CASE WHEN reward >= 0.9 AND usage_count >= 20 THEN 'reflex' WHEN reward >= 0.7 AND usage_count >= 5 THEN 'crystal' ELSE 'booster' END")
def graduation(t):
    new = S.tier_by_score(c("reward"), c("usage_count"))
    return t.patterns.where(F.coalesce("tier", F.lit("booster")) != new).select("id", new.alias("tier"))


@query("sql_table_function", "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1")
def sql_table_function(t):
    t.events.createOrReplaceTempView("events_fn")
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION over_value(low DOUBLE) RETURNS TABLE (event_type STRING, n BIGINT) RETURN SELECT event_type, count(*) FROM events_fn WHERE value > low GROUP BY 1")
    return t.spark.sql("SELECT * FROM over_value(50D)")


@query("sql_scalar_function", "SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS class FROM documents")
def sql_scalar_function(t):
    t.documents.createOrReplaceTempView("documents_fn")
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION size_class(n BIGINT) RETURNS STRING RETURN CASE WHEN n > 2000 THEN 'long' ELSE 'short' END")
    return t.spark.sql("SELECT doc_id, size_class(n_chars) AS class FROM documents_fn")


@query("audit_view", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def audit_view(t):
    t.events.where(c("event_type").isin("error", "signup")).createOrReplaceTempView("v_audit")
    return t.spark.sql("SELECT event_type, count(*) AS n FROM v_audit GROUP BY 1")


@query("seed_export", "SELECT min(id) AS id, domain FROM patterns WHERE regexp_matches(domain, '^(en|de)\\.') AND NOT regexp_matches(domain, 'src1$') GROUP BY substr(problem, 1, 200), domain")
def seed_export(t):
    return files.seed_rows(t.patterns, r"^(en|de)\.", "src1$", T.stripped).select("id", "domain")


@query("notification_events", "SELECT event_type AS channel, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def notification_events(t):
    return files.notifications(t.events.select(c("event_type").alias("channel"), c("props").alias("payload")), "k long").select("channel", "k")


@query("patterns_by_transition", "WITH x AS (SELECT pattern_id AS a, lead(pattern_id) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS b FROM outcomes) SELECT a, b, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4")
def patterns_by_transition(t):
    return Q.transitions(t.outcomes, "session_id", ["ts", "event_id"], "pattern_id").where("n >= 4").select("a", "b", "n")
