"""Queries on scans, filters, paging and row sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans as S
from .registry import query


@query("scan_vectors", "SELECT vec_id, label FROM vectors WHERE len(v) > 0")
def scan_vectors(t):
    return t.vectors.where(F.size("v") > 0).select("vec_id", "label")


@query("lookup_by_id", "SELECT id, problem, domain FROM patterns WHERE id = 42")
def lookup_by_id(t):
    return S.lookup(t.patterns, "id", 42).select("id", "problem", "domain")


@query("scan_category", "SELECT id, domain, reward FROM patterns WHERE domain = 'en.src1' ORDER BY reward DESC, id LIMIT 20")
def scan_category(t):
    return S.best(S.lookup(t.patterns, "domain", "en.src1"), "reward", 20).select("id", "domain", "reward")


@query("scan_recent", "SELECT id, updated_days::BIGINT AS updated_days FROM patterns ORDER BY updated_days, id LIMIT 25")
def scan_recent(t):
    return S.recent(t.patterns, 25).select("id", F.col("updated_days").cast("long").alias("updated_days"))


@query("scan_top_effective", "SELECT id, effectiveness FROM patterns ORDER BY effectiveness DESC, id LIMIT 25")
def scan_top_effective(t):
    return S.best(t.patterns, "effectiveness", 25).select("id", "effectiveness")


@query("scan_tiers", "SELECT id, coalesce(tier, 'booster') AS tier FROM patterns WHERE coalesce(tier, 'booster') IN ('reflex', 'booster')")
def scan_tiers(t):
    return S.in_tiers(t.patterns, ["reflex", "booster"]).select("id", F.coalesce("tier", F.lit("booster")).alias("tier"))


@query("sql_with_parameters", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def sql_with_parameters(t):
    t.orders.createOrReplaceTempView("orders_param")
    return t.spark.sql("SELECT o_orderpriority, count(*) AS n FROM orders_param WHERE o_totalprice > :low GROUP BY 1", args={"low": 100000})


@query(
    "listing_page",
    """SELECT id, domain, reward FROM patterns WHERE lower(tier) = 'crystal' AND (contains(lower(problem), 'the') OR contains(lower(solution), 'the') OR contains(lower(domain), 'the'))
ORDER BY reward DESC, id LIMIT 20 OFFSET 10""",
)
def listing_page(t):
    return S.listing(t.patterns, tier="Crystal", search="The", sort="reward", descending=True, offset=10, limit=20).select("id", "domain", "reward")


@query("listing_count", "SELECT count(*) AS n FROM patterns WHERE domain = 'en.src3'")
def listing_count(t):
    return S.lookup(t.patterns, "domain", "en.src3").agg(F.count("*").alias("n"))


@query("coalesced_projection", "SELECT id, coalesce(tier, 'booster') AS tier, coalesce(problem, '') AS problem, substring(coalesce(problem, ''), 1, 80) AS label FROM patterns")
def coalesced_projection(t):
    p = F.coalesce("problem", F.lit(""))
    return t.patterns.select("id", F.coalesce("tier", F.lit("booster")).alias("tier"), p.alias("problem"), F.substring(p, 1, 80).alias("label"))


@query("domain_both_ways", "SELECT id, domain FROM patterns WHERE domain = 'en' OR starts_with(domain, 'en.') OR starts_with('en', domain || '.')")
def domain_both_ways(t):
    return S.in_domain(t.patterns, "en").select("id", "domain")


@query("domain_or_child", "SELECT id, domain FROM patterns WHERE domain = 'de' OR starts_with(domain, 'de.')")
def domain_or_child(t):
    return S.in_domain(t.patterns, "de", "within").select("id", "domain")


@query("domain_prefix", "SELECT id, domain FROM patterns WHERE starts_with(domain, 'en.src1')")
def domain_prefix(t):
    return S.in_domain(t.patterns, "en.src1", "prefix").select("id", "domain")


@query("tags_all", "SELECT id FROM patterns WHERE list_has_all(tags, ['en', 'long'])")
def tags_all(t):
    return S.all_tags(t.patterns, ["en", "long"]).select("id")


@query("tags_any", "SELECT id FROM patterns WHERE list_has_any(tags, ['fr', 'src4'])")
def tags_any(t):
    return S.any_tag(t.patterns, ["fr", "src4"]).select("id")


@query("exclude_session", "SELECT id, session_id FROM patterns WHERE session_id IS DISTINCT FROM 's7'")
def exclude_session(t):
    return S.not_in_session(t.patterns, "s7").select("id", "session_id")


@query("only_successful", "SELECT id, success_rate FROM patterns WHERE success_rate > 0.5 AND reward >= 0.6 AND effectiveness >= 0.3")
def only_successful(t):
    return t.patterns.where("success_rate > 0.5 AND reward >= 0.6 AND effectiveness >= 0.3").select("id", "success_rate")


@query("keywords_all", "SELECT id FROM patterns WHERE (contains(lower(problem), 'the') OR contains(lower(solution), 'the')) AND (contains(lower(problem), 'and') OR contains(lower(solution), 'and'))")
def keywords_all(t):
    return S.all_words(t.patterns, "The and").select("id")


@query("like_any_column", "SELECT id, reward FROM patterns WHERE problem ILIKE '%tion%' OR solution ILIKE '%tion%' OR domain ILIKE '%tion%' ORDER BY reward DESC, id LIMIT 10")
def like_any_column(t):
    like = F.col("problem").ilike("%tion%") | F.col("solution").ilike("%tion%") | F.col("domain").ilike("%tion%")
    return S.best(t.patterns.where(like), "reward", 10).select("id", "reward")


@query("not_archived", "SELECT id FROM patterns WHERE archived IS NULL OR NOT archived")
def not_archived(t):
    return t.patterns.where(~F.coalesce("archived", F.lit(False))).select("id")


@query("metric_time_range", "SELECT event_id, value FROM events WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")
def metric_time_range(t):
    return t.events.where("event_type = 'view' AND ts BETWEEN TIMESTAMP_NTZ '2024-01-05' AND TIMESTAMP_NTZ '2024-01-10'").select("event_id", "value")


@query(
    "low_reward",
    """SELECT id, reward, CASE WHEN reward < 0.1 THEN 'archive' WHEN effectiveness < 0.3 THEN 'review' ELSE 'monitor' END AS advice,
  array_to_string(list_filter([CASE WHEN reward < 0.1 THEN 'very low reward' END, CASE WHEN effectiveness < 0.3 THEN 'low effectiveness' END, CASE WHEN confidence < 0.3 THEN 'low confidence' END],
    lambda x: x IS NOT NULL), '; ') AS reasons
FROM patterns WHERE reward < 0.3 AND reuse_count >= 5""",
)
def low_reward(t):
    return S.low_reward(t.patterns).select("id", "reward", "advice", F.array_join("reasons", "; ").alias("reasons"))


@query("stale_patterns", "SELECT id, updated_days::BIGINT AS updated_days FROM patterns WHERE updated_days > 90 AND reuse_count < 20")
def stale_patterns(t):
    return S.stale(t.patterns, 90, 20).select("id", F.col("updated_days").cast("long").alias("updated_days"))


@query("archive_marks", "SELECT id, array_to_string(list_append(tags, '__archived__'), ',') AS tags, domain || chr(10) || '---' || chr(10) || 'archived' AS critique FROM patterns WHERE reward < 0.05")
def archive_marks(t):
    return S.archived(t.patterns.where("reward < 0.05"), "archived").select("id", F.array_join("tags", ",").alias("tags"), "critique")


@query(
    "opportunities",
    """SELECT count_if(reward < 0.4 AND usage_count >= 10) AS low_performers, count_if(updated_days > 90 AND reuse_count < 10) AS stale, count_if(strlen(solution) > 1000) AS complex,
  count_if(reward >= 0.8 AND usage_count >= 10) AS high_performers, count_if(abs(reward - effectiveness) > 0.4) AS inconsistent FROM patterns""",
)
def opportunities(t):
    c = F.col
    return t.patterns.agg(
        F.count_if((c("reward") < 0.4) & (c("usage_count") >= 10)).alias("low_performers"),
        F.count_if((c("updated_days") > 90) & (c("reuse_count") < 10)).alias("stale"),
        F.count_if(F.octet_length("solution") > 1000).alias("complex"),
        F.count_if((c("reward") >= 0.8) & (c("usage_count") >= 10)).alias("high_performers"),
        F.count_if(F.abs(c("reward") - c("effectiveness")) > 0.4).alias("inconsistent"),
    )


@query("audit_query", "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id < 50 AND value > 10 ORDER BY ts DESC, event_id LIMIT 20 OFFSET 5")
def audit_query(t):
    df = t.events
    for test in ("event_type = 'error'", "user_id < 50", "value > 10"):
        df = df.where(test)
    return df.orderBy(F.desc("ts"), "event_id").offset(5).limit(20).select("event_id", "user_id")


@query("access_include", "SELECT id FROM patterns WHERE domain IN (SELECT lang || '.' || source FROM documents WHERE doc_id < 5)")
def access_include(t):
    return S.granted(t.patterns, t.patterns.where("id < 5"), "include", "domain").select("id")


@query("access_exclude", "SELECT id FROM patterns WHERE domain NOT IN (SELECT lang || '.' || source FROM documents WHERE doc_id < 5)")
def access_exclude(t):
    return S.granted(t.patterns, t.patterns.where("id < 5"), "exclude", "domain").select("id")


@query("surprise_listing", "SELECT id, surprise FROM patterns WHERE surprise >= 0.7 ORDER BY surprise DESC, id LIMIT 50")
def surprise_listing(t):
    return S.best(t.patterns.where("surprise >= 0.7"), "surprise", 50).select("id", "surprise")


@query("timeline_overlap", "SELECT id, min_days, max_days FROM predictions WHERE min_days <= 10 AND max_days >= 5")
def timeline_overlap(t):
    return S.overlapping(t.predictions, 5, 10).select("id", "min_days", "max_days")


@query("event_filter", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'error') AND ts >= TIMESTAMP '2024-01-20'")
def event_filter(t):
    return t.events.where(F.col("event_type").isin("purchase", "error") & (F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-20'"))).select("event_id")


@query(
    "upsert_latest",
    """WITH n AS (SELECT id, reward + 1 AS reward, updated_days - 50 AS v FROM patterns WHERE id % 3 = 0 UNION ALL SELECT id + 1000000, reward, updated_days FROM patterns WHERE id < 10),
b AS (SELECT id, reward, -updated_days::BIGINT AS v, 0 AS x FROM patterns UNION ALL SELECT id, reward, -v::BIGINT, 1 FROM n)
SELECT id, reward, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, x DESC) AS r FROM b) WHERE r = 1""",
)
def upsert_latest(t):
    p = t.patterns
    v = -F.col("updated_days").cast("long")
    old = p.select("id", "reward", v.alias("v"))
    new = p.where("id % 3 = 0").select("id", (F.col("reward") + 1).alias("reward"), (v + 50).alias("v")).unionByName(p.where("id < 10").select((F.col("id") + 1000000).alias("id"), "reward", v.alias("v")))
    return S.upserted(old, new, "id", "v")


@query("import_new_hashes", "SELECT DISTINCT content_hash FROM patterns WHERE id >= 500 AND content_hash NOT IN (SELECT content_hash FROM patterns WHERE id < 500)")
def import_new_hashes(t):
    return S.without_known(t.patterns.where("id >= 500").select("content_hash"), t.patterns.where("id < 500"), "content_hash")


@query("incremental_changes", "SELECT id, updated_days::BIGINT AS updated_days FROM patterns WHERE updated_days < 30 ORDER BY updated_days, id LIMIT 40 OFFSET 10")
def incremental_changes(t):
    return S.changed_since(t.patterns, 30, 40, 10).select("id", F.col("updated_days").cast("long").alias("updated_days"))


@query("retention_latest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 3")
def retention_latest(t):
    return S.kept_latest(t.events, "user_id", [F.desc("ts"), F.asc("event_id")], 3).select("user_id", "event_id")


@query("retention_cutoff", "SELECT count(*) AS n_kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention_cutoff(t):
    last = t.events.agg(F.max("ts").alias("m"))
    return t.events.join(F.broadcast(last)).where("ts >= m - INTERVAL 7 DAYS").agg(F.count("*").alias("n_kept"))


@query(
    "backup_chain",
    """WITH b AS (SELECT date_trunc('day', ts)::DATE AS d, count(*) AS n FROM events GROUP BY 1), f AS (SELECT max(d) AS full_d FROM b WHERE day(d) % 7 = 1 AND d <= DATE '2024-01-18')
SELECT CAST(d AS VARCHAR) AS d, n, CASE WHEN d = full_d THEN 'full' ELSE 'incremental' END AS kind FROM b, f WHERE d >= full_d AND d <= DATE '2024-01-18'""",
)
def backup_chain(t):
    """Restore plan to a moment: the last full backup before it and all increments since."""
    days = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n")).where("d <= DATE '2024-01-18'")
    full = days.where("day(d) % 7 = 1").agg(F.max("d").alias("full_d"))
    return days.join(F.broadcast(full)).where("d >= full_d").select(F.col("d").cast("string").alias("d"), "n", F.when(F.col("d") == F.col("full_d"), "full").otherwise("incremental").alias("kind"))


@query("export_json", """SELECT id, '{"problem":' || to_json(problem)::VARCHAR || ',"domain":' || to_json(domain)::VARCHAR || ',"reuse_count":' || reuse_count || '}' AS doc FROM patterns""")
def export_json(t):
    return t.patterns.select("id", F.to_json(F.struct("problem", "domain", "reuse_count")).alias("doc"))


@query("distinct_columns", "SELECT DISTINCT domain, tier FROM patterns")
def distinct_columns(t):
    return t.patterns.select("domain", "tier").distinct()


@query("import_dedup_key", "SELECT min(id) AS id, count(*) AS n FROM patterns GROUP BY md5(lower(trim(problem)) || '|' || lower(trim(domain)))")
def import_dedup_key(t):
    key = F.md5(F.concat_ws("|", F.lower(F.trim("problem")), F.lower(F.trim("domain"))))
    return t.patterns.groupBy(key.alias("k")).agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n")
