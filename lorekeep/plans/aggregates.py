"""Queries on aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import aggregates as A
from .registry import query


@query(
    "pattern_stats",
    """SELECT count(*) AS n, round(avg(reward), 6) AS avg_reward, round(avg(confidence), 6) AS avg_confidence, round(count_if(success_rate > 0.5) / count(*), 6) AS success_share,
  sum(usage_count)::BIGINT AS usage, round(avg(usage_count), 6) AS avg_usage FROM patterns""",
)
def pattern_stats(t):
    return A.pattern_stats(t.patterns)


@query(
    "domain_rollup",
    """WITH e AS (SELECT unnest([string_split(domain, '.')[1], domain]) AS domain, reward, success_rate FROM patterns)
SELECT domain, count(*) AS n, round(avg(reward), 6) AS avg_reward, round(avg(success_rate), 6) AS avg_success FROM e GROUP BY 1 HAVING count(*) >= 5""",
)
def domain_rollup(t):
    return A.rolled_up(t.patterns, 5)


@query("reward_histogram", "SELECT b AS bucket, coalesce(n, 0) AS n FROM range(10) r(b) LEFT JOIN (SELECT least(floor(reward * 10), 9)::BIGINT AS k, count(*) AS n FROM patterns GROUP BY 1) ON b = k")
def reward_histogram(t):
    return A.histogram(t.patterns, "reward")


@query(
    "reuse_distribution",
    """WITH m AS (SELECT max(reuse_count) // 5 + 1 AS w, count(*) AS total FROM patterns)
SELECT (reuse_count // w) * w AS low, (reuse_count // w + 1) * w - 1 AS high, count(*) AS n, round(100.0 * count(*) / any_value(total), 4) AS percent FROM patterns, m GROUP BY 1, 2""",
)
def reuse_distribution(t):
    p = t.patterns
    m = p.agg((F.floor(F.max("reuse_count") / 5) + 1).alias("w"), F.count("*").alias("total"))
    b = F.floor(F.col("reuse_count") / F.col("w"))
    return p.join(F.broadcast(m)).groupBy((b * F.col("w")).alias("low"), ((b + 1) * F.col("w") - 1).alias("high")).agg(F.count("*").alias("n"), F.round(F.lit(100.0) * F.count("*") / F.first("total"), 4).alias("percent"))


@query("reuse_summary", "SELECT min(reuse_count) AS low, max(reuse_count) AS high, list_sort(list(reuse_count))[count(*) // 2 + 1] AS median_upper, round(avg(reuse_count), 6) AS mean FROM patterns")
def reuse_summary(t):
    return t.patterns.agg(F.min("reuse_count").alias("low"), F.max("reuse_count").alias("high"), A.upper_median("reuse_count").cast("long").alias("median_upper"), A.mean("reuse_count").alias("mean"))


@query(
    "duplicate_groups",
    """SELECT content_hash, count(*) AS n, arg_max(id, {'a': reward, 'b': reuse_count, 'c': -id}) AS canonical, round(sum(reward), 6) AS combined_reward, sum(reuse_count)::BIGINT AS total_reuse,
  array_to_string(list_sort(list(id)), ',') AS ids FROM patterns GROUP BY 1 HAVING count(*) > 1""",
)
def duplicate_groups(t):
    return A.duplicate_groups(t.patterns)


@query("merge_duplicates", "SELECT arg_max(id, {'a': reward, 'b': reuse_count, 'c': -id}) AS id, content_hash, sum(reuse_count)::BIGINT AS reuse_count FROM patterns GROUP BY 2")
def merge_duplicates(t):
    return A.merged_duplicates(t.patterns)


@query(
    "consolidation",
    """WITH g AS (SELECT domain, tier, arg_max(id, {'a': reward, 'b': -id}) AS prim, arg_max(tags, {'a': reward, 'b': -id}) AS own, count(*) AS n, round(avg(reward), 6) AS reward_avg, round(max(reward), 6) AS reward_max,
    round(min(reward), 6) AS reward_min, round(CASE WHEN sum(reuse_count) = 0 THEN avg(reward) ELSE sum(reward * reuse_count) / sum(reuse_count) END, 6) AS reward_weighted,
    round(avg(effectiveness), 6) AS effectiveness, sum(reuse_count)::BIGINT AS reuse FROM patterns WHERE tier IS NOT NULL GROUP BY 1, 2),
f AS (SELECT domain, tier, tag, count(*) AS f FROM (SELECT domain, tier, unnest(tags) AS tag FROM patterns WHERE tier IS NOT NULL) GROUP BY ALL),
r AS (SELECT domain, tier, tag, row_number() OVER (PARTITION BY domain, tier ORDER BY f + CASE WHEN list_contains(own, tag) THEN 1000 ELSE 0 END DESC, tag) AS k FROM f JOIN g USING (domain, tier))
SELECT domain, tier, prim AS "primary", n, reward_avg, reward_max, reward_min, reward_weighted, effectiveness, reuse, (SELECT string_agg(tag, ',' ORDER BY k) FROM r WHERE k <= 3 AND r.domain = g.domain AND r.tier = g.tier) AS tags FROM g""",
)
def consolidation(t):
    return A.consolidated(t.patterns.where("tier IS NOT NULL"), ["domain", "tier"])


@query(
    "insight_windows",
    """SELECT w AS days, count_if(updated_days <= w) AS updated, count_if(created_days <= w) AS created, round(avg(reward) FILTER (WHERE updated_days <= w), 6) AS avg_reward,
  round(avg(success_rate) FILTER (WHERE updated_days <= w), 6) AS avg_success, (sum(usage_count) FILTER (WHERE updated_days <= w))::BIGINT AS usage FROM patterns, (SELECT unnest([7, 30, 90])::BIGINT AS w) GROUP BY w""",
)
def insight_windows(t):
    p = t.patterns
    out = None
    for w in (7, 30, 90):  # three windows of one pass each over few columns
        a = F.col("updated_days") <= w
        one = p.agg(F.lit(w).cast("long").alias("days"), F.count_if(a).alias("updated"), F.count_if(F.col("created_days") <= w).alias("created"), A.mean(F.when(a, F.col("reward"))).alias("avg_reward"), A.mean(F.when(a, F.col("success_rate"))).alias("avg_success"), F.sum(F.when(a, F.col("usage_count"))).alias("usage"))
        out = one if out is None else out.unionByName(one)
    return out


@query("child_domains", "SELECT string_split(domain, '.')[2] AS child, count(*) AS n, round(avg(reward), 6) AS avg_reward FROM patterns WHERE starts_with(domain, 'en.') GROUP BY 1")
def child_domains(t):
    rest = F.substring_index(F.expr("substring(domain, length('en.') + 1)"), ".", 1)
    return t.patterns.where(F.col("domain").startswith("en.")).groupBy(rest.alias("child")).agg(F.count("*").alias("n"), A.mean("reward").alias("avg_reward"))


@query("distinct_contexts", "SELECT count(*) AS n, count(DISTINCT session_id) AS sessions FROM outcomes WHERE ts >= TIMESTAMP '2024-01-15' AND session_id <> ''")
def distinct_contexts(t):
    o = t.outcomes.where("ts >= TIMESTAMP_NTZ '2024-01-15' AND session_id <> ''")
    return o.agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))


@query(
    "auto_promotion",
    """WITH u AS (SELECT pattern_id, count(*) AS uses, count(DISTINCT session_id) AS sessions FROM outcomes WHERE outcome = 'success' GROUP BY 1)
SELECT id, tier, uses, sessions, CASE tier WHEN 'booster' THEN 'crystal' ELSE 'reflex' END AS next_tier FROM patterns JOIN u ON id = pattern_id WHERE uses >= 3 AND sessions >= 2 AND tier <> 'reflex'""",
)
def auto_promotion(t):
    u = t.outcomes.where("outcome = 'success'").groupBy("pattern_id").agg(F.count("*").alias("uses"), F.count_distinct("session_id").alias("sessions"))
    j = t.patterns.join(u, F.col("id") == F.col("pattern_id")).where("uses >= 3 AND sessions >= 2 AND tier <> 'reflex'")
    return j.select("id", "tier", "uses", "sessions", F.when(F.col("tier") == "booster", "crystal").otherwise("reflex").alias("next_tier"))


@query(
    "session_stats",
    """WITH s AS (SELECT session_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS seconds, count_if(outcome = 'success') AS learned, round(sum(value), 4) AS tokens, max(ts) AS last FROM outcomes GROUP BY 1)
SELECT count(*) AS sessions, sum(n)::BIGINT AS events, round(avg(CASE WHEN n > 1 THEN seconds END), 4) AS avg_seconds, round(sum(learned) * 1000 / sum(tokens), 6) AS learned_per_1000,
  count_if(last >= TIMESTAMP '2024-01-30') AS active FROM s""",
)
def session_stats(t):
    s = t.outcomes.groupBy("session_id").agg(F.count("*").alias("n"), F.expr("(unix_micros(CAST(max(ts) AS TIMESTAMP)) - unix_micros(CAST(min(ts) AS TIMESTAMP))) / 1000000D").alias("seconds"), F.count_if(F.col("outcome") == "success").alias("learned"), F.round(F.sum("value"), 4).alias("tokens"), F.max("ts").alias("last"))
    return s.agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.round(F.avg(F.when(F.col("n") > 1, F.col("seconds"))), 4).alias("avg_seconds"), F.round(F.sum("learned") * 1000 / F.sum("tokens"), 6).alias("learned_per_1000"), F.count_if(F.expr("last >= TIMESTAMP_NTZ '2024-01-30'")).alias("active"))


@query("metric_stats", "SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(sum(value), 3) AS total, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def metric_stats(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), A.mean("value").alias("mean"), F.round(F.sum("value"), 3).alias("total"), F.round(F.max("value") - F.min("value"), 6).alias("spread"))


@query("last_gauge", "SELECT event_type, arg_max(value, {'a': ts, 'b': event_id}) AS value FROM events GROUP BY 1")
def last_gauge(t):
    return t.events.groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("metric_names", "SELECT DISTINCT event_type FROM events")
def metric_names(t):
    return t.events.select("event_type").distinct()


@query(
    "prediction_stats",
    """SELECT count(*) AS n, count_if(status = 'pending') AS pending, count_if(status = 'resolved') AS resolved, count_if(status = 'expired') AS expired,
  round(count_if(status = 'resolved' AND (probability > 0.5) = outcome) / count_if(status = 'resolved'), 6) AS accuracy,
  round(avg((probability - outcome::INT) * (probability - outcome::INT)), 6) AS avg_brier, round(avg(confidence), 6) AS avg_confidence, round(avg(n_evidence), 6) AS avg_evidence FROM predictions""",
)
def prediction_stats(t):
    done = F.col("status") == "resolved"
    status = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "resolved", "expired")]
    hit = F.count_if(done & ((F.col("probability") > 0.5) == F.col("outcome")))
    return t.predictions.agg(F.count("*").alias("n"), *status, F.round(hit / F.count_if(done), 6).alias("accuracy"), A.mean(F.when(done, S.brier(F.col("probability"), F.col("outcome")))).alias("avg_brier"), A.mean("confidence").alias("avg_confidence"), A.mean("n_evidence").alias("avg_evidence"))


BUCKETS = """b AS (SELECT least(floor(probability * 10), 9)::BIGINT AS bucket, count(*) AS n, count_if(outcome) AS positive, round(sum((probability - outcome::INT) * (probability - outcome::INT)), 6) AS brier
FROM predictions WHERE status = 'resolved' GROUP BY 1)"""


@query("calibration_buckets", f"WITH {BUCKETS} SELECT * FROM b")
def calibration_buckets(t):
    return A.calibration_buckets(t.predictions)


@query(
    "calibration_report",
    f"""WITH {BUCKETS} SELECT sum(n)::BIGINT AS n, round(sum(brier) / sum(n), 6) AS avg_brier, round(avg(abs((bucket + 0.5::DOUBLE) / 10 - positive / n)), 6) AS calibration_error,
  round(sum(positive) / sum(n), 6) AS positive_rate, count_if((bucket + 0.5::DOUBLE) / 10 > positive / n) AS overconfident FROM b""",
)
def calibration_report(t):
    return A.calibration_report(A.calibration_buckets(t.predictions))


@query(
    "wilson_intervals",
    f"""WITH {BUCKETS}, z AS (SELECT *, positive / n AS p, 1.96::DOUBLE AS z FROM b)
SELECT bucket, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low,
  round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM z""",
)
def wilson_intervals(t):
    b = A.calibration_buckets(t.predictions)
    return b.select("bucket", F.round(S.wilson(F.col("positive"), F.col("n"), 1.96, False), 6).alias("low"), F.round(S.wilson(F.col("positive"), F.col("n"), 1.96, True), 6).alias("high"))


@query(
    "isotonic_rates",
    f"""WITH {BUCKETS}, r AS (SELECT bucket, positive / n AS rate, row_number() OVER (ORDER BY bucket) AS k FROM b),
a AS (SELECT i.k AS i, j.k AS j, (SELECT avg(rate) FROM r WHERE k BETWEEN i.k AND j.k) AS m FROM r i JOIN r j ON i.k <= j.k),
l AS (SELECT r.k, a.i, min(m) AS m FROM r JOIN a ON a.i <= r.k AND a.j >= r.k GROUP BY ALL)
SELECT bucket, round(rate, 6) AS rate, round((SELECT max(m) FROM l WHERE l.k = r.k), 6) AS pooled FROM r""",
)
def isotonic_rates(t):
    return A.isotonic(A.calibration_buckets(t.predictions))


@query(
    "calibrated_probability",
    f"""WITH {BUCKETS} SELECT id, round(least(1, greatest(0, CASE WHEN n >= 5 THEN probability * 0.5 + positive / n * 0.5 ELSE probability * 0.7 + (SELECT sum(positive) / sum(n) FROM b) * 0.3 END)), 6) AS calibrated
FROM predictions LEFT JOIN b ON least(floor(probability * 10), 9) = bucket""",
)
def calibrated_probability(t):
    b = A.calibration_buckets(t.predictions)
    whole = b.agg((F.sum("positive") / F.sum("n")).alias("rate"))
    j = t.predictions.withColumn("bucket", F.least(F.floor(F.col("probability") * 10), F.lit(9))).join(F.broadcast(b), "bucket", "left").join(F.broadcast(whole))
    p = F.when(F.col("n") >= 5, F.col("probability") * 0.5 + F.col("positive") / F.col("n") * 0.5).otherwise(F.col("probability") * 0.7 + F.col("rate") * 0.3)
    return j.select("id", F.round(S.clamp(p), 6).alias("calibrated"))


VARIANT = """v AS (SELECT DISTINCT user_id, CASE WHEN (CASE WHEN h >= 9223372036854775808 THEN 18446744073709551616::HUGEINT - h ELSE h END)::DOUBLE / 9223372036854775808 < 0.3 THEN 'treatment' ELSE 'control' END AS variant
FROM (SELECT user_id, ('0x' || substr(md5('exp1:' || user_id), 1, 16))::UBIGINT::HUGEINT AS h FROM events))"""


@query("ab_assignment", f"WITH {VARIANT} SELECT user_id, variant FROM v")
def ab_assignment(t):
    return t.events.select("user_id").distinct().select("user_id", A.variant(F.col("user_id").cast("string"), "exp1", 0.3).alias("variant"))


def _ab_rows(t):
    return t.events.withColumn("variant", A.variant(F.col("user_id").cast("string"), "exp1", 0.3))


@query(
    "ab_variant_stats",
    f"""WITH {VARIANT} SELECT variant, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(list_sort(list(value))[count(*) // 2 + 1], 6) AS median_upper,
  round(list_sort(list(value))[least(floor(count(*) * 0.95)::BIGINT + 1, count(*))], 6) AS p95, round(list_sort(list(value))[least(floor(count(*) * 0.99)::BIGINT + 1, count(*))], 6) AS p99, min(value) AS low, max(value) AS high
FROM events JOIN v USING (user_id) GROUP BY 1, 2""",
)
def ab_variant_stats(t):
    return A.variant_stats(_ab_rows(t), ["variant", "event_type"], "value")


@query(
    "ab_baseline",
    """SELECT event_type, year(ts)::BIGINT AS year, weekofyear(ts)::BIGINT AS week, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1, 2, 3""",
)
def ab_baseline(t):
    week = t.events.groupBy("event_type", F.year("ts").cast("long").alias("year"), F.weekofyear("ts").cast("long").alias("week"))
    return week.agg(F.count("*").alias("n"), A.mean("value").alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), *A.percentiles("value", [0.25, 0.5, 0.75, 0.95]))


@query("ab_summary", f"WITH {VARIANT} SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE variant = 'treatment') AS treated, count(DISTINCT user_id) FILTER (WHERE variant = 'control') AS control FROM events JOIN v USING (user_id)")
def ab_summary(t):
    of = lambda v: F.count_distinct(F.when(F.col("variant") == v, F.col("user_id")))
    return _ab_rows(t).agg(F.count_distinct("user_id").alias("users"), of("treatment").alias("treated"), of("control").alias("control"))


@query(
    "regression_by_week",
    """WITH w AS (SELECT event_type, weekofyear(ts)::BIGINT AS week, avg(value) AS m FROM events GROUP BY 1, 2), c AS (SELECT *, lag(m) OVER (PARTITION BY event_type ORDER BY week) AS prev FROM w)
SELECT event_type, week, round((prev - m) / prev, 6) AS drop_share, CASE WHEN (prev - m) / prev >= 0.2 THEN 'critical' WHEN (prev - m) / prev >= 0.1 THEN 'warning' ELSE 'ok' END AS severity FROM c WHERE prev IS NOT NULL""",
)
def regression_by_week(t):
    w = t.events.groupBy("event_type", F.weekofyear("ts").cast("long").alias("week")).agg(F.avg("value").alias("m"))
    c = w.withColumn("prev", F.lag("m").over(Window.partitionBy("event_type").orderBy("week"))).where("prev IS NOT NULL")
    drop = (F.col("prev") - F.col("m")) / F.col("prev")
    return c.select("event_type", "week", F.round(drop, 6).alias("drop_share"), A.change_severity(drop).alias("severity"))


@query(
    "improvement_progress",
    """WITH w AS (SELECT event_type, avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS base, avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS cur FROM events GROUP BY 1)
SELECT event_type, round((cur - base) / (base * 0.1), 6) AS progress, cur >= base * 1.1 AS achieved FROM w""",
)
def improvement_progress(t):
    early = F.expr("ts < TIMESTAMP_NTZ '2024-01-15'")
    w = t.events.groupBy("event_type").agg(F.avg(F.when(early, F.col("value"))).alias("base"), F.avg(F.when(~early, F.col("value"))).alias("cur"))
    return w.select("event_type", F.round((F.col("cur") - F.col("base")) / (F.col("base") * 0.1), 6).alias("progress"), (F.col("cur") >= F.col("base") * 1.1).alias("achieved"))


@query("tier_counts", "SELECT coalesce(tier, 'booster') AS tier, count(*) AS n, sum(usage_count)::BIGINT AS usage, round(avg(usage_count), 6) AS avg_usage FROM patterns GROUP BY 1")
def tier_counts(t):
    return t.patterns.groupBy(F.coalesce("tier", F.lit("booster")).alias("tier")).agg(F.count("*").alias("n"), F.sum("usage_count").alias("usage"), A.mean("usage_count").alias("avg_usage"))


@query("domain_counts", "SELECT coalesce(domain, 'unknown') AS domain, count(*) AS n FROM patterns GROUP BY 1 ORDER BY n DESC, domain LIMIT 50")
def domain_counts(t):
    return t.patterns.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(50)


@query("daily_pulse", "SELECT d::DATE::VARCHAR AS day, coalesce(n, 0) AS n FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) g(d) LEFT JOIN (SELECT ts::DATE AS x, count(*) AS n FROM events GROUP BY 1) ON d = x")
def daily_pulse(t):
    return A.daily(t.events, "ts", "2023-12-25", "2024-02-05")


@query("tag_frequency", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM patterns) GROUP BY 1")
def tag_frequency(t):
    text = F.when(F.col("id") % 2 == 0, F.to_json("tags")).otherwise(F.array_join("tags", ", "))
    return A.tags_counted(t.patterns.select(text.alias("tags_text")), "tags_text")


@query("having_filters", "SELECT domain, count(*) AS n FROM patterns GROUP BY 1 HAVING count(*) > 20 OR count(*) < 4")
def having_filters(t):
    return t.patterns.groupBy("domain").agg(F.count("*").alias("n")).where("n > 20 OR n < 4")


@query(
    "pattern_health",
    """SELECT count(*) AS n, count_if(reward < 0.3) AS weak, count_if(confidence < 0.3) AS unsure, round(avg(created_days), 6) AS avg_age, count_if(updated_days > 90) AS stale FROM patterns""",
)
def pattern_health(t):
    return t.patterns.agg(F.count("*").alias("n"), F.count_if(F.col("reward") < 0.3).alias("weak"), F.count_if(F.col("confidence") < 0.3).alias("unsure"), A.mean("created_days").alias("avg_age"), F.count_if(F.col("updated_days") > 90).alias("stale"))


@query("domain_coverage", "SELECT domain, count(*) AS n, round(avg(reward), 6) AS avg_reward, max(reuse_count) AS most_reused, round(least(count(*) / 100.0::DOUBLE, 1) * (0.5 + 0.5 * avg(reward)), 6) AS coverage FROM patterns GROUP BY 1")
def domain_coverage(t):
    n = F.count("*")
    return t.patterns.groupBy("domain").agg(n.alias("n"), A.mean("reward").alias("avg_reward"), F.max("reuse_count").alias("most_reused"), F.round(F.least(n / 100.0, F.lit(1.0)) * (F.avg("reward") * 0.5 + 0.5), 6).alias("coverage"))


@query(
    "temporal_trends",
    """WITH a AS (SELECT avg(reward) AS whole, avg(reward) FILTER (WHERE updated_days <= 7) AS week, avg(reward) FILTER (WHERE updated_days <= 30) AS month FROM patterns)
SELECT round(whole, 6) AS whole, round(week, 6) AS week, round(month, 6) AS month, CASE WHEN week > whole + 0.05 THEN 'improving' WHEN week < whole - 0.05 THEN 'declining' ELSE 'stable' END AS weekly,
  CASE WHEN month > whole + 0.03 THEN 'improving' WHEN month < whole - 0.03 THEN 'declining' ELSE 'stable' END AS monthly FROM a""",
)
def temporal_trends(t):
    r = F.col("reward")
    a = t.patterns.agg(F.avg(r).alias("whole"), F.avg(F.when(F.col("updated_days") <= 7, r)).alias("week"), F.avg(F.when(F.col("updated_days") <= 30, r)).alias("month"))
    way = lambda x, e: F.when(F.col(x) > F.col("whole") + e, "improving").when(F.col(x) < F.col("whole") - e, "declining").otherwise("stable")
    return a.select(*[F.round(c, 6).alias(c) for c in ("whole", "week", "month")], way("week", 0.05).alias("weekly"), way("month", 0.03).alias("monthly"))


@query(
    "fisher_importance",
    """WITH r AS (SELECT pattern_id, sum(CASE outcome WHEN 'success' THEN 0.1::DOUBLE WHEN 'failure' THEN -0.15::DOUBLE ELSE 0.05::DOUBLE END) AS d, count(*) AS n FROM outcomes GROUP BY 1),
x AS (SELECT id, domain, least(abs(d), 1) * (n + 1) AS raw FROM patterns JOIN r ON id = pattern_id)
SELECT id, domain, round(raw / sum(raw) OVER (PARTITION BY domain), 6) AS share FROM x""",
)
def fisher_importance(t):
    delta = F.when(F.col("outcome") == "success", 0.1).when(F.col("outcome") == "failure", -0.15).otherwise(0.05)
    return A.fisher_by_domain(t.patterns, t.outcomes.select("pattern_id", delta.alias("delta")))


@query("audit_statistics", "SELECT event_type, count(*) AS n, count_if(value >= 20) AS passed, count_if(value < 20) AS failed, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def audit_statistics(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 20).alias("passed"), F.count_if(F.col("value") < 20).alias("failed"), F.count_distinct("user_id").alias("users"))


@query("probability_summary", "SELECT domain, count(*) AS n, round(avg(probability), 6) AS mean, round(median(probability), 6) AS med, round(stddev_pop(probability), 6) AS std, min(probability) AS low, max(probability) AS high FROM predictions GROUP BY 1")
def probability_summary(t):
    return t.predictions.groupBy("domain").agg(F.count("*").alias("n"), A.mean("probability").alias("mean"), F.round(F.median("probability"), 6).alias("med"), F.round(F.stddev_pop("probability"), 6).alias("std"), F.min("probability").alias("low"), F.max("probability").alias("high"))


@query("outcome_log", "WITH r AS (SELECT pattern_id, CASE outcome WHEN 'success' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.7::DOUBLE WHEN 'neutral' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS r, row_number() OVER (PARTITION BY pattern_id ORDER BY ts DESC, event_id) AS k FROM outcomes) SELECT pattern_id, round(sum(r * (11 - k)) / sum(11 - k), 6) AS recent FROM r WHERE k <= 10 GROUP BY 1")
def outcome_log(t):
    r = F.when(F.col("outcome") == "success", 1.0).when(F.col("outcome") == "partial", 0.7).when(F.col("outcome") == "neutral", 0.5).otherwise(0.2)
    k = F.row_number().over(Window.partitionBy("pattern_id").orderBy(F.desc("ts"), "event_id"))
    x = t.outcomes.select("pattern_id", r.alias("r"), k.alias("k")).where("k <= 10")
    return x.groupBy("pattern_id").agg(F.round(F.sum(F.col("r") * (F.lit(11) - F.col("k"))) / F.sum(F.lit(11) - F.col("k")), 6).alias("recent"))


@query("status_counts", "SELECT status, count(*) AS n FROM predictions GROUP BY 1")
def status_counts(t):
    return t.predictions.groupBy("status").agg(F.count("*").alias("n"))


@query("scenario_pass_rate", "SELECT p.domain, count(*) AS n, count(DISTINCT session_id) AS sessions, count_if(outcome = 'success') AS passed, round(count_if(outcome = 'success') / count(*), 6) AS rate FROM (SELECT id, domain FROM patterns) p JOIN outcomes o ON p.id = o.pattern_id GROUP BY 1")
def scenario_pass_rate(t):
    j = t.patterns.select("id", "domain").join(t.outcomes, F.col("id") == F.col("pattern_id"))
    ok = F.count_if(F.col("outcome") == "success")
    return j.groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), ok.alias("passed"), F.round(ok / F.count("*"), 6).alias("rate"))
