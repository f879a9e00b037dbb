"""Queries on what the store knows of itself, on scenarios and on findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scenarios as N
from ..operators import selfmodel as M
from ..sources.tables import patterns
from .registry import query

c = F.col

HEALTH = """h0 AS (SELECT count(*) AS n, coalesce(avg(reward), 0) AS avg_reward, coalesce(avg(effectiveness), 0) AS avg_effectiveness, coalesce(sum(reuse_count), 0)::BIGINT AS total_reuse,
  count_if(reward >= 0.8::DOUBLE) AS high, count_if(reward < 0.4::DOUBLE) AS low, count_if(id IN (SELECT vec_id FROM embeddings)) AS embedded, coalesce(avg(created_days), 0) AS avg_age,
  count_if(updated_days > 30 AND reuse_count < 5) AS stale, count_if(created_days <= 7) AS n_week, coalesce(avg(reward) FILTER (WHERE created_days <= 7), 0) AS week,
  count_if(created_days <= 30) AS n_month, coalesce(avg(reward) FILTER (WHERE created_days <= 30), 0) AS month, count_if(updated_days BETWEEN 30 AND 37 AND reuse_count < 5) AS decay FROM patterns),
h AS (SELECT *, n - high - low AS medium, n_month / 4.0::DOUBLE AS growth, CASE WHEN week > avg_reward + 0.05::DOUBLE THEN 'improving' WHEN week < avg_reward - 0.05::DOUBLE THEN 'declining' ELSE 'stable' END AS week_trend,
  CASE WHEN month > avg_reward + 0.03::DOUBLE THEN 'improving' WHEN month < avg_reward - 0.03::DOUBLE THEN 'declining' ELSE 'stable' END AS month_trend FROM h0)"""

FOUND = (
    HEALTH
    + """, g AS (SELECT domain, count(*) AS n, least(count(*) / 100.0::DOUBLE, 1) * (0.5::DOUBLE + coalesce(avg(reward), 0) * 0.5::DOUBLE) AS covered FROM patterns GROUP BY 1),
r AS (SELECT *, stale / n::DOUBLE AS s, low / n::DOUBLE AS l, embedded / n::DOUBLE AS e FROM h WHERE n > 0),
m AS (SELECT domain, n, sum(n) OVER () AS total, count(*) OVER () AS domains FROM g ORDER BY n DESC, domain LIMIT 1),
found AS (SELECT 1 AS rule, 'knowledge_decay' AS category, CASE WHEN s > 0.5 THEN 4 WHEN s > 0.3 THEN 3 ELSE 2 END AS level, NULL::VARCHAR AS domain, s AS impact, stale || ' patterns (' || floor(s * 100 + 0.5)::BIGINT || '%) are stale' AS reason FROM r WHERE s > 0.2
UNION ALL SELECT 2, 'low_embedding_coverage', CASE WHEN e < 0.5 THEN 3 ELSE 2 END, NULL, 1 - e, (n - embedded) || ' patterns (' || floor((1 - e) * 100 + 0.5)::BIGINT || '%) missing embeddings' FROM r WHERE e < 0.8
UNION ALL SELECT 3, 'coverage_gap', CASE WHEN covered < 0.3 THEN 3 ELSE 2 END, domain, 1 - covered, 'Domain ' || domain || ' has low coverage ' || (floor(covered * 1000 + 0.5)::BIGINT // 10) || '.' || (floor(covered * 1000 + 0.5)::BIGINT % 10) || '%' FROM g WHERE covered < 0.6 AND n > 5
UNION ALL SELECT 4, 'quality_degradation', 2, NULL, 0.2, '7d avg reward ' || (floor(week * 100 + 0.5)::BIGINT // 100) || '.' || lpad((floor(week * 100 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0') || ' below overall' FROM h WHERE week_trend = 'declining'
UNION ALL SELECT 5, 'quality_degradation', 3, NULL, 0.4, '30d avg reward ' || (floor(month * 100 + 0.5)::BIGINT // 100) || '.' || lpad((floor(month * 100 + 0.5)::BIGINT % 100)::VARCHAR, 2, '0') || ' below overall' FROM h WHERE month_trend = 'declining'
UNION ALL SELECT 6, 'overspecialization', 1, domain, n / total::DOUBLE - 0.5, 'Knowledge concentrated in ' || domain || ' (' || floor(n / total::DOUBLE * 100 + 0.5)::BIGINT || '%)' FROM m WHERE domains > 3 AND n / total::DOUBLE > 0.7
UNION ALL SELECT 7, 'quality_degradation', CASE WHEN l > 0.5 THEN 3 ELSE 2 END, NULL, l, low || ' patterns (' || floor(l * 100 + 0.5)::BIGINT || '%) have low reward' FROM r WHERE l > 0.3)"""
)


def _embedded(t):
    return t.embeddings.select(c("vec_id").alias("id"))


@query("introspected_health", f"WITH {HEALTH} SELECT * REPLACE (round(avg_reward, 6) AS avg_reward, round(avg_effectiveness, 6) AS avg_effectiveness, round(avg_age, 6) AS avg_age, round(week, 6) AS week, round(month, 6) AS month) FROM h")
def introspected_health(t):
    h = M.health(t.patterns, _embedded(t))
    return h.withColumns({x: F.round(x, 6) for x in ("avg_reward", "avg_effectiveness", "avg_age", "week", "month")})


@query("vulnerabilities", f"WITH {FOUND} SELECT rule, category, ['low', 'medium', 'high', 'critical'][level] AS severity, domain, round(impact, 6) AS impact, reason FROM found")
def vulnerabilities(t):
    return M.vulnerabilities(t.patterns, _embedded(t)).select("rule", "category", "severity", "domain", F.round("impact", 6).alias("impact"), "reason")


@query(
    "store_verdict",
    f"""WITH {FOUND}, k AS (SELECT count_if(level = 1) AS low, count_if(level = 2) AS medium, count_if(level = 3) AS high, count_if(level = 4) AS critical FROM found)
SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 1 THEN 'degraded' WHEN high + medium > 0 THEN 'warning' ELSE 'healthy' END AS quick_status,
  CASE WHEN critical > 0 THEN 'critical' WHEN high > 1 THEN 'degraded' WHEN high > 0 OR medium > 2 THEN 'warning' ELSE 'healthy' END AS status FROM k""",
)
def store_verdict(t):
    return M.verdict(M.vulnerabilities(t.patterns, _embedded(t)))


@query(
    "recommendations",
    f"""WITH {FOUND}, a AS (SELECT *, CASE category WHEN 'knowledge_decay' THEN [3, 5, 8, 10][level] WHEN 'low_embedding_coverage' THEN [3, 5, 7, 9][level] WHEN 'coverage_gap' THEN 7 WHEN 'quality_degradation' THEN [2, 4, 7, 9][level] ELSE 3 END AS priority,
  CASE category WHEN 'knowledge_decay' THEN 'refresh_stale_patterns' WHEN 'low_embedding_coverage' THEN 'generate_embeddings' WHEN 'coverage_gap' THEN 'fill_coverage_gap' WHEN 'quality_degradation' THEN 'archive_low_quality' ELSE 'research_topic' END AS action,
  CASE category WHEN 'knowledge_decay' THEN 'refresh stale knowledge' WHEN 'low_embedding_coverage' THEN 'generate missing embeddings' WHEN 'coverage_gap' THEN 'improve ' || domain || ' knowledge coverage' WHEN 'quality_degradation' THEN 'improve pattern quality' ELSE 'diversify knowledge base' END AS goal FROM found),
b AS (SELECT *, lag(action) OVER (ORDER BY priority DESC, level DESC, rule, domain) AS prev FROM a)
SELECT row_number() OVER (ORDER BY priority DESC, level DESC, rule, domain) AS rank, priority, action, domain, round(impact, 6) AS benefit, reason, goal FROM b WHERE prev IS NULL OR prev <> action""",
)
def recommendations(t):
    return M.recommendations(M.vulnerabilities(t.patterns, _embedded(t))).withColumn("benefit", F.round("benefit", 6))


SCENARIOS = """w AS (SELECT p.id AS pattern_id, s.id AS scenario_id, p.solution, lower(p.domain) AS mine, CASE WHEN s.id % 2 = 0 THEN lower(s.domain) ELSE lower(string_split(s.domain, '.')[1]) END AS asked,
  list_filter(regexp_extract_all(lower(s.problem), '[\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 3) AS e, list_filter(regexp_extract_all(lower(coalesce(string_split(s.solution, chr(10))[2], '')), '[\\p{L}\\p{N}]+'), lambda x: strlen(x) >= 3) AS k,
  s.id % 5 = 0 AS holdout, CASE WHEN s.n_chars < 500 THEN 'easy' WHEN s.n_chars < 2000 THEN 'medium' ELSE 'hard' END AS difficulty FROM patterns p JOIN patterns s ON s.parent_id = p.id),
x AS (SELECT *, CASE WHEN len(e) = 0 THEN 0.5::DOUBLE ELSE len(list_filter(e, lambda y: contains(lower(solution), y))) / len(e)::DOUBLE * 0.7::DOUBLE
  + CASE WHEN len(k) = 0 THEN 0.5::DOUBLE ELSE len(list_filter(k, lambda y: contains(lower(solution), y))) / len(k)::DOUBLE END * 0.3::DOUBLE END AS keyword, least(strlen(solution) / 100.0::DOUBLE, 1) AS completeness,
  CASE WHEN mine = asked THEN 1.0::DOUBLE WHEN starts_with(mine, asked) OR starts_with(asked, mine) THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END AS domain_match FROM w),
y AS (SELECT *, keyword * 0.4::DOUBLE + completeness * 0.3::DOUBLE + domain_match * 0.3::DOUBLE AS score FROM x), ev AS (SELECT *, round(score, 9) >= 0.7::DOUBLE AS passed FROM y)"""


def _scenarios(t):
    """Each pattern as the solution of the scenarios that its children set: their problem expected, their second line the context."""
    size = c("n_chars")
    rows = patterns(t.documents, t.labels.where("false"))  # no label is asked for, so none is joined to the texts
    s = rows.where("parent_id IS NOT NULL").select(
        c("id").alias("scenario_id"),
        c("parent_id").alias("pattern_id"),
        F.when(c("id") % 2 == 0, c("domain")).otherwise(F.split("domain", "\\.")[0]).alias("asked_domain"),
        c("problem").alias("expected"),
        F.get(F.split("solution", "\n"), 1).alias("context"),
        (c("id") % 5 == 0).alias("holdout"),
        F.when(size < 500, "easy").when(size < 2000, "medium").otherwise("hard").alias("difficulty"),
    )
    return N.evaluated(s.join(rows.select(c("id").alias("pattern_id"), "solution", "domain"), "pattern_id"))


# Nine decimals, as scores of seven or eight are common and a tie could be rounded either way.
@query("scenario_evaluations", f"WITH {SCENARIOS} SELECT pattern_id, scenario_id, round(keyword, 9) AS keyword, round(completeness, 9) AS completeness, domain_match, round(score, 9) AS score, passed FROM ev")
def scenario_evaluations(t):
    return _scenarios(t).select("pattern_id", "scenario_id", *[F.round(x, 9).alias(x) for x in ("keyword", "completeness")], "domain_match", F.round("score", 9).alias("score"), "passed")


@query(
    "scenario_statistics",
    f"""WITH {SCENARIOS} SELECT pattern_id, count(*) AS evaluated, count_if(passed) AS n_passed, sum(round(score * 1000000000)::BIGINT) / (count(*) * 1000000000)::DOUBLE AS avg_score, sum(round(score * 1000000000)::BIGINT * CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 1.5::DOUBLE ELSE 2 END) / (count(*) * 1000000000)::DOUBLE AS weighted_score,
  count_if(holdout) AS n_holdout, coalesce(count_if(passed AND holdout) / nullif(count_if(holdout), 0)::DOUBLE, 0) AS holdout_rate FROM ev GROUP BY 1""",
)
def scenario_statistics(t):
    return N.statistics(_scenarios(t), "pattern_id")  # quotients of whole numbers, so not rounded


MARKERS = "['" + "', '".join(N.SPECIFIC) + "']"


@query("contrast_scores", f"SELECT conv_id, turn, round(0.5::DOUBLE + CASE WHEN len(list_filter({MARKERS}, lambda k: contains(lower(text), k))) > 0 THEN 0.2 ELSE 0 END + CASE WHEN contains(text, '`') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.1 ELSE 0 END, 6) AS score FROM conversations WHERE role = 'assistant'")
def contrast_scores(t):
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.round(N.contrast(c("text")), 6).alias("score"))
