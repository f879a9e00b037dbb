"""Queries on text functions, personal data, coherence, rewards, tiers and learning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import embed as E
from ..functions import scoring as S
from ..functions import text as T
from ..functions import vectors as V
from .registry import query

c = F.col
TOK = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}'']+'))"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query("token_sets", f"SELECT item_id, array_to_string(list_sort({TOK.format('text')}), ' ') AS words FROM benchmark")
def token_sets(t):
    return t.benchmark.select("item_id", F.array_join(F.array_sort(T.tokens(c("text"))), " ").alias("words"))


@query(
    "coherence_pairs",
    f"""WITH w AS (SELECT id, parent_id, {TOK.format('solution')} AS x FROM patterns), n AS (SELECT id, parent_id, x, len(list_intersect(x, {_list(T.NEGATION)})) AS neg, len(list_intersect(x, {_list(T.AFFIRMATION)})) AS aff FROM w),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.x, b.x)) / greatest(len(list_distinct(list_concat(a.x, b.x))), 1)::DOUBLE AS jac, abs(a.neg / greatest(a.neg + a.aff, 1)::DOUBLE - b.neg / greatest(b.neg + b.aff, 1)::DOUBLE) AS dist
  FROM n a JOIN n b ON a.id = b.parent_id)
SELECT a, b, round(jac, 6) AS similarity, round(CASE WHEN jac > 0.3 THEN jac * dist ELSE 0 END, 6) AS contradiction,
  CASE WHEN jac > 0.3 AND jac * dist > 0.35 THEN 'contradictory' WHEN jac > 0.8 AND dist < 0.2 THEN 'supportive' ELSE 'neutral' END AS kind FROM p""",
)
def coherence_pairs(t):
    x = t.patterns.select("id", "parent_id", T.tokens(c("solution")).alias("x"))
    n = x.select("id", "parent_id", "x", T.listed(c("x"), T.NEGATION).alias("neg"), T.listed(c("x"), T.AFFIRMATION).alias("aff"))
    a, b = n.alias("a"), n.alias("b")
    j = a.join(b, c("a.id") == c("b.parent_id"))
    p = j.select(c("a.id").alias("a"), c("b.id").alias("b"), T.jaccard(c("a.x"), c("b.x")).alias("jac"), T.negation_distance(c("a.neg"), c("a.aff"), c("b.neg"), c("b.aff")).alias("dist"))
    kind = F.when((c("jac") > 0.3) & (c("jac") * c("dist") > 0.35), "contradictory").when((c("jac") > 0.8) & (c("dist") < 0.2), "supportive").otherwise("neutral")
    return p.select("a", "b", F.round("jac", 6).alias("similarity"), F.round(F.when(c("jac") > 0.3, c("jac") * c("dist")).otherwise(0.0), 6).alias("contradiction"), kind.alias("kind"))


@query("coherence_gate", "SELECT id, round(energy, 6) AS energy, CASE WHEN k = 0 THEN 'accept' WHEN m > 0 THEN 'reject' WHEN k > 3 THEN 'review' WHEN energy >= 0.7 THEN 'warn' ELSE 'review' END AS action FROM (SELECT id, id % 6 AS k, CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS m, greatest(0, least(1, (1 - least((id % 6) * 0.1::DOUBLE, 1)) * (1 + least((id % 4) * 0.1::DOUBLE, 0.3::DOUBLE)))) AS energy FROM patterns)")
def coherence_gate(t):
    k, m = c("id") % 6, F.when(c("id") % 11 == 0, 1).otherwise(0)
    e = S.coherence_energy(k * 0.1, c("id") % 4)
    return t.patterns.select("id", F.round(e, 6).alias("energy"), S.coherence_action(k, m, e).alias("action"))


@query("titles", "SELECT id, regexp_replace(array_to_string(string_split(regexp_replace(trim(problem), '\\s+', ' ', 'g'), ' ')[:10], ' '), '[,;:\\-.]+$', '') AS title FROM patterns")
def titles(t):
    return t.patterns.select("id", T.title(c("problem")).alias("title"))


@query(
    "summaries",
    """WITH a AS (SELECT id, trim(solution) AS w, trim(string_split(trim(solution), chr(10) || chr(10))[1]) AS p FROM patterns), b AS (SELECT id, w, p, trim(string_split(p, chr(10))[1]) AS l FROM a),
d AS (SELECT id, w, string_split(regexp_replace(CASE WHEN strlen(l) >= 80 AND strlen(l) < strlen(p) THEN l ELSE p END, '\\s+', ' ', 'g'), ' ') AS x FROM b)
SELECT id, CASE WHEN w = '' THEN '(No solution provided)' ELSE array_to_string(x[:50], ' ') || CASE WHEN len(x) > 50 THEN '...' ELSE '' END END AS summary FROM d""",
)
def summaries(t):
    return t.patterns.select("id", T.summary(c("solution")).alias("summary"))


@query("pyramid_coverage", "SELECT count(*) AS n, count_if(strlen(problem) > 0) AS with_title, count_if(strlen(solution) > 20) AS with_summary, round(100.0 * count_if(strlen(solution) > 20) / count(*), 4) AS percent FROM patterns")
def pyramid_coverage(t):
    s = F.count_if(F.octet_length("solution") > 20)
    return t.patterns.agg(F.count("*").alias("n"), F.count_if(F.octet_length("problem") > 0).alias("with_title"), s.alias("with_summary"), F.round(F.lit(100.0) * s / F.count("*"), 4).alias("percent"))


@query("truncated_labels", "SELECT id, CASE WHEN strlen(problem) <= 40 THEN problem ELSE substring(problem, 1, 37) || '...' END AS label FROM patterns")
def truncated_labels(t):
    return t.patterns.select("id", T.truncated(c("problem"), 40).alias("label"))


@query("domain_algebra", "SELECT id, string_split(domain, '.')[1] AS root, len(string_split(domain, '.')) AS depth, array_to_string([string_split(domain, '.')[1], domain], '|') AS levels, CASE WHEN len(string_split(domain, '.')) > 1 THEN string_split(domain, '.')[1] END AS parent FROM patterns")
def domain_algebra(t):
    d = c("domain")
    return t.patterns.select("id", T.domain_root(d).alias("root"), T.domain_depth(d).alias("depth"), F.array_join(T.domain_levels(d), "|").alias("levels"), T.domain_parent(d).alias("parent"))


@query("domain_similarity", "SELECT a.id, CASE WHEN a.domain = b.domain THEN 1.0::DOUBLE WHEN string_split(a.domain, '.')[1] = string_split(b.domain, '.')[1] THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS similarity FROM patterns a JOIN patterns b ON b.id = a.parent_id")
def domain_similarity(t):
    a, b = t.patterns.select("id", "parent_id", c("domain").alias("da")), t.patterns.select(c("id").alias("pid"), c("domain").alias("db"))
    return a.join(b, c("parent_id") == c("pid")).select("id", T.domain_similarity(c("da"), c("db")).alias("similarity"))


@query("content_hashes", "SELECT id, md5(problem || chr(10) || solution) AS h, sha256(problem || chr(10) || solution) AS content FROM patterns")
def content_hashes(t):
    both = F.concat_ws("\n", "problem", "solution")
    return t.patterns.select("id", F.md5(both).alias("h"), F.sha2(both, 256).alias("content"))


def _pii_sql() -> str:
    x = "text"
    for _, p, put in T.STRIP:
        flags = "gi" if p.startswith("(?i)") else "g"
        x = f"regexp_replace({x}, '{p.removeprefix('(?i)').replace(chr(39), chr(39) * 2)}', '{put}', '{flags}')"
    return f"SELECT doc_id, md5({x}) AS stripped, {x} <> text AS changed FROM documents"


@query("pii_stripped", _pii_sql())
def pii_stripped(t):
    s = T.stripped(c("text"))
    return t.documents.select("doc_id", F.md5(s).alias("stripped"), (s != c("text")).alias("changed"))


@query("pii_class", "SELECT doc_id, greatest(" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {k} ELSE 0 END" for _, p, k in T.DETECT) + ")::BIGINT AS class FROM documents")
def pii_class(t):
    return t.documents.select("doc_id", T.personal_class(c("text")).alias("class"))


@query("pii_summary", " UNION ALL ".join(f"SELECT '{n}' AS kind, coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0)::BIGINT AS n, count_if(regexp_matches(text, '{p}')) AS docs FROM documents" for n, p, _ in T.DETECT))
def pii_summary(t):
    cols = [x for n, p, _ in T.DETECT for x in (F.sum(F.regexp_count("text", F.lit(p))).alias(f"{n}_n"), F.count_if(c("text").rlike(p)).alias(f"{n}_d"))]
    one = t.documents.agg(*cols)  # one pass for all kinds
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), c(f"{n}_n").alias("n"), c(f"{n}_d").alias("docs")) for n, _, _ in T.DETECT]))
    return one.select(rows.alias("r")).select("r.*")


@query("pii_redacted_talk", "SELECT conv_id, turn, " + "regexp_replace(" * len(T.DETECT) + "text" + "".join(f", '{p}', '[{n}]', 'g')" for n, p, _ in T.DETECT) + " AS text FROM conversations")
def pii_redacted_talk(t):
    return t.conversations.select("conv_id", "turn", T.redacted(c("text")).alias("text"))


@query("pii_styles", "SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '***', 'g') = text AS same, substr(sha256(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[a-z]+')), 1, 8) AS hashed, length(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[a-z]+')) AS masked_length FROM documents")
def pii_styles(t):
    m = F.regexp_extract("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]+", 0)
    fixed = F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "***")
    return t.documents.select("doc_id", (fixed == c("text")).alias("same"), F.substring(F.sha2(m, 256), 1, 8).alias("hashed"), F.length(F.mask(m)).cast("long").alias("masked_length"))


@query("dna_barcode", "SELECT id, CASE WHEN tier = 'reflex' THEN 'R' WHEN tier = 'crystal' THEN 'C' ELSE 'B' END || repeat('#', floor(reward * 5)::BIGINT) || repeat('-', 5 - floor(reward * 5)::BIGINT) || CASE WHEN created_days < 30 THEN 'n' ELSE 'o' END || reuse_count || CASE WHEN surprise > 0.5 THEN '!' ELSE '' END AS dna FROM patterns")
def dna_barcode(t):
    k = F.floor(c("reward") * 5).cast("int")
    return t.patterns.select("id", F.concat(F.when(c("tier") == "reflex", "R").when(c("tier") == "crystal", "C").otherwise("B"), F.repeat(F.lit("#"), k), F.repeat(F.lit("-"), F.lit(5) - k), F.when(c("created_days") < 30, "n").otherwise("o"), c("reuse_count").cast("string"), F.when(c("surprise") > 0.5, "!").otherwise("")).alias("dna"))


@query("prompt_budget", "SELECT domain, id FROM (SELECT domain, id, sum(ceil(length(problem) / 4.0)::BIGINT) OVER (PARTITION BY domain ORDER BY reward DESC, id) AS used FROM patterns) WHERE used <= 200")
def prompt_budget(t):
    """Patterns that fit a token budget, best first; four characters count as a token."""
    used = F.sum(F.ceil(F.length("problem") / 4.0)).over(Window.partitionBy("domain").orderBy(F.desc("reward"), "id"))
    return t.patterns.withColumn("used", used).where("used <= 200").select("domain", "id")


@query("context_lines", "SELECT domain, string_agg('- ' || id || ' (' || tier || ')', chr(10) ORDER BY id) AS context FROM patterns WHERE reward > 0.9 AND tier IS NOT NULL GROUP BY 1")
def context_lines(t):
    x = F.array_sort(F.collect_list(F.struct("id", F.concat(F.lit("- "), c("id").cast("string"), F.lit(" ("), c("tier"), F.lit(")")).alias("line"))))
    return t.patterns.where("reward > 0.9 AND tier IS NOT NULL").groupBy("domain").agg(F.array_join(F.transform(x, lambda e: e["line"]), "\n").alias("context"))


@query("query_complexity", "SELECT conv_id, turn, round(1 - exp(-0.45::DOUBLE * (" + " + ".join(f"contains(' ' || lower(text) || ' ', '{w}')::INT" for w in T.CUES) + ")), 6) AS demand FROM conversations")
def query_complexity(t):
    return t.conversations.select("conv_id", "turn", F.round(T.reasoning_demand(c("text")), 6).alias("demand"))


@query("complexity_levels", "SELECT id, CASE WHEN reward < 0.3 THEN 'low' WHEN reward < 0.5 THEN 'medium' WHEN reward < 0.7 THEN 'high' ELSE 'very_high' END AS level FROM patterns")
def complexity_levels(t):
    return t.patterns.select("id", T.complexity_level(c("reward")).alias("level"))


@query("code_detectors", "SELECT page_id, len(regexp_extract_all(html, '<script>')) AS scripts, len(regexp_extract_all(html, 'href=\"[^\"]*\"')) AS links, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages")
def code_detectors(t):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t.pages.select("page_id", n("<script>").alias("scripts"), n('href="[^"]*"').alias("links"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))


@query("json_path", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_path(t):
    k = F.get_json_object("props", "$.k")
    return t.events.where(k.isNotNull()).select("event_id", k.cast("long").alias("k"))


# Rewards, tiers, learning


@query(
    "beta_statistics",
    """WITH b AS (SELECT pattern_id, 1.0::DOUBLE + count_if(outcome = 'success') AS a, 1.0::DOUBLE + count_if(outcome = 'failure') AS b FROM outcomes GROUP BY 1)
SELECT pattern_id, a AS alpha, b AS beta, round(a / (a + b), 6) AS mean, round(a * b / ((a + b) * (a + b) * (a + b + 1)), 9) AS variance, round(1 - 1 / (a + b - 2 + 1), 6) AS confidence FROM b""",
)
def beta_statistics(t):
    n = lambda o: F.count_if(c("outcome") == o) + F.lit(1.0)
    b = t.outcomes.groupBy("pattern_id").agg(n("success").alias("alpha"), n("failure").alias("beta"))
    a, z = c("alpha"), c("beta")
    return b.select("pattern_id", "alpha", "beta", F.round(S.beta_mean(a, z), 6).alias("mean"), F.round(S.beta_variance(a, z), 9).alias("variance"), F.round(S.beta_confidence(a + z - 2), 6).alias("confidence"))


@query(
    "modified_rewards",
    """WITH x AS (SELECT event_id, CASE outcome WHEN 'success' THEN 0.9::DOUBLE WHEN 'partial' THEN 0.7::DOUBLE WHEN 'neutral' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS base, (event_id % 10) / 10.0::DOUBLE AS conf, (event_id % 7) / 7.0::DOUBLE AS ctx,
  CASE WHEN event_id % 3 = 0 THEN (event_id % 5) / 5.0::DOUBLE END AS speed, CASE WHEN event_id % 4 = 0 THEN (event_id % 6) / 6.0::DOUBLE END AS sat, event_id % 2 = 0 AS ver FROM outcomes)
SELECT event_id, round(greatest(0, least(1, base * greatest(0.5, least(1.5, (0.7 + conf * 0.4) * (0.8 + ctx * 0.2) * coalesce(0.95 + speed * 0.1, 1) * coalesce(0.8 + sat * 0.4, 1) * CASE WHEN ver THEN 1.05 ELSE 1 END)))), 6) AS reward FROM x""",
)
def modified_rewards(t):
    e = c("event_id")
    m = S.reward_modifiers(e % 10 / 10.0, e % 7 / 7.0, F.when(e % 3 == 0, e % 5 / 5.0), F.when(e % 4 == 0, e % 6 / 6.0), e % 2 == 0)
    return t.outcomes.select("event_id", F.round(S.clamp(S.base_reward(c("outcome")) * m), 6).alias("reward"))


@query(
    "tier_evaluation",
    """WITH x AS (SELECT id, reward, coalesce(tier, 'booster') AS old, CASE WHEN reward >= 0.9 AND usage_count >= 20 THEN 'reflex' WHEN reward >= 0.7 AND usage_count >= 5 THEN 'crystal' ELSE 'booster' END AS new FROM patterns),
y AS (SELECT *, CASE new WHEN 'reflex' THEN 3 WHEN 'crystal' THEN 2 ELSE 1 END AS rn, CASE old WHEN 'reflex' THEN 3 WHEN 'crystal' THEN 2 ELSE 1 END AS ro FROM x)
SELECT id, old, CASE WHEN rn > ro THEN new WHEN old = 'reflex' AND reward < 0.8 THEN 'crystal' WHEN old = 'crystal' AND reward < 0.6 THEN 'booster' ELSE old END AS tier FROM y""",
)
def tier_evaluation(t):
    old = F.coalesce("tier", F.lit("booster"))
    return t.patterns.select("id", old.alias("old"), S.tier_with_hysteresis(c("reward"), c("usage_count"), old).alias("tier"))


@query("temperature_classes", "SELECT id, CASE WHEN updated_days <= 7 AND usage_count >= 3 THEN 'hot' WHEN updated_days <= 30 THEN 'warm' ELSE 'cold' END AS temperature FROM patterns")
def temperature_classes(t):
    return t.patterns.select("id", S.temperature(c("updated_days"), c("usage_count")).alias("temperature"))


@query("recency_forms", "SELECT id, round(exp(-(updated_days * 24) / 720.0::DOUBLE), 6) AS exponential, round(pow(2, -updated_days / 30.0::DOUBLE), 6) AS half_life, round(CASE WHEN updated_days <= 7 THEN 1 ELSE pow(2, -updated_days / 30.0::DOUBLE) END, 6) AS weight FROM patterns")
def recency_forms(t):
    d = c("updated_days")
    return t.patterns.select("id", F.round(S.recency_exponential(d), 6).alias("exponential"), F.round(S.recency_half_life(d), 6).alias("half_life"), F.round(S.recency_weight(d), 6).alias("weight"))


@query(
    "importance_and_protection",
    """WITH x AS (SELECT id, reward, usage_count AS n, success_count / greatest(usage_count, 1)::DOUBLE AS p, effectiveness FROM patterns WHERE usage_count > 0),
f AS (SELECT *, least(CASE WHEN p > 0.05 AND p < 0.95 THEN 1 / (p * (1 - p)) ELSE 0.5 END / 25, 1) AS fi FROM x), i AS (SELECT *, least(fi * 0.3 + p * 0.5 + least(greatest(ln(n), 1) / 10, 1) * 0.2, 1) AS imp FROM f)
SELECT id, round(fi, 6) AS fisher, round(imp, 6) AS importance, round(CASE WHEN abs(effectiveness - reward) < 0.001 THEN effectiveness ELSE reward + (effectiveness - reward) * CASE WHEN imp >= 0.3 THEN 1 / (1 + 1000 * fi * (effectiveness - reward) * (effectiveness - reward)) ELSE 1 END END, 6) AS reward FROM i""",
)
def importance_and_protection(t):
    p = t.patterns.where("usage_count > 0")
    rate = c("success_count") / c("usage_count").cast("double")
    imp = S.importance(c("success_count"), c("usage_count"))
    return p.select("id", F.round(S.fisher(rate), 6).alias("fisher"), F.round(imp, 6).alias("importance"), F.round(S.protected_update(c("reward"), c("effectiveness"), S.fisher(rate), imp >= 0.3, 1000.0), 6).alias("reward"))


@query("metacognition", "SELECT id, round(greatest(0, least(1, reward * effectiveness * (1 - 0.5 * abs(reward - effectiveness) * (1 - reward * effectiveness)))), 6) AS quality FROM patterns")
def metacognition(t):
    return t.patterns.select("id", F.round(S.metacognitive_quality(c("reward"), c("effectiveness")), 6).alias("quality"))


@query("satisfaction_mean", "SELECT pattern_id, round(avg(value), 6) AS satisfaction, count(*) AS n FROM outcomes GROUP BY 1")
def satisfaction_mean(t):
    return t.outcomes.groupBy("pattern_id").agg(F.round(F.avg("value"), 6).alias("satisfaction"), F.count("*").alias("n"))


@query("transfer_pairs", "SELECT a.domain AS src, b.domain AS dst, count(*) AS n, round(avg(b.reward - a.reward), 6) AS gain FROM (SELECT id, string_split(domain, '.')[1] AS domain, reward FROM patterns) a JOIN (SELECT parent_id, string_split(domain, '.')[1] AS domain, reward FROM patterns) b ON a.id = b.parent_id WHERE a.domain <> b.domain GROUP BY 1, 2")
def transfer_pairs(t):
    root = T.domain_root(c("domain"))
    a = t.patterns.select(c("id").alias("a"), root.alias("src"), c("reward").alias("ra"))
    b = t.patterns.select(c("parent_id").alias("b"), root.alias("dst"), c("reward").alias("rb"))
    return a.join(b, c("a") == c("b")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.avg(c("rb") - c("ra")), 6).alias("gain"))


@query("consensus", "WITH w AS (SELECT domain, tier, exp(effectiveness - max(effectiveness) OVER (PARTITION BY domain)) AS e, confidence FROM patterns WHERE tier IS NOT NULL), s AS (SELECT domain, tier, e / sum(e) OVER (PARTITION BY domain) * confidence AS x FROM w) SELECT domain, tier, round(sum(x), 6) AS support FROM s GROUP BY 1, 2")
def consensus(t):
    w = Window.partitionBy("domain")
    x = t.patterns.where("tier IS NOT NULL").select("domain", "tier", "confidence", F.exp(c("effectiveness") - F.max("effectiveness").over(w)).alias("e"))
    s = x.select("domain", "tier", (c("e") / F.sum("e").over(w) * c("confidence")).alias("x"))
    return s.groupBy("domain", "tier").agg(F.round(F.sum("x"), 6).alias("support"))


@query("improvement_plan", "SELECT id, kind FROM (SELECT id, 'low' AS kind FROM patterns WHERE reward < 0.2 AND usage_count >= 10 UNION ALL SELECT id, 'stale' FROM patterns WHERE updated_days > 150 AND reuse_count < 10 UNION ALL SELECT id, 'inconsistent' FROM patterns WHERE abs(reward - effectiveness) > 0.7)")
def improvement_plan(t):
    kinds = F.array_compact(F.array(F.when((c("reward") < 0.2) & (c("usage_count") >= 10), "low"), F.when((c("updated_days") > 150) & (c("reuse_count") < 10), "stale"), F.when(F.abs(c("reward") - c("effectiveness")) > 0.7, "inconsistent")))
    return t.patterns.select("id", F.explode(kinds).alias("kind"))


@query("introspection_rules", "SELECT domain, CASE WHEN n < 5 THEN 'thin' WHEN r < 0.4 THEN 'weak' ELSE 'fine' END AS finding FROM (SELECT domain, count(*) AS n, avg(reward) AS r FROM patterns GROUP BY 1)")
def introspection_rules(t):
    g = t.patterns.groupBy("domain").agg(F.count("*").alias("n"), F.avg("reward").alias("r"))
    return g.select("domain", F.when(c("n") < 5, "thin").when(c("r") < 0.4, "weak").otherwise("fine").alias("finding"))


@query("alert_counts", "SELECT event_type, count_if(value > 95) AS critical, count_if(value > 80 AND value <= 95) AS warning FROM events GROUP BY 1")
def alert_counts(t):
    return t.events.groupBy("event_type").agg(F.count_if(c("value") > 95).alias("critical"), F.count_if((c("value") > 80) & (c("value") <= 95)).alias("warning"))


@query("alerts_with_cooldown", "WITH RECURSIVE a AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE value > 90), r(event_type, k, last) AS (SELECT event_type, 1::BIGINT, ts FROM a WHERE k = 1 UNION ALL SELECT r.event_type, a.k, CASE WHEN a.ts >= r.last + INTERVAL 1 DAY THEN a.ts ELSE r.last END FROM r JOIN a ON a.event_type = r.event_type AND a.k = r.k + 1) SELECT event_type, count(DISTINCT last) AS fired FROM r GROUP BY 1")
def alerts_with_cooldown(t):
    """A rule fires again only a day after it last fired: a fold over the ordered hits of each rule."""
    us = F.unix_micros(c("ts").cast("timestamp"))
    hits = t.events.where("value > 90").groupBy("event_type").agg(F.array_sort(F.collect_list(us)).alias("x"))
    start = F.struct(F.lit(-(1 << 60)).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.when(x >= s["last"] + 86_400_000_000, F.struct(x.alias("last"), (s["n"] + 1).alias("n"))).otherwise(s)
    return hits.select("event_type", F.aggregate("x", start, step)["n"].alias("fired"))


@query("session_windows", "WITH x AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS cut FROM events), s AS (SELECT user_id, sum(coalesce(cut, TRUE)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, count(DISTINCT k) AS sessions FROM s GROUP BY 1")
def session_windows(t):
    s = t.events.withColumn("tt", c("ts").cast("timestamp")).groupBy("user_id", F.session_window("tt", "6 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("tumbling_windows", "SELECT event_type, CAST(date_trunc('day', ts)::DATE AS VARCHAR) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(t):
    w = t.events.withColumn("tt", c("ts").cast("timestamp")).groupBy("event_type", F.window("tt", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "total")


@query("hash_embeddings")
def hash_embeddings(t):
    return t.benchmark.select("item_id", F.transform(E.embedded(c("text")), lambda x: F.round(x, 6)).alias("embedding"))


@query("first_sundays", "SELECT DISTINCT CAST(CASE WHEN isodow(m) = 7 THEN m ELSE m + (7 - isodow(m))::INT END AS VARCHAR) AS day FROM (SELECT date_trunc('month', o_orderdate)::DATE AS m FROM orders)")
def first_sundays(t):
    m = F.trunc(F.to_date("o_orderdate"), "month")
    return t.orders.select(F.next_day(F.date_sub(m, 1), "Sun").cast("string").alias("day")).distinct()
