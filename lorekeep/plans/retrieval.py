"""Queries on vectors, retrieval, full text and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import vectors as V
from ..operators import fulltext as X
from ..operators import prediction as P
from ..operators import retrieval as R
from .registry import query

KNN = "q AS (SELECT v AS q FROM vectors WHERE vec_id = 0), k AS (SELECT vec_id, label, v, round(list_cosine_similarity(v, q), 6) AS sim FROM vectors, q)"


@query("knn_exact", f"WITH {KNN} SELECT vec_id, label, sim FROM k ORDER BY sim DESC, vec_id LIMIT 10")
def knn_exact(t):
    return R.nearest(t.vectors, R.query_vector(t.vectors, 0), 10).select("vec_id", "label", "sim")


@query("knn_filtered", f"WITH {KNN} SELECT vec_id, sim FROM k WHERE sim >= 0.1 AND label = 3 ORDER BY sim DESC, vec_id LIMIT 10")
def knn_filtered(t):
    return R.nearest(t.vectors.where("label = 3"), R.query_vector(t.vectors, 0), 10, 0.1).select("vec_id", "sim")


@query("knn_excluding_self", f"WITH {KNN} SELECT vec_id, sim FROM k WHERE vec_id <> 0 ORDER BY sim DESC, vec_id LIMIT 50")
def knn_excluding_self(t):
    return R.nearest(t.vectors, R.query_vector(t.vectors, 0), 50, exclude=0).select("vec_id", "sim")


@query("knn_top100_then_filter", f"WITH {KNN}, h AS (SELECT * FROM k ORDER BY sim DESC, vec_id LIMIT 100) SELECT vec_id, sim FROM h WHERE label = 2")
def knn_top100_then_filter(t):
    """The filter comes after the cut, so fewer rows than asked for may be left."""
    return R.nearest(t.vectors, R.query_vector(t.vectors, 0), 100).where("label = 2").select("vec_id", "sim")


BATCH = "j AS (SELECT q.vec_id AS qid, x.vec_id, round(list_cosine_similarity(x.v, q.v), 6) AS sim FROM vectors q JOIN vectors x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)"


def _queries(t):
    return t.vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))


@query("knn_batch", f"WITH {BATCH} SELECT qid, vec_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM j) WHERE rank <= 5")
def knn_batch(t):
    return R.nearest_each(t.vectors, _queries(t), 5)


@query("similar_edges", f"WITH {BATCH}, e AS (SELECT qid, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS r FROM j WHERE sim >= 0.3) WHERE r <= 5) SELECT qid AS src, vec_id AS dst, sim FROM e UNION ALL SELECT vec_id, qid, sim FROM e")
def similar_edges(t):
    e = R.nearest_each(t.vectors, _queries(t), 5, 0.3).select(F.col("qid").alias("src"), F.col("vec_id").alias("dst"), "sim")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))


@query("near_pairs_in_label", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.3")
def near_pairs_in_label(t):
    return R.pairs_within(t.vectors, "label", 0.3)


NEAR = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.3)"


@query("near_pairs_hashed", f"WITH {NEAR} SELECT a, b, sim FROM p")
def near_pairs_hashed(t):
    """All pairs; at 0.3 hash tables would lose many, so blocks are compared whole."""
    return R.all_pairs(t.vectors, 0.3)


@query(
    "near_duplicate_groups",
    f"""WITH RECURSIVE {NEAR}, n AS (SELECT v.vec_id, row_number() OVER (ORDER BY v.vec_id) AS k, (SELECT list(a) FROM p WHERE p.b = v.vec_id) AS near FROM vectors v),
s(k, seeds) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.k, CASE WHEN list_has_any(coalesce(n.near, []), s.seeds) THEN s.seeds ELSE list_append(s.seeds, n.vec_id) END FROM s JOIN n ON n.k = s.k + 1),
e AS (SELECT unnest(seeds) AS seed FROM s WHERE k = (SELECT max(k) FROM s)), m AS (SELECT min(p.a) AS seed, p.b AS vec_id FROM p JOIN e ON e.seed = p.a WHERE p.b NOT IN (SELECT seed FROM e) GROUP BY p.b)
SELECT seed, vec_id FROM m UNION ALL SELECT DISTINCT seed, seed FROM m""",
)
def near_duplicate_groups(t):
    """Over all vectors, whatever their label."""
    return R.near_groups(t.vectors, 0.3)


def picks_sql(n: int, weight: float, zero: bool) -> str:
    """Greedy choice from a table cand (vec_id, v, sim) in n steps, each a table of what is chosen so far."""
    steps = ["p0 AS (SELECT NULL::BIGINT AS vec_id, 0::BIGINT AS place WHERE FALSE)"]
    for k in range(1, n + 1):
        most = "max(list_cosine_similarity(c.v, d.v))"
        near = f"(SELECT {f'greatest(0.0::DOUBLE, {most})' if zero else most} FROM p{k - 1} JOIN cand d USING (vec_id))"
        score = "c.sim" if k == 1 else f"{weight}::DOUBLE * c.sim - {round(1 - weight, 6)}::DOUBLE * {near}"
        steps.append(f"p{k} AS MATERIALIZED (SELECT * FROM p{k - 1} UNION ALL (SELECT vec_id, {k} FROM (SELECT c.vec_id, c.sim, {score} AS score FROM cand c WHERE c.vec_id NOT IN (SELECT vec_id FROM p{k - 1})) ORDER BY score DESC, sim DESC, vec_id LIMIT 1))")
    return ", ".join(steps)


@query("mmr_retrieval", f"WITH {KNN}, cand AS (SELECT vec_id, v, sim FROM k ORDER BY sim DESC, vec_id LIMIT 100), {picks_sql(10, 0.7, False)} SELECT vec_id, place FROM p10")
def mmr_retrieval(t):
    return R.diverse(R.nearest(t.vectors, R.query_vector(t.vectors, 0), 100), 10, 0.7, None)


@query("mmr_standalone", f"WITH {KNN}, cand AS (SELECT vec_id, v, sim FROM k WHERE sim >= 0 ORDER BY sim DESC, vec_id LIMIT 50), {picks_sql(10, 0.5, True)} SELECT vec_id, place FROM p10")
def mmr_standalone(t):
    return R.diverse(R.nearest(t.vectors, R.query_vector(t.vectors, 0), 50, 0.0), 10, 0.5, 0.0)


@query("mmr_order_only", f"WITH {KNN} SELECT vec_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS place FROM k ORDER BY sim DESC, vec_id LIMIT 10")
def mmr_order_only(t):
    """The reranking whose penalty only depends on the place: the plain order of similarity."""
    from pyspark.sql import Window

    k = R.nearest(t.vectors, R.query_vector(t.vectors, 0), 10)
    return k.select("vec_id", F.row_number().over(Window.orderBy(F.desc("sim"), "vec_id")).cast("long").alias("place"))


@query(
    "embedding_quality",
    f"""WITH {BATCH}, o AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM j),
c AS (SELECT q.vec_id AS qid, x.vec_id, round(list_cosine_similarity(x.v[1:48], q.v[1:48]), 6) AS sim FROM vectors q JOIN vectors x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
n AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM c),
s AS (SELECT o.qid, count_if(o.rank <= 5 AND n.rank <= 5) / count_if(o.rank <= 5)::DOUBLE AS r, count_if(o.rank <= 5 AND n.rank <= 5) / count_if(n.rank <= 5)::DOUBLE AS p, coalesce(1.0::DOUBLE / min(n.rank) FILTER (WHERE o.rank <= 5 AND n.rank <= 5), 0) AS rr
  FROM o JOIN n ON o.qid = n.qid AND o.vec_id = n.vec_id GROUP BY 1)
SELECT round(avg(r), 6) AS recall, round(avg(p), 6) AS precision, round(avg(rr), 6) AS mrr, count(*) AS samples, count_if(r < 0.85 OR p < 0.8) AS failed FROM s""",
)
def embedding_quality(t):
    """Neighbours by vectors cut to their first 48 numbers against those by whole ones."""
    cut = lambda c: F.slice(c, 1, 48).alias(c)
    found = R.nearest_each(t.vectors.select("vec_id", cut("v")), _queries(t).select("qid", cut("q")), 5)
    return R.quality_gate(found, R.nearest_each(t.vectors, _queries(t), 5))


@query(
    "five_factor_scores",
    """SELECT id, round(greatest(0, least(1, ((1 - surprise) * 0.5 + exp(-(updated_days * 24) / 720.0::DOUBLE) * 0.1
  + ((confidence * 0.4 + success_rate * 0.6) * (least(usage_count, 10) / 10.0::DOUBLE) + confidence * (1 - least(usage_count, 10) / 10.0::DOUBLE)) * 0.2 + reward * 0.1
  + (CASE WHEN usage_count > 0 THEN least(ln(usage_count) / ln(100), 1) ELSE 0 END) * 0.1))), 6) AS score FROM patterns""",
)
def five_factor_scores(t):
    c = F.col
    s = S.five_factor(F.lit(1.0) - c("surprise"), S.recency_exponential(c("updated_days")), S.reliability_by_usage(c("confidence"), c("success_rate"), c("usage_count")), c("reward"), S.reuse_log100(c("usage_count")))
    return t.patterns.select("id", F.round(s, 6).alias("score"))


@query(
    "four_factor_scores",
    """WITH m AS (SELECT max(reuse_count) AS most FROM patterns) SELECT id, round(greatest(0, least(1, (1 - surprise) * 0.5 + pow(2, -updated_days / 30.0::DOUBLE) * 0.2 + (effectiveness * 0.6 + confidence * 0.3 + CASE WHEN success THEN 0.1 ELSE 0 END) * 0.2
  + ln(1 + reuse_count) / ln(1 + most) * 0.1)), 6) AS score FROM patterns, m""",
)
def four_factor_scores(t):
    c = F.col
    m = t.patterns.agg(F.max("reuse_count").alias("most"))
    s = S.four_factor(F.lit(1.0) - c("surprise"), S.recency_half_life(c("updated_days")), S.reliability_by_outcome(c("effectiveness"), c("confidence"), c("success")), S.reuse_log_max(c("reuse_count"), c("most")))
    return t.patterns.join(F.broadcast(m)).select("id", F.round(s, 6).alias("score"))


@query(
    "quality_and_relevance",
    """WITH x AS (SELECT *, effectiveness * 0.4 + confidence * 0.3 + reward * 0.2 + CASE WHEN success THEN 0.1 ELSE 0 END AS q FROM patterns)
SELECT id, round(q, 6) AS quality, round(q * exp(-0.0077::DOUBLE * updated_days) * (1 + 0.2 * surprise), 6) AS relevance FROM x""",
)
def quality_and_relevance(t):
    c = F.col
    q = S.quality(c("effectiveness"), c("confidence"), c("reward"), c("success"))
    return t.patterns.select("id", F.round(q, 6).alias("quality"), F.round(S.relevance(q, c("updated_days"), c("surprise")), 6).alias("relevance"))


def _bm25_sql(table: str, key: str, column: str, words: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{k}" for k, w in enumerate(words))
    df = ", ".join(f"count(1) FILTER (WHERE tf{k} > 0) AS df{k}" for k in range(len(words)))
    score = " + ".join(f"ln((n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE) + 1) * tf{k} * 2.2::DOUBLE / (tf{k} + (0.25::DOUBLE + len / avg * 0.75::DOUBLE) * 1.2::DOUBLE)" for k in range(len(words)))
    some = " OR ".join(f"tf{k} > 0" for k in range(len(words)))
    return f"""w AS (SELECT {key}, regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+') AS t FROM {table}), d AS (SELECT {key}, len(t) AS len, {tf} FROM w), s AS (SELECT count(*) AS n, avg(len) AS avg, {df} FROM d),
f AS (SELECT {key}, round(-({score}), 6) AS rank FROM d, s WHERE {some})"""


WORDS = ["idiot", "tion", "license"]


@query("bm25_documents", f"WITH {_bm25_sql('documents', 'doc_id', 'text', WORDS)} SELECT doc_id, rank FROM f")
def bm25_documents(t):
    return X.bm25(t.documents, "doc_id", "text", WORDS)


@query("bm25_page", f"WITH {_bm25_sql('documents', 'doc_id', 'text', WORDS)} SELECT doc_id, rank FROM f ORDER BY rank, doc_id LIMIT 10 OFFSET 5")
def bm25_page(t):
    return X.bm25(t.documents, "doc_id", "text", WORDS).orderBy("rank", "doc_id").offset(5).limit(10)


@query("fts_index_terms", "SELECT term, count(DISTINCT item_id) AS df, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) GROUP BY 1")
def fts_index_terms(t):
    return X.index(t.benchmark, "item_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("fts_snippet", "SELECT doc_id, regexp_replace(substr(text, greatest(strpos(lower(text), 'idiot') - 30, 1)::BIGINT, 65), '(idiot)', '<mark>\\1</mark>', 'gi') AS snippet FROM documents WHERE strpos(lower(text), 'idiot') > 0")
def fts_snippet(t):
    return t.documents.select("doc_id", X.snippet(F.col("text"), "idiot").alias("snippet")).where("snippet IS NOT NULL")


@query("stemmed_search")
def stemmed_search(t):
    """Documents with any form of the words."""
    return X.stemmed(t.documents, "doc_id", "text", ["license", "warranties"])


@query("porter_stems")
def porter_stems(t):
    return t.benchmark.select("item_id", F.explode(F.array_distinct(X.stems(X.terms(F.col("text"))))).alias("stem"))


@query(
    "hybrid_retrieval",
    f"""WITH {KNN}, top AS (SELECT vec_id AS doc_id, sim FROM k ORDER BY sim DESC, vec_id LIMIT 100), {_bm25_sql('documents', 'doc_id', 'text', WORDS)}, b AS (SELECT min(rank) AS lo, max(rank) AS hi FROM f),
n AS (SELECT doc_id, greatest(0.1, least(1, 1 - (rank - lo) / (hi - lo))) AS fts FROM f, b) SELECT coalesce(top.doc_id, n.doc_id) AS doc_id, round(coalesce(sim, 0) * 0.7 + coalesce(fts, 0) * 0.3, 6) AS score FROM top FULL JOIN n ON top.doc_id = n.doc_id""",
)
def hybrid_retrieval(t):
    top = R.nearest(t.vectors, R.query_vector(t.vectors, 0), 100).select(F.col("vec_id").alias("doc_id"), "sim")
    f = X.bm25(t.documents, "doc_id", "text", WORDS)
    b = f.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    fts = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.lit(1.0) - (F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return R.hybrid(top, f.join(F.broadcast(b)).select("doc_id", fts.alias("fts")), "doc_id")


@query("staged_lookup", "SELECT p.id, CASE WHEN p.tier = 'reflex' THEN 'reflex' WHEN p.tier = 'crystal' THEN 'crystal' ELSE 'full' END AS stage FROM patterns p JOIN (SELECT DISTINCT md5(problem) AS h FROM patterns WHERE id % 50 = 0) q ON md5(p.problem) = q.h")
def staged_lookup(t):
    asked = t.patterns.where("id % 50 = 0").select(F.md5("problem").alias("h")).distinct()
    hit = t.patterns.withColumn("h", F.md5("problem")).join(asked, "h")
    return hit.select("id", F.when(F.col("tier").isin("reflex", "crystal"), F.col("tier")).otherwise("full").alias("stage"))


# Vector functions


@query("vector_norms", "SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, abs(sqrt(list_dot_product(v, v)) - 1) < 1e-4 AS unit FROM vectors")
def vector_norms(t):
    return t.vectors.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), V.is_normalized(F.col("v")).alias("unit"))


@query("vector_distances", "SELECT x.vec_id, round(list_distance(x.v, q.v), 6) AS l2, round(list_distance(x.v, q.v) * list_distance(x.v, q.v), 6) AS l2sq, round(list_cosine_similarity(x.v, q.v), 6) AS cos FROM vectors x, vectors q WHERE q.vec_id = 1")
def vector_distances(t):
    j = t.vectors.join(F.broadcast(R.query_vector(t.vectors, 1)))
    return j.select("vec_id", F.round(V.l2(F.col("v"), F.col("q")), 6).alias("l2"), F.round(V.squared_l2(F.col("v"), F.col("q")), 6).alias("l2sq"), F.round(V.cosine(F.col("v"), F.col("q")), 6).alias("cos"))


BALL = "b AS (SELECT vec_id, label, list_transform(v, lambda x: x * (tanh(0.5 * sqrt(list_dot_product(v, v))) * 0.99::DOUBLE / sqrt(list_dot_product(v, v)))) AS p FROM vectors)"
DIST = "acosh(greatest(1, 1 + 2 * list_distance(a.p, b.p) * list_distance(a.p, b.p) / ((1 - list_dot_product(a.p, a.p)) * (1 - list_dot_product(b.p, b.p)))))"


@query("poincare_distances", f"WITH {BALL} SELECT a.vec_id, round({DIST}, 6) AS d FROM b a, b WHERE b.vec_id = 2")
def poincare_distances(t):
    b = t.vectors.select("vec_id", V.to_ball(F.col("v")).alias("p"))
    q = b.where("vec_id = 2").select(F.col("p").alias("q"))
    return b.join(F.broadcast(q)).select("vec_id", F.round(V.poincare(F.col("p"), F.col("q")), 6).alias("d"))


@query("hyperbolic_knn", f"WITH {BALL} SELECT a.vec_id, round({DIST}, 6) AS d FROM b a, b WHERE b.vec_id = 2 AND a.vec_id <> 2 ORDER BY d, a.vec_id LIMIT 10")
def hyperbolic_knn(t):
    return poincare_distances(t).where("vec_id <> 2").orderBy("d", "vec_id").limit(10)


@query("hyperbolic_rerank", f"WITH {KNN}, {BALL}, c AS (SELECT vec_id, sim FROM k ORDER BY sim DESC, vec_id LIMIT 20) SELECT c.vec_id, round(sim * 0.7 + 0.3 / (1 + {DIST}), 6) AS score FROM c JOIN b a ON c.vec_id = a.vec_id, b WHERE b.vec_id = 0")
def hyperbolic_rerank(t):
    top = R.nearest(t.vectors, R.query_vector(t.vectors, 0), 20)
    q = R.query_vector(t.vectors, 0).select(V.to_ball(F.col("q")).alias("q"))
    d = V.poincare(V.to_ball(F.col("v")), F.col("q"))
    return top.join(F.broadcast(q)).select("vec_id", F.round(F.col("sim") * 0.7 + F.lit(0.3) / (d + 1), 6).alias("score"))


@query("mobius_sum_norm", f"WITH {BALL}, x AS (SELECT a.vec_id, a.p AS u, b.p AS w, list_dot_product(a.p, b.p) AS uw, list_dot_product(a.p, a.p) AS uu, list_dot_product(b.p, b.p) AS ww FROM b a, b WHERE b.vec_id = 3) SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(u, w), lambda z: pow((z[1] * (1 + 2 * uw + ww) + z[2] * (1 - uu)) / (1 + 2 * uw + uu * ww), 2)))), 6) AS norm FROM x")
def mobius_sum_norm(t):
    b = t.vectors.select("vec_id", V.to_ball(F.col("v")).alias("p"))
    q = b.where("vec_id = 3").select(F.col("p").alias("q"))
    return b.join(F.broadcast(q)).select("vec_id", F.round(V.norm(V.mobius_add(F.col("p"), F.col("q"))), 6).alias("norm"))


@query("exp_log_maps", "SELECT vec_id, round(tanh(sqrt(list_dot_product(v, v))), 6) AS exp_norm, round(atanh(least(sqrt(list_dot_product(v, v)) * 0.5, 0.99)), 6) AS log_norm FROM vectors")
def exp_log_maps(t):
    half = V.scaled(F.col("v"), F.lit(0.5))
    return t.vectors.select("vec_id", F.round(V.norm(V.exp_map_origin(F.col("v"))), 6).alias("exp_norm"), F.round(V.norm(V.log_map_origin(half)), 6).alias("log_norm"))


@query("hierarchy_depths", "SELECT id, round(least(len(string_split(domain, '.')) / 5.0::DOUBLE, 1), 6) AS depth, CASE WHEN surprise < 0.2 THEN 'root' WHEN surprise < 0.4 THEN 'high_level' WHEN surprise < 0.6 THEN 'mid_level' WHEN surprise < 0.8 THEN 'detailed' ELSE 'leaf' END AS tier FROM patterns")
def hierarchy_depths(t):
    return t.patterns.select("id", F.round(F.least(F.size(F.split("domain", r"\.")) / 5.0, F.lit(1.0)), 6).alias("depth"), S.hierarchy_label(F.col("surprise")).alias("tier"))


@query("centroids", "SELECT label, list(m ORDER BY i)[1] AS first, count(*) AS dims FROM (SELECT label, i, round(avg(x), 6) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY 1, 2) GROUP BY 1")
def centroids(t):
    x = t.vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("m"))
    return x.groupBy("label").agg(F.min_by("m", "i").alias("first"), F.count("*").alias("dims"))


# Forecasts


@query(
    "evidence_probability",
    """WITH e AS (SELECT domain, success_rate, confidence, (success_rate * 0.4 + confidence * 0.3 + effectiveness * 0.2 + (1 - surprise) * 0.1) * CASE WHEN updated_days > 30 THEN exp(-(updated_days - 30) / 180.0::DOUBLE) ELSE 1 END AS w FROM patterns),
g AS (SELECT domain, count(*) AS n, sum(success_rate * w) AS sw, sum(w) AS w, avg(confidence) AS c, var_pop(success_rate) AS var FROM e GROUP BY 1),
x AS (SELECT domain, n, sw / w * 0.9 + 0.05 AS p, greatest(0.1, least(0.95, least(n / 10.0::DOUBLE, 1) * 0.3 + c * 0.3 + least(w / n, 1) * 0.2 + CASE WHEN n < 2 THEN 0.5 ELSE 1 - least(var / 0.25, 1) END * 0.2)) AS c FROM g)
SELECT domain, n, round(p, 6) AS probability, round(c, 6) AS confidence, round(greatest(p - (1 - c) * 0.5, 0), 6) AS low, round(least(p + (1 - c) * 0.5, 1), 6) AS high FROM x""",
)
def evidence_probability(t):
    c = F.col
    w = S.evidence_quality(c("success_rate"), c("confidence"), c("effectiveness"), F.lit(1.0) - c("surprise"), c("updated_days"))
    return P.from_evidence(t.patterns.select("domain", "success_rate", "confidence", w.alias("weight")), "domain")


@query(
    "timeline_estimate",
    """WITH c AS (SELECT domain, count(*) AS total, quantile_cont(resolution_days, 0.25) AS q1, quantile_cont(resolution_days, 0.75) AS q3 FROM predictions GROUP BY 1),
j AS (SELECT p.domain, resolution_days::DOUBLE AS d, total FROM predictions p JOIN c ON p.domain = c.domain WHERE total <= 3 OR resolution_days BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
SELECT domain, count(*) AS n, any_value(total) - count(*) AS outliers, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90 FROM j GROUP BY 1""",
)
def timeline_estimate(t):
    return P.timeline(t.predictions, "domain", "resolution_days")


@query("prediction_flags", "SELECT id, CASE WHEN status = 'resolved' THEN (probability > 0.5) = outcome END AS correct, round(greatest(0, probability - (1 - confidence) / 2), 6) AS low, round(least(1, probability + (1 - confidence) / 2), 6) AS high, status = 'pending' AND age_days > max_days AS overdue FROM predictions")
def prediction_flags(t):
    p, half = F.col("probability"), (F.lit(1.0) - F.col("confidence")) / 2
    return t.predictions.select("id", F.when(F.col("status") == "resolved", (p > 0.5) == F.col("outcome")).alias("correct"), F.round(F.greatest(F.lit(0.0), p - half), 6).alias("low"), F.round(F.least(F.lit(1.0), p + half), 6).alias("high"), ((F.col("status") == "pending") & (F.col("age_days") > F.col("max_days"))).alias("overdue"))
