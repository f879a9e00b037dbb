"""Queries on stored indexes, similarity joins of sets, and best paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ann as N
from ..operators import cuts as C
from ..operators import detectors as D
from ..operators import importance as I
from ..operators import paths as P
from ..operators import retrieval as R
from ..operators import setjoin as J
from ..operators import textindex as X
from .registry import query
from .retrieval import BATCH, WORDS, _bm25_sql, _queries

# Approximate neighbours


@query("ivf_all_lists", f"WITH {BATCH} SELECT qid, vec_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM j) WHERE rank <= 5")
def ivf_all_lists(t):
    """With every list probed and enough candidates decided, the index gives the exact neighbours: every row is in it once."""
    index = N.built(t.vectors)
    return N.search(t.spark, index, _queries(t), 5, probes=len(index.centroids), rerank=400)


@query("ivf_neighbours")
def ivf_neighbours(t):
    """Neighbours from the lists nearest to each query; ivf_recall measures them."""
    return N.search(t.spark, N.built(t.vectors), _queries(t), 5)


@query("ivf_recall", "SELECT count(*) AS queries, count(*) * least(5, (SELECT count(*) - 1 FROM embeddings)) AS asked, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0")
def ivf_recall(t):
    """Whether nine in ten of the true neighbours of every 50th vector, found by comparing all, are among those of the index."""
    found = N.recall(ivf_neighbours(t), R.nearest_each(t.vectors, _queries(t), 5))
    return found.select("queries", "asked", (F.col("found") >= F.col("asked") * 0.9).alias("enough"))


# Stored full text


@query("stored_bm25", f"WITH {_bm25_sql('documents', 'doc_id', 'text', WORDS)} SELECT doc_id, rank FROM f")
def stored_bm25(t):
    return X.search(X.built(t.documents, "doc_id", "text"), t.spark, " OR ".join(WORDS))


def _match_sql(table: str) -> str:
    """A phrase and a prefix without a word, over a table (doc_id, text)."""
    part = lambda k: f"ln((n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE) + 1) * tf{k} * 2.2::DOUBLE / (tf{k} + (0.25::DOUBLE + len / avg * 0.75::DOUBLE) * 1.2::DOUBLE)"
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM {table}),
d AS (SELECT doc_id, len(t) AS len, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS tf0, len(list_filter(t, lambda x: starts_with(x, 'tio'))) AS tf1, list_contains(t, 'license') AS bad FROM w),
s AS (SELECT count(*) AS n, avg(len) AS avg, count(1) FILTER (WHERE tf0 > 0) AS df0, count(1) FILTER (WHERE tf1 > 0) AS df1 FROM d)
SELECT doc_id, round(-({part(0)} + {part(1)}), 6) AS rank FROM d, s WHERE tf0 > 0 AND tf1 > 0 AND NOT bad"""


MATCH = '"of the" AND (tio* NOT license)'


@query("stored_match", _match_sql("documents"))
def stored_match(t):
    return X.search(X.built(t.documents, "doc_id", "text"), t.spark, MATCH)


CHANGED = "CASE WHEN lang = 'en' AND n_chars > 1000 THEN string_split(text, chr(10))[1] ELSE text END"


@query("stored_updates", _match_sql(f"(SELECT doc_id, {CHANGED} AS text FROM documents)"))
def stored_updates(t):
    """A second load replaces some documents by their first lines; both segments are then rewritten as one."""
    new = t.documents.where("lang = 'en' AND n_chars > 1000").select("doc_id", F.split("text", "\n").getItem(0).alias("text"))
    index = X.added(X.built(t.documents, "doc_id", "text"), new)
    return X.search(X.merged(index, t.spark), t.spark, MATCH)


@query("stored_terms", "SELECT term, count(DISTINCT item_id) AS df, count(*) AS tf, max(c)::BIGINT AS most FROM (SELECT item_id, term, count(*) OVER (PARTITION BY item_id, term) AS c FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark)) GROUP BY 1")
def stored_terms(t):
    """What the postings say of every term: documents, occurrences, and the most in one document."""
    p = X.built(t.benchmark, "item_id", "text").postings(t.spark)
    count = F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)
    return p.groupBy("term").agg(F.sum(F.size("keys")).alias("df"), F.sum(count).alias("tf"), F.max("most").alias("most"))


# Similar sets


SETS = "w AS (SELECT id, domain, list_distinct(regexp_extract_all(lower(solution), '[\\p{L}\\p{N}'']+')) AS x FROM patterns), c AS (SELECT domain, list_sort(x) AS x, min(id) AS k FROM w WHERE len(x) > 0 GROUP BY 1, 2)"


def _sets(t):
    return J.classes(t.patterns.select("id", "domain", T.tokens(F.col("solution")).alias("x")), "domain")


@query("similar_statements", f"WITH {SETS} SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))::DOUBLE, 6) AS similarity FROM c a JOIN c b ON a.domain = b.domain AND a.k < b.k WHERE len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x)))::DOUBLE >= 0.5")
def similar_statements(t):
    """Pairs of different statements of a domain, each named by the least of its copies; statement_classes says who these are."""
    sets, _ = _sets(t)
    return J.similar_classes(sets, 0.5).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("statement_classes", f"WITH {SETS} SELECT w.id, c.k AS class FROM w JOIN c ON w.domain = c.domain AND list_sort(w.x) = c.x")
def statement_classes(t):
    _, member = _sets(t)
    return member.select("id", "class")


@query("similar_candidates", f"WITH {SETS} SELECT domain, count(*) AS sets, TRUE AS fewer FROM c GROUP BY 1 HAVING count(*) > 5")
def similar_candidates(t):
    """Whether the filters leave fewer pairs than there are, in domains of more than five statements."""
    sets, _ = _sets(t)
    of = J.candidates(sets, 0.5).join(sets.select(F.col("class").alias("a"), "block"), "a").groupBy("block").agg(F.count("*").alias("looked"))
    n = sets.groupBy("block").agg(F.count("*").alias("sets")).where("sets > 5").join(of, "block", "left")
    return n.select(F.col("block").alias("domain"), "sets", (F.coalesce("looked", F.lit(0)) < F.col("sets") * (F.col("sets") - 1) / 2).alias("fewer"))


# Best paths


def _layers(hops: int, start: int) -> str:
    """Chained tables l1, l2, ...: the best product of strengths over exactly so many edges from a start."""
    out = [f"e AS (SELECT src, dst, max(strength) AS strength FROM edges WHERE strength >= 0.3 GROUP BY 1, 2), l0 AS (SELECT {start}::BIGINT AS node, 1.0::DOUBLE AS total)"]
    out += [f"l{k} AS MATERIALIZED (SELECT e.dst AS node, max(total * strength) AS total FROM l{k - 1} JOIN e ON e.src = node GROUP BY 1)" for k in range(1, hops + 1)]
    every = " UNION ALL ".join(f"SELECT node, {k}::BIGINT AS hops, round(total, 9) AS total FROM l{k}" for k in range(hops + 1))
    return f"WITH {', '.join(out)}, a AS ({every})"


@query("strongest_reach", f"{_layers(6, 3)} SELECT node, max(total) AS total, arg_min(hops, (-total, hops)) AS hops FROM a GROUP BY 1 HAVING arg_min(hops, (-total, hops)) > 0")
def strongest_reach(t):
    """From one node the strongest path to every node within six hops."""
    return P.strongest(t.edges, 3, 6, 0.3).select("node", F.round("total", 9).alias("total"), "hops")


@query("shortest_reach", f"{_layers(6, 3)}, m AS (SELECT node, min(hops) AS hops FROM a GROUP BY 1) SELECT node, hops, max(total) AS total FROM a JOIN m USING (node, hops) WHERE hops > 0 GROUP BY 1, 2")
def shortest_reach(t):
    """From one node the path of fewest hops to every node within six, the strongest of these."""
    return P.shortest(t.edges, 3, 6, 0.3).select("node", "hops", F.round("total", 9).alias("total"))


_LINKED = "e AS (SELECT DISTINCT item_id AS x, -vendor_id - 1 AS y FROM sale_lines WHERE item_id IS NOT NULL AND vendor_id IS NOT NULL), l2 AS MATERIALIZED (SELECT DISTINCT a.x, b.x AS z FROM e a JOIN e b ON a.y = b.y AND a.x <> b.x)"


@query(
    "shortcut_candidates",
    f"""WITH {_LINKED}, s AS (SELECT DISTINCT l.sale_id AS session, item_id AS x FROM sale_lines l JOIN sales o ON l.sale_id = o.sale_id WHERE sold_at >= TIMESTAMP '2024-02-01' AND item_id IS NOT NULL),
p AS (SELECT a.x AS a, b.x AS b, count(*) AS n FROM s a JOIN s b ON a.session = b.session AND a.x < b.x GROUP BY 1, 2 HAVING count(*) >= 3),
k AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM items i JOIN items j ON i.brand = j.brand AND i.kind = j.kind WHERE i.item_id = p.a AND j.item_id = p.b)),
h1 AS MATERIALIZED (SELECT x AS a, z FROM l2 WHERE x IN (SELECT a FROM k)), t1 AS MATERIALIZED (SELECT a, b FROM k WHERE (a, b) NOT IN (SELECT a, z FROM h1)),
{", ".join(f"h{m} AS MATERIALIZED (SELECT DISTINCT h.a, l2.z FROM h{m - 1} h JOIN l2 ON l2.x = h.z WHERE h.a IN (SELECT a FROM t{m - 1})), t{m} AS MATERIALIZED (SELECT a, b FROM t{m - 1} WHERE (a, b) NOT IN (SELECT a, z FROM h{m}))" for m in range(2, 6))},
d AS (SELECT k.*, CASE WHEN (a, b) NOT IN (SELECT a, b FROM t1) THEN 2 WHEN (a, b) NOT IN (SELECT a, b FROM t2) THEN 4 WHEN (a, b) NOT IN (SELECT a, b FROM t3) THEN 6 WHEN (a, b) NOT IN (SELECT a, b FROM t4) THEN 8 WHEN (a, b) NOT IN (SELECT a, b FROM t5) THEN 10 END AS hops FROM k)
SELECT a, b, n, hops::BIGINT AS hops, round((hops - 1) / hops::DOUBLE, 6) AS saving, round(0.6 * n / (SELECT max(n) FROM k) + 0.4 * (hops - 1) / hops::DOUBLE, 6) AS score FROM d WHERE hops >= 3 ORDER BY score DESC, a, b LIMIT 1000""",
)
def shortcut_candidates(t):
    """Items often sold together since February that no chain of vendors joins closely; items of one brand and kind are linked already."""
    sold = t.sale_lines.join(t.sales.where("sold_at >= TIMESTAMP_NTZ '2024-02-01'").select("sale_id"), "sale_id").select(F.col("sale_id").alias("session"), F.col("item_id").alias("x"))
    links = t.sale_lines.where("item_id IS NOT NULL AND vendor_id IS NOT NULL").select(F.col("item_id").alias("src"), (-F.col("vendor_id") - 1).alias("dst")).distinct()
    label = F.concat("brand", F.lit("/"), "kind")
    return P.shortcuts(sold, links, alike=t.items.select(F.col("item_id").alias("x"), label.alias("label")))


# Detectors


def _detectors_sql() -> str:
    count = lambda d: f"SELECT page_id, '{d.name}' AS name, '{d.domain}' AS domain, {d.confidence}::DOUBLE AS confidence, len(regexp_extract_all(html, '{d.pattern}')) AS n, regexp_extract(html, '{d.pattern}') AS hit FROM pages"
    return " UNION ALL ".join(map(count, D.WEB))


@query("code_patterns", f"SELECT * FROM ({_detectors_sql()}) WHERE n > 0")
def code_patterns(t):
    """Every detector's matches in every page: how many, and the first."""
    return D.found(t.pages, "page_id", "html", D.WEB).drop("first")


@query("code_pattern_summary", f"SELECT domain, name, count(*) AS texts, sum(n)::BIGINT AS n, max(confidence) AS confidence, arg_min(hit, page_id) AS example FROM ({_detectors_sql()}) WHERE n > 0 AND confidence >= 0.8 GROUP BY 1, 2")
def code_pattern_summary(t):
    return D.learned(D.found(t.pages, "page_id", "html", D.WEB), "page_id", 0.8)


# Importance


_GRADIENT = "SELECT event_type, 1 / (1 + exp(-(0.3 - 0.02 * value))) - (user_id % 3 = 0)::INT AS e, value FROM events"


@query("gradient_moments", f"SELECT event_type, count(*) AS n, round(avg(e), 6) AS g0, round(avg(e * value), 6) AS g1, round(avg(e * e), 6) AS f0, round(avg(e * value * e * value), 6) AS f1 FROM ({_GRADIENT}) GROUP BY 1")
def gradient_moments(t):
    """Means and mean squares of the examples' gradients of a model with two weights, by kind of event."""
    x = [F.lit(1.0), F.col("value")]
    y = (F.col("user_id") % 3 == 0).cast("double")
    return I.moments(t.events, x, y, [0.3, -0.02], ["event_type"]).select("event_type", "n", *[F.round(k, 6).alias(k) for k in ("g0", "g1", "f0", "f1")])


@query("fitted_importance", "WITH x AS (SELECT (quality = 1)::INT AS y, count(*) AS n FROM labels GROUP BY 1), p AS (SELECT sum(n * y) / sum(n)::DOUBLE AS p FROM x) SELECT count(*) AS n, TRUE AS at_rest, round(any_value(p * (1 - p)), 5) AS fisher FROM labels, p WHERE quality IS NOT NULL")
def fitted_importance(t):
    """A model of nothing but a constant, fitted to the labels: its gradient rests at zero and its importance is p (1 - p)."""
    rows = t.labels.where("quality IS NOT NULL")
    y = (F.col("quality") == 1).cast("double")
    w = I.fitted(rows, [F.lit(1.0)], y, ridge=0.0)
    return I.moments(rows, [F.lit(1.0)], y, w).select("n", (F.abs("g0") < 1e-6).alias("at_rest"), F.round("f0", 5).alias("fisher"))


# Cuts


@query("supplier_cut", "WITH RECURSIVE b AS (SELECT src, dst, strength FROM edges UNION ALL SELECT dst, src, strength FROM edges), r(node) AS (SELECT min(src) FROM b UNION SELECT b.dst FROM r JOIN b ON b.src = r.node), d AS (SELECT src, sum(strength) AS w FROM b GROUP BY 1) SELECT (SELECT min(node) FROM r) AS component, round(min(w), 6) AS weight, (SELECT count(*) FROM r) AS nodes FROM d WHERE src IN (SELECT node FROM r)")
def supplier_cut(t):
    """The least cut of the whole graph of parts and suppliers, in the component of its least node: no cut beats that of its weakest node."""
    return C.least_cuts(t.edges).orderBy("component").limit(1).select("component", "weight", "nodes")


# Contexts for a model


_ESC = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_CENTS = "CASE WHEN {x} >= 0.995 THEN '1.00' ELSE '0.' || lpad(greatest(floor({x} * 100 + 0.5), 0)::BIGINT::VARCHAR, 2, '0') END"
_SHORT = "CASE WHEN length({x}) <= 160 THEN {x} ELSE substr({x}, 1, 157) || '...' END"
_CONTEXT = f"""WITH {BATCH}, top AS (SELECT * FROM (SELECT qid, vec_id AS id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank FROM j) WHERE rank <= 5),
near AS (SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY strength DESC, dst) AS near FROM (SELECT src, dst, strength, row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst) AS k FROM (SELECT src, dst, max(strength) AS strength FROM edges GROUP BY 1, 2)) WHERE k <= 3 GROUP BY 1),
hint AS (SELECT pattern_id AS id, event_type AS decision, n / t::DOUBLE AS confidence FROM (SELECT pattern_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY pattern_id) AS t, row_number() OVER (PARTITION BY pattern_id ORDER BY count(*) DESC, event_type) AS k FROM outcomes GROUP BY 1, 2) WHERE k = 1),
p AS (SELECT qid, rank, sim, p.*, near, decision, h.confidence AS sure FROM top JOIN patterns p ON top.id = p.id LEFT JOIN near n ON n.id = p.id LEFT JOIN hint h ON h.id = p.id)"""


def _context(t):
    """The five patterns nearest to each query, with neighbours in the graph and what was mostly decided with them."""
    top = R.nearest_each(t.vectors, _queries(t), 5).select("qid", F.col("vec_id").alias("id"), "sim", "rank")
    links = t.edges.groupBy("src", "dst").agg(F.max("strength").alias("strength"))
    strong = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("strength"), "dst"))
    near = links.withColumn("k", strong).where("k <= 3").groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "dst"))), lambda e: e["dst"].cast("string")), ",").alias("near"))
    n = t.outcomes.groupBy("pattern_id", "event_type").agg(F.count("*").alias("n"))
    hint = n.groupBy(F.col("pattern_id").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("b"), F.sum("n").alias("t")).select("id", F.col("b.event_type").alias("decision"), (-F.col("b.m") / F.col("t")).alias("sure"))
    return top.join(t.patterns, "id").join(near, "id", "left").join(hint, "id", "left")


def _escaped(x):
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _cents(x):
    return F.when(x >= 0.995, "1.00").otherwise(F.concat(F.lit("0."), F.lpad(F.greatest(F.floor(x * 100 + 0.5), F.lit(0)).cast("string"), 2, "0")))


def _short(x):
    return F.when(F.length(x) <= 160, x).otherwise(F.concat(F.substring(x, 1, 157), F.lit("...")))


def _listed(line, keep=None):
    """Lines of a query's patterns by rank, joined; those that do not hold are left out."""
    row = F.struct("rank", line.alias("line"))
    rows = F.array_sort(F.collect_list(row if keep is None else F.when(keep, row)))
    return F.array_join(F.transform(rows, lambda e: e["line"]), "")


@query(
    "context_xml",
    f"""{_CONTEXT} SELECT qid, '<learned_context><confidence>' || {_CENTS.format(x='avg(sim)')} || '</confidence><patterns>' || coalesce(string_agg('<pattern><similarity>' || {_CENTS.format(x='sim')} || '</similarity><reward>' || {_CENTS.format(x='reward')} || '</reward><problem>' || {_ESC.format(x=_SHORT.format(x='problem'))} || '</problem><solution>' || {_ESC.format(x=_SHORT.format(x='solution'))} || '</solution>' || coalesce('<related>' || near || '</related>', '') || '</pattern>', '' ORDER BY rank) FILTER (WHERE success), '') || '</patterns><reasoning_hints>'
 || coalesce(string_agg('<hint><decision>' || decision || '</decision><confidence>' || {_CENTS.format(x='sure')} || '</confidence></hint>', '' ORDER BY rank) FILTER (WHERE decision IS NOT NULL), '') || '</reasoning_hints><avoid>' || coalesce(string_agg('<failed_approach><problem>' || {_ESC.format(x=_SHORT.format(x='problem'))} || '</problem></failed_approach>', '' ORDER BY rank) FILTER (WHERE NOT success), '') || '</avoid></learned_context>' AS context FROM p GROUP BY 1""",
)
def context_xml(t):
    """What is known for a query as XML: patterns that worked with their neighbours, decisions taken with them, and approaches that failed."""
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    pattern = tag("pattern", F.concat(tag("similarity", _cents(F.col("sim"))), tag("reward", _cents(F.col("reward"))), tag("problem", _escaped(_short(F.col("problem")))), tag("solution", _escaped(_short(F.col("solution")))), F.coalesce(tag("related", F.col("near")), F.lit(""))))
    hint = tag("hint", F.concat(tag("decision", F.col("decision")), tag("confidence", _cents(F.col("sure")))))
    failed = tag("failed_approach", tag("problem", _escaped(_short(F.col("problem")))))
    g = _context(t).groupBy("qid").agg(F.avg("sim").alias("s"), _listed(pattern, F.col("success")).alias("p"), _listed(hint, F.col("decision").isNotNull()).alias("h"), _listed(failed, ~F.col("success")).alias("f"))
    return g.select("qid", tag("learned_context", F.concat(tag("confidence", _cents(F.col("s"))), tag("patterns", F.col("p")), tag("reasoning_hints", F.col("h")), tag("avoid", F.col("f")))).alias("context"))


@query(
    "context_few_shot",
    f"""{_CONTEXT}, l AS (SELECT *, '### ' || {_SHORT.format(x='problem')} || chr(10) || {_SHORT.format(x='solution')} || chr(10) AS line FROM p WHERE success), u AS (SELECT *, sum(ceil(length(line) / 4.0)) OVER (PARTITION BY qid ORDER BY rank) AS used FROM l)
SELECT qid, string_agg(line, '' ORDER BY rank) AS context, max(used)::BIGINT AS tokens FROM u WHERE used <= 150 GROUP BY 1""",
)
def context_few_shot(t):
    """What worked for a query as examples, the nearest first, as long as they fit 150 tokens of four characters."""
    line = F.concat(F.lit("### "), _short(F.col("problem")), F.lit("\n"), _short(F.col("solution")), F.lit("\n"))
    u = _context(t).where("success").withColumn("line", line)
    u = u.withColumn("used", F.sum(F.ceil(F.length("line") / 4.0)).over(Window.partitionBy("qid").orderBy("rank"))).where("used <= 150")
    return u.groupBy("qid").agg(_listed(F.col("line")).alias("context"), F.max("used").cast("long").alias("tokens"))
