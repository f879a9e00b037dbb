"""Queries for personal data with places, statements, plans, dead letters, hyperbolic means, views and table functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import personal as P
from ..functions import scoring as S
from ..functions import statements as W
from ..functions import text as T
from ..functions import vectors as V
from ..operators import fulltext as X
from ..operators import graph as G
from ..operators import planning as L
from ..operators import retrieval as R
from ..operators import sequences as Q
from ..operators import setjoin as J
from ..sources.scratch import dropped, written
from .registry import query

c = F.col


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


# Personal data


def _one_kind(k: int) -> str:
    kind, cls, confidence, pattern = P.KINDS[k]
    real = {"IPV4": f"h[i] NOT IN ({', '.join(map(_q, P.HARMLESS['IPV4']))})", "SSN": f"h[i] NOT IN ({', '.join(map(_q, P.HARMLESS['SSN']))})", "CREDIT_CARD": f"NOT starts_with(replace(replace(h[i], '-', ''), ' ', ''), '{P.TEST_CARD}')"}.get(kind, "TRUE")
    return f"""SELECT doc_id, {k} AS rank, '{kind}' AS kind, {cls}::BIGINT AS class, {confidence}::DOUBLE AS confidence, h[i] AS hit,
  (list_sum(list_transform(p[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: strlen(x))), 0))::BIGINT AS start
FROM (SELECT doc_id, regexp_split_to_array(text, {_q(pattern)}) AS p, regexp_extract_all(text, {_q(pattern)}) AS h FROM documents), unnest(range(1, len(h) + 1)) AS u(i) WHERE {real}"""


FOUND = "f AS (SELECT *, start + strlen(hit) AS stop FROM (" + " UNION ALL ".join(_one_kind(k) for k in range(len(P.KINDS))) + "))"


@query("pii_matches", f"WITH {FOUND} SELECT doc_id, kind, class, start, stop::BIGINT AS stop, confidence FROM f")
def pii_matches(t):
    m = t.documents.select("doc_id", F.explode(P.matches(c("text"))).alias("m"))
    return m.select("doc_id", "m.kind", "m.class", c("m.from").alias("start"), c("m.upto").alias("stop"), "m.confidence")


MEETS = "b[1].start < {e}.stop AND b[1].stop > {e}.start"
SPANS = f"""{FOUND}, o AS (SELECT doc_id, list({{'start': start, 'stop': stop, 'class': class, 'kind': kind, 'confidence': confidence, 'hit': hit}} ORDER BY start, rank) AS m FROM f GROUP BY 1),
k AS (SELECT doc_id, list_reduce(list_transform(m, lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda e: {MEETS.format(e='e')})) = 0 THEN list_concat(a, b)
  ELSE list_transform(a, lambda e, i: CASE WHEN i = list_position(list_transform(a, lambda g: {MEETS.format(e='g')}), TRUE) AND b[1].class > e.class THEN b[1] ELSE e END) END) AS s FROM o)"""


@query("pii_spans", f"WITH {SPANS} SELECT doc_id, x.kind, x.class, x.start, x.stop::BIGINT AS stop, x.confidence, CASE WHEN strlen(x.hit) <= 4 THEN repeat('*', strlen(x.hit)) ELSE substr(x.hit, 1, 2) || repeat('*', strlen(x.hit) - 4) || right(x.hit, 2) END AS shown FROM (SELECT doc_id, unnest(s) AS x FROM k)")
def pii_spans(t):
    m = t.documents.select("doc_id", F.explode(P.spans(c("text"))).alias("m"))
    return m.select("doc_id", "m.kind", "m.class", c("m.from").alias("start"), c("m.upto").alias("stop"), "m.confidence", P.shown(c("m.text")).alias("shown"))


@query("pii_counts", f"WITH {SPANS} SELECT x.kind, count(*) AS n, count(DISTINCT doc_id) AS docs, max(x.class) AS class FROM (SELECT doc_id, unnest(s) AS x FROM k) GROUP BY 1")
def pii_counts(t):
    m = t.documents.select("doc_id", F.explode(P.spans(c("text"))).alias("m"))
    return m.groupBy("m.kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.max("m.class").alias("class"))


# Statements


@query("goal_conditions", "SELECT conv_id, turn, CASE WHEN len(x) = 0 THEN 'has_research_results,pattern_stored' ELSE array_to_string(x, ',') END AS conditions, p::BIGINT AS priority, d AS domain FROM (SELECT conv_id, turn, list_filter([" + ", ".join(f"CASE WHEN {_any('lower(text)', words)} THEN '{name}' END" for name, words in W.GOALS) + "], lambda y: y IS NOT NULL) AS x, CASE " + " ".join(f"WHEN {_any('lower(text)', words)} THEN {p}" for p, words in W.URGENCY) + " ELSE 5 END AS p, CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{d}'" for w, d in W.GOAL_DOMAINS) + " END AS d FROM conversations)")
def goal_conditions(t):
    x = c("text")
    return t.conversations.select("conv_id", "turn", F.array_join(W.goal_conditions(x), ",").alias("conditions"), W.goal_priority(x).alias("priority"), W.goal_domain(x).alias("domain"))


TRIM = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


@query("beliefs", f"SELECT id, 0::BIGINT AS n, md5(problem) AS statement, 0.7::DOUBLE AS confidence FROM patterns UNION ALL SELECT id, i::BIGINT, md5(trim(s[i], {TRIM})), 0.8::DOUBLE FROM (SELECT id, string_split(solution, '.') AS s FROM patterns), unnest(range(1, least(len(s), 5) + 1)) AS u(i) WHERE strlen(trim(s[i], {TRIM})) > 10")
def beliefs(t):
    b = t.patterns.select("id", F.explode(W.beliefs(c("problem"), c("solution"))).alias("b"))
    return b.select("id", "b.n", F.md5("b.statement").alias("statement"), "b.confidence")


WORDS = r"list_filter(regexp_split_to_array(trim(lower({x}), " + TRIM + r"), '[ \t\n\r\x0b\x0c]+'), lambda w: strlen(w) > 3 AND NOT list_contains(" + _list(W.NO_SUBJECT) + ", w))"


@query("subject_words", f"SELECT item_id, array_to_string(list_sort(list_distinct({WORDS.format(x='text')})), ' ') AS subjects FROM benchmark")
def subject_words(t):
    return t.benchmark.select("item_id", F.array_join(F.array_sort(W.subjects(c("text"))), " ").alias("subjects"))


def _pairs(t):
    """Advice of a pattern and of those made from it, in one language: to use what succeeded, to avoid what failed."""
    advice = F.concat(F.when(c("success"), "use ").otherwise("avoid "), "solution")
    x = t.patterns.select("id", "parent_id", T.domain_root(c("domain")).alias("root"), advice.alias("s"))
    a, b = x.alias("a"), x.alias("b")
    j = a.join(b, (c("a.id") == c("b.parent_id")) & (c("a.root") == c("b.root")))
    sim = T.jaccard(T.tokens(c("a.s")), T.tokens(c("b.s")))
    return j.select(c("a.id").alias("a"), c("b.id").alias("b"), c("a.s").alias("x"), c("b.s").alias("y"), sim.alias("sim"))


TOK = "list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}'']+'))"
OPPOSED = "(" + " OR ".join(f"(contains(lower(x), {_q(p)}) AND contains(lower(y), {_q(n)})) OR (contains(lower(x), {_q(n)}) AND contains(lower(y), {_q(p)}))" for p, n in W.OPPOSED) + ")"
PAIRS = f"""s0 AS (SELECT id, parent_id, domain, CASE WHEN success THEN 'use ' ELSE 'avoid ' END || solution AS solution FROM patterns),
d AS (SELECT a.id AS a, b.id AS b, a.solution AS x, b.solution AS y, {TOK.format(x='a.solution')} AS tx, {TOK.format(x='b.solution')} AS ty FROM s0 a JOIN s0 b ON a.id = b.parent_id AND split_part(a.domain, '.', 1) = split_part(b.domain, '.', 1)),
e AS (SELECT *, CASE WHEN len(list_distinct(list_concat(tx, ty))) = 0 THEN 0 ELSE len(list_intersect(tx, ty)) / len(list_distinct(list_concat(tx, ty)))::DOUBLE END AS sim, {WORDS.format(x='x')} AS sx, {WORDS.format(x='y')} AS sy FROM d),
g AS (SELECT a, b, sim, CASE WHEN {OPPOSED} THEN CASE WHEN sim > 0.7 THEN 'major' WHEN sim > 0.5 THEN 'moderate' ELSE 'minor' END
  WHEN sim > 0.6 AND sim < 0.95 AND {_any('lower(x)', W.RECOMMENDS)} AND {_any('lower(y)', W.RECOMMENDS)} AND len(sx) > 0 AND len(sy) > 0 AND len(list_intersect(sx, sy)) = 0 THEN 'minor' END AS severity FROM e)"""


@query("belief_conflicts", f"WITH {PAIRS} SELECT a, b, severity, round(sim, 6) AS similarity FROM g WHERE severity IS NOT NULL")
def belief_conflicts(t):
    p = _pairs(t).withColumn("severity", W.conflict(c("x"), c("y"), c("sim")))
    return p.where("severity IS NOT NULL").select("a", "b", "severity", F.round("sim", 6).alias("similarity"))


ALIKE = f"t0 AS (SELECT id, domain, {TOK.format(x='solution')} AS t FROM patterns), c0 AS (SELECT a.id AS a, b.id AS b FROM patterns a JOIN patterns b ON a.id = b.parent_id AND split_part(a.domain, '.', 1) = split_part(b.domain, '.', 1) UNION SELECT a.id, b.id FROM t0 a JOIN t0 b ON a.domain = b.domain AND a.id < b.id AND len(list_intersect(a.t, b.t)) >= 0.3 * len(list_distinct(list_concat(a.t, b.t))) AND len(a.t) > 0)"
GATE = PAIRS.replace("FROM s0 a JOIN s0 b ON a.id = b.parent_id AND split_part(a.domain, '.', 1) = split_part(b.domain, '.', 1))", "FROM c0 JOIN s0 a ON a.id = c0.a JOIN s0 b ON b.id = c0.b)")


def _read_advice(pairs, advice):
    """(a, b, sim, severity) of pairs (a, b) from their texts."""
    one = lambda k, name: advice.select(c("id").alias(k), c("s").alias(name))
    p = pairs.join(one("a", "x"), "a").join(one("b", "y"), "b").withColumn("sim", T.jaccard(T.tokens(c("x")), T.tokens(c("y"))))
    return p.select("a", "b", "sim", W.conflict(c("x"), c("y"), c("sim")).alias("severity"))


def _alike_advice(alike, advice):
    """(a, b, sim, severity) of pairs (a, b, similarity of solutions): texts are read once for their traits and meet only where these leave a pair open."""
    ids = written(alike.select(c("a").alias("id")).unionByName(alike.select(c("b").alias("id"))).distinct(), "ids")
    x = T.tokens(c("solution"))
    # What the word before it adds to a solution's words.
    word = F.when(c("success"), "use").otherwise("avoid")
    of = advice.join(ids, "id", "left_semi").withColumn("x", x).select("id", F.size("x").alias("n"), "success", F.array_contains("x", "use").alias("use"), F.array_contains("x", "avoid").alias("avoid"), F.array_contains("x", word).alias("own"), W.traits(c("s")).alias("traits"))
    of = written(of, "traits")
    side = lambda k: of.select(c("id").alias(k), F.struct(*[m for m in of.columns if m != "id"]).alias(f"of_{k}"))
    p = alike.join(side("a"), "a").join(side("b"), "b")
    u, v = c("of_a"), c("of_b")
    both = F.round(c("similarity") * (u["n"] + v["n"]) / (1 + c("similarity"))).cast("int")
    has = lambda other, own: F.when(own["success"], other["use"]).otherwise(other["avoid"])
    more = F.when(u["success"] == v["success"], (~(u["own"] & v["own"])).cast("int")).otherwise((has(v, u) & ~u["own"]).cast("int") + (has(u, v) & ~v["own"]).cast("int"))
    p = p.withColumn("both", both + more).withColumn("all", u["n"] + v["n"] + (~u["own"]).cast("int") + (~v["own"]).cast("int") - c("both"))
    p = p.withColumn("sim", c("both") / c("all").cast("double"))
    severity, left = W.conflict_by_traits(u["traits"], v["traits"], c("sim"))
    p = written(p.select("a", "b", "sim", severity.alias("severity"), left.alias("left")), "advice")
    left = written(p.where("left").select("a", "b"), "left")
    return p.where("NOT left").select("a", "b", "sim", "severity").unionByName(_read_advice(left, advice))


@query(
    "write_gate",
    f"""WITH {ALIKE}, {GATE}, n AS (SELECT *, row_number() OVER (PARTITION BY b, severity IS NULL ORDER BY a) AS k FROM g),
w AS (SELECT b AS id, count(1) FILTER (WHERE severity IS NOT NULL AND k <= 10) AS conflicts, count(1) FILTER (WHERE severity = 'major' AND k <= 10) AS major, coalesce(sum(CASE severity WHEN 'major' THEN 0.5::DOUBLE WHEN 'moderate' THEN 0.25::DOUBLE WHEN 'minor' THEN 0.1::DOUBLE END) FILTER (WHERE k <= 10), 0) AS penalty, count(1) FILTER (WHERE severity IS NULL AND sim > 0.2) AS supports FROM n GROUP BY 1),
z AS (SELECT p.id, coalesce(conflicts, 0) AS conflicts, coalesce(major, 0) AS major, coalesce(supports, 0) AS supports, greatest(0, least(1, (1 - least(coalesce(penalty, 0), 1)) * (1 + least(coalesce(supports, 0) * 0.1::DOUBLE, 0.3::DOUBLE)))) AS energy FROM patterns p LEFT JOIN w ON p.id = w.id)
SELECT id, conflicts, supports, round(energy, 6) AS energy, CASE WHEN conflicts = 0 THEN 'accept' WHEN major > 0 THEN 'reject' WHEN conflicts > 3 THEN 'review' WHEN energy >= 0.7 THEN 'warn' ELSE 'review' END AS action FROM z""",
)
def write_gate(t):
    """Every pattern against those before it that it may contradict: its parent's advice, and advice of its domain alike by 0.3. At most ten conflicts count."""
    sets, member = J.classes(t.patterns.select("id", "domain", T.tokens(c("solution")).alias("x")), "domain")
    alike = written(J.expanded(J.similar_classes(sets, 0.3), member), "alike")
    dropped(sets, member)
    advice = t.patterns.select("id", "parent_id", T.domain_root(c("domain")).alias("root"), "success", "solution", F.concat(F.when(c("success"), "use ").otherwise("avoid "), "solution").alias("s"))
    # Rows that share an id are pairs of their own each; all others have the text that their id says.
    twice = written(advice.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "twice")
    known = advice.join(twice, "id", "left_anti")
    # A parent and its children meet at its id: a text is dealt once as a parent's and once as a child's.
    child = known.select(c("parent_id").alias("a"), "root", c("id").alias("b"), c("s").alias("y"))
    kin = known.select(c("id").alias("a"), "root", c("s").alias("x")).join(child, ["a", "root"])
    kin = kin.withColumn("sim", T.jaccard(T.tokens(c("x")), T.tokens(c("y")))).select("a", "b", "sim", W.conflict(c("x"), c("y"), c("sim")).alias("severity"))
    all_kin = advice.select(c("id").alias("a"), "root").join(advice.select(c("parent_id").alias("a"), "root", c("id").alias("b")), ["a", "root"]).select("a", "b")
    shared = lambda pairs: pairs.join(twice.withColumnRenamed("id", "a"), "a", "left_semi").select("a", "b").unionByName(pairs.join(twice.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
    p = _alike_advice(alike, known).unionByName(kin).dropDuplicates(["a", "b"])
    p = p.unionByName(_read_advice(shared(alike).unionByName(shared(all_kin)).distinct(), advice))
    p = p.select("b", "severity", "sim", F.row_number().over(Window.partitionBy("b", c("severity").isNull()).orderBy("a")).alias("k"))
    counts = c("severity").isNotNull() & (c("k") <= 10)
    cost = F.when(c("severity") == "major", 0.5).when(c("severity") == "moderate", 0.25).otherwise(0.1)
    g = p.groupBy(c("b").alias("id")).agg(F.count_if(counts).alias("conflicts"), F.count_if(counts & (c("severity") == "major")).alias("major"), F.sum(F.when(counts, cost).otherwise(0.0)).alias("penalty"), F.count_if(c("severity").isNull() & (c("sim") > 0.2)).alias("supports"))
    j = t.patterns.select("id").join(g, "id", "left").fillna(0)
    e = S.coherence_energy(c("penalty"), c("supports"))
    return j.select("id", "conflicts", "supports", F.round(e, 6).alias("energy"), S.coherence_action(c("conflicts"), c("major"), e).alias("action"))


RELATIONS = f"""{PAIRS}, r AS (SELECT a AS src, b AS dst, 'contradicts' AS relation FROM g WHERE severity IS NOT NULL UNION ALL SELECT b, a, 'supports' FROM g WHERE severity IS NULL AND sim > 0.2
  UNION ALL SELECT id, parent_id, 'depends' FROM patterns WHERE parent_id IS NOT NULL UNION ALL SELECT a.id, a.parent_id, 'refines' FROM patterns a JOIN patterns b ON a.parent_id = b.id AND a.domain = b.domain AND a.id <> b.id)"""


def _relations(t):
    p = _pairs(t).withColumn("severity", W.conflict(c("x"), c("y"), c("sim")))
    wrong = p.where("severity IS NOT NULL").select(c("a").alias("src"), c("b").alias("dst"), F.lit("contradicts").alias("relation"))
    right = p.where("severity IS NULL AND sim > 0.2").select(c("b").alias("src"), c("a").alias("dst"), F.lit("supports").alias("relation"))
    k = t.patterns.select("id", "parent_id", "domain")
    needs = k.where("parent_id IS NOT NULL").select(c("id").alias("src"), c("parent_id").alias("dst"), F.lit("depends").alias("relation"))
    up = k.select(c("id").alias("up"), c("domain").alias("of"))
    finer = k.join(up, (c("parent_id") == c("up")) & (c("domain") == c("of")) & (c("id") != c("up"))).select(c("id").alias("src"), c("parent_id").alias("dst"), F.lit("refines").alias("relation"))
    return wrong.unionByName(right).unionByName(needs).unionByName(finer)


@query("belief_relations", f"WITH {RELATIONS} SELECT src, dst, relation FROM r")
def belief_relations(t):
    return _relations(t)


@query("belief_standing", f"WITH {RELATIONS}, s AS (SELECT dst AS id, 1 AS s, 0 AS k FROM r WHERE relation = 'supports' UNION ALL SELECT dst, 0, 1 FROM r WHERE relation = 'contradicts' UNION ALL SELECT src, 0, 1 FROM r WHERE relation = 'contradicts') SELECT id, sum(s)::BIGINT AS supporting, sum(k)::BIGINT AS contradicting FROM s GROUP BY 1")
def belief_standing(t):
    """Supports count where they point, contradictions either way."""
    r = _relations(t)
    s = r.where("relation = 'supports'").select(c("dst").alias("id"), F.lit(1).alias("s"), F.lit(0).alias("k"))
    k = r.where("relation = 'contradicts'").select(F.explode(F.array("src", "dst")).alias("id"), F.lit(0).alias("s"), F.lit(1).alias("k"))
    return s.unionByName(k).groupBy("id").agg(F.sum("s").alias("supporting"), F.sum("k").alias("contradicting"))


FEATURES = r"""SELECT conv_id, turn, least(ln(length(text) + 1.0::DOUBLE) / ln(2001.0::DOUBLE), 1) AS l,
  1 - exp(-(0.8::DOUBLE * b + 0.3 * least(greatest(tick - 6.0 * b, 0) / 2, 3) + 0.25 * syn + 0.25 * greatest(q - 1, 0) + 0.2 * greatest(s - 1, 0) + 0.3 * li + 0.3 * jo)) AS st, demand,
  CASE WHEN len(w) = 0 THEN 0.5 ELSE least(least(list_sum(list_transform(w, lambda x: strlen(x))) / len(w)::DOUBLE / 10.0, 1) * 0.5 + CASE WHEN code THEN 0.3 ELSE 0 END + 0.2, 1) END AS dom
FROM (SELECT conv_id, turn, text, floor(len(regexp_extract_all(text, '```')) / 2) AS b, len(regexp_extract_all(text, '`'))::DOUBLE AS tick, len(regexp_extract_all(text, '\?')) AS q,
  len(list_filter(regexp_split_to_array(text, '[.?!;\n]'), lambda x: len(regexp_extract_all(x, '[^ \t\n\r\x0b\x0c]+')) >= 3)) AS s,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \t\r\x0b\x0c]*(- |\* )') OR (regexp_matches(x, '^[ \t\r\x0b\x0c]*[0-9]') AND contains(x, '. ')))) AS li,
  """ + " + ".join(f"contains(text, '{w}')::INT" for w in W.SYNTAX) + " AS syn, " + " + ".join(f"contains(lower(text), '{w}')::INT" for w in W.JOINING) + " AS jo, " + _any("text", ("::", "->", "()")) + r""" AS code,
  list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS w, 1 - exp(-0.45::DOUBLE * (""" + " + ".join(f"contains(' ' || lower(text) || ' ', '{w}')::INT" for w in T.CUES) + ")) AS demand FROM conversations)"


@query("complexity_features", f"WITH f AS ({FEATURES}) SELECT conv_id, turn, round(l, 6) AS length, round(demand, 6) AS reasoning, round(st, 6) AS structure, round(dom, 6) AS specificity, CASE WHEN sc < 0.3 THEN 'low' WHEN sc < 0.5 THEN 'medium' WHEN sc < 0.7 THEN 'high' ELSE 'very_high' END AS level FROM (SELECT *, round(greatest(0, least(1, l * 0.15 + demand * 0.15 + dom * 0.25 + st * 0.25 + 0.5 * 0.2)), 9) AS sc FROM f)")
def complexity_features(t):
    """All features of a question and its level; without a history the accuracy counts as one half."""
    x = c("text")
    f = t.conversations.select("conv_id", "turn", W.length_feature(x).alias("l"), T.reasoning_demand(x).alias("r"), W.structure_feature(x).alias("s"), W.specificity_feature(x).alias("d"))
    level = T.complexity_level(F.round(W.complexity(c("l"), c("r"), c("d"), c("s"), F.lit(0.5)), 9))
    return f.select("conv_id", "turn", F.round("l", 6).alias("length"), F.round("r", 6).alias("reasoning"), F.round("s", 6).alias("structure"), F.round("d", 6).alias("specificity"), level.alias("level"))


# Graphs, plans, chains


@query("undirected_distances", "WITH RECURSIVE u AS (SELECT src AS a, dst AS b FROM edges WHERE kind <> 'refines' UNION SELECT dst, src FROM edges WHERE kind <> 'refines'), r(node, hops) AS (SELECT 5::BIGINT, 0 UNION SELECT u.b, hops + 1 FROM r JOIN u ON u.a = r.node WHERE hops < 3) SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY 1")
def undirected_distances(t):
    """Shortest distances over edges either way, short cuts left out."""
    return G.undirected_distance(t.edges, 5, 3, "refines")


@query("workflow_validity", "WITH RECURSIVE d AS (SELECT DISTINCT kind, src, dst FROM edges), i AS (SELECT d.* FROM d JOIN (SELECT DISTINCT kind, src AS n FROM d) x ON d.kind = x.kind AND d.dst = x.n), r(kind, a, b) AS (SELECT kind, src, dst FROM i UNION SELECT r.kind, r.a, i.dst FROM r JOIN i ON i.kind = r.kind AND i.src = r.b) SELECT k.kind, k.n, coalesce(x.cyclic, FALSE) AS cyclic FROM (SELECT kind, count(*) AS n FROM d GROUP BY 1) k LEFT JOIN (SELECT DISTINCT kind, TRUE AS cyclic FROM r WHERE a = b) x ON x.kind = k.kind")
def workflow_validity(t):
    """Edges of each kind as dependencies: whether any order can satisfy them."""
    d = t.edges.select(c("kind").alias("group"), c("src").alias("id"), c("dst").alias("needs")).distinct()
    bad = G.cyclic(d).select("group").distinct().withColumn("bad", F.lit(True))
    return d.groupBy("group").agg(F.count("*").alias("n")).join(bad, "group", "left").select(c("group").alias("kind"), "n", F.coalesce("bad", F.lit(False)).alias("cyclic"))


# Facts are the kinds of items, in the order of their names. An item adds its kind, a large one the next kind too, to what has the kind before.
_ACTIONS = """k AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS b, count(*) OVER () AS m FROM (SELECT DISTINCT kind FROM items WHERE kind IS NOT NULL)),
i AS (SELECT item_id, price, CASE WHEN b = 0 THEN 0 ELSE 1 << (b - 1) END::BIGINT AS needs, ((1 << b) | CASE WHEN size > 40 THEN 1 << ((b + 1) % m) ELSE 0 END)::BIGINT AS adds, (1 << m) - 1 AS goal FROM items JOIN k USING (kind) WHERE price IS NOT NULL AND item_id IS NOT NULL AND size IS NOT NULL AND m < 12),
a AS (SELECT needs, adds, min(price) AS cost, arg_min(item_id::VARCHAR, {'p': price, 'n': item_id::VARCHAR}) AS name, any_value(goal) AS goal FROM i GROUP BY 1, 2)"""


@query(
    "action_plan",
    f"WITH RECURSIVE {_ACTIONS}, r(state, cost, plan, n) AS (SELECT 0::BIGINT, 0.0::DOUBLE, '', 0 UNION SELECT r.state | a.adds, r.cost + a.cost, CASE WHEN plan = '' THEN name ELSE plan || '>' || name END, n + 1 FROM r JOIN a ON (r.state & a.needs) = a.needs AND (r.state | a.adds) <> r.state WHERE n < 8) SELECT plan, round(cost, 6) AS cost FROM r WHERE state = (SELECT max(goal) FROM a) ORDER BY r.cost, plan LIMIT 1",
)
def action_plan(t):
    """The cheapest sequence of items that has every kind, found by search over sets of kinds; of items that do the same the cheapest is an action."""
    some = t.items.where("price IS NOT NULL AND item_id IS NOT NULL AND size IS NOT NULL AND kind IS NOT NULL")
    kinds = sorted(r["kind"] for r in t.items.where("kind IS NOT NULL").select("kind").distinct().collect())  # a handful
    if len(kinds) >= 12:
        raise ValueError("too many kinds to plan over")
    b = F.array_position(F.array(*map(F.lit, kinds)), c("kind")) - 1
    bit = lambda k: F.pow(F.lit(2.0), k).cast("long")
    adds = bit(b).bitwiseOR(F.when(c("size") > 40, bit((b + 1) % len(kinds))).otherwise(F.lit(0).cast("long")))
    needs = F.when(b == 0, F.lit(0).cast("long")).otherwise(bit(b - 1))
    name = c("item_id").cast("string")
    best = some.groupBy(needs.alias("needs"), adds.alias("adds")).agg(F.min(F.struct(c("price").alias("cost"), name.alias("name"))).alias("x"))
    actions = best.select("x.name", "needs", "adds", F.lit(0).cast("long").alias("removes"), "x.cost")
    return L.planned(actions, 0, (1 << len(kinds)) - 1).select("plan", F.round("cost", 6).alias("cost"))


@query("dead_letter_replay", "SELECT status, count(*) AS n, sum(tries)::BIGINT AS tries FROM (SELECT event_id % 4 + 1 AS tries, CASE WHEN json_extract_string(props, '$.k')::BIGINT % 2 = 0 THEN 'succeeded' WHEN event_id % 4 + 1 < 3 THEN 'failed' ELSE 'abandoned' END AS status FROM events WHERE event_type = 'error' AND event_id % 4 < 3) GROUP BY 1")
def dead_letter_replay(t):
    """Failed writes tried again: payloads with an even k are accepted now."""
    e = t.events.where("event_type = 'error'").select(c("event_id").alias("id"), (c("event_id") % 4).alias("tries"), c("props").alias("payload"))
    works = F.get_json_object("payload", "$.k").cast("long") % 2 == 0
    return L.replayed_letters(e, works).groupBy("status").agg(F.count("*").alias("n"), F.sum("tries").alias("tries"))


CHAIN = """l AS (SELECT user_id, event_id, event_type || '|' || event_id AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r(user_id, event_id, k, prev, hash) AS (SELECT user_id, event_id, k, '', sha256('|' || body) FROM l WHERE k = 1 UNION ALL SELECT l.user_id, l.event_id, l.k, r.hash, sha256(r.hash || '|' || l.body) FROM r JOIN l ON l.user_id = r.user_id AND l.k = r.k + 1),
v AS (SELECT l.user_id, l.event_id, l.k, r.prev <> coalesce(lag(r.hash) OVER (PARTITION BY l.user_id ORDER BY l.k), '') OR r.hash <> sha256(r.prev || '|' || l.body || CASE WHEN length(l.body) % 7 = 3 AND l.event_id % 101 > 90 THEN '!' ELSE '' END) AS bad FROM l JOIN r ON l.user_id = r.user_id AND l.event_id = r.event_id)"""


def _log(t):
    """A chained log of each user's events in which some bodies were changed afterwards."""
    body = F.concat_ws("|", "event_type", c("event_id").cast("string"))
    log = Q.chained(t.events.select(c("user_id").alias("chain"), c("event_id").alias("seq"), body.alias("body")))
    changed = (F.length("body") % 7 == 3) & (c("seq") % 101 > 90)
    return log.withColumn("body", F.when(changed, F.concat("body", F.lit("!"))).otherwise(c("body")))


@query("hash_chain", f"WITH RECURSIVE {CHAIN} SELECT user_id AS chain, count(*) AS n, min(event_id) FILTER (WHERE bad) AS first_bad FROM v GROUP BY 1")
def hash_chain(t):
    """Each entry's hash covers its predecessor's: links and hashes are checked, and the first wrong entry named."""
    return Q.chain_breaks(_log(t))


@query("violations_view", f"WITH RECURSIVE {CHAIN} SELECT e.event_id, v.bad AS tampered FROM events e LEFT JOIN (SELECT event_id, bad FROM v WHERE bad) v USING (event_id) WHERE e.event_type = 'error'")
def violations_view(t):
    bad = Q.chain_checked(_log(t)).where("bad").select(c("seq").alias("event_id"), c("bad").alias("tampered"))
    return t.events.where("event_type = 'error'").select("event_id").join(bad, "event_id", "left")


@query("lineage_depths", "WITH RECURSIVE d(id, depth) AS (SELECT p.id, 0 FROM patterns p WHERE NOT EXISTS (SELECT 1 FROM patterns q WHERE q.id = p.parent_id) UNION ALL SELECT p.id, depth + 1 FROM patterns p JOIN d ON p.parent_id = d.id) SELECT depth::BIGINT AS depth, count(*) AS n FROM d GROUP BY 1")
def lineage_depths(t):
    return G.depths(t.patterns).groupBy("depth").agg(F.count("*").alias("n"))


@query("delta_log", "WITH x AS (SELECT user_id, event_id, event_type, json_extract_string(props, '$.k') AS k, row_number() OVER w AS seq, lag(event_type) OVER w AS t0, lag(json_extract_string(props, '$.k')) OVER w AS k0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, seq, CASE WHEN seq = 1 THEN 'create' ELSE 'update' END AS operation, CASE WHEN seq = 1 THEN 'event_type,k' ELSE array_to_string(list_filter([CASE WHEN event_type IS DISTINCT FROM t0 THEN 'event_type' END, CASE WHEN k IS DISTINCT FROM k0 THEN 'k' END], lambda y: y IS NOT NULL), ',') END AS fields, CASE WHEN seq = 1 OR seq % 10 = 0 THEN event_type || '/' || k END AS snapshot FROM x")
def delta_log(t):
    """A change log of each user's state: what an event changed, with a snapshot at the first and at every tenth change."""
    state = F.map_from_arrays(F.array(F.lit("event_type"), F.lit("k")), F.array("event_type", F.get_json_object("props", "$.k")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = t.events.select("event_id", F.row_number().over(w).cast("long").alias("seq"), state.alias("new"), F.lag(state).over(w).alias("old"))
    fields = F.when(c("seq") == 1, F.array_sort(F.map_keys("new"))).otherwise(F.transform(Q.changed_fields(c("old"), c("new")), lambda d: d["field"]))
    shot = F.when((c("seq") == 1) | (c("seq") % 10 == 0), F.concat_ws("/", c("new")["event_type"], c("new")["k"]))
    return x.select("event_id", "seq", F.when(c("seq") == 1, "create").otherwise("update").alias("operation"), F.array_join(fields, ",").alias("fields"), shot.alias("snapshot"))


@query("cone_nodes", "WITH RECURSIVE p(node, hops) AS (SELECT 9::BIGINT, 0 UNION SELECT e.src, hops + 1 FROM p JOIN edges e ON e.dst = p.node WHERE hops < 2 AND e.strength >= 0.5), f(node, hops) AS (SELECT 9::BIGINT, 0 UNION SELECT e.dst, hops + 1 FROM f JOIN edges e ON e.src = f.node WHERE hops < 2 AND e.strength >= 0.5) SELECT 'past' AS cone, node, min(hops)::BIGINT AS hops FROM p WHERE node <> 9 GROUP BY 2 UNION ALL SELECT 'future', node, min(hops)::BIGINT FROM f WHERE node <> 9 GROUP BY 2 UNION ALL SELECT 'core', 9, 0")
def cone_nodes(t):
    """What led to a node and what follows from it, with distances."""
    e = t.edges.where("strength >= 0.5").select("src", "dst")
    back = e.select(c("dst").alias("src"), c("src").alias("dst"))
    cone = lambda name, x: G.reachable(x, 9, 2).where("node <> 9").select(F.lit(name).alias("cone"), "node", "hops")
    core = t.spark.createDataFrame([("core", 9, 0)], "cone string, node long, hops long")
    return cone("past", back).unionByName(cone("future", e)).unionByName(core)


@query("future_clusters", "SELECT domain, floor(probability * 5)::BIGINT AS band, count(*) AS n, round(max(probability), 6) AS best, arg_max(id, {'a': probability, 'b': -id}) AS leader FROM predictions WHERE probability >= 0.5 GROUP BY 1, 2")
def future_clusters(t):
    p = t.predictions.where("probability >= 0.5")
    return p.groupBy("domain", F.floor(c("probability") * 5).alias("band")).agg(F.count("*").alias("n"), F.round(F.max("probability"), 6).alias("best"), F.max_by("id", F.struct("probability", -c("id"))).alias("leader"))


def _nation_edges(t):
    """Customers' nations against suppliers', by the region of the customer; weights as shares of the region's, times ten."""
    n = t.nation.select("n_nationkey", "n_regionkey")
    c1 = t.customer.join(n, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "c_nationkey", c("n_regionkey").cast("long").alias("region"))
    o = t.orders.select("o_orderkey", "o_custkey").join(c1, c("o_custkey") == c("c_custkey"))
    s = t.lineitem.select("l_orderkey", "l_suppkey").join(t.supplier.select("s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))
    e = s.join(o, c("l_orderkey") == c("o_orderkey")).groupBy("region", c("c_nationkey").cast("long").alias("src"), c("s_nationkey").cast("long").alias("dst")).agg(F.count("*").cast("double").alias("strength"))
    whole = e.groupBy("region").agg((F.sum("strength") / 10).alias("w"))
    return e.join(F.broadcast(whole), "region").select("region", "src", "dst", (c("strength") / c("w")).alias("strength"))


@query("region_clusters")
def region_clusters(t):
    """Nations bound by orders, split along least cuts as long as these are weak."""
    return L.clustered_by_cut(_nation_edges(t), "region", 0.4)


@query("min_cut_by_region")
def min_cut_by_region(t):
    """The least cut of each region's graph of nations."""
    return G.min_cut(_nation_edges(t), "region")


# Attention


@query("attention_update", "WITH a AS (SELECT id, reward * pow(0.95, updated_days % 20) AS x, archived, reuse_count FROM patterns), b AS (SELECT id, CASE WHEN reuse_count >= 100 THEN greatest(0, least(1, x * 1.5)) WHEN archived THEN x * (1 - 0.4) ELSE x END AS y FROM a) SELECT id, round(y, 6) AS attention FROM b WHERE y >= 0.05")
def attention_update(t):
    """Attention after days of decay; much used rows boosted and held at one, archived ones inhibited, weak ones gone."""
    x = S.attention_after(c("reward"), c("updated_days") % 20, 0.05)
    y = F.when(c("reuse_count") >= 100, S.boosted(x, 1.5)).when(c("archived"), S.inhibited(x, 0.4)).otherwise(x)
    return t.patterns.select("id", y.alias("y")).where("y >= 0.05").select("id", F.round("y", 6).alias("attention"))


@query("attention_spread", "WITH a AS (SELECT reward AS x FROM patterns WHERE reward >= 0.1 AND NOT archived), s AS (SELECT sum(x) AS total FROM a) SELECT count(*) AS n, round(sum(x), 6) AS total, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std, min(x) AS low, max(x) AS high, round(sum(-(x / total) * ln(x / total)), 6) AS entropy FROM a, s")
def attention_spread(t):
    a = t.patterns.where("reward >= 0.1 AND NOT archived").select(c("reward").alias("x"))
    # Entropy of the shares from sums: ln(total) - sum(x ln x) / total.
    total, logs = F.sum("x"), F.sum(c("x") * F.log("x"))
    return a.agg(F.count("*").alias("n"), F.round(total, 6).alias("total"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.median("x"), 6).alias("median"), F.round(F.stddev_pop("x"), 6).alias("std"), F.min("x").alias("low"), F.max("x").alias("high"), F.round(F.log(total) - logs / total, 6).alias("entropy"))


# Vectors


KNN = "q AS (SELECT v AS q FROM vectors WHERE vec_id = 0), k AS (SELECT vec_id, v, round(list_cosine_similarity(v, q), 6) AS sim FROM vectors, q)"


@query("knn_capped", f"WITH {KNN} SELECT vec_id, sim FROM k ORDER BY sim DESC, vec_id LIMIT 50")
def knn_capped(t):
    """Eighty are asked for; a search gives fifty at most."""
    return R.nearest(t.vectors, R.query_vector(t.vectors, 0), R.capped(80)).select("vec_id", "sim")


@query("nan_safe_top", "WITH x AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'NaN'::DOUBLE ELSE reward END AS score FROM patterns) SELECT id, score FROM x WHERE NOT isnan(score) ORDER BY score DESC, id LIMIT 12")
def nan_safe_top(t):
    """Scores that are no number never win."""
    x = t.patterns.select("id", F.when(c("id") % 9 == 0, F.lit(float("nan"))).otherwise(c("reward")).alias("score"))
    return R.top_scores(x, "score", "id", 12)


BALL = "b AS (SELECT vec_id, label, list_transform(v, lambda x: x * (tanh(0.5 * sqrt(list_dot_product(v, v))) * 0.99::DOUBLE / sqrt(list_dot_product(v, v)))) AS p FROM vectors)"


@query("tangent_transport", f"WITH {BALL} SELECT a.vec_id, round(sqrt(list_dot_product(b.p, b.p)) * (2 / (1 - list_dot_product(a.p, a.p))) / (2 / (1 - list_dot_product(b.p, b.p) * 0.25)), 6) AS norm FROM b a, b WHERE b.vec_id = 6")
def tangent_transport(t):
    """A tangent vector carried from each point to one half as far out as a fixed one."""
    b = t.vectors.select("vec_id", V.to_ball(c("v")).alias("p"))
    q = b.where("vec_id = 6").select(c("p").alias("q"))
    return b.join(F.broadcast(q)).select("vec_id", F.round(V.norm(V.transported(c("p"), V.scaled(c("q"), F.lit(0.5)), c("q"))), 6).alias("norm"))


@query("ball_midpoints", f"WITH {BALL}, g AS (SELECT label, p, 1 / sqrt(greatest(1 - list_dot_product(p, p), 1e-10)) AS w FROM b), m AS (SELECT label, i, sum(w * p[i]) / sum(w) AS x FROM g, unnest(range(1, len(p) + 1)) AS u(i) GROUP BY 1, 2) SELECT label, round(sqrt(sum(x * x)), 6) AS norm, round(min(x) FILTER (WHERE i = 1), 6) AS first FROM m GROUP BY 1")
def ball_midpoints(t):
    """The Einstein midpoint of each label's points: means weighted by the Lorentz factor, place by place."""
    b = t.vectors.select("label", V.to_ball(c("v")).alias("p"))
    x = b.select("label", V.lorentz(c("p")).alias("w"), F.posexplode("p").alias("i", "x")).groupBy("label", "i").agg((F.sum(c("w") * c("x")) / F.sum("w")).alias("m"))
    return x.groupBy("label").agg(F.round(F.sqrt(F.sum(c("m") * c("m"))), 6).alias("norm"), F.round(F.min_by("m", "i"), 6).alias("first"))


LOW_A = [[((i * 7 + k) % 5 - 2) / 10.0 for k in range(64)] for i in range(2)]
LOW_B = [[((i * 3 + k) % 7 - 3) / 10.0 for k in range(2)] for i in range(64)]


@query("low_rank_adapter", f"WITH a AS (SELECT vec_id, v, list_dot_product(v, {LOW_A[0]}::DOUBLE[]) AS h0, list_dot_product(v, {LOW_A[1]}::DOUBLE[]) AS h1 FROM vectors), y AS (SELECT vec_id, list_transform(v, lambda x, i: x + 0.5 * (h0 * ({[r[0] for r in LOW_B]}::DOUBLE[])[i] + h1 * ({[r[1] for r in LOW_B]}::DOUBLE[])[i])) AS y FROM a) SELECT vec_id, i::BIGINT AS i, round(y[i] / sqrt(list_dot_product(y, y)), 6) AS x FROM y, unnest(range(1, 65)) AS u(i)")
def low_rank_adapter(t):
    from ..functions.embed import low_rank

    y = t.vectors.select("vec_id", F.posexplode(low_rank(c("v"), LOW_A, LOW_B, 0.5)).alias("i", "x"))
    return y.select("vec_id", (c("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


# Search


MATCH_SQL = """w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM benchmark),
d AS (SELECT item_id, len(t) AS len, len(list_filter(t, lambda x: x = 'the')) AS tf0, len(list_filter(t, lambda x: starts_with(x, 'answ'))) AS tf1, list_contains(t, 'not') AS bad FROM w),
s AS (SELECT count(*) AS n, avg(len) AS avg, count(1) FILTER (WHERE tf0 > 0) AS df0, count(1) FILTER (WHERE tf1 > 0) AS df1 FROM d),
f AS (SELECT item_id, round(-(ln((n - df0 + 0.5::DOUBLE) / (df0 + 0.5::DOUBLE) + 1) * tf0 * 2.2::DOUBLE / (tf0 + (0.25::DOUBLE + len / avg * 0.75::DOUBLE) * 1.2::DOUBLE) + ln((n - df1 + 0.5::DOUBLE) / (df1 + 0.5::DOUBLE) + 1) * tf1 * 2.2::DOUBLE / (tf1 + (0.25::DOUBLE + len / avg * 0.75::DOUBLE) * 1.2::DOUBLE)), 6) AS rank FROM d, s WHERE (tf0 > 0 OR tf1 > 0) AND NOT bad)"""


@query("fts_match", f"WITH {MATCH_SQL} SELECT item_id, rank FROM f WHERE rank <= -0.01")
def fts_match(t):
    """A query with operators, a prefix and a column scope, down to a least rank."""
    return X.matched(t.benchmark, "item_id", "{text}: (the OR answ*) NOT not", ["text"], -0.01)


# Intervals and experiments


@query("wilson_levels", "WITH b AS (SELECT least(floor(probability * 10), 9)::BIGINT AS bucket, count(*)::DOUBLE AS n, count_if(outcome)::DOUBLE AS s FROM predictions WHERE status = 'resolved' GROUP BY 1 UNION ALL SELECT 10, 0, 0), z(level, z) AS (VALUES (0.9::DOUBLE, 1.645::DOUBLE), (0.95, 1.96), (0.99, 2.576)) SELECT bucket, level, round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, (s / n + z * z / (2 * n) - z * sqrt((s / n * (1 - s / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)) END, 6) AS low, round(CASE WHEN n = 0 THEN 1 ELSE least(1, (s / n + z * z / (2 * n) + z * sqrt((s / n * (1 - s / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)) END, 6) AS high FROM b, z")
def wilson_levels(t):
    done = t.predictions.where("status = 'resolved'")
    b = done.groupBy(F.least(F.floor(c("probability") * 10), F.lit(9)).alias("bucket")).agg(F.count("*").cast("double").alias("n"), F.count_if("outcome").cast("double").alias("s"))
    b = b.unionByName(t.spark.createDataFrame([(10, 0.0, 0.0)], "bucket long, n double, s double"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(z).alias("z")) for k, z in ((0.9, 1.645), (0.95, 1.96), (0.99, 2.576))]))
    x = b.select("*", levels.alias("l"))
    low, high = S.wilson_interval(c("s"), c("n"), c("l.z"))
    return x.select("bucket", "l.level", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("ab_buckets", "SELECT session_id, CASE WHEN (('0x' || substr(md5('exp1:' || session_id), 1, 12))::BIGINT % 1000) / 1000.0::DOUBLE < 0.2 THEN 'control' ELSE 'treatment' END AS variant FROM (SELECT DISTINCT session_id FROM outcomes)")
def ab_buckets(t):
    """Sessions in a thousand buckets by a hash, the first share held out."""
    s = t.outcomes.select("session_id").distinct()
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("exp1:"), "session_id")), 1, 12), 16, 10).cast("long") % 1000
    return s.select("session_id", F.when(bucket / 1000.0 < 0.2, "control").otherwise("treatment").alias("variant"))


@query("staged_promotions", "SELECT p.id, CASE WHEN p.tier IN ('reflex', 'crystal') THEN p.tier ELSE 'full' END AS stage, CASE WHEN p.tier IN ('reflex', 'crystal') THEN NULL WHEN p.reward >= 0.9 AND p.usage_count >= 20 THEN 'reflex' WHEN p.reward >= 0.7 AND p.usage_count >= 5 THEN 'crystal' END AS promoted FROM patterns p JOIN (SELECT DISTINCT domain, md5(problem) AS h FROM patterns WHERE id % 50 = 0) q ON md5(p.problem) = q.h AND p.domain = q.domain")
def staged_promotions(t):
    """Lookups by domain and problem: the stage that answers, and the stage that a row of the full search moves to."""
    asked = t.patterns.where("id % 50 = 0").select("domain", F.md5("problem").alias("h")).distinct()
    hit = t.patterns.withColumn("h", F.md5("problem")).join(asked, ["domain", "h"])
    held = c("tier").isin("reflex", "crystal")
    new = S.tier_by_score(c("reward"), c("usage_count"))
    return hit.select("id", F.when(held, c("tier")).otherwise("full").alias("stage"), F.when(~F.coalesce(held, F.lit(False)) & (new != "booster"), new).alias("promoted"))


@query("pull_pages", "WITH x AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS k, count(*) OVER () AS n FROM events WHERE ts > TIMESTAMP '2024-01-20') SELECT event_id, n > 520 AS has_more FROM x WHERE k >= 20 AND k < 520")
def pull_pages(t):
    """One page of changes since a time: at most 500 rows from an offset, and whether more follow."""
    from ..operators.scans import pulled

    return pulled(t.events.where("ts > TIMESTAMP_NTZ '2024-01-20'"), ["ts", "event_id"], 700, 20).select("event_id", "has_more")


@query("event_fanout", "SELECT h.name AS handler, count(*) AS n FROM events e JOIN (VALUES ('audit', ['error', 'signup']), ('metrics', ['click', 'view', 'purchase', 'signup', 'error']), ('sales', ['purchase'])) AS h(name, kinds) ON list_contains(h.kinds, e.event_type) GROUP BY 1")
def event_fanout(t):
    """Each event to every handler that asks for its type."""
    handlers = t.spark.createDataFrame([("audit", ["error", "signup"]), ("metrics", ["click", "view", "purchase", "signup", "error"]), ("sales", ["purchase"])], "name string, kinds array<string>")
    each = handlers.select(c("name").alias("handler"), F.explode("kinds").alias("event_type"))
    return t.events.join(F.broadcast(each), "event_type").groupBy("handler").agg(F.count("*").alias("n"))


# Views


@query("view_recent_activity", "SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def view_recent_activity(t):
    return _view(t, "v_recent_audit_activity").select("event_id", "event_type", "user_id")


VIEWS = {
    "v_recent_audit_activity": "SELECT event_id, ts, event_type, user_id, value FROM log ORDER BY ts DESC, event_id DESC LIMIT 100",
    "v_security_alerts": "SELECT event_id, ts, user_id, value AS severity FROM log WHERE event_type = 'error' AND value > 90",
    "v_failed_attempts": "SELECT event_id, ts, user_id, get_json_object(props, '$.k') AS reason FROM log WHERE event_type = 'error'",
    "v_rotations": "SELECT event_id, ts, user_id, get_json_object(props, '$.k') AS version FROM log WHERE event_type = 'signup'",
    "v_active_links": "SELECT src, dst, strength, age_days, CASE WHEN age_days > 0 THEN round((age_days - 1.0D) / age_days * 100, 1) END AS savings FROM links WHERE strength >= 0.3",
    "v_link_candidates": "SELECT a, b, n FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM links WHERE strength < 0.5 GROUP BY 1, 2) x WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM links l WHERE l.strength >= 0.5 AND least(l.src, l.dst) = x.a AND greatest(l.src, l.dst) = x.b)",
    "v_link_stats": "SELECT count_if(strength >= 0.3) AS active, count_if(strength < 0.3) AS inactive, round(avg(CASE WHEN strength >= 0.3 THEN strength END), 6) AS avg_strength FROM links",
    "v_experiment_summary": "SELECT variant, count(*) AS n, count(DISTINCT session_id) AS sessions, round(avg(value), 6) AS mean FROM measured GROUP BY variant",
    "v_variant_comparison": "SELECT event_type, round(avg(CASE WHEN variant = 'treatment' THEN value END) - avg(CASE WHEN variant = 'control' THEN value END), 6) AS difference FROM measured GROUP BY event_type",
    "v_hierarchy_tree": "SELECT id, domain, depth, CASE WHEN depth IS NULL THEN 'unclassified' WHEN depth < 0.2 THEN 'root' WHEN depth < 0.4 THEN 'high_level' WHEN depth < 0.6 THEN 'mid_level' WHEN depth < 0.8 THEN 'detailed' ELSE 'leaf' END AS tier FROM nodes",
}


def _view(t, name: str):
    """A view over the derived tables, by name."""
    t.events.createOrReplaceTempView("log")
    t.edges.createOrReplaceTempView("links")
    variant = F.when(F.conv(F.substring(F.md5(F.concat(F.lit("exp1:"), "session_id")), 1, 12), 16, 10).cast("long") % 1000 / 1000.0 < 0.2, "control").otherwise("treatment")
    t.outcomes.withColumn("variant", variant).createOrReplaceTempView("measured")
    t.patterns.select("id", "domain", F.when(~c("archived"), c("surprise")).alias("depth")).createOrReplaceTempView("nodes")
    t.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {VIEWS[name]}")
    return t.spark.table(name)


VARIANT = "CASE WHEN (('0x' || substr(md5('exp1:' || session_id), 1, 12))::BIGINT % 1000) / 1000.0::DOUBLE < 0.2 THEN 'control' ELSE 'treatment' END"


@query("view_security_alerts", "SELECT event_id, user_id, value AS severity FROM events WHERE event_type = 'error' AND value > 90")
def view_security_alerts(t):
    return _view(t, "v_security_alerts").select("event_id", "user_id", "severity")


@query("view_failed_attempts", "SELECT event_id, json_extract_string(props, '$.k') AS reason FROM events WHERE event_type = 'error'")
def view_failed_attempts(t):
    return _view(t, "v_failed_attempts").select("event_id", "reason")


@query("view_rotations", "SELECT event_id, json_extract_string(props, '$.k') AS version FROM events WHERE event_type = 'signup'")
def view_rotations(t):
    return _view(t, "v_rotations").select("event_id", "version")


@query("view_active_links", "SELECT src, dst, CASE WHEN age_days > 0 THEN round((age_days - 1.0::DOUBLE) / age_days * 100, 1) END AS savings FROM edges WHERE strength >= 0.3")
def view_active_links(t):
    return _view(t, "v_active_links").select("src", "dst", "savings")


@query("view_link_candidates", "SELECT a, b, n FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM edges WHERE strength < 0.5 GROUP BY 1, 2) x WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM edges l WHERE l.strength >= 0.5 AND least(l.src, l.dst) = x.a AND greatest(l.src, l.dst) = x.b)")
def view_link_candidates(t):
    return _view(t, "v_link_candidates")


@query("view_link_stats", "SELECT count_if(strength >= 0.3) AS active, count_if(strength < 0.3) AS inactive, round(avg(strength) FILTER (WHERE strength >= 0.3), 6) AS avg_strength FROM edges")
def view_link_stats(t):
    return _view(t, "v_link_stats")


@query("view_experiment_summary", f"SELECT {VARIANT} AS variant, count(*) AS n, count(DISTINCT session_id) AS sessions, round(avg(value), 6) AS mean FROM outcomes GROUP BY 1")
def view_experiment_summary(t):
    return _view(t, "v_experiment_summary")


@query("view_variant_comparison", f"WITH m AS (SELECT event_type, value, {VARIANT} AS variant FROM outcomes) SELECT event_type, round(avg(value) FILTER (WHERE variant = 'treatment') - avg(value) FILTER (WHERE variant = 'control'), 6) AS difference FROM m GROUP BY 1")
def view_variant_comparison(t):
    return _view(t, "v_variant_comparison")


@query("view_hierarchy_tree", "SELECT id, CASE WHEN archived THEN 'unclassified' WHEN surprise < 0.2 THEN 'root' WHEN surprise < 0.4 THEN 'high_level' WHEN surprise < 0.6 THEN 'mid_level' WHEN surprise < 0.8 THEN 'detailed' ELSE 'leaf' END AS tier FROM patterns")
def view_hierarchy_tree(t):
    return _view(t, "v_hierarchy_tree").select("id", "tier")


FUNCTIONS = """CREATE OR REPLACE TEMPORARY FUNCTION audit_statistics(low TIMESTAMP_NTZ, high TIMESTAMP_NTZ) RETURNS TABLE (event_type STRING, total BIGINT, good BIGINT, bad BIGINT, users BIGINT)
  RETURN SELECT event_type, count(*), count_if(outcome = 'success'), count_if(outcome = 'failure'), count(DISTINCT user_id) FROM outcome_log WHERE ts BETWEEN low AND high GROUP BY event_type;
CREATE OR REPLACE TEMPORARY FUNCTION regressed(share DOUBLE) RETURNS TABLE (event_type STRING, before DOUBLE, after DOUBLE)
  RETURN SELECT event_type, b, a FROM (SELECT event_type, avg(CASE WHEN day(ts) <= 15 THEN value END) AS b, avg(CASE WHEN day(ts) > 15 THEN value END) AS a FROM outcome_log GROUP BY event_type) x WHERE a < b * (1 - share);
CREATE OR REPLACE TEMPORARY FUNCTION retrieved_together(least_n BIGINT) RETURNS TABLE (src BIGINT, dst BIGINT, n BIGINT)
  RETURN SELECT l_partkey, l_suppkey, count(*) FROM retrieved GROUP BY l_partkey, l_suppkey HAVING count(*) >= least_n"""


def _functions(t):
    t.outcomes.createOrReplaceTempView("outcome_log")
    t.lineitem.createOrReplaceTempView("retrieved")
    for statement in FUNCTIONS.split(";\n"):
        t.spark.sql(statement)
    return t.spark


@query("fn_audit_statistics", "SELECT event_type, count(*) AS total, count_if(outcome = 'success') AS good, count_if(outcome = 'failure') AS bad, count(DISTINCT user_id) AS users FROM outcomes WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY 1")
def fn_audit_statistics(t):
    return _functions(t).sql("SELECT * FROM audit_statistics(TIMESTAMP_NTZ '2024-01-05', TIMESTAMP_NTZ '2024-01-25')")


@query("fn_regressed", "SELECT event_type, round(b, 6) AS before, round(a, 6) AS after FROM (SELECT event_type, avg(value) FILTER (WHERE day(ts) <= 15) AS b, avg(value) FILTER (WHERE day(ts) > 15) AS a FROM outcomes GROUP BY 1) WHERE a < b * (1 - 0.001::DOUBLE)")
def fn_regressed(t):
    return _functions(t).sql("SELECT event_type, round(before, 6) AS before, round(after, 6) AS after FROM regressed(0.001D)")


@query("fn_retrieved_together", "SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3")
def fn_retrieved_together(t):
    return _functions(t).sql("SELECT * FROM retrieved_together(3L)")
