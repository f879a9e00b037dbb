"""Queries on graphs and lineage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import graph as G
from ..operators import paths as P
from ..sources.tables import tasks
from .registry import query


@query("edges_out", "SELECT dst AS node, kind, round(strength, 6) AS strength FROM edges WHERE src = 7 AND strength >= 0.3")
def edges_out(t):
    return G.neighbours(t.edges, 7, "out", least=0.3).withColumn("strength", F.round("strength", 6))


@query("edges_in", "SELECT src AS node, kind, round(strength, 6) AS strength FROM edges WHERE dst = 7 AND kind = 'similar'")
def edges_in(t):
    return G.neighbours(t.edges, 7, "in", ["similar"]).withColumn("strength", F.round("strength", 6))


@query("neighbour_union", "SELECT node, kind, round(strength, 6) AS strength FROM (SELECT dst AS node, kind, strength FROM edges WHERE src = 7 UNION ALL SELECT src, kind, strength FROM edges WHERE dst = 7) ORDER BY strength DESC, node, kind LIMIT 8")
def neighbour_union(t):
    return G.neighbours(t.edges, 7, limit=8).withColumn("strength", F.round("strength", 6))


@query("edge_node_join", "SELECT e.src, e.dst, p.domain, round(e.strength, 6) AS strength FROM edges e JOIN patterns p ON e.dst = p.id WHERE e.src = 3")
def edge_node_join(t):
    e, p = t.edges.where("src = 3"), t.patterns.select("id", "domain")
    return e.join(p, e["dst"] == p["id"]).select("src", "dst", "domain", F.round("strength", 6).alias("strength"))


@query("symmetric_edges", "SELECT src, dst, kind FROM edges UNION ALL SELECT dst, src, kind FROM edges WHERE kind = 'similar'")
def symmetric_edges(t):
    return G.both_ways(t.edges, ("similar",)).select("src", "dst", "kind")


@query("undirected_neighbours", "SELECT src AS node, count(DISTINCT dst) AS n FROM (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) GROUP BY 1")
def undirected_neighbours(t):
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    u = t.edges.select(ends.alias("e")).select("e.src", "e.dst").repartition(2 * tasks(t.lineitem), "src", "dst").distinct()
    return u.groupBy(F.col("src").alias("node")).agg(F.count("dst").alias("n"))


@query("edge_validation", "SELECT count(*) AS n FROM edges WHERE src <> dst AND strength BETWEEN 0 AND 1")
def edge_validation(t):
    return G.valid_edges(t.edges).agg(F.count("*").alias("n"))


PATHS = """WITH RECURSIVE e AS (SELECT src, dst, max(strength) AS strength FROM edges WHERE strength >= 0.3 GROUP BY 1, 2),
p(path, dst, total) AS (SELECT [src, dst], dst, strength FROM e WHERE src = 3
  UNION ALL SELECT list_append(path, e.dst), e.dst, total * strength FROM p JOIN e ON p.dst = e.src WHERE len(path) <= 3 AND p.dst <> 20 AND NOT list_contains(path, e.dst))"""


@query("simple_paths", f"{PATHS} SELECT array_to_string(path, '>') AS path, len(path) - 1 AS hops, round(total, 9) AS total FROM p WHERE dst = 20")
def simple_paths(t):
    return G.simple_paths(t.edges, 3, 20, 3, 0.3)


@query("strongest_path", f"{PATHS}, r AS (SELECT array_to_string(path, '>') AS path, len(path) - 1 AS hops, round(total, 9) AS total FROM p WHERE dst = 20) SELECT * FROM r ORDER BY total DESC, hops, path LIMIT 1")
def strongest_path(t):
    return P.as_text(P.strongest(t.edges, 3, 3, 0.3, end=20))


@query("shortest_path", f"{PATHS}, r AS (SELECT array_to_string(path, '>') AS path, len(path) - 1 AS hops, round(total, 9) AS total FROM p WHERE dst = 20) SELECT * FROM r ORDER BY hops, total DESC, path LIMIT 1")
def shortest_path(t):
    return P.as_text(P.shortest(t.edges, 3, 3, 0.3, end=20))


@query("reachable", "WITH RECURSIVE r(node, hops) AS (SELECT 5::BIGINT, 0 UNION SELECT e.dst, hops + 1 FROM r JOIN edges e ON e.src = r.node WHERE hops < 2 AND e.strength >= 0.5) SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY 1")
def reachable(t):
    return G.reachable(t.edges.where("strength >= 0.5"), 5, 2)


@query(
    "pressure",
    """WITH s0 AS (SELECT 5::BIGINT AS node, 1.0::DOUBLE AS p), s1 AS (SELECT node, sum(p) AS p FROM (SELECT e.dst AS node, p * 0.85 * strength AS p FROM s0 JOIN edges e ON node = src UNION ALL SELECT node, p * 0.15 FROM s0) WHERE p > 1e-9 GROUP BY 1),
s2 AS (SELECT node, sum(p) AS p FROM (SELECT e.dst AS node, p * 0.85 * strength AS p FROM s1 JOIN edges e ON node = src UNION ALL SELECT node, p * 0.15 FROM s1) WHERE p > 1e-9 GROUP BY 1),
s3 AS (SELECT node, sum(p) AS p FROM (SELECT e.dst AS node, p * 0.85 * strength AS p FROM s2 JOIN edges e ON node = src UNION ALL SELECT node, p * 0.15 FROM s2) WHERE p > 1e-9 GROUP BY 1)
SELECT node, round(p / (SELECT sum(p) FROM s3), 6) AS p FROM s3""",
)
def pressure(t):
    return G.pressure(t.edges, 5).select("node", F.round("p", 6).alias("p"))


@query("lineage_ancestors", "WITH RECURSIVE u(node, parent, depth) AS (SELECT id, parent_id, 0 FROM patterns WHERE id = 190 UNION ALL SELECT p.id, p.parent_id, depth + 1 FROM patterns p JOIN u ON p.id = u.parent WHERE depth < 100) SELECT node, depth::BIGINT AS depth FROM u")
def lineage_ancestors(t):
    return G.ancestors(t.patterns, 190)


@query("lineage_root_chain", "WITH RECURSIVE u(node, parent, depth) AS (SELECT id, parent_id, 0 FROM patterns WHERE id = 165 UNION ALL SELECT p.id, p.parent_id, depth + 1 FROM patterns p JOIN u ON p.id = u.parent WHERE depth < 100) SELECT string_agg(node::VARCHAR, '>' ORDER BY depth DESC) AS chain FROM u")
def lineage_root_chain(t):
    x = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.col("node").cast("string").alias("n")))), lambda e: e["n"])
    return G.ancestors(t.patterns, 165).agg(F.array_join(x, ">").alias("chain"))


@query("lineage_descendants", "WITH RECURSIVE d(node, depth) AS (SELECT id, 0 FROM patterns WHERE id = 15 UNION ALL SELECT p.id, depth + 1 FROM patterns p JOIN d ON p.parent_id = d.node WHERE depth < 100) SELECT node, depth::BIGINT AS depth FROM d")
def lineage_descendants(t):
    return G.descendants(t.patterns, 15)


@query("graph_stats", "SELECT count(*) AS n_edges, count(DISTINCT src) + count(DISTINCT dst) AS node_count_ref, (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM edges UNION SELECT dst FROM edges)) AS n_nodes, count_if(kind = 'similar') AS similar, count_if(kind = 'depends') AS depends, count_if(kind = 'refines') AS refines, round(avg(strength), 6) AS avg_strength FROM edges")
def graph_stats(t):
    return G.graph_stats(t.edges)


@query("prune_weak_edges", "SELECT src, dst FROM edges WHERE strength < 0.4 AND age_days > 90 AND auto_created")
def prune_weak_edges(t):
    return G.prunable(t.edges, 0.4, 90).select("src", "dst")


@query("prune_stats", "SELECT count(*) AS n, count_if(strength < 0.4) AS weak, round(avg(strength) FILTER (WHERE auto_created), 6) AS auto_strength FROM edges")
def prune_stats(t):
    return t.edges.agg(F.count("*").alias("n"), F.count_if(F.col("strength") < 0.4).alias("weak"), F.round(F.avg(F.when(F.col("auto_created"), F.col("strength"))), 6).alias("auto_strength"))


@query("co_retrieval_strength", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n, round(count(*) / (count(*) + 10.0::DOUBLE), 6) AS strength FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2 HAVING count(*) >= 2")
def co_retrieval_strength(t):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    n = t.lineitem.where(p != s).groupBy(F.least(p, s).alias("a"), F.greatest(p, s).alias("b")).agg(F.count("*").alias("n")).where("n >= 2")
    return n.withColumn("strength", F.round(F.col("n") / (F.col("n") + F.lit(10.0)), 6))


@query(
    "wormhole_candidates",
    """WITH s AS (SELECT DISTINCT session_id, pattern_id AS x FROM outcomes), p AS (SELECT a.x AS a, b.x AS b, count(*) AS n FROM s a JOIN s b ON a.session_id = b.session_id AND a.x < b.x GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a, b, n, round(0.6 * n / max(n) OVER () + 0.4 * 0.75, 6) AS score FROM p""",
)
def wormhole_candidates(t):
    from ..operators.sequences import co_occurrence

    p = co_occurrence(t.outcomes.withColumnRenamed("pattern_id", "x"), "session_id", "x", 3)
    most = p.agg(F.max("n").alias("most"))
    return p.join(F.broadcast(most)).select("a", "b", "n", F.round(F.col("n") * 0.6 / F.col("most") + 0.4 * 0.75, 6).alias("score"))


@query("wormhole_decay", "SELECT src, dst, round(CASE WHEN age_days > 30 THEN strength * pow(0.99, age_days - 30) ELSE strength END, 6) AS strength, CASE WHEN age_days > 30 THEN strength * pow(0.99, age_days - 30) ELSE strength END >= 0.1 AS active FROM edges")
def wormhole_decay(t):
    s = S.wormhole_decay(F.col("strength"), F.col("age_days"))
    return t.edges.select("src", "dst", F.round(s, 6).alias("strength"), (s >= 0.1).alias("active"))


@query("cross_domain_pairs", "SELECT a.id AS a, b.id AS b, 1.5::DOUBLE AS boost FROM patterns a JOIN patterns b ON a.id = b.parent_id WHERE string_split(a.domain, '.')[1] <> string_split(b.domain, '.')[1]")
def cross_domain_pairs(t):
    a = t.patterns.select(F.col("id").alias("a"), F.substring_index("domain", ".", 1).alias("ra"))
    b = t.patterns.select(F.col("id").alias("b"), "parent_id", F.substring_index("domain", ".", 1).alias("rb"))
    return a.join(b, F.col("a") == F.col("parent_id")).where("ra <> rb").select("a", "b", F.lit(1.5).alias("boost"))


@query("trace_back", "WITH RECURSIVE r(node, hops, w) AS (SELECT 9::BIGINT, 0, 1.0::DOUBLE UNION ALL SELECT e.src, hops + 1, w * strength FROM r JOIN edges e ON e.dst = r.node WHERE hops < 2 AND strength >= 0.6) SELECT node, hops::BIGINT AS hops, round(max(w), 6) AS weight FROM r GROUP BY 1, 2")
def trace_back(t):
    """Causes of a node: edges backwards, weights multiplied, the best of each node and distance."""
    e = t.edges.where("strength >= 0.6").select("src", "dst", "strength")
    front = t.spark.createDataFrame([(9, 0, 1.0)], "node long, hops long, weight double")
    out = front
    for _ in range(2):
        front = front.join(e, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), (F.col("hops") + 1).alias("hops"), (F.col("weight") * F.col("strength")).alias("weight")).groupBy("node", "hops").agg(F.max("weight").alias("weight"))
        out = out.unionByName(front)
    return out.withColumn("weight", F.round("weight", 6))


@query("likely_futures", "SELECT domain, id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY probability DESC, id) AS k FROM predictions WHERE probability >= 0.6) WHERE k <= 5")
def likely_futures(t):
    k = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("probability"), "id"))
    return t.predictions.where("probability >= 0.6").withColumn("k", k).where("k <= 5").select("domain", "id")


@query("attention_core", "SELECT id, round(reward * pow(0.95, updated_days % 20), 6) AS attention FROM patterns WHERE reward * pow(0.95, updated_days % 20) >= 0.1 ORDER BY attention DESC, id LIMIT 50")
def attention_core(t):
    a = F.round(F.col("reward") * F.pow(F.lit(0.95), F.col("updated_days") % 20), 6)
    return t.patterns.select("id", a.alias("attention")).where("attention >= 0.1").orderBy(F.desc("attention"), "id").limit(50)


@query("trajectory_edges", "SELECT a, b, count(*) AS n FROM (SELECT conv_id, role || (turn % 3) AS a, lead(role || (turn % 3)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL GROUP BY 1, 2")
def trajectory_edges(t):
    step = F.concat("role", (F.col("turn") % 3).cast("string"))
    x = t.conversations.select(step.alias("a"), F.lead(step).over(Window.partitionBy("conv_id").orderBy("turn")).alias("b"))
    return x.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("graph_export", "SELECT src, dst, kind, round(strength, 4) AS strength FROM edges ORDER BY strength DESC, src, dst, kind LIMIT 100")
def graph_export(t):
    return t.edges.orderBy(F.desc("strength"), "src", "dst", "kind").limit(100).select("src", "dst", "kind", F.round("strength", 4).alias("strength"))


@query("ready_steps", "SELECT id FROM patterns p WHERE NOT success AND NOT EXISTS (SELECT 1 FROM patterns q WHERE q.id = p.parent_id AND NOT q.success)")
def ready_steps(t):
    tasks = t.patterns.select("id", F.col("success").alias("done"))
    return G.unmet(tasks, t.patterns.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("needs")))
