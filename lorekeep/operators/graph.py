"""Graphs as edge tables (src, dst, kind, strength): neighbours, paths, reach, pressure, lineage, cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

MAX_HOPS = 10


def both_ways(edges: DataFrame, symmetric: tuple[str, ...] | None = None) -> DataFrame:
    """Edges and the reverse of the symmetric kinds (of all if None)."""
    back = edges if symmetric is None else edges.where(F.col("kind").isin(*symmetric))
    return edges.unionByName(back.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns]))


def valid_edges(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst AND strength BETWEEN 0 AND 1")


def neighbours(edges: DataFrame, node: int, direction: str = "both", kinds: list[str] | None = None, least: float = 0.0, limit: int | None = None) -> DataFrame:
    """Neighbours of a node: (node, kind, strength), strongest first."""
    e = edges.where(F.col("strength") >= least)
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    out = e.where(F.col("src") == node).select(F.col("dst").alias("node"), "kind", "strength")
    back = e.where(F.col("dst") == node).select(F.col("src").alias("node"), "kind", "strength")
    n = {"out": out, "in": back, "both": out.unionByName(back)}[direction].orderBy(F.desc("strength"), "node", "kind")
    return n if limit is None else n.limit(limit)


def simple_paths(edges: DataFrame, start: int, end: int, hops: int, least: float = 0.0) -> DataFrame:
    """All paths without a repeated node, of at most some hops: path as text, hops, product of strengths."""
    if hops > MAX_HOPS:
        raise ValueError(f"at most {MAX_HOPS} hops")
    e = edges.where(F.col("strength") >= least).groupBy("src", "dst").agg(F.max("strength").alias("strength"))
    front = e.where(F.col("src") == start).select(F.array("src", "dst").alias("path"), "dst", F.col("strength").alias("total"))
    found = front.where(F.col("dst") == end)
    for _ in range(hops - 1):
        f = front.where(F.col("dst") != end).alias("f")
        x = e.alias("x")
        front = f.join(x, F.col("f.dst") == F.col("x.src")).where(~F.array_contains(F.col("f.path"), F.col("x.dst")))
        front = front.select(F.array_append(F.col("f.path"), F.col("x.dst")).alias("path"), F.col("x.dst").alias("dst"), (F.col("f.total") * F.col("x.strength")).alias("total"))
        found = found.unionByName(front.where(F.col("dst") == end))
    return found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"), F.round("total", 9).alias("total"))


def reachable(edges: DataFrame, start: int, hops: int) -> DataFrame:
    """(node, hops) of every node within some hops of a start; the frontier only holds nodes not seen before."""
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct()
    seen = spark.createDataFrame([(start, 0)], "node long, hops long")
    front = seen
    for k in range(1, hops + 1):
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = written(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(k).cast("long")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def pressure(edges: DataFrame, start: int, iterations: int = 3, damping: float = 0.85, least: float = 1e-9, epsilon: float = 1e-6) -> DataFrame:
    """Pressure from one node: each round a node passes on a damped share over each edge and keeps the rest; normalised at the end."""
    spark = edges.sparkSession
    e = edges.select("src", "dst", F.least(F.greatest("strength", F.lit(0.0)), F.lit(1.0)).alias("w"))
    now = spark.createDataFrame([(start, 1.0)], "node long, p double")
    for _ in range(iterations):
        sent = now.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("p") * damping * F.col("w")).alias("p"))
        kept = now.select("node", (F.col("p") * (1 - damping)).alias("p"))
        new = written(sent.unionByName(kept).where(F.col("p") > least).groupBy("node").agg(F.sum("p").alias("p")), "pressure")
        gap = new.join(now.select("node", F.col("p").alias("q")), "node", "full").agg(F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))))).first()[0]
        now = new
        if gap is not None and gap < epsilon:
            break
    whole = now.agg(F.sum("p").alias("t"))
    return now.join(F.broadcast(whole)).select("node", (F.col("p") / F.col("t")).alias("p")).where(F.col("p") >= least)


def ancestors(rows: DataFrame, node: int, hops: int = 100) -> DataFrame:
    """(node, depth): the chain of parents of (id, parent_id), itself at depth 0. A chain has a row a hop, so one recursive query serves."""
    view = f"lineage_{uuid.uuid4().hex}"
    rows.select("id", "parent_id").createOrReplaceTempView(view)
    return rows.sparkSession.sql(
        f"""WITH RECURSIVE up(node, parent, depth) MAX RECURSION LEVEL {int(hops) + 2} AS (
          SELECT id, parent_id, 0 FROM {view} WHERE id = {int(node)}
          UNION ALL SELECT p.id, p.parent_id, up.depth + 1 FROM {view} p JOIN up ON p.id = up.parent WHERE up.depth < {int(hops)} AND p.id <> up.node)
        SELECT node, CAST(depth AS BIGINT) AS depth FROM up"""
    )


def descendants(rows: DataFrame, node: int, hops: int = 100) -> DataFrame:
    """(node, depth): all below a node of (id, parent_id), itself at depth 0; a frontier a round without nodes that are out already, so a cycle ends."""
    links = rows.select("id", "parent_id").where("parent_id IS NOT NULL AND id <> parent_id")
    front = rows.where(F.col("id") == node).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("depth"))
    out = front
    for k in range(1, hops + 1):
        below = links.join(front.select(F.col("node").alias("parent_id")), "parent_id").select(F.col("id").alias("node")).distinct()
        front = written(below.join(out.select("node"), "node", "left_anti").withColumn("depth", F.lit(k).cast("long")), "lineage")
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def depths(rows: DataFrame, hops: int = 100) -> DataFrame:
    """(id, depth) of every row of (id, parent_id) that hangs on a root, which has no parent among the rows.

    Chains are halved each round (a row's ancestor becomes that one's ancestor), so rounds grow with the logarithm of the depth.
    """
    here = rows.select(F.col("id").alias("up")).withColumn("here", F.lit(True))
    links = rows.select("id", F.col("parent_id").alias("up")).join(here, "up", "left")
    now = written(links.select("id", F.when(F.col("here"), F.col("up")).alias("up"), F.when(F.col("here"), 1).otherwise(0).cast("long").alias("depth")), "depths")
    n = 1
    while n < hops and not now.where("up IS NOT NULL").isEmpty():
        far = now.select(F.col("id").alias("up"), F.col("up").alias("above"), F.col("depth").alias("more"))
        new = written(now.join(far, "up", "left").select("id", F.col("above").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
        dropped(now)
        now, n = new, 2 * n
    return now.where("up IS NULL").select("id", "depth")


def undirected_distance(edges: DataFrame, start: int, hops: int = MAX_HOPS, without: str | None = None) -> DataFrame:
    """(node, hops) over edges either way, those of one kind left out."""
    e = edges if without is None else edges.where(F.col("kind") != without)
    return reachable(both_ways(e.select("src", "dst", "kind")), start, hops)


def cyclic(deps: DataFrame) -> DataFrame:
    """Dependencies (group, id, needs) that no order of steps can satisfy: those left when steps without open needs, and needs that no step waits for, are taken away again and again."""
    left = written(deps.select("group", "id", "needs").distinct(), "deps")
    n = left.count()
    while n:
        has_needs = left.select("group", F.col("id").alias("needs")).distinct()
        is_needed = left.select("group", F.col("needs").alias("id")).distinct()
        new = written(left.join(has_needs, ["group", "needs"], "left_semi").join(is_needed, ["group", "id"], "left_semi").select("group", "id", "needs"), "deps")
        dropped(left)
        left, before = new, n
        n = left.count()
        if n == before:
            break
    return left


def prunable(edges: DataFrame, weaker: float, older: int) -> DataFrame:
    return edges.where((F.col("strength") < weaker) & (F.col("age_days") > older) & F.col("auto_created"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Counts by kind; node_count_ref adds distinct sources and distinct targets, n_nodes counts each node once."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).agg(F.count_distinct("node").alias("n_nodes"))
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("similar", "depends", "refines")]
    return edges.agg(F.count("*").alias("n_edges"), (F.count_distinct("src") + F.count_distinct("dst")).alias("node_count_ref"), *kinds, F.round(F.avg("strength"), 6).alias("avg_strength")).join(F.broadcast(ends))


def min_cut(edges: DataFrame, component: str, sizes: DataFrame | None = None) -> DataFrame:
    """Global minimum cut of each component (Stoer and Wagner): its weight and the nodes on the smaller side.

    A component's edges must fit one task; components are split among tasks. A node (component, label) of `sizes` counts as k nodes.
    """

    def weighed(rows, of):
        import pandas as pd

        k = dict(zip(of["label"], of["k"], strict=True))
        return cut(rows, k) if len(rows) else pd.DataFrame([], columns=["component", "weight", "smaller_side"])

    def cut(rows, k=None):
        import pandas as pd

        w: dict[int, dict[int, float]] = {}
        for a, b, s in zip(rows["src"], rows["dst"], rows["strength"], strict=True):
            if a != b:
                w.setdefault(a, {})[b] = w.get(a, {}).get(b, 0.0) + s
                w.setdefault(b, {})[a] = w.get(b, {}).get(a, 0.0) + s
        nodes, merged, best, side = sorted(w), {v: [v] for v in w}, float("inf"), []
        while len(nodes) > 1:
            weight, order, left = dict.fromkeys(nodes, 0.0), [], set(nodes)
            while left:
                v = max(left, key=lambda x: (weight[x], -x))
                left.remove(v)
                order.append(v)
                for u, s in w[v].items():
                    if u in left:
                        weight[u] += s
            s, t = order[-2], order[-1]
            if weight[t] < best - 1e-12:
                best, side = weight[t], list(merged[t])
            for u, x in w.pop(t).items():
                w[u].pop(t, None)
                if u != s:
                    w[s][u] = w[s].get(u, 0.0) + x
                    w[u][s] = w[u].get(s, 0.0) + x
            merged[s] += merged[t]
            nodes.remove(t)
        count = lambda nodes: len(nodes) if k is None else int(sum(k[x] for x in nodes))
        n, size = count(set(rows["src"]) | set(rows["dst"])), count(side)
        return pd.DataFrame([(int(rows[component].iloc[0]), round(best, 6) if side else 0.0, min(size, n - size))], columns=["component", "weight", "smaller_side"])

    if sizes is not None:
        return edges.groupBy(component).cogroup(sizes.groupBy("component")).applyInPandas(weighed, "component long, weight double, smaller_side long")
    return edges.groupBy(component).applyInPandas(lambda rows: cut(rows), "component long, weight double, smaller_side long")


def unmet(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Open steps all of whose dependencies are done: tasks (id, done), deps (id, needs)."""
    waiting = deps.join(tasks.where(~F.col("done")).select(F.col("id").alias("needs")), "needs").select("id").distinct()
    return tasks.where(~F.col("done")).join(waiting, "id", "left_anti").select("id")
