"""Best paths by relaxing labels layer by layer: a node keeps its best label of each length, so no layer has more rows than nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

#: Totals that agree to so many places are ties, which go to fewer hops, then to the path that is first as text.
PLACES = 12


def _links(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.col("strength") >= least).groupBy("src", "dst").agg(F.max("strength").alias("strength"))


def _best_of(rows: DataFrame) -> DataFrame:
    """The best label of each node: the largest total, ties to the path that is first as text."""
    total = F.round(F.col("total"), PLACES)
    top = rows.withColumn("_t", total)
    # The least of (minus total, path) is one aggregate, so labels of a node combine before the shuffle.
    return top.groupBy("node").agg(F.min(F.struct((-F.col("_t")).alias("t"), "path", "total")).alias("b")).select("node", "b.total", "b.path")


def strongest(edges: DataFrame, start: int, hops: int, least: float = 0.0, end: int | None = None) -> DataFrame:
    """(node, hops, total, path): of every node within some hops of a start the path of the greatest product of strengths.

    Strengths are at most 1, so a label that is no better than the node's own with fewer hops can be on no best path and is not
    passed on. With `end` labels below the best of that node are not passed on either, and only its row is given. The path is
    text with a mark behind every node.
    """
    spark = edges.sparkSession
    e = written(_links(edges, least), "links")
    front = F.broadcast(spark.createDataFrame([(start, 1.0, f"{start}>")], "node long, total double, path string"))  # one row
    best = written(front.withColumn("hops", F.lit(0).cast("long")), "labels")
    for k in range(1, hops + 1):
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("total") * F.col("strength")).alias("total"), F.concat("path", F.col("dst").cast("string"), F.lit(">")).alias("path"))
        step = _best_of(step)
        known = best.select("node", F.col("total").alias("had"))
        better = step.join(known, "node", "left").where(F.col("had").isNull() | (F.round("total", PLACES) > F.round("had", PLACES))).drop("had")
        if end is not None:
            goal = best.where(F.col("node") == end).agg(F.max("total").alias("goal"))
            better = better.join(F.broadcast(goal)).where(F.col("goal").isNull() | (F.col("total") > F.col("goal"))).drop("goal")
        new = written(better.withColumn("hops", F.lit(k).cast("long")), "labels")
        if new.isEmpty():
            dropped(new)
            break
        rest = best.join(new.select("node"), "node", "left_anti")
        merged = written(rest.unionByName(new), "labels")
        dropped(best)
        best, front = merged, new.drop("hops")
    out = best.where(F.col("hops") > 0)
    return out if end is None else out.where(F.col("node") == end)


def shortest(edges: DataFrame, start: int, hops: int, least: float = 0.0, end: int | None = None) -> DataFrame:
    """(node, hops, total, path): of every node the path of fewest hops, of these the one of the greatest product."""
    spark = edges.sparkSession
    e = written(_links(edges, least), "links")
    front = F.broadcast(spark.createDataFrame([(start, 1.0, f"{start}>")], "node long, total double, path string"))  # one row
    seen = written(front.withColumn("hops", F.lit(0).cast("long")), "labels")
    for k in range(1, hops + 1):
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("total") * F.col("strength")).alias("total"), F.concat("path", F.col("dst").cast("string"), F.lit(">")).alias("path"))
        new = written(_best_of(step.join(seen.select("node"), "node", "left_anti")).withColumn("hops", F.lit(k).cast("long")), "labels")
        if new.isEmpty():
            dropped(new)
            break
        seen, front = seen.unionByName(new), new.drop("hops")
        if end is not None and not new.where(F.col("node") == end).isEmpty():
            break
    out = seen.where(F.col("hops") > 0)
    return out if end is None else out.where(F.col("node") == end)


def as_text(paths: DataFrame) -> DataFrame:
    """(path, hops, total) as the listing of simple paths gives them."""
    return paths.select(F.expr("substring(path, 1, length(path) - 1)").alias("path"), "hops", F.round("total", 9).alias("total"))


def distances(pairs: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """(a, b, hops) of pairs of nodes that an undirected path of some edges at most joins: frontiers from both ends, until they meet.

    Frontiers are kept for each node that is an end of an open pair, all pairs at once; the side that stands nearer to its ends
    takes the next step. Pairs that have met, and ends without an open pair, go on no further.
    """
    e = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    e = written(e, "links")
    todo = written(pairs.select("a", "b").where("a <> b").distinct(), "pairs")
    start = lambda side: written(todo.select(F.col(side).alias("origin"), F.col(side).alias("node")).distinct(), "frontier")
    front = {"a": start("a"), "b": start("b")}
    before = {"a": None, "b": None}
    out = None
    for k in range(1, most + 1):
        side = "a" if k % 2 else "b"
        now = front[side].join(todo.select(F.col(side).alias("origin")).distinct(), "origin", "left_semi")
        step = now.join(e, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        # A neighbour of a frontier lies in it, in the one before it, or in neither, which is the next.
        step = step.join(front[side], ["origin", "node"], "left_anti")
        if before[side] is not None:
            step = step.join(before[side], ["origin", "node"], "left_anti")
        before[side], front[side] = front[side], written(step, "frontier")
        a = front["a"].select(F.col("origin").alias("a"), "node")
        b = front["b"].select(F.col("origin").alias("b"), "node")
        met = written(todo.join(a, "a").join(b, ["b", "node"]).select("a", "b").distinct().withColumn("hops", F.lit(k).cast("long")), "met")
        out = met if out is None else out.unionByName(met)
        left = written(todo.join(met, ["a", "b"], "left_anti"), "pairs")
        dropped(todo)
        todo = left
        if todo.isEmpty():
            break
    return out


def shortcuts(used: DataFrame, edges: DataFrame, known: DataFrame | None = None, alike: DataFrame | None = None, often: int = 3, saving: float = 0.5, far: int = 3, top: int = 1000, w_often: float = 0.6, w_saving: float = 0.4, large: int = 1000) -> DataFrame:
    """(a, b, n, hops, saving, score): pairs (session, x) used together in several sessions though far apart in the graph, the best first.

    `known` pairs (a, b) have a shortcut already; so have nodes with one label (x, label) in `alike`. The `often` - 1 largest sessions, if they are large, make no pairs of their own:
    a pair needs another session to count at all, so they only add to the counts of pairs that the others made.
    """
    s = written(used.select("session", "x").dropna().distinct(), "uses")
    sizes = s.groupBy("session").agg(F.count("*").alias("n"))
    big = [r["session"] for r in sizes.where(F.col("n") > large).orderBy(F.desc("n"), "session").limit(often - 1).collect()]
    rest = s.where(~F.col("session").isin(big)) if big else s
    p, q = rest.alias("p"), rest.alias("q")
    pairs = p.join(q, (F.col("p.session") == F.col("q.session")) & (F.col("p.x") < F.col("q.x"))).groupBy(F.col("p.x").alias("a"), F.col("q.x").alias("b")).agg(F.count("*").alias("n"))
    for one in big:
        inside = s.where(F.col("session") == one).select("x")
        pairs = pairs.join(inside.select(F.col("x").alias("a"), F.lit(1).alias("_a")), "a", "left").join(inside.select(F.col("x").alias("b"), F.lit(1).alias("_b")), "b", "left")
        pairs = pairs.select("a", "b", (F.col("n") + F.coalesce(F.col("_a") * F.col("_b"), F.lit(0))).alias("n"))
    pairs = pairs.where(F.col("n") >= often)
    if known is not None:
        pairs = pairs.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    if alike is not None:
        label = alike.select("x", "label").dropna().distinct()
        same = pairs.join(label.withColumnRenamed("x", "a"), "a").join(label.withColumnRenamed("x", "b"), ["b", "label"]).select("a", "b").distinct()
        pairs = pairs.join(same, ["a", "b"], "left_anti")
    pairs = written(pairs, "together")
    most = pairs.agg(F.max("n").alias("most"))
    d = distances(pairs, edges)
    saved = (F.col("hops") - 1) / F.col("hops")
    found = pairs.join(d, ["a", "b"]).withColumn("saving", saved).where((F.col("saving") >= saving) & (F.col("hops") >= far))
    score = F.round(F.col("n") * w_often / F.col("most") + F.col("saving") * w_saving, 6)
    return found.join(F.broadcast(most)).select("a", "b", "n", "hops", F.round("saving", 6).alias("saving"), score.alias("score")).orderBy(F.desc("score"), "a", "b").limit(top)
