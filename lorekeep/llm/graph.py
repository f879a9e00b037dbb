"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, dropped, hot_keys, joined, written

#: Edges that make a file of a round's table.
EDGES_A_FILE = 500_000


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m, n): the least of each node's neighbours v and itself, and how many pairs it has."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")


def _with_least(pairs: DataFrame, rows: int, hub: int) -> tuple[DataFrame, DataFrame]:
    """The pairs with the least neighbour m of their u, and the table of these; hubs are joined on their own."""
    least = _least(pairs)
    hot = hot_keys(least, "u", rows, hub) if rows > hub else []
    return joined(pairs, least.select("u", "m"), "u", hot), least


def components(edges: DataFrame, hub: int = HOT_ROWS) -> DataFrame:
    """(node, root) of every node of an edge table (a, b) of longs; root is the least node of its component.

    Large-star and small-star in turn: each round joins the edges with the least neighbour per node, so no group of
    neighbours is ever gathered, and a hub of more than `hub` edges is joined by broadcast of its one row. Rounds grow with the logarithm of a component's size, and end
    when every node hangs on a root. Each round is a written table, so a lost executor costs a round at most; a table has as
    many files as the edges before it ask for.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = written(e, "edges")
    rows = e.count()
    while rows:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = _with_least(both, 2 * rows, hub)
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small, least = _with_least(large, rows, hub)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e2 = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e2 = written(e2.coalesce(rows // EDGES_A_FILE + 1), "edges")
        dropped(e)
        e = e2
        rows, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
        if rows == nodes and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._lorekeep_path = e._lorekeep_path
    return out
