"""Least cuts and clusters of graphs that no task holds: nodes that no small cut can part are merged first.

Two nodes are joined by paths of one and two edges that share no edge; what these carry together is a lower bound of every cut
between the two. Where it reaches the bound that is looked for (the least cut known so far, or the threshold of clusters), the
nodes are merged, which loses no smaller cut; parallel edges add up, and the next round may merge more. The first rounds look at groups of
edges, each as a graph of its own in one task, where a merged node grows by all that is bound to it; later ones at paths of the whole graph. What is left is cut in
one task a component, and a component that does not fit there is an error, not a wrong answer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written
from .graph import min_cut
from .planning import clustered_by_cut

#: Nodes of more neighbours than this lend no paths of two edges (the bound stays one); edges of a component that one task cuts.
MIDDLE, FITS = 64, 200_000
#: Paths of two edges that a round looks at; where there are more, it takes those that end at one of some nodes, at fewest one in SHARE.
PATHS, SHARE = 2_000_000, 64
#: Edges that a task looks at as a graph of their own, nodes of it from which it grows a merged one, and edges of a graph for which paths alone do.
GROUP, HUBS, SMALL = 1 << 20, 16, 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component of edges (src, dst).

    Each node is hung on its least neighbour and these pointers are followed to their ends; what a tree holds is then one node, and only
    edges between trees are left for the next round, until there are none.
    """
    e = written(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "links")
    place = None
    while place is None or not e.isEmpty():
        ends = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        to = written(ends.groupBy(F.col("src").alias("node")).agg(F.least(F.col("src"), F.min("dst")).alias("label")).select("node", "label", F.lit(True).alias("moved")), "labels")
        while not to.where("moved").isEmpty():
            up = to.select(F.col("node").alias("label"), F.col("label").alias("up"))
            new = written(to.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") < F.col("label")).alias("moved")), "labels")
            dropped(to)
            to = new
        name = lambda k: to.select(F.col("node").alias(k), F.col("label").alias(f"to_{k}"))  # noqa: B023, E731
        left = e.where("src <> dst").join(name("src"), "src").join(name("dst"), "dst").select(F.least("to_src", "to_dst").alias("src"), F.greatest("to_src", "to_dst").alias("dst")).where("src <> dst")
        e2 = written(left.distinct(), "links")
        if place is None:
            dropped(e)
            place, e = to.select("node", "label"), e2
            place._scratch_path = to._scratch_path
        else:
            new = written(place.join(to.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            dropped(e, place, to)
            place, e = new, e2
    dropped(e)
    return place


def _merged(edges: DataFrame) -> DataFrame:
    """Undirected edges a <= b, parallel ones added up."""
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "strength")
    return ends.groupBy("src", "dst").agg(F.sum("strength").alias("strength"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "strength"))


def _degrees(edges: DataFrame) -> DataFrame:
    return _both(edges).groupBy(F.col("src").alias("node")).agg(F.sum("strength").alias("weight"), F.count("*").alias("n"))


def _bonds(edges: DataFrame, degrees: DataFrame, share: int) -> DataFrame:
    """(src, dst, bond): what paths of one and two edges carry between two nodes, for pairs that have any and of which one is of the share."""
    drawn = lambda node: F.pmod(F.xxhash64(node), F.lit(share)) == 0
    both = _both(edges).join(degrees.where(F.col("n") <= MIDDLE).select(F.col("node").alias("src")), "src", "left_semi")
    near = both.groupBy("src").agg(F.collect_list(F.struct("dst", "strength")).alias("near"))
    two = near.select("near", F.explode("near").alias("x")).where(drawn("x.dst")).select("x", F.explode("near").alias("y"))
    # A pair of two drawn nodes is met from both.
    two = two.where((F.col("x.dst") < F.col("y.dst")) | (F.col("x.dst") > F.col("y.dst")) & ~drawn("y.dst"))
    two = two.select(F.least("x.dst", "y.dst").alias("src"), F.greatest("x.dst", "y.dst").alias("dst"), F.least("x.strength", "y.strength").alias("strength"))
    return edges.where(drawn("src") | drawn("dst")).unionByName(two).groupBy("src", "dst").agg(F.sum("strength").alias("bond"))


def _firm(edges: DataFrame, degrees: DataFrame, best: DataFrame, threshold: float | None, share: int) -> DataFrame:
    """Pairs (src, dst) that no cut of interest parts: single edges that carry the bound, and pairs whose paths do."""
    bonds = edges.withColumnRenamed("strength", "bond").unionByName(_bonds(edges, degrees, share))
    if threshold is not None:
        return bonds.where(F.col("bond") >= threshold).select("src", "dst")
    least = best.agg(F.min("weight")).first()[0]
    near = bonds.where(F.col("bond") >= least - 1e-12).join(degrees.select(F.col("node").alias("src"), "component"), "src")
    return near.join(best, "component").where(F.col("bond") >= F.col("weight") - 1e-12).select("src", "dst")


def _groups(batches: Iterator, most: int) -> Iterator[tuple]:
    """(nodes, src, dst, strength) of so many edges at most, src and dst as places in nodes, parallel edges added up; without strengths their number."""
    import numpy as np
    import pyarrow as pa

    def graph(held: list) -> tuple:
        table = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate([table[k].to_numpy() for k in ("src", "dst")]), return_inverse=True)
        x, y = at[: table.num_rows], at[table.num_rows :]
        pairs, of = np.unique(np.minimum(x, y) * len(nodes) + np.maximum(x, y), return_inverse=True)
        strength = table["strength"].to_numpy() if "strength" in table.column_names else None
        return nodes, pairs // len(nodes), pairs % len(nodes), np.bincount(of, strength, len(pairs))

    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, most - n)
            held.append(some)
            at, n = at + some.num_rows, n + some.num_rows
            if n == most:
                yield graph(held)
                held, n = [], 0
    if n:
        yield graph(held)


def _linked(edges: DataFrame) -> DataFrame:
    """(src, dst): each node of a group of edges with the least one of its component in the group, which link what the edges do."""
    most = GROUP

    def step(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for nodes, x, y, _ in _groups(batches, most):
            label = np.arange(len(nodes))
            while True:
                least = np.minimum(label[x], label[y])
                new = label.copy()
                # What a label's tree is linked with goes to its root.
                np.minimum.at(new, label[x], least)
                np.minimum.at(new, label[y], least)
                while (new[new] != new).any():
                    new = new[new]
                new = new[label]
                if (new == label).all():
                    break
                label = new
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["src", "dst"])

    kind = dict(edges.dtypes)["src"]
    return edges.select("src", "dst").mapInArrow(step, f"src {kind}, dst {kind}")


def _grown(n: int, x, y, w, bound: float):
    """The node that stands for each of n nodes after those that paths of one and two edges bind to a growing one by the bound are merged with it.

    What is bound to one merged node by the bound is bound to all in it, so it may be merged at once. Edges are distinct pairs.
    """
    import numpy as np

    label = np.arange(n)
    tried = np.zeros(n, bool)
    for _ in range(HUBS):
        weight = np.bincount(x, w, n) + np.bincount(y, w, n)
        weight[tried] = 0
        hub = int(weight.argmax())
        if weight[hub] < bound:
            break
        tried[hub] = True
        inside = np.zeros(n, bool)
        inside[hub] = True
        while True:
            # Edges between the merged node and others, and those that go on from there.
            out, back = inside[x] & ~inside[y], inside[y] & ~inside[x]
            near = np.bincount(y[out], w[out], n) + np.bincount(x[back], w[back], n)
            far = ~inside[x] & ~inside[y]
            u, v, s = x[far], y[far], w[far]
            bond = near + np.bincount(v, np.minimum(near[u], s), n) + np.bincount(u, np.minimum(near[v], s), n)
            new = (bond >= bound) & ~inside
            if not new.any():
                break
            inside |= new
        label[inside[label]] = hub
        x, y = np.where(inside[x], hub, x), np.where(inside[y], hub, y)
        pairs, of = np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_inverse=True)
        w = np.bincount(of, w, len(pairs))
        x, y = pairs // n, pairs % n
        x, y, w = x[x != y], y[x != y], w[x != y]
        if not len(x):
            break
    return label


def _local(edges: DataFrame, bound: float) -> DataFrame:
    """(merged, src, dst, strength): groups of edges with what the bound binds in a group merged; where merged is true, src goes with dst.

    A group is a part of the graph, and what no small cut parts in it none parts in the whole.
    """

    most = GROUP

    def step(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for nodes, x, y, w in _groups(batches, most):
            # Sums of strengths are as good as their order lets them be.
            label = _grown(len(nodes), x[x != y], y[x != y], w[x != y], bound + 1e-9)
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            left = label[x] != label[y]
            pairs, of = np.unique(np.minimum(label[x], label[y])[left] * len(nodes) + np.maximum(label[x], label[y])[left], return_inverse=True)
            src, dst = np.concatenate([moved, pairs // len(nodes)]), np.concatenate([label[moved], pairs % len(nodes)])
            strength = np.concatenate([np.zeros(len(moved)), np.bincount(of, w[left], len(pairs))])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(src)) < len(moved)), pa.array(nodes[src]), pa.array(nodes[dst]), pa.array(strength)], names=["merged", "src", "dst", "strength"])

    kind = dict(edges.dtypes)["src"]
    return edges.select("src", "dst", "strength").mapInArrow(step, f"merged boolean, src {kind}, dst {kind}, strength double")


def _in_order(edges: DataFrame) -> DataFrame:
    """A written table of edges by their least ends, in which those of a group are likely to be of one part of the graph."""
    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "strength")
    return written(ends.repartitionByRange(edges.count() // GROUP + 1, "src", "dst"), "cut-edges")


def _closed(edges: DataFrame, threshold: float | None, most: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """((component, src, dst, strength) left, (component, node, label) of all nodes, (component, weight, side) of the least single node met)."""
    given = written(edges.select("src", "dst", F.col("strength").cast("double").alias("strength")), "cut-given")
    by_groups = given.count() > SMALL
    table = _in_order(given) if by_groups else written(_merged(given), "cut-edges")
    links = written(_linked(table), "links")
    label = components(links).select("node", F.col("label").alias("component"))
    dropped(given, links)
    place = written(label.select("component", "node", F.col("node").alias("label")), "cut-places")
    e, best, whole = table.where("src <> dst"), None, False
    for _ in range(most):
        # Merged nodes are named by one of them, so their components are known.
        degrees = written(_degrees(e).join(label, "node"), "degrees")
        # One node against the rest is a cut: the least of them bounds the least cut.
        single = degrees.groupBy("component").agg(F.min(F.struct(F.col("weight"), F.col("node"))).alias("m")).select("component", "m.weight", "m.node")
        sized = single.join(place.groupBy("component", F.col("label").alias("node")).agg(F.count("*").alias("side")), ["component", "node"])
        known = sized.select("component", "weight", "side") if best is None else best.unionByName(sized.select("component", "weight", "side")).groupBy("component").agg(F.min(F.struct("weight", "side")).alias("m")).select("component", "m.*")
        best = written(known, "cut-bounds")
        share, firm, kept = 1, None, e
        if by_groups:
            # One bound for all components: what the largest binds, each binds.
            bound = threshold if threshold is not None else best.agg(F.max("weight")).first()[0]
            met = written(_local(e, bound), "groups") if bound is not None else None
            if met is not None and not met.where("merged").isEmpty():
                firm, kept = met.where("merged").select("src", "dst"), met.where("NOT merged").select("src", "dst", "strength")
            else:
                by_groups, table2 = False, written(_merged(e), "cut-edges")
                dropped(table, *([] if met is None else [met]))
                table = e = kept = table2
        if firm is None:
            paths = degrees.where(F.col("n") <= MIDDLE).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0
            share = 1 if whole else max(1, min(SHARE, int(paths) // (2 * PATHS)))
            met = firm = written(_firm(e, degrees, best, threshold, share), "bonds")
            if share > 1 and firm.isEmpty():
                share, met = 1, written(_firm(e, degrees, best, threshold, 1), "bonds")
                dropped(firm)
                firm = met
            if firm.isEmpty():
                break
        to = components(firm)
        name = lambda k: to.select(F.col("node").alias(k), F.col("label").alias(f"to_{k}"))  # noqa: B023, E731
        moved = kept.join(name("src"), "src", "left").join(name("dst"), "dst", "left").select(F.coalesce("to_src", "src").alias("src"), F.coalesce("to_dst", "dst").alias("dst"), "strength")
        table2 = written(_merged(moved.where("src <> dst")), "cut-edges")
        place2 = written(place.join(to.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("component", "node", F.coalesce("to", "label").alias("label")), "cut-places")
        # A share, or groups, that merge little are not worth a further round: the next one takes all paths.
        n = table2.count()
        little = 2 * n > e.count()
        whole, by_groups = not by_groups and (share == 1 or little), by_groups and not little and n > SMALL
        if by_groups:
            given, table2 = table2, _in_order(table2)
            dropped(given)
        dropped(table, place, degrees, met, to)
        table, e, place = table2, table2, place2
        if e.isEmpty():
            break
    e = e.join(label.withColumnRenamed("node", "src"), "src").select("component", "src", "dst", "strength")
    large = e.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > FITS).select("component").first()
    if large:
        raise ValueError(f"component {large[0]} has too many nodes that no path of two edges binds")
    return e, place, best


def least_cuts(edges: DataFrame, most: int = 30) -> DataFrame:
    """(component, weight, smaller_side, nodes): the least cut of every component of (src, dst, strength >= 0), named by its least node.

    Of equal cuts that of a single merged node is given, the one with fewest nodes.
    """
    e, place, best = _closed(edges, None, most)
    n = place.groupBy("component").agg(F.count("*").alias("nodes"))
    out = best.join(n, "component").select("component", "weight", F.least("side", F.col("nodes") - F.col("side")).alias("smaller_side"), "nodes")
    if e.isEmpty():
        return out.withColumn("weight", F.round("weight", 6))
    sides = place.groupBy("component", "label").agg(F.count("*").alias("k"))
    inner = min_cut(e, "component", sides).withColumnsRenamed({"weight": "w", "smaller_side": "s"})
    j = out.join(inner, "component", "left")
    less = F.col("w") < F.col("weight") - 1e-9
    return j.select("component", F.round(F.when(less, F.col("w")).otherwise(F.col("weight")), 6).alias("weight"), F.when(less, F.col("s")).otherwise(F.col("smaller_side")).alias("smaller_side"), "nodes")


def clusters(edges: DataFrame, threshold: float, most: int = 30) -> DataFrame:
    """(component, cluster, node): components split at their least cut as long as that weighs less than a bound; clusters are named by their least node."""
    e, place, _ = _closed(edges, threshold, most)
    # Edges left lie between merged nodes; a component without any is one cluster.
    split = clustered_by_cut(e, "component", threshold).select(F.col("grp").alias("component"), F.col("node").alias("label"), F.col("cluster").alias("c"))
    j = place.join(split, ["component", "label"], "left").withColumn("c", F.coalesce("c", "label"))
    name = j.groupBy("component", "c").agg(F.min("node").alias("cluster"))
    return j.join(name, ["component", "c"]).select("component", "cluster", "node")
