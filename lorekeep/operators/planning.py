"""Plans over steps and actions, and batches that failed: state search by frontiers, replay with a bound on tries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def planned(actions: DataFrame, start: int, goal: int, most: int = 20) -> DataFrame:
    """(plan, cost): the cheapest sequence of actions (name, needs, adds, removes, cost) from a state to one with all bits of the goal.

    A state is a set of facts as bits. Each round applies every possible action to every state of the frontier and keeps the
    cheapest way to each state, of equal ones the first by name; states reached more cheaply before are not opened again.
    """
    spark = actions.sparkSession
    actions = written(actions, "actions")
    a = F.broadcast(actions)  # the actions of a planner: at most one for each set of needs, additions and removals
    front = spark.createDataFrame([(start, 0.0, "")], "state long, cost double, plan string")
    best = front
    for _ in range(most):
        step = front.join(a, F.col("state").bitwiseAND(F.col("needs")) == F.col("needs"))
        plan = F.when(F.col("plan") == "", F.col("name")).otherwise(F.concat_ws(">", "plan", "name"))
        new = step.select(F.col("state").bitwiseOR(F.col("adds")).bitwiseAND(F.bitwise_not(F.col("removes"))).alias("state"), (front["cost"] + actions["cost"]).alias("cost"), plan.alias("plan"))
        new = new.groupBy("state").agg(F.min(F.struct("cost", "plan")).alias("x")).select("state", "x.cost", "x.plan")
        known = best.select("state", F.col("cost").alias("c"), F.col("plan").alias("p"))
        better = F.col("c").isNull() | (F.struct("cost", "plan") < F.struct(F.col("c").alias("cost"), F.col("p").alias("plan")))
        front = written(new.join(known, "state", "left").where(better).select("state", "cost", "plan"), "front")
        if front.isEmpty():
            break
        merged = best.unionByName(front).groupBy("state").agg(F.min(F.struct("cost", "plan")).alias("x")).select("state", "x.cost", "x.plan")
        best = written(merged, "states")
    done = best.where(F.col("state").bitwiseAND(F.lit(goal).cast("long")) == goal)
    return done.orderBy("cost", "plan").limit(1).select("plan", "cost")


def replayed_letters(letters: DataFrame, works, most: int = 3, batch: int | None = None) -> DataFrame:
    """Entries (id, tries, payload) after one replay: status succeeded, failed (one try more) or abandoned (no try left), the oldest first.

    works: a condition on the payload under which a write succeeds. Entries with no try left are not looked at.
    """
    ready = letters.where(F.col("tries") < most)
    if batch is not None:
        ready = ready.orderBy("id").limit(batch)
    tries = F.col("tries") + 1
    status = F.when(F.coalesce(works, F.lit(False)), "succeeded").when(tries < most, "failed").otherwise("abandoned")
    return ready.select("id", status.alias("status"), tries.alias("tries"))


def clustered_by_cut(edges: DataFrame, group: str, threshold: float) -> DataFrame:
    """(group, cluster, node): a group's nodes split at its least cut as long as that weighs less than a bound; a group must fit a task.

    A cluster is named by its least node.
    """

    def least_cut(nodes, w):
        """The least cut of some nodes, by merging the two that were reached last until one is left."""
        merged, best, side = {v: [v] for v in nodes}, float("inf"), []
        left_w = {v: {u: x for u, x in w[v].items() if u in merged} for v in nodes}
        while len(left_w) > 1:
            reach, order = dict.fromkeys(sorted(left_w), 0.0), []
            while reach:
                v = max(reach, key=lambda x: (reach[x], -x))
                last = reach.pop(v)
                order.append(v)
                for u, x in left_w[v].items():
                    if u in reach:
                        reach[u] += x
            s, t = order[-2], order[-1]
            if last < best - 1e-12:
                best, side = last, list(merged[t])
            for u, x in left_w.pop(t).items():
                left_w[u].pop(t, None)
                if u != s:
                    left_w[s][u] = left_w[s].get(u, 0.0) + x
                    left_w[u][s] = left_w[u].get(s, 0.0) + x
            merged[s] += merged.pop(t)
        return best, set(side)

    def split(rows):
        import pandas as pd

        w: dict[int, dict[int, float]] = {}
        for a, b, s in zip(rows["src"], rows["dst"], rows["strength"], strict=True):
            if a != b:
                w.setdefault(a, {})[b] = w.get(a, {}).get(b, 0.0) + s
                w.setdefault(b, {})[a] = w.get(b, {}).get(a, 0.0) + s
        open_, out = [sorted(w)] if w else [], []
        while open_:
            nodes = open_.pop()
            cut, side = least_cut(nodes, w) if len(nodes) > 1 else (float("inf"), set())
            if cut < threshold:
                open_ += [sorted(side), sorted(set(nodes) - side)]
            else:
                out += [(int(rows[group].iloc[0]), int(min(nodes)), int(v)) for v in nodes]
        return pd.DataFrame(out, columns=["grp", "cluster", "node"])

    return edges.groupBy(group).applyInPandas(split, "grp long, cluster long, node long")


