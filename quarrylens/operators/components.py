"""Strongly connected components of many graphs, small ones in a task each, large ones by rounds.

A graph of up to EDGES_IN_TASK edges is one group, solved in a task.  Larger graphs are reduced
together, by rounds over their edges:

1.  A node without a way in or out is a component of its own, and goes.
2.  A node with one way in only (or one way out only) is in its neighbour's component if it is in
    any larger one.  It is taken out, and its other edges are hung on the neighbour; a coin for each
    node and round sees to it that no two neighbours go at once.  Chains and rings so shrink by a
    constant share a round.  What was taken out is written, to be resolved from the end.
3.  What no longer shrinks is coloured: every node takes the least label that reaches it, and the
    nodes of a colour that lead back to its first node are a component.
4.  Nodes that were taken out belong to the neighbour's component if one of their edges leads into it.

No round has more rows than there are edges.  When what is left of a graph is small, a task ends it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import step

EDGES_IN_TASK = 200_000
MAX_ROUNDS = 400
FOUND = "node bigint, component bigint"


def tarjan(sources: list[int], targets: list[int]) -> dict[int, int]:
    """The least node of each node's component; without recursion."""
    out: dict[int, list[int]] = {}
    for s, t in zip(sources, targets):
        out.setdefault(s, []).append(t)
        out.setdefault(t, [])
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    component: dict[int, int] = {}
    open_: list[int] = []
    for root in out:
        if root in number:
            continue
        walk = [(root, iter(out[root]))]
        number[root] = low[root] = len(number)
        open_.append(root)
        while walk:
            node, rest = walk[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    open_.append(to)
                    walk.append((to, iter(out[to])))
                    break
                if to not in component:
                    low[node] = min(low[node], number[to])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(open_.pop())
                    least = min(members)
                    component.update(dict.fromkeys(members, least))
    return component


def _solved(part: pd.DataFrame) -> pd.DataFrame:
    found = tarjan(part["s"].tolist(), part["t"].tolist())
    return pd.DataFrame({"node": list(found), "component": list(found.values())}, dtype="int64")


def _shrunk(edges: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """Edges without the nodes that this round takes out; and for those (node, into, way): the
    neighbour they were hung on, and where one of their edges leads (or comes from)."""
    forward = number % 2 == 0  # by ways in, or by ways out
    rows = edges if forward else edges.select("g", F.col("t").alias("s"), F.col("s").alias("t"))
    sources = rows.groupBy(F.col("s").alias("v")).agg(F.lit(True).alias("leads"))
    single = rows.groupBy(F.col("t").alias("v")).agg(F.count("*").alias("n"), F.min("s").alias("u"))
    ends = single.join(sources, "v", "full_outer")
    loose = ends.filter("n IS NULL OR leads IS NULL").select("v")
    coin = lambda c: F.xxhash64(F.col(c), F.lit(number)) % 2 == 0
    chosen = single.filter((F.col("n") == 1) & coin("v") & ~coin("u")).join(loose, "v", "left_anti").join(loose.withColumnRenamed("v", "u"), "u", "left_anti").select("v", "u")
    rows = rows.join(loose.withColumnRenamed("v", "s"), "s", "left_anti").join(loose.withColumnRenamed("v", "t"), "t", "left_anti")
    rows = rows.join(chosen.select(F.col("v").alias("t"), F.lit(True).alias("gone")), "t", "left").filter("gone IS NULL").drop("gone")
    moved = step(rows.join(chosen.withColumnRenamed("v", "s"), "s", "left").select("g", "s", "t", "u"), "components-moved")
    removed = moved.filter("u IS NOT NULL").select(F.col("s").alias("node"), F.col("u").alias("into"), F.col("t").alias("way"))
    left = moved.select("g", F.coalesce("u", "s").alias("s"), "t").filter("s <> t").distinct()
    return step(left if forward else left.select("g", F.col("t").alias("s"), F.col("s").alias("t")), "components-edges"), removed


def _coloured(edges: DataFrame) -> DataFrame:
    """Components of edges of which none has an end with one way in or out only."""
    found = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("s").alias("v")).union(edges.select("t")).distinct()
        colour = step(nodes.withColumn("c", F.col("v")), "components-colours")
        while True:  # the least label that reaches a node
            came = edges.join(colour.withColumnRenamed("v", "s"), "s").groupBy(F.col("t").alias("v")).agg(F.min("c").alias("came"))
            now = step(colour.join(came, "v", "left").select("v", F.least("c", "came").alias("c"), (F.col("came") < F.col("c")).alias("changed")), "components-colours")
            colour, more = now.select("v", "c"), now.filter("changed").limit(1).count()
            if not more:
                break
        own = edges.join(colour.select(F.col("v").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("v").alias("t"), F.col("c").alias("ct")), "t")
        own = step(own.filter("cs = ct").select("s", "t"), "components-within")
        back = step(colour.filter("v = c"), "components-back")
        edge = back
        while True:  # nodes that lead back to their colour's first
            edge = own.join(edge.withColumnRenamed("v", "t"), "t").select(F.col("s").alias("v"), "c").distinct().join(back.select("v"), "v", "left_anti")
            edge = step(edge, "components-back")
            if edge.isEmpty():
                break
            back = step(back.unionByName(edge), "components-back")
        found = back if found is None else found.unionByName(back)
        edges = edges.join(back.select(F.col("v").alias("s")), "s", "left_anti").join(back.select(F.col("v").alias("t")), "t", "left_anti")
        edges = step(edges, "components-edges")
    return None if found is None else found.select(F.col("v").alias("node"), F.col("c").alias("component"))


def _by_rounds(edges: DataFrame, edges_in_task: int) -> DataFrame | None:
    """Components (node, component) of large graphs; nodes that are alone may be missing."""
    taken, found, small = [], None, []
    before = stalled = 0
    for number in range(MAX_ROUNDS):
        sizes = edges.groupBy("g").agg(F.count("*").alias("n"))
        little = sizes.filter(F.col("n") <= edges_in_task).select("g")
        done = step(edges.join(little, "g", "left_semi").groupBy("g").applyInPandas(_solved, FOUND), "components-found")
        small.append(done)
        edges = step(edges.join(little, "g", "left_anti"), "components-edges")
        n = edges.count()
        if not n:
            break
        stalled = stalled + 1 if number and n > 0.97 * before else 0
        if stalled == 4:
            break
        before = n
        edges, removed = _shrunk(edges, number)
        taken.append(removed)
    found = _coloured(edges)
    for part in small:
        found = part if found is None else found.unionByName(part)
    found = step(found, "components-known")
    for removed in reversed(taken):
        of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))  # noqa: B023, E731
        rows = removed.join(of("into"), "into", "left").join(of("way"), "way", "left")
        into, way = F.coalesce("into_in", "into"), F.coalesce("way_in", "way")
        same = rows.filter(into == way).select("node", "into", into.alias("component")).distinct()
        # a neighbour that was alone so far is in the component too
        found = step(found.unionByName(same.select("node", "component")).unionByName(same.select(F.col("into").alias("node"), "component")).distinct(), "components-known")
    return found


def strong_components(edges: DataFrame, edges_in_task: int | None = None) -> DataFrame:
    """graph, node and component (its least node) for every node of ``edges`` (graph, source, target).

    Null graphs are one graph; edges with a null end are left out.
    """
    edges_in_task = EDGES_IN_TASK if edges_in_task is None else edges_in_task
    edges = edges.select("graph", "source", "target").filter("source IS NOT NULL AND target IS NOT NULL").distinct()
    ends = edges.select("graph", F.explode(F.array("source", "target")).alias("name")).distinct()
    names = step(ends.select("graph", "name", F.monotonically_increasing_id().alias("node"), F.xxhash64(F.coalesce(F.to_json(F.struct("graph")), F.lit(""))).alias("g")), "components-names")
    end = lambda c: names.select("graph", F.col("name").alias(c), F.col("node").alias(c[0]), *(["g"] if c == "source" else []))
    on = lambda left, right, c: left.withColumn("__g", F.to_json(F.struct("graph"))).join(right.withColumn("__g", F.to_json(F.struct("graph"))).drop("graph"), ["__g", c]).drop("__g")
    known = step(on(on(edges, end("source"), "source"), end("target"), "target").filter("s <> t").select("g", "s", "t"), "components-edges")
    found = _by_rounds(known, edges_in_task)
    rows = names.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # a component's number may be that of any of its nodes: say it by the least name
    least = rows.groupBy("component").agg(F.min("name").alias("least"))
    return rows.join(least, "component").select("graph", F.col("name").alias("node"), F.col("least").alias("component"))
