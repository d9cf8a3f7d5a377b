"""Workflow rules over events: filters, scopes, resolution, graph checks, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import strong_components
from .steps import step

MAX_DEPTH = 5
NUMERIC = ("gt", "gte", "lt", "lte")


def event_type_filter(events: DataFrame, types: Sequence[str]) -> DataFrame:
    """``relation``: True or False by type, Failure if the event has none."""
    return events.withColumn("relation", F.when(F.col("event_type").isNull(), "Failure").when(F.col("event_type").isin(*types), "True").otherwise("False"))


def field_condition(path: str, op: str, value=None, payload: str = "props") -> Column:
    """One condition on a JSON payload; false where the field isn't there (``exists`` says so)."""
    text = F.get_json_object(payload, path)
    compare = {
        "eq": lambda: text == str(value),
        "ne": lambda: text != str(value),
        "contains": lambda: F.instr(text, str(value)) > 0,
        "in": lambda: text.isin(*[str(v) for v in value]),
        "exists": lambda: text.isNotNull(),
        "gt": lambda: text.try_cast("double") > float(value),
        "gte": lambda: text.try_cast("double") >= float(value),
        "lt": lambda: text.try_cast("double") < float(value),
        "lte": lambda: text.try_cast("double") <= float(value),
    }
    if op not in compare:
        raise ValueError(f"unknown operator: {op}")
    return F.coalesce(compare[op](), F.lit(False))


def field_fault(path: str, op: str, payload: str = "props") -> Column:
    """Whether a condition can't be judged: an order asked of a value that is no number."""
    text = F.get_json_object(payload, path)
    return text.isNotNull() & text.try_cast("double").isNull() if op in NUMERIC else F.lit(False)


def field_filter(events: DataFrame, conditions: Sequence[dict], payload: str = "props") -> DataFrame:
    """``relation`` True where all conditions {path, op, value} hold, Failure where one can't be
    judged or the payload is no JSON, else False."""
    every, fault = F.lit(True), F.get_json_object(payload, "$").isNull()
    for c in conditions:
        every = every & field_condition(c["path"], c["op"], c.get("value"), payload)
        fault = fault | field_fault(c["path"], c["op"], payload)
    return events.withColumn("relation", F.when(F.coalesce(fault, F.lit(True)), "Failure").when(every, "True").otherwise("False"))


def with_scope(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with the attributes of their user; unknown users have nulls."""
    return events.join(users, "user_id", "left")


def resolved_workflows(events: DataFrame, workflows: DataFrame) -> DataFrame:
    """Each event with its active workflows, shared by the tenant or of its organization, in order."""
    active = workflows.filter(F.col("status") == "ACTIVE").select("tenant", F.col("org").alias("owner"), "uuid", "priority", "updated_at", F.col("event_type").alias("on_type"))
    meets = (events["tenant"] == active["tenant"]) & (F.col("on_type") == F.col("event_type")) & (F.col("owner").isNull() | (F.col("owner") == F.col("org")))
    both = events.join(active, meets).drop(active["tenant"])
    order = Window.partitionBy("event_id").orderBy("priority", F.desc("updated_at"), "uuid")
    return both.withColumn("nth", F.row_number().over(order))


def call_chains(spark: SparkSession, calls: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """root, node, depth and cyclic for every chain of calls up to ``max_depth``.

    A chain that returns to a node of its own is marked and ends there.
    """
    now = calls.select(F.col("caller").alias("root"), F.col("callee").alias("node"), F.array("caller", "callee").alias("path"), (F.col("caller") == F.col("callee")).alias("cyclic"))
    out = now.withColumn("depth", F.lit(1))
    for depth in range(2, max_depth + 1):
        step = now.filter("NOT cyclic").join(calls, F.col("node") == F.col("caller"))
        now = step.select("root", F.col("callee").alias("node"), F.concat("path", F.array("callee")).alias("path"), F.array_contains("path", F.col("callee")).alias("cyclic"))
        out = out.unionByName(now.withColumn("depth", F.lit(depth)))
    return out.select("root", "node", "depth", "cyclic")


def cycles(edges: DataFrame) -> DataFrame:
    """graph and node of every node that leads back to itself."""
    edges = step(edges.select("graph", "source", "target"), "rules-edges")
    found = step(strong_components(edges), "rules-components")
    several = found.groupBy(F.to_json(F.struct("graph")).alias("__g"), "component").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    within = found.withColumn("__g", F.to_json(F.struct("graph"))).join(several, ["__g", "component"], "left_semi").select("graph", "node")
    return within.union(edges.filter("source = target").select("graph", "source")).distinct()


def graph_faults(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """graph, fault and place: no root, an edge to no node, a node on a cycle."""
    known = nodes.select("graph", "node")
    rootless = roots.join(known, ["graph", "node"], "left_anti").select("graph", F.lit("root missing").alias("fault"), F.col("node").alias("at"))
    ends = edges.select("graph", F.explode(F.array("source", "target")).alias("node")).distinct()
    loose = ends.join(known, ["graph", "node"], "left_anti").select("graph", F.lit("edge to no node").alias("fault"), F.col("node").alias("at"))
    turning = cycles(edges).select("graph", F.lit("cycle").alias("fault"), F.col("node").alias("at"))
    return rootless.unionByName(loose).unionByName(turning)


def execution_counters(runs: DataFrame) -> DataFrame:
    """Counts by state and mean duration of ended runs, for each workflow."""
    n = lambda state: F.count_if(F.col("state") == state).alias(state.lower())
    return runs.groupBy("workflow").agg(*[n(s) for s in ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED")], F.round(F.avg(F.when(F.col("state").isin("SUCCEEDED", "FAILED"), F.col("duration"))), 4).alias("avg_duration"))


def traces(relations: DataFrame, node: str) -> DataFrame:
    """Log rows of a node: what it decided for each event; the events themselves are unchanged."""
    return relations.select("event_id", F.lit(node).alias("node"), "relation")
