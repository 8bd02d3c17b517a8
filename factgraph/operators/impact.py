"""Bounded impact traversal over incoming relations, level by level."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators.answer import numbered
from factgraph.scratch import Scratch

#: The relation kinds that a change of each sort travels along.
PLANS = {
    "PUBLIC_SIGNATURE": ("CALLS", "OVERRIDES", "IMPLEMENTS", "USES_TYPE"),
    "RENAME": ("REFERENCES", "CALLS", "IMPORTS", "USES_TYPE"),
    "MODULE_MOVE": ("IMPORTS",),
    "BASE_INTERFACE": ("EXTENDS", "IMPLEMENTS", "OVERRIDES", "USES_TYPE"),
}


@dataclass(frozen=True)
class Budget:
    """None is no limit.  Seconds are looked at before each level."""

    nodes: int | None = None
    edges: int | None = None
    depth: int = 3
    seconds: float | None = None


@dataclass
class Impact:
    """nodes: (node, depth, via, place); edges: (kind, source, target, depth); both complete or cut.

    stopped: the budgets that ended the walk (NODES, EDGES, TIME, DEPTH); what a continuation is bound to.
    """

    nodes: DataFrame
    edges: DataFrame
    truncated: bool
    frontier: DataFrame
    stopped: tuple[str, ...] = ()
    bound: tuple[str, str, int] = ("", "", 0)


class Mismatch(ValueError):
    """A continuation of another root, change or depth."""


_NODES = "node string, depth int, via string, place long"
_ORDER = ("_p", "kind", "source")


def traverse(relations: DataFrame, root: str, change: str, budget: Budget = Budget(), start: Impact | None = None, clock: Callable[[], float] = time.monotonic) -> Impact:
    """Nodes that reach ``root`` and the edges on the way, in the order of a breadth-first walk.

    A level is one join.  Its edges stand in the order (place of the expanded node, kind, source); where a
    budget ends the walk is one row, found by a distributed top-k, so no task sees a whole level.  A node at the
    depth limit is emitted, not expanded.  ``start`` resumes a walk that was cut: what it has emitted is
    not emitted again, its frontier is expanded first, and the budget begins anew.  Edges and levels are
    written once, so a level is never computed again.
    """
    spark, began = relations.sparkSession, clock()
    scratch = Scratch(spark)
    bound = (root, change, budget.depth)
    if start is not None and start.bound != bound:
        raise Mismatch(f"continuation of {start.bound}, asked for {bound}")
    edges = scratch.write(relations.where(F.col("kind").isin(*PLANS[change])).select("kind", "source", "target"))
    if start is None:
        frontier = nodes = spark.createDataFrame([(root, 0, None, 1)], _NODES)
        walked = edges.select("kind", "source", "target", F.lit(0).alias("depth")).limit(0)
        n_nodes, last = 1, 1
    else:
        nodes, frontier, walked = start.nodes, start.frontier, start.edges
        n_nodes, last = 0, nodes.agg(F.max("place")).first()[0]
    n_edges, emitted = 0, None if start is None else start.edges.select("kind", "source", "target")
    while True:
        front = frontier.where(F.col("depth") < budget.depth)
        if front.isEmpty():
            break
        if budget.seconds is not None and clock() - began > budget.seconds:
            return Impact(nodes, walked, True, frontier, ("TIME",), bound)
        hit = edges.join(front.select(F.col("node").alias("target"), "depth", F.col("place").alias("_p")), "target")
        if emitted is not None:
            hit = hit.join(emitted, ["kind", "source", "target"], "left_anti")
        hit = scratch.write(hit.select("kind", "source", "target", "depth", "_p"))
        first = F.min_by(F.struct("_p", "kind", "source", "target", "depth"), F.struct(*_ORDER)).alias("f")
        found = hit.groupBy(F.col("source").alias("node")).agg(first).join(nodes.select("node"), "node", "left_anti")
        found = scratch.write(found.select("node", "f.*"))
        stops = []
        if budget.edges is not None:
            stops += [("EDGES", r) for r in hit.orderBy(*_ORDER).offset(budget.edges - n_edges).limit(1).collect()]  # one row
        if budget.nodes is not None:
            stops += [("NODES", r) for r in found.orderBy(*_ORDER).offset(budget.nodes - n_nodes).limit(1).collect()]  # one row
        why, stop = min(stops, key=lambda x: tuple(x[1][c] for c in _ORDER), default=(None, None))
        if stop is not None:
            before = F.struct(*_ORDER) < F.struct(F.lit(stop["_p"]).cast("long").alias("_p"), F.lit(stop["kind"]).alias("kind"), F.lit(stop["source"]).alias("source"))
            hit, found = hit.where(before), found.where(before)
        fresh = numbered(found, list(_ORDER), "place").select("node", (F.col("depth") + 1).cast("int").alias("depth"), F.col("target").alias("via"), (F.col("place") + last).alias("place"))
        fresh = scratch.write(fresh)
        n_edges, new = n_edges + hit.count(), fresh.count()
        n_nodes, last = n_nodes + new, last + new
        walked = walked.unionByName(hit.select("kind", "source", "target", "depth"))
        nodes = nodes.unionByName(fresh)
        if stop is not None:
            again = front.where(F.col("place") >= stop["_p"])
            return Impact(nodes, walked, True, again.unionByName(fresh), (why,), bound)
        frontier = fresh
    at_limit = not nodes.where(F.col("depth") >= budget.depth).isEmpty()
    return Impact(nodes, walked, at_limit, nodes.limit(0), ("DEPTH",) * at_limit, bound)


def distances(relations: DataFrame, root: str, change: str, depth: int = 3) -> DataFrame:
    """Nodes and their distance without budgets: a frontier join a level, no order needed."""
    scratch = Scratch(relations.sparkSession)
    edges = scratch.write(relations.where(F.col("kind").isin(*PLANS[change])).select(F.col("source").alias("node"), F.col("target").alias("_t")).distinct())
    seen = front = relations.sparkSession.createDataFrame([(root, 0)], "node string, depth int")
    for d in range(1, depth + 1):
        near = edges.join(front.select(F.col("node").alias("_t")), "_t").select("node").distinct()
        front = scratch.write(near.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def related_tests(nodes: DataFrame, owners: DataFrame, resources: DataFrame) -> DataFrame:
    """Test resources that own an affected node (other than the root), at the least distance."""
    tests = resources.where((F.col("role") == "TEST") & (F.col("state") == "ACTIVE")).select(F.col("uid").alias("resource_uid"), "path_key")
    own = nodes.where("depth > 0").join(owners.withColumnRenamed("entity", "node"), "node")
    return own.join(tests, "resource_uid").groupBy("resource_uid", "path_key").agg(F.min("depth").alias("distance"))
