"""Structural summaries: grouping, boundary edges, fan, gaps, samples and cycles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph import parts
from factgraph.scratch import Scratch


def by_prefix(path: Column, rules: dict[str, str]) -> Column:
    """Label of the longest prefix that fits, then the first label; null if none does."""
    out = F.lit(None).cast("string")
    for prefix, label in sorted(rules.items(), key=lambda x: (len(x[0]), [-ord(c) for c in x[0]])):
        out = F.when(F.startswith(path, F.lit(prefix)), label).otherwise(out)
    return out


def by_depth(path: Column, root: str, depth: int) -> Column:
    """The first ``depth`` directories below root; null for paths that are not deep enough."""
    rest = path if not root else F.substr(path, F.lit(len(root) + 2))
    parts = F.split(rest, "/")
    inside = F.lit(True) if not root else F.startswith(path, F.lit(root + "/"))
    return F.when(inside & (F.size(parts) > depth), F.array_join(F.slice(parts, 1, depth), "/"))


def inventory(grouped: DataFrame, structure: DataFrame) -> DataFrame:
    """Per group: resources, those with full, partial and no support."""
    s = structure.select(F.col("resource_uid").alias("uid"), F.col("state").alias("s"))
    n = grouped.join(s, "uid", "left").groupBy("g").agg(F.count("*").alias("total"), F.count_if(F.col("s") == "COMPLETE").alias("supported"), F.count_if(F.col("s").isin("PARTIAL", "CONTAINER_ONLY")).alias("partial"))
    return n.withColumn("unsupported", F.col("total") - F.col("supported") - F.col("partial"))


def entity_groups(grouped: DataFrame, owners: DataFrame) -> DataFrame:
    """(entity, g): groups of the resources that own an entity."""
    g = grouped.select(F.col("uid").alias("resource_uid"), "g")
    return parts.join(owners, g, ["resource_uid"], parts.tasks(owners, grouped)).select("entity", "g").distinct()


def edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations between groups, both ends in scope: (kind, source, target, sg, tg), no two alike.

    entities: distinct (entity, g).  Then relations are made distinct before the joins, where they are narrower.
    """
    n = parts.tasks(relations, entities)
    s = entities.select(F.col("entity").alias("source"), F.col("g").alias("sg"))
    t = entities.select(F.col("entity").alias("target"), F.col("g").alias("tg"))
    r = relations.select("kind", "source", "target").distinct()
    return parts.join(parts.join(r, s, ["source"], n), t, ["target"], n).select("kind", "source", "target", "sg", "tg")


def edge_counts(e: DataFrame) -> DataFrame:
    return e.groupBy("sg", "tg", "kind").agg(F.count("*").alias("n"))


def fan(e: DataFrame) -> DataFrame:
    """Per group the number of other groups it reaches and is reached from, and of relations each way."""
    across = e.where(~F.col("sg").eqNullSafe(F.col("tg"))).withColumn("rid", F.concat_ws(">", "kind", "source", "target"))
    out = across.groupBy(F.col("sg").alias("g")).agg(F.countDistinct(F.coalesce("tg", F.lit("\x00"))).alias("fan_out"), F.countDistinct("rid").alias("out_relations"))
    into = across.groupBy(F.col("tg").alias("h")).agg(F.countDistinct(F.coalesce("sg", F.lit("\x00"))).alias("fan_in"), F.countDistinct("rid").alias("in_relations"))
    both = out.join(into, F.col("g").eqNullSafe(F.col("h")), "full")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_out", "fan_in", "out_relations", "in_relations")]
    return both.select(F.coalesce("g", "h").alias("g"), *zero)


def gap_counts(gaps: DataFrame, grouped: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per group, intended kind and reason: gaps, those with a candidate, those cut."""
    has = candidates.select(F.col("gap_uid").alias("uid")).distinct().withColumn("has", F.lit(True))
    g = gaps.join(grouped.select(F.col("uid").alias("resource_uid"), "g"), "resource_uid").join(has, "uid", "left")
    return g.groupBy("g", "intended", "reason").agg(F.count("*").alias("total"), F.count_if(F.col("has")).alias("with_candidate"), F.count_if("truncated").alias("cut"))


def sample(grouped: DataFrame, n: int) -> DataFrame:
    """The first n members of each group by path."""
    place = F.row_number().over(Window.partitionBy("g").orderBy("path_key"))
    return grouped.withColumn("place", place).where(F.col("place") <= n)


#: Edges of a group graph that one task may hold (some 100 bytes each); a larger graph is coloured by joins.
ONE_TASK_EDGES = 1_000_000


def cycles(pairs: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """Groups (src, dst edges) that reach one another: (member, component), components of two and more, named by
    their least member.

    Edges are made distinct first.  If a count proves them few, one task finds the components; else
    colours do, by joins alone: the result is the same.  No table of reachable pairs is made.
    """
    scratch = Scratch(pairs.sparkSession)
    e = scratch.write(pairs.where("src <> dst").select("src", "dst").distinct())
    if e.limit(one_task_edges + 1).count() > one_task_edges:
        return _coloured(e, scratch)
    kind = e.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True)]
        found = [(m, min(c)) for c in strong_components(rows) if len(c) > 1 for m in c]
        value = pa.string() if kind == "string" else pa.from_numpy_dtype({"bigint": "int64", "int": "int32"}[kind])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], value) for k in (0, 1)], ["member", "component"])

    e = e if kind in ("string", "bigint", "int") else e.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    kind = kind if kind in ("bigint", "int") else "string"
    return e.coalesce(1).mapInArrow(run, f"member {kind}, component {kind}")


def strong_components(edges: list[tuple]) -> list[list]:
    """Strongly connected components of a graph in memory, without recursion."""
    out_of: dict = {}
    for a, b in edges:
        out_of.setdefault(a, []).append(b)
        out_of.setdefault(b, [])
    seen, low, on, stack, found = {}, {}, set(), [], []
    for start in out_of:
        if start in seen:
            continue
        seen[start] = low[start] = len(seen)
        stack.append(start)
        on.add(start)
        work = [(start, iter(out_of[start]))]
        while work:
            v, rest = work[-1]
            w = next((w for w in rest if w not in seen or w in on), None)
            if w is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == seen[v]:
                    own = []
                    while not own or own[-1] != v:
                        own.append(stack.pop())
                    found.append(own)
                    on.difference_update(own)
            elif w in seen:
                low[v] = min(low[v], seen[w])
            else:
                seen[w] = low[w] = len(seen)
                stack.append(w)
                on.add(w)
                work.append((w, iter(out_of[w])))
    return found


def _coloured(e: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node takes the least node that reaches it as its colour; the nodes of a colour that reach back to the
    node it is named after are its component.  What is left goes on, edges inside a colour only."""
    done = None
    while not e.isEmpty():
        colour = scratch.write(e.select(F.col("src").alias("v")).union(e.select("dst")).distinct().withColumn("c", F.col("v")))
        while True:
            near = e.join(colour.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("m"))
            new = scratch.write(colour.join(near, "v", "left").select("v", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            colour = new.select("v", "c")
            if new.where("moved").isEmpty():
                break
        ends = [colour.select(F.col("v").alias(x), F.col("c").alias(f"c_{x}")) for x in ("src", "dst")]
        inside = scratch.write(e.join(ends[0], "src").join(ends[1], "dst").where("c_src = c_dst").select("src", "dst", F.col("c_src").alias("c")))
        front = back = colour.where("v = c")
        while True:
            front = scratch.write(inside.join(front.select(F.col("v").alias("dst")), "dst", "left_semi").select(F.col("src").alias("v"), "c").distinct().join(back, "v", "left_anti"))
            if front.isEmpty():
                break
            back = back.unionByName(front)
        back = scratch.write(back)
        done = back if done is None else done.unionByName(back)
        e = scratch.write(inside.join(back.select(F.col("v").alias("src")), "src", "left_anti").join(back.select(F.col("v").alias("dst")), "dst", "left_anti").select("src", "dst"))
    several = done.groupBy("c").count().where("count > 1").select("c")
    return done.join(several, "c", "left_semi").select(F.col("v").alias("member"), F.col("c").alias("component"))


def inventory_fingerprint(path: Column) -> Column:
    """Aggregate: a digest of a set of paths that does not depend on their order.

    The digest of each path is added in four pieces, so a group of any size is one fixed-size sum.
    """
    pieces = [F.sum(F.conv(F.substr(F.sha2(path, 256), F.lit(i), F.lit(15)), 16, 10).cast("decimal(38,0)")).cast("string") for i in (1, 16, 31, 46)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *pieces), 256)


def first_paths(edges: DataFrame, n: int) -> DataFrame:
    """(node, path, place): of the paths of two edges (source, target) from each node the first n by name.

    Only the first n ends of a middle and the first n middles of a node can be in them, so each is cut
    before the two meet: a hub's paths are never listed.
    """
    e = edges.select("source", "target").distinct()
    best = lambda df, by, order: df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_k") <= n).drop("_k")
    ends = best(e.select(F.col("source").alias("mid"), F.col("target").alias("end")), "mid", F.col("end"))
    into = e.select(F.col("source").alias("node"), F.col("target").alias("mid")).join(ends.select("mid").distinct(), "mid", "left_semi")
    paths = best(into, "node", F.concat("mid", F.lit(">"))).join(ends, "mid").select("node", F.concat_ws(">", "node", "mid", "end").alias("path"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("path"))
    return paths.withColumn("place", place.cast("long")).where(F.col("place") <= n)


#: Bounds of a request.
MOST_RULES, MOST_LABEL_BYTES, MOST_PREFIX_BYTES, MOST_DEPTH, MOST_SAMPLE = 64, 128, 512, 16, 64


class InvalidRequest(ValueError):
    """A request that has no defined answer."""


@dataclass(frozen=True)
class Grouping:
    """Exactly one of: prefix rules (prefix -> label), directory depth below ``root``, or a column (role, language, kind)."""

    rules: dict[str, str] | None = None
    depth: int | None = None
    root: str = ""
    column: str | None = None

    def check(self) -> None:
        if sum(x is not None for x in (self.rules, self.depth, self.column)) != 1:
            raise InvalidRequest("name exactly one grouping")
        if self.column is not None and self.column not in ("role", "language", "kind"):
            raise InvalidRequest(f"no grouping by {self.column}")
        if self.depth is not None and not 1 <= self.depth <= MOST_DEPTH:
            raise InvalidRequest(f"depth is 1 to {MOST_DEPTH}")
        check_path(self.root, empty=True)
        if self.rules is not None:
            if not 1 <= len(self.rules) <= MOST_RULES:
                raise InvalidRequest(f"1 to {MOST_RULES} rules")
            plain = [p.rstrip("/") for p in self.rules]
            if len(set(plain)) < len(plain):
                raise InvalidRequest("two rules have the same prefix")
            for prefix, label in self.rules.items():
                check_path(prefix)
                if not label or len(label.encode()) > MOST_LABEL_BYTES:
                    raise InvalidRequest(f"labels have 1 to {MOST_LABEL_BYTES} bytes")

    def key(self) -> Column:
        if self.rules is not None:
            return by_prefix(F.col("path_key"), self.rules)
        return by_depth(F.col("path_key"), self.root, self.depth) if self.depth is not None else F.col(self.column)


def check_path(path: str, empty: bool = False) -> None:
    """Paths are relative, inside the root, with slashes and without drives."""
    if not path and empty:
        return
    if not path or len(path.encode()) > MOST_PREFIX_BYTES:
        raise InvalidRequest(f"prefixes have 1 to {MOST_PREFIX_BYTES} bytes")
    parts = path.rstrip("/").split("/")
    if path.startswith("/") or "\\" in path or "\0" in path or path[1:2] == ":" or any(x in ("", ".", "..") for x in parts):
        raise InvalidRequest(f"not a path below the root: {path}")


@dataclass(frozen=True)
class Summary:
    """The tables of a structural summary; ``cycles`` is None if not asked for."""

    groups: DataFrame
    samples: DataFrame
    edges: DataFrame
    gaps: DataFrame
    cycles: DataFrame | None


def summary(resources: DataFrame, structures: DataFrame, owners: DataFrame, relations: DataFrame, gaps: DataFrame, candidates: DataFrame, grouping: Grouping, members: int = 5, ungrouped: bool = True, with_cycles: bool = False, scope: str = "") -> Summary:
    """A structural summary of the active files below ``scope``, grouped one way.

    groups: per group its inventory, internal edges, fan and relations both ways; a null group is what
    no rule groups, and is left out last, after fan-in and fan-out have counted it.  The edges between groups
    are written once, since each table reads them.
    """
    grouping.check()
    check_path(scope, empty=True)
    if not 0 <= members <= MOST_SAMPLE:
        raise InvalidRequest(f"0 to {MOST_SAMPLE} members a sample")
    scratch = Scratch(resources.sparkSession)
    files = resources.where((F.col("state") == "ACTIVE") & (F.col("kind") == "FILE"))
    files = files.where(F.startswith("path_key", F.lit(scope.rstrip("/") + "/"))) if scope else files
    grouped = scratch.write(files.withColumn("g", grouping.key()).select("uid", "path_key", "g"))
    e = scratch.write(edges(relations, entity_groups(grouped, owners)))
    inside = e.where(F.col("sg").eqNullSafe(F.col("tg"))).groupBy(F.col("sg").alias("h")).agg(F.countDistinct(F.concat_ws(">", "kind", "source", "target")).alias("internal"))
    f = fan(e).withColumnRenamed("g", "i")
    out = inventory(grouped, structures).join(inside, F.col("g").eqNullSafe(F.col("h")), "left").join(f, F.col("g").eqNullSafe(F.col("i")), "left").drop("h", "i").fillna(0, ["internal", "fan_in", "fan_out", "in_relations", "out_relations"])
    keep = (lambda df, *names: df) if ungrouped else (lambda df, *names: df.dropna(subset=list(names)))
    loops = cycles(e.where("sg IS NOT NULL AND tg IS NOT NULL").select(F.col("sg").alias("src"), F.col("tg").alias("dst"))) if with_cycles else None
    across = edge_counts(e.where(~F.col("sg").eqNullSafe(F.col("tg"))))
    return Summary(keep(out, "g"), keep(sample(grouped, members), "g"), keep(across, "sg", "tg"), keep(gap_counts(gaps, grouped, candidates), "g"), loops)
