"""Direct relations with evidence, gaps, and what limits an answer about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph import parts
from factgraph.functions.text import names_suffix, weakest

#: Order of weakness, and the cap on candidates of a gap.
FRESHNESS = ("FRESH", "DIRTY", "STALE")
SUPPORT = ("SUPPORTED", "PARTIAL", "UNSUPPORTED")
CANDIDATES = 16


def kind_matches(kind: Column, kinds: tuple[str, ...]) -> Column:
    """Whether an edge or intended kind is asked for; INHERITANCE stands for either of its two kinds."""
    if not kinds:
        return F.lit(True)
    return kind.isin(*kinds) | ((kind == "INHERITANCE") & F.lit(bool({"EXTENDS", "IMPLEMENTS"} & set(kinds))))


def direct(relations: DataFrame, endpoint: str, outgoing: bool, kinds: tuple[str, ...] = ()) -> DataFrame:
    end = "source" if outgoing else "target"
    return relations.where((F.col(end) == endpoint) & kind_matches(F.col("kind"), kinds))


def evidence(relations: DataFrame, occurrences: DataFrame, resources: DataFrame) -> DataFrame:
    """Evidence sites of relations: one row each, with the file's path and revision."""
    o = occurrences.select(F.col("relation_kind").alias("kind"), "source", "target", F.col("uid").alias("occurrence"), "resource_uid", "symbol_uid", "start_byte", "end_byte", F.col("revision").alias("site_revision"))
    r = resources.select(F.col("uid").alias("resource_uid"), "path_key", F.col("revision").alias("file_revision"))
    return relations.join(o, ["kind", "source", "target"]).join(r, "resource_uid")


def summarised(sites: DataFrame, structure: DataFrame) -> DataFrame:
    """Relations with their number of sites and the weakest freshness and support of them."""
    s = structure.select("resource_uid", F.col("state").alias("_state"), "freshness")
    out = sites.join(s, "resource_uid", "left")
    fresh = F.when(F.col("site_revision") != F.col("file_revision"), "STALE").when(F.col("freshness") == "CURRENT", "FRESH").otherwise("DIRTY")
    support = F.when(F.col("_state") == "COMPLETE", "SUPPORTED").when(F.col("_state").isin("PARTIAL", "CONTAINER_ONLY"), "PARTIAL").otherwise("UNSUPPORTED")
    return out.groupBy("kind", "source", "target").agg(F.count("*").alias("sites"), weakest(fresh, FRESHNESS).alias("freshness"), weakest(support, SUPPORT).alias("support"))


def gaps_in(gaps: DataFrame, resource: str | None = None, symbol: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Gaps directly inside an anchor: of a resource, only those outside every symbol."""
    hit = F.col("symbol_uid") == symbol if symbol is not None else (F.col("resource_uid") == resource) & F.col("symbol_uid").isNull()
    return gaps.where(hit & kind_matches(F.col("intended"), kinds))


def gaps_naming(gaps: DataFrame, candidates: DataFrame, endpoint: str) -> DataFrame:
    """Gaps that have the endpoint among their candidates."""
    return gaps.join(candidates.where(F.col("target") == endpoint).select(F.col("gap_uid").alias("uid")), "uid", "left_semi")


def callers_by_name(gaps: DataFrame, name: str) -> DataFrame:
    """Resources with an unresolved use whose name could mean ``name``."""
    return gaps.where(names_suffix(F.col("lookup_name"), F.lit(name))).select("resource_uid").distinct()


def capped_candidates(candidates: DataFrame) -> DataFrame:
    """Per gap its distinct candidates in order, the first 16, and whether there were more."""
    first = candidates.groupBy("gap_uid", "target").agg(F.min("arrival").alias("arrival"))
    place = F.row_number().over(Window.partitionBy("gap_uid").orderBy("target"))
    n = F.count("*").over(Window.partitionBy("gap_uid"))
    return first.withColumn("place", place).withColumn("truncated", n > CANDIDATES).where(F.col("place") <= CANDIDATES)


def coverage_limits(outgoing: bool, gaps: Column, unattributed: Column, stale: Column) -> Column:
    """Limits of an answer; an incoming answer never covers all places that could point here."""
    return F.array_compact(F.array(F.when(gaps > 0, "UNRESOLVED_REFERENCES"), F.when(unattributed > 0, "UNATTRIBUTED_GAPS"), F.when(stale > 0, "STALE_EVIDENCE"), F.when(F.lit(not outgoing), "REVERSE_SCOPE_NOT_ENUMERABLE")))


def gap_context(gaps: DataFrame, resources: DataFrame, symbols: DataFrame) -> DataFrame:
    """Gaps with the path of their file, the symbol they are in and the name of that symbol's parent (null without one)."""
    r = resources.select(F.col("uid").alias("resource_uid"), "path_key")
    s = symbols.select(F.col("uid").alias("symbol_uid"), "qualified_name", "parent_uid")
    p = symbols.select(F.col("uid").alias("parent_uid"), F.col("name").alias("parent"))
    n = parts.tasks(gaps, resources, symbols)
    return parts.join(parts.join(parts.join(gaps, r, ["resource_uid"], n), s, ["symbol_uid"], n, "left"), p, ["parent_uid"], n, "left")


def with_candidates(gaps: DataFrame, candidates: DataFrame) -> DataFrame:
    """Gaps that have a candidate."""
    n = parts.tasks(gaps, candidates)
    some = parts.deal(candidates.select(F.col("gap_uid").alias("uid")), n, "uid").distinct()
    return parts.deal(gaps, n, "uid").join(some, "uid", "left_semi")


def orphans(relations: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Relations that no occurrence gives evidence of."""
    sites = occurrences.select(F.col("relation_kind").alias("kind"), "source", "target")
    return relations.join(sites, ["kind", "source", "target"], "left_anti")


def at_same_start(occurrences: DataFrame, gaps: DataFrame) -> DataFrame:
    """(occurrence, gap) that begin at one place of one file."""
    g = gaps.select(F.col("uid").alias("gap"), "resource_uid", "start_byte")
    return occurrences.join(g, ["resource_uid", "start_byte"]).select(F.col("uid").alias("occurrence"), "gap")


def dependents(relations: DataFrame, owners: DataFrame, gaps: DataFrame, candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Resources (resource_uid) that own the source of a relation to a target (target), or have a gap that may mean one."""
    direct = relations.join(targets, "target", "left_semi").select(F.col("source").alias("entity")).join(owners, "entity").select("resource_uid")
    named = candidates.join(targets, "target", "left_semi").select(F.col("gap_uid").alias("uid"))
    return direct.unionByName(gaps.join(named, "uid", "left_semi").select("resource_uid")).distinct()


def invalidated(relations: DataFrame, owners: DataFrame, gaps: DataFrame, candidates: DataFrame, touched: DataFrame, inventory_changed: bool) -> DataFrame:
    """Resources whose relations a change of entities (target) makes doubtful: their dependents, and if the inventory
    has changed those with an import that was not found."""
    out = dependents(relations, owners, gaps, candidates, touched)
    lost = gaps.where("intended = 'IMPORTS' AND reason = 'NOT_FOUND'").select("resource_uid")
    return out.unionByName(lost).distinct() if inventory_changed else out


def unattributed(gaps: DataFrame) -> DataFrame:
    """Per resource the gaps outside every symbol."""
    return gaps.groupBy("resource_uid").agg(F.greatest(F.lit(0), F.count("*") - F.count("symbol_uid")).cast("long").alias("unattributed"))


def gap_counters(gaps: DataFrame) -> DataFrame:
    """Per intended kind: gaps, those whose candidates were cut, those outside every symbol."""
    return gaps.groupBy("intended").agg(F.count("*").alias("total"), F.count_if("truncated").alias("cut"), F.count_if(F.col("symbol_uid").isNull()).alias("unattributed"))
