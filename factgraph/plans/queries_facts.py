"""Queries over files, symbols, relations, impact and structure, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import text as T
from factgraph.operators import impact, locate, relations, structure
from factgraph.operators.answer import Answer, limited, numbered
from factgraph.plans.bridge import Facts

ALL: dict[str, tuple[Callable[[Facts], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Facts], DataFrame]):
        ALL[name] = (f, sql)
        return f

    return keep


# scans and predicates --------------------------------------------------------------------------


@query("S6_active_resources", "SELECT uid, path_key, role, kind FROM b_resource WHERE state = 'ACTIVE'")
def _(f):
    return locate.active(f("b_resource")).select("uid", "path_key", "role", "kind")


@query("S7_file_listing", "SELECT path_key, role, language FROM b_resource WHERE state = 'ACTIVE' AND starts_with(path_key, 'region1/') AND role = 'SOURCE' AND kind = 'FILE' ORDER BY path_key LIMIT 200")
def _(f):
    return limited(locate.list_files(f("b_resource"), directory="region1", role="SOURCE", kind="FILE"), ["path_key"], 200)[0].select("path_key", "role", "language")


@query("O1_listing_truncated", "SELECT count(*) > 200 AS truncated FROM b_resource WHERE state = 'ACTIVE' AND starts_with(path_key, 'region1/')")
def _(f):
    return limited(locate.list_files(f("b_resource"), directory="region1"), ["path_key"], 200)[1]


@query("P4_direct_children", "SELECT path_key FROM b_resource WHERE state = 'ACTIVE' AND starts_with(path_key, 'region2/') AND length(path_key) > 8 AND instr(substr(path_key, 9), '/') = 0")
def _(f):
    return locate.list_files(f("b_resource"), directory="region2", recursive=False).select("path_key")


@query("S8_locate_by_name", "SELECT uid, path_key, false AS exact FROM b_resource WHERE state = 'ACTIVE' AND split_part(path_key, '/', -1) = '17'")
def _(f):
    return locate.locate(f("b_resource"), name="17").select("uid", "path_key", "exact")


@query("S8_locate_by_path", "SELECT uid, path_key, true AS exact FROM b_resource WHERE state = 'ACTIVE' AND path_key = 'region1/nation1'")
def _(f):
    return locate.locate(f("b_resource"), path="region1/nation1").select("uid", "path_key", "exact")


_SYMBOLS = "SELECT s.*, r.path_key, s.revision = r.revision AS current FROM b_symbol s JOIN b_resource r ON r.uid = s.resource_uid AND r.state = 'ACTIVE'"


@query("S9_symbol_search", f"SELECT path_key, start_byte, name, uid, current FROM ({_SYMBOLS}) WHERE name = 'f17' AND kind IN ('CLASS', 'METHOD') AND path_key LIKE 'region1/%' ORDER BY path_key, start_byte, end_byte DESC, name, uid LIMIT 50")
def _(f):
    found = locate.search_symbols(f("b_symbol"), f("b_resource"), name="f17", kinds=("CLASS", "METHOD"), prefix="region1/")
    return limited(found, locate.symbol_order(), 50)[0].select("path_key", "start_byte", "name", "uid", "current")


@query("S9_symbol_partial", f"SELECT uid, qualified_name, path_key FROM ({_SYMBOLS}) WHERE contains(lower(qualified_name), 'm3.f1') OR contains(name, 'm3.f1')")
def _(f):
    return locate.search_symbols(f("b_symbol"), f("b_resource"), partial="M3.F1").select("uid", "qualified_name", "path_key")


@query("S10_current_split", f"SELECT current, count(*) AS n FROM ({_SYMBOLS}) GROUP BY current")
def _(f):
    return locate.search_symbols(f("b_symbol"), f("b_resource")).groupBy("current").agg(F.count("*").alias("n"))


@query("S11_symbol_at", """SELECT point_uid, symbol_uid FROM (SELECT o.uid AS point_uid, s.uid AS symbol_uid, row_number() OVER (PARTITION BY o.uid ORDER BY s.end_byte - s.start_byte, s.start_byte DESC, s.uid) AS k
FROM b_occurrence o JOIN b_symbol s ON s.resource_uid = o.resource_uid AND s.start_byte <= o.start_byte AND o.start_byte < s.end_byte) WHERE k = 1""")
def _(f):
    return locate.symbol_at(f("b_symbol"), f("b_occurrence").select(F.col("uid").alias("point_uid"), "resource_uid", F.col("start_byte").alias("offset")))


@query("S12_outline", f"SELECT uid, kind, name, row_number() OVER (ORDER BY start_byte, end_byte DESC, uid) AS place FROM ({_SYMBOLS}) WHERE current AND path_key IN (SELECT min(path_key) FROM b_resource WHERE path_key LIKE 'region%/customer/1%' AND state = 'ACTIVE')")
def _(f):
    path = f("b_resource").where("path_key LIKE 'region%/customer/1%' AND state = 'ACTIVE'").agg(F.min("path_key")).first()[0]
    return locate.outline(f("b_symbol"), f("b_resource"), path or "").select("uid", "kind", "name", "place")


@query("P1_prefix", "SELECT uid FROM b_resource WHERE path_key >= 'parts/Brand#1' AND path_key < 'parts/Brand#2'")
def _(f):
    return f("b_resource").where(F.startswith("path_key", F.lit("parts/Brand#1"))).select("uid")


@query("P2_exact_prefix", "SELECT uid FROM b_resource WHERE substr(path_key, 1, 9) = 'region1/n'")
def _(f):
    return f("b_resource").where(F.substr("path_key", F.lit(1), F.lit(9)) == "region1/n").select("uid")


@query("P3_ascii_contains", "SELECT uid FROM b_resource WHERE contains(translate(path_key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'brand#2')")
def _(f):
    return f("b_resource").where(T.contains_ascii(F.col("path_key"), "BRAND#2")).select("uid")


@query("P5_basename", "SELECT uid, split_part(path_key, '/', -1) AS name FROM b_resource")
def _(f):
    return f("b_resource").select("uid", T.basename(F.col("path_key")).alias("name"))


@query("P6_suffix_names", "SELECT uid FROM b_gap WHERE lookup_name = 'f5' OR lookup_name LIKE '%::f5' OR lookup_name LIKE '%.f5'")
def _(f):
    return f("b_gap").where(T.names_suffix(F.col("lookup_name"), F.lit("f5"))).select("uid")


@query("P7_null_safe", "SELECT a.uid FROM b_resource a WHERE a.language IS NOT DISTINCT FROM NULL AND a.role IS DISTINCT FROM 'SOURCE'")
def _(f):
    return f("b_resource").where(F.col("language").eqNullSafe(F.lit(None)) & ~F.col("role").eqNullSafe("SOURCE")).select("uid")


@query("P8_kind_filter", "SELECT uid FROM b_gap WHERE intended IN ('EXTENDS', 'CALLS') OR intended = 'INHERITANCE'")
def _(f):
    return f("b_gap").where(relations.kind_matches(F.col("intended"), ("EXTENDS", "CALLS"))).select("uid")


@query("P10_currentness", "SELECT CASE WHEN count(*) = 0 THEN 'NEVER_PUBLISHED' WHEN count(*) FILTER (freshness = 'DIRTY') > 0 THEN 'DIRTY' ELSE 'CURRENT' END AS currentness FROM b_structure")
def _(f):
    return locate.currentness(f("b_structure"))


_COVER = """SELECT r.uid, r.path_key, r.state, r.kind, r.language, coalesce(s.state, CASE WHEN r.language IN ('PYTHON', 'TYPESCRIPT', 'RUST', 'CSHARP') THEN 'COMPLETE' ELSE 'UNSUPPORTED' END) AS coverage,
  CASE WHEN s.basis_revision IS DISTINCT FROM r.revision THEN 'STALE' WHEN s.freshness = 'CURRENT' THEN 'FRESH' ELSE 'DIRTY' END AS fresh FROM b_resource r LEFT JOIN b_structure s ON s.resource_uid = r.uid"""


@query("P11_structural_coverage", f"SELECT uid, coverage FROM ({_COVER})")
def _(f):
    return locate.with_structure(f("b_resource"), f("b_structure")).select("uid", "coverage")


@query("P12_incomplete_coverage", f"SELECT path_key, coverage FROM ({_COVER}) WHERE state = 'ACTIVE' AND kind = 'FILE' AND language IS NOT NULL AND coverage <> 'COMPLETE'")
def _(f):
    out = locate.with_structure(locate.active(f("b_resource")), f("b_structure"))
    return out.where("kind = 'FILE' AND language IS NOT NULL AND coverage <> 'COMPLETE'").select("path_key", "coverage")


@query("P13_evidence_freshness", f"SELECT uid, fresh FROM ({_COVER})")
def _(f):
    return locate.with_structure(f("b_resource"), f("b_structure")).select("uid", "fresh")


@query("P14_support", f"SELECT uid, CASE coverage WHEN 'COMPLETE' THEN 'SUPPORTED' WHEN 'PARTIAL' THEN 'PARTIAL' WHEN 'CONTAINER_ONLY' THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS support FROM ({_COVER})")
def _(f):
    return locate.with_structure(f("b_resource"), f("b_structure")).select("uid", "support")


# joins and evidence ------------------------------------------------------------------------------

_SITES = "SELECT r.kind, r.source, r.target, o.uid AS occurrence, o.resource_uid, o.symbol_uid, o.start_byte, o.revision AS site_revision, f.path_key, f.revision AS file_revision FROM b_relation r JOIN b_occurrence o ON o.relation_kind = r.kind AND o.source = r.source AND o.target = r.target JOIN b_resource f ON f.uid = o.resource_uid"


@query("J1_evidence_sites", f"SELECT occurrence, e.kind, source, target, path_key, s.name AS symbol FROM ({_SITES}) e LEFT JOIN b_symbol s ON s.uid = e.symbol_uid")
def _(f):
    e = relations.evidence(f("b_relation"), f("b_occurrence"), f("b_resource"))
    s = f("b_symbol").select(F.col("uid").alias("symbol_uid"), F.col("name").alias("symbol"))
    return e.join(s, "symbol_uid", "left").select("occurrence", "kind", "source", "target", "path_key", "symbol")


@query("J2_gap_context", "SELECT g.uid, r.path_key, s.qualified_name, p.name AS parent FROM b_gap g JOIN b_resource r ON r.uid = g.resource_uid LEFT JOIN b_symbol s ON s.uid = g.symbol_uid LEFT JOIN b_symbol p ON p.uid = s.parent_uid")
def _(f):
    return relations.gap_context(f("b_gap"), f("b_resource"), f("b_symbol")).select("uid", "path_key", "qualified_name", "parent")


@query("J3_symbol_parent", "SELECT s.uid, r.path_key, p.uid AS parent FROM b_symbol s JOIN b_resource r ON r.uid = s.resource_uid LEFT JOIN b_symbol p ON p.uid = s.parent_uid")
def _(f):
    return locate.symbol_places(f("b_symbol"), f("b_resource")).select("uid", "path_key", "parent")


@query("J7_gaps_with_candidates", "SELECT uid FROM b_gap WHERE uid IN (SELECT gap_uid FROM b_candidate)")
def _(f):
    return relations.with_candidates(f("b_gap"), f("b_candidate")).select("uid")


@query("J8_orphan_relations", "SELECT kind, source, target FROM b_relation r WHERE NOT EXISTS (SELECT 1 FROM b_occurrence o WHERE o.relation_kind = r.kind AND o.source = r.source AND o.target = r.target)")
def _(f):
    return relations.orphans(f("b_relation"), f("b_occurrence"))


@query("J11_span_equality", "SELECT o.uid AS occurrence, g.uid AS gap FROM b_occurrence o JOIN b_gap g ON g.resource_uid = o.resource_uid AND g.start_byte = o.start_byte")
def _(f):
    return relations.at_same_start(f("b_occurrence"), f("b_gap"))


@query("J12_full_outer_diff", """SELECT coalesce(a.uid, b.uid) AS uid, CASE WHEN a.uid IS NULL THEN 'CREATE' WHEN b.uid IS NULL THEN 'DELETE' WHEN a.size <> b.size THEN 'MODIFY' ELSE 'SAME' END AS change
FROM (SELECT * FROM b_resource WHERE state = 'ACTIVE') a FULL JOIN (SELECT uid, size + CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END AS size FROM b_resource WHERE size % 13 <> 0) b ON a.uid = b.uid""")
def _(f):
    seen = f("b_resource").where("size % 13 <> 0").select("uid", (F.col("size") + F.when(F.col("size") % 3 == 0, 1).otherwise(0)).alias("size"))
    return locate.diff(locate.active(f("b_resource")), seen)


@query("J13_suffix_join", """SELECT w.want, count(r.uid) AS hits, CASE count(r.uid) WHEN 0 THEN 'EXTERNAL' WHEN 1 THEN 'INTERNAL' ELSE 'AMBIGUOUS' END AS outcome
FROM (SELECT DISTINCT concat('customer/', o_custkey % 40) AS want FROM orders UNION SELECT DISTINCT concat(l_partkey % 50, '') FROM lineitem) w LEFT JOIN b_resource r ON r.path_key = w.want OR ends_with(r.path_key, concat('/', w.want)) GROUP BY w.want""")
def _(f):
    want = f("orders").select(F.concat(F.lit("customer/"), (F.col("o_custkey") % 40).cast("string")).alias("want")).union(f("lineitem").select((F.col("l_partkey") % 50).cast("string"))).distinct()
    return locate.by_suffix(want, f("b_resource"))


@query("J14_dependent_owners", """SELECT DISTINCT o.resource_uid FROM b_relation r JOIN b_owner o ON o.entity = r.source WHERE r.target IN (SELECT uid FROM b_resource WHERE path_key LIKE 'parts/Brand#1%')
UNION SELECT g.resource_uid FROM b_gap g JOIN b_candidate c ON c.gap_uid = g.uid WHERE c.target IN (SELECT uid FROM b_resource WHERE path_key LIKE 'parts/Brand#1%')""")
def _(f):
    touched = f("b_resource").where(F.startswith("path_key", F.lit("parts/Brand#1"))).select(F.col("uid").alias("target"))
    return relations.dependents(f("b_relation"), f("b_owner"), f("b_gap"), f("b_candidate"), touched)


@query("J16_first_occurrence", "SELECT w.k, min_by(r.uid, r.path_key) AS uid FROM (SELECT DISTINCT CAST(o_orderkey % 60 AS VARCHAR) AS k FROM orders) w LEFT JOIN b_resource r ON split_part(r.path_key, '/', -1) = w.k AND r.state = 'ACTIVE' GROUP BY w.k")
def _(f):
    return locate.first_named(f("orders").select((F.col("o_orderkey") % 60).cast("string").alias("k")).distinct(), f("b_resource"))


# relations ---------------------------------------------------------------------------------------

@query("G1_outgoing", "SELECT kind, source, target FROM b_relation WHERE source = 'customer:1'")
def _(f):
    return relations.direct(f("b_relation"), "customer:1", True)


@query("G1_incoming_with_evidence", f"""SELECT kind, source, target, count(*) AS sites, CASE max(CASE WHEN site_revision <> file_revision THEN 2 WHEN s.freshness = 'CURRENT' THEN 0 ELSE 1 END) WHEN 0 THEN 'FRESH' WHEN 1 THEN 'DIRTY' ELSE 'STALE' END AS freshness,
 CASE max(CASE WHEN s.state = 'COMPLETE' THEN 0 WHEN s.state IN ('PARTIAL', 'CONTAINER_ONLY') THEN 1 ELSE 2 END) WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS support
FROM ({_SITES}) e LEFT JOIN b_structure s ON s.resource_uid = e.resource_uid WHERE target IN ('part:1', 'part:2', 'supplier:1') GROUP BY kind, source, target""")
def _(f):
    some = f("b_relation").where(F.col("target").isin("part:1", "part:2", "supplier:1"))
    return relations.summarised(relations.evidence(some, f("b_occurrence"), f("b_resource")), f("b_structure"))


@query("G2_callers", "SELECT source AS caller FROM b_relation WHERE target = 'part:5' AND kind = 'CALLS'")
def _(f):
    return relations.direct(f("b_relation"), "part:5", False, ("CALLS",)).select(F.col("source").alias("caller"))


@query("G2_importers", "SELECT source AS importer FROM b_relation WHERE target = 'customer:7' AND kind = 'IMPORTS'")
def _(f):
    return relations.direct(f("b_relation"), "customer:7", False, ("IMPORTS",)).select(F.col("source").alias("importer"))


@query("G3_type_relations", "SELECT kind, source FROM b_relation WHERE target = 'supplier:3' AND kind IN ('USES_TYPE', 'IMPLEMENTS', 'EXTENDS')")
def _(f):
    return relations.direct(f("b_relation"), "supplier:3", False, ("USES_TYPE", "IMPLEMENTS", "EXTENDS")).select("kind", "source")


@query("G4_gaps_of_resource", "SELECT uid, reason FROM b_gap WHERE resource_uid = 'customer:10' AND symbol_uid IS NULL")
def _(f):
    return relations.gaps_in(f("b_gap"), resource="customer:10").select("uid", "reason")


@query("G4_gaps_of_symbols", "SELECT g.uid, g.intended FROM b_gap g WHERE symbol_uid = 'order:33' AND intended IN ('CALLS', 'INHERITANCE')")
def _(f):
    return relations.gaps_in(f("b_gap"), symbol="order:33", kinds=("CALLS", "EXTENDS")).select("uid", "intended")


@query("G5_gaps_naming_target", "SELECT uid, reason FROM b_gap WHERE uid IN (SELECT gap_uid FROM b_candidate WHERE target = 'part:11')")
def _(f):
    return relations.gaps_naming(f("b_gap"), f("b_candidate"), "part:11").select("uid", "reason")


@query("G6_answer_limits", """SELECT o.resource_uid, array_to_string(list_filter([CASE WHEN count(*) FILTER (symbol_uid IS NOT NULL) > 0 THEN 'UNRESOLVED_REFERENCES' END, CASE WHEN count(*) FILTER (symbol_uid IS NULL) > 0 THEN 'UNATTRIBUTED_GAPS' END,
 CASE WHEN count(*) FILTER (reason = 'CONFIG') > 0 THEN 'STALE_EVIDENCE' END, 'REVERSE_SCOPE_NOT_ENUMERABLE'], lambda x: x IS NOT NULL), ',') AS limits FROM b_gap o GROUP BY o.resource_uid""")
def _(f):
    n = f("b_gap").groupBy("resource_uid").agg(F.count_if(F.col("symbol_uid").isNotNull()).alias("g"), F.count_if(F.col("symbol_uid").isNull()).alias("u"), F.count_if(F.col("reason") == "CONFIG").alias("s"))
    return n.select("resource_uid", F.array_join(relations.coverage_limits(False, F.col("g"), F.col("u"), F.col("s")), ",").alias("limits"))


@query("G7_callers_by_name", "SELECT DISTINCT resource_uid FROM b_gap WHERE lookup_name = 'f9' OR lookup_name LIKE '%::f9' OR lookup_name LIKE '%.f9'")
def _(f):
    return relations.callers_by_name(f("b_gap"), "f9")


@query("A8_coverage_counters", "SELECT intended, count(*) AS total, count(*) FILTER (truncated) AS cut, count(*) FILTER (symbol_uid IS NULL) AS unattributed FROM b_gap GROUP BY intended")
def _(f):
    return relations.gap_counters(f("b_gap"))


@query("A9_unattributed_gaps", "SELECT g.resource_uid, greatest(0, count(*) - coalesce(max(a.n), 0))::BIGINT AS unattributed FROM b_gap g LEFT JOIN (SELECT resource_uid, count(*) AS n FROM b_gap WHERE symbol_uid IS NOT NULL GROUP BY 1) a ON a.resource_uid = g.resource_uid GROUP BY g.resource_uid")
def _(f):
    return relations.unattributed(f("b_gap"))


@query("A11_limit_union", "SELECT intended, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM b_gap GROUP BY intended")
def _(f):
    return f("b_gap").groupBy("intended").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query("A12_keep_first", "SELECT lookup_name, min_by(uid, start_byte * 1000000 + length(uid)) AS n FROM (SELECT lookup_name, uid, start_byte, row_number() OVER (PARTITION BY lookup_name ORDER BY start_byte, uid) AS k FROM b_gap) WHERE k = 1 GROUP BY lookup_name")
def _(f):
    k = F.row_number().over(Window.partitionBy("lookup_name").orderBy("start_byte", "uid"))
    return f("b_gap").withColumn("k", k).where("k = 1").select("lookup_name", F.col("uid").alias("n"))


@query("O2_endpoint_order", "SELECT source, row_number() OVER (ORDER BY CASE split_part(source, ':', 1) WHEN 'customer' THEN 0 WHEN 'order' THEN 1 ELSE 2 END, source) AS place FROM (SELECT DISTINCT source FROM b_relation)")
def _(f):
    kind = F.split_part(F.col("source"), F.lit(":"), F.lit(1))
    rank = F.when(kind == "customer", 0).when(kind == "order", 1).otherwise(2)
    return numbered(f("b_relation").select("source").distinct().withColumn("rank", rank), ["rank", "source"]).drop("rank")


@query("O3_relation_order", "SELECT kind, source, target, row_number() OVER (ORDER BY kind, source, target) AS place FROM b_relation")
def _(f):
    return numbered(f("b_relation"), ["kind", "source", "target"])


@query("O4_candidate_cap", "SELECT gap_uid, target, place, n > 16 AS truncated FROM (SELECT gap_uid, target, row_number() OVER (PARTITION BY gap_uid ORDER BY target) AS place, count(*) OVER (PARTITION BY gap_uid) AS n FROM (SELECT DISTINCT gap_uid, target FROM b_candidate)) WHERE place <= 16")
def _(f):
    return relations.capped_candidates(f("b_candidate")).select("gap_uid", "target", F.col("place").cast("long").alias("place"), "truncated")


# impact ------------------------------------------------------------------------------------------

_IMPACT = """WITH RECURSIVE w AS (SELECT 'part:1' AS node, 0 AS depth UNION SELECT r.source, w.depth + 1 FROM w JOIN b_relation r ON r.target = w.node AND r.kind IN ('CALLS', 'OVERRIDES', 'IMPLEMENTS', 'USES_TYPE') WHERE w.depth < 3),
n AS (SELECT node, min(depth)::INTEGER AS depth FROM w GROUP BY node)"""


@query("G8_impact_depth3", f"{_IMPACT} SELECT node, depth FROM n")
def _(f):
    return impact.distances(f("b_relation"), "part:1", "PUBLIC_SIGNATURE")


@query("G8_impact_edges", f"{_IMPACT} SELECT r.kind, r.source, r.target, n.depth FROM n JOIN b_relation r ON r.target = n.node AND r.kind IN ('CALLS', 'OVERRIDES', 'IMPLEMENTS', 'USES_TYPE') WHERE n.depth < 3")
def _(f):
    return impact.traverse(f("b_relation"), "part:1", "PUBLIC_SIGNATURE").edges.select("kind", "source", "target", F.col("depth").cast("int").alias("depth"))


def _level(k: int) -> str:
    """SQL of one level of a walk cut at 120 nodes and 150 edges: its edges in order, running counts, new nodes."""
    return f"""h{k} AS (SELECT r.kind, r.source, r.target, f.place AS p FROM n{k - 1} f JOIN e r ON r.target = f.node),
o{k} AS (SELECT *, row_number() OVER (ORDER BY p, kind, source) AS i, row_number() OVER (PARTITION BY source ORDER BY p, kind) = 1 AND source NOT IN (SELECT node FROM a{k - 1}) AS new FROM h{k}),
c{k} AS (SELECT *, i + (SELECT edges FROM t{k - 1}) AS es, sum(new::INT) OVER (ORDER BY i) + (SELECT count(*) FROM a{k - 1}) AS ns FROM o{k}),
k{k} AS (SELECT * FROM c{k} WHERE NOT (SELECT stop FROM t{k - 1}) AND i < (SELECT coalesce(min(i), 9223372036854775807) FROM c{k} WHERE es > 150 OR ns > 120)),
n{k} AS (SELECT source AS node, {k} AS depth, target AS via, ns AS place FROM k{k} WHERE new), a{k} AS (SELECT * FROM a{k - 1} UNION ALL SELECT * FROM n{k}),
t{k} AS (SELECT (SELECT edges FROM t{k - 1}) + (SELECT count(*) FROM k{k}) AS edges, (SELECT stop FROM t{k - 1}) OR (SELECT count(*) FROM k{k}) < (SELECT count(*) FROM c{k}) AS stop)"""


@query("G8_impact_budget", f"""WITH e AS (SELECT kind, source, target FROM b_relation WHERE kind IN ('CALLS', 'OVERRIDES', 'IMPLEMENTS', 'USES_TYPE')),
n0 AS (SELECT 'part:1' AS node, 0 AS depth, NULL::VARCHAR AS via, 1 AS place), a0 AS (SELECT * FROM n0), t0 AS (SELECT 0 AS edges, false AS stop), {_level(1)}, {_level(2)}, {_level(3)}
SELECT node, depth::INTEGER AS depth, via, place::BIGINT AS place FROM a3""")
def _(f):
    """Cut at 120 nodes and 150 edges; tested against a walk node by node, too."""
    return impact.traverse(f("b_relation"), "part:1", "PUBLIC_SIGNATURE", impact.Budget(120, 150)).nodes


@query("G9_impact_continued", f"{_IMPACT} SELECT node, depth FROM n")
def _(f):
    page = impact.traverse(f("b_relation"), "part:1", "PUBLIC_SIGNATURE", impact.Budget(200, 400))
    return impact.traverse(f("b_relation"), "part:1", "PUBLIC_SIGNATURE", start=page).nodes.select("node", "depth") if page.truncated else page.nodes.select("node", "depth")


@query("G10_related_tests", f"{_IMPACT} SELECT o.resource_uid, r.path_key, min(n.depth) AS distance FROM n JOIN b_owner o ON o.entity = n.node JOIN b_resource r ON r.uid = o.resource_uid WHERE n.depth > 0 AND r.role = 'TEST' AND r.state = 'ACTIVE' GROUP BY 1, 2")
def _(f):
    return impact.related_tests(impact.distances(f("b_relation"), "part:1", "PUBLIC_SIGNATURE"), f("b_owner"), f("b_resource"))


@query("O7_test_order", f"{_IMPACT} SELECT resource_uid, distance FROM (SELECT o.resource_uid, min(n.depth) AS distance FROM n JOIN b_owner o ON o.entity = n.node JOIN b_resource r ON r.uid = o.resource_uid WHERE n.depth > 0 AND r.role = 'TEST' AND r.state = 'ACTIVE' GROUP BY 1) ORDER BY distance, resource_uid LIMIT 10")
def _(f):
    return impact.related_tests(impact.distances(f("b_relation"), "part:1", "PUBLIC_SIGNATURE"), f("b_owner"), f("b_resource")).select("resource_uid", "distance").orderBy("distance", "resource_uid").limit(10)


# structure ---------------------------------------------------------------------------------------

_GROUPED = "SELECT r.*, CASE WHEN instr(path_key, '/') > 0 THEN split_part(path_key, '/', 1) END AS g FROM b_resource r WHERE state = 'ACTIVE' AND kind = 'FILE'"
_EDGES = f"""SELECT DISTINCT r.kind, r.source, r.target, s.g AS sg, t.g AS tg FROM b_relation r JOIN (SELECT DISTINCT o.entity, x.g FROM b_owner o JOIN ({_GROUPED}) x ON x.uid = o.resource_uid) s ON s.entity = r.source
JOIN (SELECT DISTINCT o.entity, x.g FROM b_owner o JOIN ({_GROUPED}) x ON x.uid = o.resource_uid) t ON t.entity = r.target"""


def grouped(f: Facts) -> DataFrame:
    return locate.list_files(f("b_resource"), kind="FILE").withColumn("g", structure.by_depth(F.col("path_key"), "", 1))


def group_edges(f: Facts) -> DataFrame:
    return structure.edges(f("b_relation"), structure.entity_groups(grouped(f), f("b_owner")))


@query("A1_inventory", f"SELECT g, count(*) AS total, count(*) FILTER (s.state = 'COMPLETE') AS supported, count(*) FILTER (s.state IN ('PARTIAL', 'CONTAINER_ONLY')) AS partial, count(*) - count(*) FILTER (s.state IN ('COMPLETE', 'PARTIAL', 'CONTAINER_ONLY')) AS unsupported FROM ({_GROUPED}) r LEFT JOIN b_structure s ON s.resource_uid = r.uid GROUP BY g")
def _(f):
    return structure.inventory(grouped(f), f("b_structure"))


@query("A2_edge_counts", f"SELECT sg, tg, kind, count(*) AS n FROM ({_EDGES}) GROUP BY sg, tg, kind")
def _(f):
    return structure.edge_counts(group_edges(f))


@query("A4_internal_edges", f"SELECT sg AS g, count(DISTINCT kind || '>' || source || '>' || target) AS n FROM ({_EDGES}) WHERE sg IS NOT DISTINCT FROM tg GROUP BY sg")
def _(f):
    return group_edges(f).where(F.col("sg").eqNullSafe(F.col("tg"))).groupBy(F.col("sg").alias("g")).agg(F.countDistinct(F.concat_ws(">", "kind", "source", "target")).alias("n"))


@query("A5_fan_in_out", f"""WITH e AS (SELECT *, kind || '>' || source || '>' || target AS rid FROM ({_EDGES}) WHERE sg IS DISTINCT FROM tg), o AS (SELECT sg AS g, count(DISTINCT coalesce(tg, chr(1))) AS fan_out, count(DISTINCT rid) AS out_relations FROM e GROUP BY sg), i AS (SELECT tg AS g, count(DISTINCT coalesce(sg, chr(1))) AS fan_in, count(DISTINCT rid) AS in_relations FROM e GROUP BY tg)
SELECT coalesce(o.g, i.g) AS g, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in, coalesce(out_relations, 0) AS out_relations, coalesce(in_relations, 0) AS in_relations FROM o FULL JOIN i ON o.g IS NOT DISTINCT FROM i.g""")
def _(f):
    return structure.fan(group_edges(f))


@query("A6_gap_counts", f"SELECT x.g, intended, reason, count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM b_candidate c WHERE c.gap_uid = q.uid)) AS with_candidate, count(*) FILTER (truncated) AS cut FROM b_gap q JOIN ({_GROUPED}) x ON x.uid = q.resource_uid GROUP BY 1, 2, 3")
def _(f):
    return structure.gap_counts(f("b_gap"), grouped(f), f("b_candidate"))


@query("A7_owners_not_current", f"SELECT x.g, count(DISTINCT s.resource_uid) FILTER (s.freshness = 'DIRTY') AS dirty, count(*) FILTER (s.state = 'UNAVAILABLE') AS conflicts FROM ({_GROUPED}) x JOIN b_structure s ON s.resource_uid = x.uid GROUP BY x.g")
def _(f):
    j = grouped(f).select(F.col("uid").alias("resource_uid"), "g").join(f("b_structure"), "resource_uid")
    return j.groupBy("g").agg(F.countDistinct(F.when(F.col("freshness") == "DIRTY", F.col("resource_uid"))).alias("dirty"), F.count_if(F.col("state") == "UNAVAILABLE").alias("conflicts"))


_PIECES = ", ':', ".join(f"sum(CAST('0x' || substr(sha256(path_key), {i}, 15) AS BIGINT))" for i in (1, 16, 31, 46))


@query("A17_directory_fingerprint", f"SELECT g, sha256(concat(count(*), ':', {_PIECES})) AS fingerprint FROM ({_GROUPED}) GROUP BY g")
def _(f):
    return grouped(f).groupBy("g").agg(structure.inventory_fingerprint(F.col("path_key")).alias("fingerprint"))


@query("W1_member_sample", f"SELECT g, path_key, place FROM (SELECT g, path_key, row_number() OVER (PARTITION BY g ORDER BY path_key) AS place FROM ({_GROUPED})) WHERE place <= 5")
def _(f):
    return structure.sample(grouped(f), 5).select("g", "path_key", F.col("place").cast("long").alias("place"))


@query("G11_prefix_groups", "SELECT uid, CASE WHEN path_key LIKE 'region1/nation2/%' THEN 'n12' WHEN path_key LIKE 'region1/%' THEN 'r1' WHEN path_key LIKE 'parts/%' THEN 'parts' END AS g FROM b_resource")
def _(f):
    return f("b_resource").select("uid", structure.by_prefix(F.col("path_key"), {"region1/": "r1", "parts/": "parts", "region1/nation2/": "n12"}).alias("g"))


@query("G12_group_cycles", """WITH RECURSIVE p AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS src, CAST((l_partkey * 7 + l_suppkey) % 40 AS BIGINT) AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
c AS (SELECT src, dst FROM p WHERE src <> dst UNION SELECT c.src, p.dst FROM c JOIN p ON p.src = c.dst AND p.src <> p.dst)
SELECT a.src AS member, least(a.src, min(a.dst)) AS component FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src""")
def _(f):
    s = f("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("src"))
    return structure.cycles(f("lineitem").join(s, "l_suppkey").select("src", ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 40).cast("long").alias("dst")))


# sets --------------------------------------------------------------------------------------------

@query("U1_tagged_union", "SELECT 'gap' AS tag, count(*) AS n FROM b_gap UNION ALL SELECT 'relation', count(*) FROM b_relation")
def _(f):
    return f("b_gap").agg(F.count("*").alias("n")).select(F.lit("gap").alias("tag"), "n").unionByName(f("b_relation").agg(F.count("*").alias("n")).select(F.lit("relation").alias("tag"), "n"))


@query("U2_union_distinct", "SELECT resource_uid FROM b_gap UNION SELECT resource_uid FROM b_occurrence")
def _(f):
    return f("b_gap").select("resource_uid").union(f("b_occurrence").select("resource_uid")).distinct()


@query("U3_distinct", "SELECT DISTINCT kind, split_part(source, ':', 1) AS source_kind FROM b_relation")
def _(f):
    return f("b_relation").select("kind", F.substring_index("source", ":", 1).alias("source_kind")).distinct()


@query("U4_path_segments", "SELECT uid, array_to_string(list_slice(string_split(path_key, '/'), 1, d), '/') AS ancestor, d FROM b_resource, (SELECT unnest([1, 2, 3]) AS d) WHERE len(string_split(path_key, '/')) > d")
def _(f):
    parts = F.split("path_key", "/")
    out = f("b_resource").select("uid", parts.alias("p"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("d"))
    return out.where(F.size("p") > F.col("d")).select("uid", F.array_join(F.slice("p", F.lit(1), F.col("d")), "/").alias("ancestor"), "d")


@query("G6_answer_state", "SELECT CASE WHEN count(*) > 0 THEN 'CONFIRMED' ELSE 'NONE_WITH_INCOMPLETE_COVERAGE' END AS state FROM b_relation WHERE target = 'part:0'")
def _(f):
    """An incoming zero is never a safe negative: its limits are not empty."""
    rows = relations.direct(f("b_relation"), "part:0", False)
    limits = f.spark.createDataFrame([("REVERSE_SCOPE_NOT_ENUMERABLE",)], "name string")
    return Answer(rows, limits, limits.limit(0)).state()
