"""Further queries: steps of larger operators that are useful by themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions.text import weakest
from factgraph.operators import answer, delivery, relations, resolve_code, store, structure
from factgraph.plans.bridge import Facts
from factgraph.plans.queries_code import _LINES
from factgraph.plans.queries_facts import _EDGES, _GROUPED, group_edges, grouped
from factgraph.sources import python_code, records

ALL: dict[str, tuple[Callable[[Facts], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Facts], DataFrame]):
        ALL[name] = (f, sql)
        return f

    return keep


@query("A3_cross_totals", f"SELECT sg AS g, count(DISTINCT kind || '>' || source || '>' || target) AS n FROM ({_EDGES}) WHERE sg IS DISTINCT FROM tg GROUP BY sg")
def _(f):
    across = group_edges(f).where(~F.col("sg").eqNullSafe(F.col("tg")))
    return across.groupBy(F.col("sg").alias("g")).agg(F.count_distinct(F.concat_ws(">", "kind", "source", "target")).alias("n"))


@query("A10_weakest_freshness", "SELECT state, CASE max(CASE freshness WHEN 'CURRENT' THEN 0 ELSE 1 END) WHEN 0 THEN 'FRESH' ELSE 'DIRTY' END AS freshness FROM b_structure GROUP BY state")
def _(f):
    fresh = F.when(F.col("freshness") == "CURRENT", "FRESH").otherwise("DIRTY")
    return f("b_structure").groupBy("state").agg(weakest(fresh, relations.FRESHNESS).alias("freshness"))


@query("J4_group_components", f"SELECT g, count(*) AS files, count(a.resource_uid) AS dirty, count(b.resource_uid) AS unavailable FROM ({_GROUPED}) x LEFT JOIN (SELECT resource_uid FROM b_structure WHERE freshness = 'DIRTY') a ON a.resource_uid = x.uid LEFT JOIN (SELECT resource_uid FROM b_structure WHERE state = 'UNAVAILABLE') b ON b.resource_uid = x.uid GROUP BY g")
def _(f):
    s = f("b_structure")
    a = s.where("freshness = 'DIRTY'").select(F.col("resource_uid").alias("uid"), F.lit(1).alias("a"))
    b = s.where("state = 'UNAVAILABLE'").select(F.col("resource_uid").alias("uid"), F.lit(1).alias("b"))
    return grouped(f).join(a, "uid", "left").join(b, "uid", "left").groupBy("g").agg(F.count("*").alias("files"), F.count("a").alias("dirty"), F.count("b").alias("unavailable"))


@query("J5_entity_groups", f"SELECT DISTINCT o.entity, x.g FROM b_owner o JOIN ({_GROUPED}) x ON x.uid = o.resource_uid")
def _(f):
    return structure.entity_groups(grouped(f), f("b_owner"))


@query("J6_group_edges", f"SELECT kind, source, target, sg, tg FROM ({_EDGES})")
def _(f):
    return group_edges(f)


@query("J15_publication_sources", "SELECT DISTINCT o.resource_uid, split_part(o.target, ':', 1) AS source_kind FROM b_occurrence o JOIN b_resource r ON r.uid = o.target")
def _(f):
    known = f("b_resource").select(F.col("uid").alias("target"))
    return f("b_occurrence").join(known, "target", "left_semi").select("resource_uid", F.substring_index("target", ":", 1).alias("source_kind")).distinct()


@query("O5_severity_top", f"SELECT id, CASE WHEN line LIKE '%error%' THEN 'error' ELSE 'warning' END AS severity, right(line, 2) AS message FROM ({_LINES}) WHERE line <> 'Compiling' ORDER BY CASE WHEN line LIKE '%error%' THEN 0 ELSE 1 END, id LIMIT 64")
def _(f):
    parsed = records.diagnostics(f.sql(_LINES)).where("parsed")
    return parsed.orderBy(records.severity_rank(F.col("severity")), "id").limit(64).select("id", "severity", "message")


@query("O10_supporting_paths", "SELECT node, path, place FROM (SELECT b.source AS node, concat(b.source, '>', a.source, '>', a.target) AS path, row_number() OVER (PARTITION BY b.source ORDER BY concat(b.source, '>', a.source, '>', a.target)) AS place FROM (SELECT DISTINCT source, target FROM b_relation WHERE kind = 'CALLS') a JOIN (SELECT DISTINCT source, target FROM b_relation WHERE kind = 'CALLS') b ON b.target = a.source) WHERE place <= 4")
def _(f):
    e = f("b_relation").where("kind = 'CALLS'").select("source", "target")
    return structure.first_paths(e, 4)


@query("S15_symbol_inspect", "SELECT s.uid, s.kind, s.signature, r.path_key, coalesce(t.state, 'UNKNOWN') AS structure, s.revision = r.revision AS current FROM b_symbol s JOIN b_resource r ON r.uid = s.resource_uid AND r.state = 'ACTIVE' LEFT JOIN b_structure t ON t.resource_uid = r.uid")
def _(f):
    r = f("b_resource").where("state = 'ACTIVE'").select(F.col("uid").alias("resource_uid"), "path_key", F.col("revision").alias("r"))
    t = f("b_structure").select("resource_uid", F.col("state").alias("t"))
    j = f("b_symbol").join(r, "resource_uid").join(t, "resource_uid", "left")
    return j.select("uid", "kind", "signature", "path_key", F.coalesce("t", F.lit("UNKNOWN")).alias("structure"), (F.col("revision") == F.col("r")).alias("current"))


@query("G22_invalidation_set", """SELECT DISTINCT o.resource_uid FROM b_relation r JOIN b_owner o ON o.entity = r.source WHERE r.target IN ('part:1', 'part:2', 'supplier:1') UNION SELECT resource_uid FROM b_gap WHERE intended = 'IMPORTS' AND reason = 'NOT_FOUND' UNION SELECT g.resource_uid FROM b_gap g JOIN b_candidate c ON c.gap_uid = g.uid WHERE c.target IN ('part:1', 'part:2', 'supplier:1')""")
def _(f):
    touched = f("b_resource").where(F.col("uid").isin("part:1", "part:2", "supplier:1")).select(F.col("uid").alias("target"))
    return relations.invalidated(f("b_relation"), f("b_owner"), f("b_gap"), f("b_candidate"), touched, True)


@query("N21_utf16_columns", "SELECT doc_id, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS units, length(text) AS points, strlen(text) AS bytes FROM b_source")
def _(f):
    units = (F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("long")
    return f("b_source").select("doc_id", units.alias("units"), F.length("text").cast("long").alias("points"), F.octet_length("text").cast("long").alias("bytes"))


@query("P16_search_status", "SELECT split_part(path_key, '/', 2) AS scope, CASE WHEN count(*) > 500 THEN 'TRUNCATED' WHEN count(*) FILTER (contains(text, 'the ')) > 0 THEN 'FOUND' WHEN count(*) FILTER (length(text) < 20) > 0 THEN 'UNAVAILABLE' WHEN count(*) FILTER (length(text) > 20000) > 0 THEN 'TRUNCATED' ELSE 'NOT_FOUND' END AS status FROM b_source GROUP BY 1")
def _(f):
    s = f("b_source").withColumn("scope", F.split_part("path_key", F.lit("/"), F.lit(2)))
    n = s.groupBy("scope").agg(F.count("*").alias("n"), F.count_if(F.contains("text", F.lit("the "))).alias("found"), F.count_if(F.length("text") < 20).alias("short"), F.count_if(F.length("text") > 20000).alias("long"))
    return n.select("scope", answer.search_status(F.col("n") > 500, F.col("found"), F.col("short"), F.col("long")).alias("status"))


_FALLBACK = "SELECT event_id, CASE event_type WHEN 'click' THEN 'EXPLICIT_TEXT_SEARCH' WHEN 'signup' THEN 'NON_STRUCTURAL_TARGET' ELSE 'INCOMPLETE_STRUCTURAL_COVERAGE' END AS reason, CASE user_id % 7 WHEN 0 THEN 'UNSUPPORTED' WHEN 1 THEN 'TRUNCATED' WHEN 2 THEN 'FOUND' WHEN 3 THEN 'REFRESHING' WHEN 4 THEN 'NOT_FOUND' WHEN 5 THEN 'UNAVAILABLE' END AS status FROM events"


@query("P17_fallback_permission", f"SELECT event_id, reason IN ('EXPLICIT_TEXT_SEARCH', 'NON_STRUCTURAL_TARGET') OR (status IS NOT NULL AND status IN ('UNSUPPORTED', 'TRUNCATED', 'REFRESHING')) AS permitted FROM ({_FALLBACK})")
def _(f):
    return f.sql(_FALLBACK).select("event_id", answer.fallback_permitted(F.col("reason"), F.col("status")).alias("permitted"))


_SELECTED = "SELECT name, length(name) % 2 = 0 AS identity, start_byte % 200 = 0 AS exact, count(*) FILTER (WHERE revision = 1 AND start_byte % 300 < 200) AS candidates, count(*) FILTER (WHERE revision = 3) AS incomplete FROM b_symbol GROUP BY name, start_byte, length(name)"


@query("B8_selection", f"SELECT name, exact, identity, candidates, incomplete, CASE WHEN candidates > 1 THEN 'TARGET_AMBIGUOUS' WHEN candidates = 1 THEN CASE WHEN exact THEN 'EXACT' ELSE 'TARGET_NOT_EXACT' END WHEN identity THEN 'TARGET_NOT_CURRENT' WHEN incomplete > 0 THEN 'TARGET_NOT_FOUND_WITH_INCOMPLETE_COVERAGE' ELSE 'TARGET_NOT_FOUND' END AS selection FROM ({_SELECTED})")
def _(f):
    return f.sql(_SELECTED).withColumn("selection", answer.selection(F.col("identity"), F.col("exact"), F.col("candidates"), F.col("incomplete")))


_SUMMARY = f"""WITH x AS ({_GROUPED}), e AS ({_EDGES}), o AS (SELECT sg AS g, count(DISTINCT coalesce(tg, chr(1))) AS fan_out, count(DISTINCT kind || '>' || source || '>' || target) AS out_relations FROM e WHERE sg IS DISTINCT FROM tg GROUP BY sg), i AS (SELECT tg AS g, count(DISTINCT coalesce(sg, chr(1))) AS fan_in, count(DISTINCT kind || '>' || source || '>' || target) AS in_relations FROM e WHERE sg IS DISTINCT FROM tg GROUP BY tg),
n AS (SELECT sg AS g, count(DISTINCT kind || '>' || source || '>' || target) AS internal FROM e WHERE sg IS NOT DISTINCT FROM tg GROUP BY sg), v AS (SELECT g, count(*) AS total, count(*) FILTER (s.state = 'COMPLETE') AS supported, count(*) FILTER (s.state IN ('PARTIAL', 'CONTAINER_ONLY')) AS partial FROM x LEFT JOIN b_structure s ON s.resource_uid = x.uid GROUP BY g)
SELECT v.g, total, supported, partial, total - supported - partial AS unsupported, coalesce(internal, 0) AS internal, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(in_relations, 0) AS in_relations, coalesce(out_relations, 0) AS out_relations
FROM v LEFT JOIN n ON n.g IS NOT DISTINCT FROM v.g LEFT JOIN o ON o.g IS NOT DISTINCT FROM v.g LEFT JOIN i ON i.g IS NOT DISTINCT FROM v.g"""


@query("G11_structural_summary", _SUMMARY)
def _(f):
    """The groups of a summary by the first directory; its other tables are A2, A6 and W1."""
    return structure.summary(f("b_resource"), f("b_structure"), f("b_owner"), f("b_relation"), f("b_gap"), f("b_candidate"), structure.Grouping(depth=1)).groups


@query("B9_source_floor", """WITH r AS (SELECT DISTINCT resource_uid, start_byte AS s, end_byte AS e FROM b_symbol), f AS (SELECT *, CASE WHEN s >= max(e) OVER (PARTITION BY resource_uid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM r),
i AS (SELECT resource_uid, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY resource_uid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM f) GROUP BY resource_uid, k) SELECT resource_uid, count(*) AS ranges, sum(e - s)::BIGINT AS floor FROM i GROUP BY resource_uid""")
def _(f):
    r = f("b_symbol").select("resource_uid", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))
    return delivery.merge_ranges(r, "resource_uid").groupBy("resource_uid").agg(F.count("*").alias("ranges"), F.sum(F.col("end") - F.col("start")).cast("long").alias("floor"))


@query("ST9_generation_publish", "SELECT event_id AS generation, CASE WHEN basis = coalesce(max(CASE WHEN ok THEN event_id END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 'STABLE' ELSE 'ABORTED' END AS state FROM (SELECT event_id, event_id % 5 <> 0 AS ok, event_id - 1 AS basis FROM events)")
def _(f):
    return delivery.published(f("events").select(F.col("event_id").alias("generation"), (F.col("event_id") - 1).alias("basis"), (F.col("event_id") % 5 != 0).alias("ok")))


@query("ST13_job_poll", "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE turn > 2) WHERE k <= 3")
def _(f):
    return store.poll(f("conversations"), "conv_id", "turn", 2, 3).select("conv_id", "turn", "role")


_CODE = "concat('import os', chr(10), 'class C', c_custkey, ':', chr(10), '    def f(self):', chr(10), '        return g(', c_custkey, ')', chr(10), 'def h():', chr(10), '    return os.getenv(\"K', c_custkey % 7, '\")', chr(10))"


@query("S16_python_structure", """SELECT concat('c', c_custkey, '.py') AS path_key, t.record, CASE t.record WHEN 'KEY' THEN concat('K', c_custkey % 7) WHEN 'STATUS' THEN '' ELSE CASE WHEN t.name = 'C' THEN concat('C', c_custkey) ELSE t.name END END AS name,
CASE t.q WHEN 'C' THEN concat('C', c_custkey) WHEN 'C.f' THEN concat('C', c_custkey, '.f') ELSE t.q END AS qualified_name FROM customer, (SELECT unnest([{'record': 'STATUS', 'name': '', 'q': ''}, {'record': 'IMPORT', 'name': 'os', 'q': 'os'}, {'record': 'SYMBOL', 'name': 'C', 'q': 'C'}, {'record': 'SYMBOL', 'name': 'f', 'q': 'C.f'}, {'record': 'CALL', 'name': 'g', 'q': 'g'}, {'record': 'SYMBOL', 'name': 'h', 'q': 'h'}, {'record': 'KEY', 'name': '', 'q': 'os.getenv'}]) AS t)""")
def _(f):
    files = f("customer").select(F.expr("concat('c', c_custkey, '.py')").alias("path_key"), F.encode(F.expr(_CODE), "UTF-8").alias("content"))
    return python_code.parse_python(files).select("path_key", "record", "name", "qualified_name")


#: A file of each language and what is in it; @ stands for the key of a customer.
_SOURCES = {
    "RUST": ("rs", "use a::b@;\nstruct S@ { x: i32 }\nimpl S@ { fn m(&self) -> i32 { self.g@(1) } }\nfn h() { env::var(\"K@\"); }\n", [
        ("STATUS", "", "", "COMPLETE"), ("IMPORT", "b@", "a::b@", "MEMBER"), ("SYMBOL", "S@", "S@", "STRUCT"), ("SYMBOL", "x", "S@::x", "FIELD"), ("SYMBOL", "m", "S@::m", "METHOD"),
        ("CALL", "g@", "self.g@", "S@::m"), ("SYMBOL", "h", "h", "FUNCTION"), ("KEY", "K@", "env::var", "LITERAL")]),
    "TYPESCRIPT": ("ts", "import { a as b@ } from \"./m@\"\nexport class C@ { x = 1\n m(): void { this.g@(`${h(2)}`) } }\nconst f@ = (z) => process.env.K@\n", [
        ("STATUS", "", "", "COMPLETE"), ("IMPORT", "b@", "./m@:a", "MEMBER"), ("SYMBOL", "C@", "C@", "CLASS"), ("SYMBOL", "x", "C@.x", "FIELD"), ("SYMBOL", "m", "C@.m", "METHOD"),
        ("CALL", "g@", "this.g@", "C@.m"), ("CALL", "h", "h", "C@.m"), ("SYMBOL", "f@", "f@", "FUNCTION"), ("KEY", "K@", "process.env", "LITERAL")]),
    "CSHARP": ("cs", "using N.M@;\nnamespace Q;\nclass C@ { const int A = 1; int P { get; } int M(int x) { return G@(x); } }\n", [
        ("STATUS", "", "", "COMPLETE"), ("IMPORT", "M@", "N.M@", "MODULE"), ("SYMBOL", "C@", "Q.C@", "CLASS"), ("SYMBOL", "A", "Q.C@.A", "CONSTANT"), ("SYMBOL", "P", "Q.C@.P", "PROPERTY"),
        ("SYMBOL", "M", "Q.C@.M", "METHOD"), ("CALL", "G@", "G@", "Q.C@.M")]),
}
_LANGUAGE = "CASE c_custkey % 3 WHEN 0 THEN 'RUST' WHEN 1 THEN 'TYPESCRIPT' ELSE 'CSHARP' END"
_IN = ", ".join(f"('{lang}', '{ext}', '{a}', '{b}', '{c}', '{d}')" for lang, (ext, _, rows) in _SOURCES.items() for a, b, c, d in rows)


@query("S16_lexed_structure", f"SELECT concat('c', c_custkey, '.', ext) AS path_key, record, replace(name, '@', CAST(c_custkey AS VARCHAR)) AS name, replace(q, '@', CAST(c_custkey AS VARCHAR)) AS qualified_name, replace(kind, '@', CAST(c_custkey AS VARCHAR)) AS kind FROM customer JOIN (VALUES {_IN}) v(lang, ext, record, name, q, kind) ON lang = {_LANGUAGE}")
def _(f):
    """Structure of Rust, TypeScript and C# files, one a customer."""
    lang, key = F.expr(_LANGUAGE), F.col("c_custkey").cast("string")
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in _SOURCES.items() for x in (k, v[i])]), lang)
    files = f("customer").select(F.concat(F.lit("c"), key, F.lit("."), pick(0)).alias("path_key"), lang.alias("language"), F.encode(F.replace(pick(1), F.lit("@"), key), "UTF-8").alias("content"))
    return python_code.parse(files).select("path_key", "record", "name", "qualified_name", "kind")


@query("G16_domain_keys", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL WHEN event_type = 'view' THEN 'USES_ENV' WHEN event_type = 'click' THEN 'USES_CONFIG' END AS kind, CASE WHEN user_id % 3 <> 0 THEN CASE event_type WHEN 'view' THEN concat('ENV:K', user_id) WHEN 'click' THEN concat('CONFIG:K', user_id) END END AS identity, CASE WHEN event_type NOT IN ('view', 'click') THEN 'NOT_A_KEY' WHEN user_id % 3 = 0 THEN 'DYNAMIC_KEY' END AS reason FROM events")
def _(f):
    api = F.when(F.col("event_type") == "view", "os.getenv").when(F.col("event_type") == "click", "ConfigurationManager.AppSettings").otherwise("map.get")
    key = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("K"), "user_id"))
    return f("events").select("event_id", resolve_code.domain_relation(api, key).alias("r")).select("event_id", "r.*")
