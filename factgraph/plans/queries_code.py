"""Queries over source text, paths, records and code resolution, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators import resolve_code
from factgraph.plans.bridge import Facts
from factgraph.sources import records, text_scan, tree

ALL: dict[str, tuple[Callable[[Facts], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Facts], DataFrame]):
        ALL[name] = (f, sql)
        return f

    return keep


def _listed(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


#: Paths of every name that a list of the discovery rules holds, in every kind of directory, and markers beside some.
_NAMES = ("a.PY", "b.pyi", "c.mjs", "d.cjs", "e.jsx", "f.mts", "g.cts", "h.tsx", "i.svelte", "j.cs", "k.rs", "test_l.py", "m_test.rs", "n.spec.ts", "o_spec.rb", "Cargo.lock", ".gitignore", "p.json", "q.Toml", "r.conf", "README", "License.txt", "s.mdx", "t.txt", "u.css", "v.html", "w.wasm", "x.woff2", "y", "z.", ".env", "a.b.ini", "contest.py", "latest_.ts")
_DIRS = ("src", "Tests", "__tests__", "specs", "a/.git", "a/.hg", "b/node_modules/x", "c/venv", "c/virtualenv", "c/__pycache__", "d/target", "e/target/x", "f/bin", "f/obj", "g/build", "h/dist/y", "i/dist", "")
_MARKERS = ("d/Cargo.toml", "f/App.CSPROJ", "g/setup.py", "h/setup.cfg", "i/cargo.toml", "e/x.sln")
_PATHS = f"SELECT o_orderkey AS uid, concat(CASE o_orderkey % {len(_DIRS)} " + " ".join(f"WHEN {i} THEN '{d}{'/' if d else ''}'" for i, d in enumerate(_DIRS)) + f" END, 'o', o_custkey, '/', CASE CAST(floor(o_orderkey / {len(_DIRS)}) AS BIGINT) % {len(_NAMES)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END) AS path_key FROM orders" + "".join(f" UNION ALL SELECT {-1 - i}, '{m}'" for i, m in enumerate(_MARKERS))


def paths(f: Facts) -> DataFrame:
    return f.sql(_PATHS)


#: The rules as SQL over a path's lower-cased name, extension and stem, from the same lists of fixed values.
_PARTS = f"SELECT uid, path_key, low, name, ext, CASE WHEN ext IS NULL THEN name ELSE substr(name, 1, length(name) - length(ext) - 1) END AS stem FROM (SELECT *, CASE WHEN instr(substr(name, 2), '.') > 0 THEN split_part(name, '.', -1) END AS ext FROM (SELECT uid, path_key, lower(path_key) AS low, lower(split_part(path_key, '/', -1)) AS name FROM ({_PATHS})))"
_LANGUAGE = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{x}'" for e, x in tree.LANGUAGES.items()) + " END"
_TEST = f"len(list_intersect(string_split(low, '/'), [{_listed(tree.TEST_DIRS)[1:-1]}])) > 0" + "".join(f" OR starts_with(stem, '{x}')" for x in tree.TEST_STARTS) + "".join(f" OR ends_with(stem, '{x}')" for x in tree.TEST_ENDS)
_ROLE = f"CASE WHEN {_TEST} THEN 'TEST' WHEN name IN {_listed(tree.CONFIG_NAMES)} OR ext IN {_listed(tree.CONFIG_EXTENSIONS)} THEN 'CONFIG' WHEN stem IN {_listed(tree.DOCS_STEMS)} OR ext IN {_listed(tree.DOCS_EXTENSIONS)} THEN 'DOCS' WHEN {_LANGUAGE} IS NOT NULL THEN 'SOURCE' WHEN ext IN {_listed(tree.ASSET_EXTENSIONS)} THEN 'ASSET' ELSE 'UNKNOWN' END"
_GONE = "".join(f" AND NOT contains('/' || path_key, '/{d}/')" for d in tree.EXCLUDED)


@query("S2_exclusion", f"""WITH p AS ({_PATHS}), k AS (SELECT * FROM p WHERE true{_GONE}),
m AS (SELECT DISTINCT regexp_replace(path_key, '[^/]*$', '') AS home, split_part(path_key, '/', -1) AS name FROM k)
SELECT uid, path_key FROM k WHERE NOT (false""" + "".join(f" OR EXISTS (SELECT 1 FROM m WHERE starts_with(path_key, m.home || '{d}/') AND (" + " OR ".join(f"ends_with(lower(m.name), '{x}')" if x.startswith(".") else f"m.name = '{x}'" for x in ms) + "))" for d, ms in tree.CONTEXTUAL.items()) + ")")
def _(f):
    return tree.excluded(paths(f)).select("uid", "path_key")


@query("S3_language", f"SELECT uid, CASE WHEN {_ROLE} IN ('TEST', 'SOURCE') THEN {_LANGUAGE} END AS language FROM ({_PARTS})")
def _(f):
    return paths(f).select("uid", tree.resource_language(F.col("path_key")).alias("language"))


@query("S3_role", f"SELECT uid, {_ROLE} AS role FROM ({_PARTS})")
def _(f):
    return paths(f).select("uid", tree.role_of(F.col("path_key")).alias("role"))


@query("S4_observed_hash", "SELECT path_key, CASE WHEN doc_id % 3 = 0 THEN 'known' ELSE sha256(text) END AS hash, doc_id % 3 = 0 AS reused FROM b_source")
def _(f):
    s = f("b_source").withColumn("content", F.encode("text", "UTF-8")).withColumn("size", F.octet_length("text")).withColumn("mtime", F.col("doc_id"))
    known = s.where("doc_id % 3 < 2").select("path_key", "size", (F.col("mtime") + F.col("doc_id") % 3).alias("mtime"), F.lit("known").alias("hash"))
    return tree.observed_hash(s.select("path_key", "size", "mtime", "content"), known).select("path_key", "hash", "reused")


@query("S13_text_scan", "SELECT path_key, count(*) AS matches FROM (SELECT path_key, unnest(string_split(text, 'the ')) FROM b_source) GROUP BY path_key HAVING count(*) > 1")
def _(f):
    s = f("b_source").select("path_key", F.encode("text", "UTF-8").alias("content"))
    return text_scan.scan(s, "the ").groupBy("path_key").agg((F.count("*") + 1).alias("matches"))


@query("W6_line_index", "SELECT doc_id, strlen(substr(text, 1, position('the ' IN text) - 1)) AS at, len(string_split(substr(text, 1, position('the ' IN text) - 1), chr(10))) - 1 AS line FROM b_source WHERE contains(text, 'the ')")
def _(f):
    s = f("b_source").select(F.col("doc_id").cast("string").alias("path_key"), F.encode("text", "UTF-8").alias("content"))
    m = text_scan.scan(s, "the ").groupBy("path_key").agg(F.min(F.struct("start_byte", "line")).alias("m"))
    return m.select(F.col("path_key").cast("long").alias("doc_id"), F.col("m.start_byte").alias("at"), F.col("m.line").alias("line"))


@query("S14_verified_ranges", "SELECT path_key, doc_id % 2 = 0 AS verified, CASE WHEN doc_id % 2 = 0 THEN sha256(unhex(substr(hex(encode(text)), 5, 40))) END AS digest FROM b_source")
def _(f):
    s = f("b_source")
    files = s.select("path_key", F.encode("text", "UTF-8").alias("content"), F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise("stale").alias("expected"))
    spans = s.select("path_key", F.lit(2).alias("start"), F.lit(22).alias("end"))
    return text_scan.verified_range(files, spans).select("path_key", "verified", F.sha2("bytes", 256).alias("digest"))


@query("S17_stable_ids", """WITH o AS (SELECT uid, qualified_name, kind, signature FROM b_symbol WHERE revision < 3), n AS (SELECT uid AS n, qualified_name, kind, signature FROM b_symbol WHERE revision > 1),
a AS (SELECT n.n, o.uid FROM n JOIN o ON o.qualified_name = n.qualified_name AND o.kind = n.kind WHERE (n.qualified_name, n.kind) IN (SELECT qualified_name, kind FROM n GROUP BY 1, 2 HAVING count(*) = 1) AND (o.qualified_name, o.kind) IN (SELECT qualified_name, kind FROM o GROUP BY 1, 2 HAVING count(*) = 1)),
n2 AS (SELECT * FROM n WHERE n NOT IN (SELECT n FROM a)), o2 AS (SELECT * FROM o WHERE uid NOT IN (SELECT uid FROM a)),
b AS (SELECT n2.n, o2.uid FROM n2 JOIN o2 ON o2.qualified_name = n2.qualified_name AND o2.kind = n2.kind AND o2.signature = n2.signature WHERE (n2.qualified_name, n2.kind, n2.signature) IN (SELECT qualified_name, kind, signature FROM n2 GROUP BY 1, 2, 3 HAVING count(*) = 1) AND (o2.qualified_name, o2.kind, o2.signature) IN (SELECT qualified_name, kind, signature FROM o2 GROUP BY 1, 2, 3 HAVING count(*) = 1))
SELECT n.n, coalesce(a.uid, b.uid) AS uid FROM n LEFT JOIN a ON a.n = n.n LEFT JOIN b ON b.n = n.n""")
def _(f):
    s = f("b_symbol")
    old = s.where("revision < 3").select("uid", "qualified_name", "kind", "signature")
    return tree.stable_ids(old, s.where("revision > 1").select(F.col("uid").alias("n"), "qualified_name", "kind", "signature"))


_STATUS = "SELECT o_orderkey AS id, concat('1 M. N... 100644 100644 100644 aa bb src/f', o_orderkey, '.py', chr(0), '2 R. N... 100644 100644 100644 aa bb R90 new', o_orderkey, chr(0), 'old', o_orderkey, chr(0), '? x y') AS value FROM orders"


@query("S20_status_entries", "SELECT o_orderkey AS id, k AS kind, CASE k WHEN 'CHANGED' THEN concat('src/f', o_orderkey, '.py') WHEN 'RENAMED' THEN concat('new', o_orderkey) ELSE 'x y' END AS path, CASE k WHEN 'RENAMED' THEN concat('old', o_orderkey) END AS original FROM orders, (SELECT unnest(['CHANGED', 'RENAMED', 'UNTRACKED']) AS k)")
def _(f):
    return records.status_entries(f.sql(_STATUS))


_LINES = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 3 THEN 'Compiling' ELSE concat('src/f', l_orderkey % 7, '.rs:', l_linenumber, ':', l_suppkey % 5, ': ', CASE WHEN l_linenumber = 1 THEN 'error' ELSE 'warning' END, ': x', l_orderkey % 3) END AS line FROM lineitem"


@query("S21_diagnostics", "SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber <> 3 AS parsed, CASE WHEN l_linenumber <> 3 THEN concat('src/f', l_orderkey % 7, '.rs') END AS path, CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber AS BIGINT) END AS row, CASE WHEN l_linenumber <> 3 THEN CASE WHEN l_linenumber = 1 THEN 'error' ELSE 'warning' END END AS severity FROM lineitem")
def _(f):
    return records.diagnostics(f.sql(_LINES)).select("id", "parsed", "path", "row", "severity")


@query("A14_diagnostics_summary", f"SELECT split_part(line, ':', 1) AS path, line LIKE '%error%' AS error, count(*) AS times, min(id) AS first FROM ({_LINES}) WHERE line <> 'Compiling' GROUP BY line ORDER BY CASE WHEN line LIKE '%error%' THEN 0 ELSE 1 END, min(id) LIMIT 64")
def _(f):
    s = records.summary(records.diagnostics(f.sql(_LINES)))
    return s.select("path", (F.col("severity") == "error").alias("error"), "times", "first")


@query("A14_diagnostics_counts", f"WITH n AS (SELECT line, count(*) AS n FROM ({_LINES}) GROUP BY line) SELECT sum(n)::BIGINT AS observed, count(*) FILTER (line <> 'Compiling') AS deduplicated, greatest(count(*) FILTER (line <> 'Compiling') - 64, 0)::BIGINT AS omitted, coalesce(sum(n) FILTER (line = 'Compiling'), 0)::BIGINT AS parse_misses FROM n")
def _(f):
    return records.diagnostics_counts(records.diagnostics(f.sql(_LINES)))


# resolution ----------------------------------------------------------------------------------------


_USES = "SELECT uid AS use, resource_uid AS file, CASE WHEN start_byte % 30 = 0 THEN concat('f', start_byte % 97) WHEN start_byte % 30 = 10 THEN 'ns' END AS receiver, regexp_replace(lookup_name, '^.*[:.]', '') AS name, truncated AS local FROM b_gap"
_BINDINGS = "SELECT concat('customer:', o_custkey) AS file, CASE WHEN o_orderkey % 5 = 0 THEN 'ns' ELSE concat('f', o_orderkey % 97) END AS local_name, CASE WHEN o_orderkey % 4 <> 0 THEN concat('f', (o_orderkey + o_orderkey % 2) % 97) END AS imported_name, CASE WHEN o_orderkey % 7 < 4 THEN concat('customer:', o_custkey % 50 + 1) END AS module, CASE WHEN o_orderkey % 7 = 4 THEN 'pkg' END AS external FROM orders WHERE o_orderkey % 3 = 0"
_NAMED = "SELECT uid, resource_uid AS file, name, CASE WHEN parent_uid IS NULL THEN name ELSE concat('f', start_byte % 97, '.', name) END AS qualified_name, parent_uid IS NULL AS top FROM b_symbol"
_ONE = "CASE {n} WHEN 0 THEN NULL WHEN 1 THEN {t} END"


@query("G13_name_resolution", f"""WITH u AS ({_USES}), b AS ({_BINDINGS}), s AS ({_NAMED}),
t AS (SELECT file, name, count(*) AS n, min(uid) AS uid FROM s WHERE top GROUP BY 1, 2), q AS (SELECT file, qualified_name, count(*) AS n, min(uid) AS uid FROM s GROUP BY 1, 2),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, local_name ORDER BY imported_name NULLS FIRST, module NULLS FIRST, external NULLS FIRST) AS k FROM b) WHERE k = 1),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, local_name ORDER BY module NULLS FIRST, external NULLS FIRST) AS k FROM b WHERE imported_name IS NULL) WHERE k = 1),
j AS (SELECT u.*, receiver IS NULL AS bare, coalesce(receiver, u.name) AS k FROM u),
x AS (SELECT j.*, CASE WHEN bare THEN f.file IS NOT NULL ELSE m.file IS NOT NULL END AS bound, CASE WHEN bare THEN f.imported_name ELSE j.name END AS want, CASE WHEN bare THEN f.module ELSE m.module END AS module, CASE WHEN bare THEN f.external ELSE m.external END AS external
  FROM j LEFT JOIN f ON f.file = j.file AND f.local_name = j.k LEFT JOIN m ON m.file = j.file AND m.local_name = j.k),
y AS (SELECT x.*, coalesce(o.n, 0) AS own_n, o.uid AS own, coalesce(r.n, 0) AS far_n, r.uid AS far, coalesce(q.n, 0) AS q_n, q.uid AS q FROM x LEFT JOIN t o ON o.file = x.file AND o.name = x.k LEFT JOIN t r ON r.file = x.module AND r.name = x.want LEFT JOIN q ON q.file = x.file AND q.qualified_name = x.receiver || '.' || x.name),
w AS (SELECT *, CASE WHEN local AND bare THEN 'POSSIBLY_SHADOWED' WHEN local THEN 'RECEIVER_TYPE_REQUIRED' WHEN bound AND want IS NULL THEN 'RECEIVER_TYPE_REQUIRED' WHEN bound THEN CASE WHEN module IS NOT NULL THEN CASE WHEN far_n = 0 THEN 'NAME_NOT_IN_MODULE' WHEN far_n > 1 THEN 'AMBIGUOUS_CANDIDATES' END WHEN external IS NULL THEN 'IMPORT_TARGET_UNRESOLVED' END
  WHEN bare THEN CASE WHEN own_n = 0 THEN 'NO_STRUCTURAL_BINDING' WHEN own_n > 1 THEN 'AMBIGUOUS_CANDIDATES' END WHEN own_n <> 1 OR q_n = 0 THEN 'RECEIVER_TYPE_REQUIRED' WHEN q_n > 1 THEN 'AMBIGUOUS_CANDIDATES' END AS reason FROM y)
SELECT use, CASE WHEN reason IS NULL THEN CASE WHEN bound THEN CASE WHEN module IS NOT NULL THEN far END WHEN bare THEN own ELSE q END END AS target, CASE WHEN reason IS NULL AND bound AND module IS NULL THEN external || ':' || want END AS external, reason FROM w""")
def _(f):
    return resolve_code.resolve_names(f.sql(_USES), f.sql(_BINDINGS), f.sql(_NAMED))


_IMPORTS = """SELECT o_orderkey AS use, concat('src/d', o_custkey % 5, '/m', o_custkey % 7, '.x') AS path_key, CASE o_orderkey % 6 WHEN 0 THEN 'PYTHON' WHEN 1 THEN 'JAVASCRIPT' WHEN 2 THEN 'TYPESCRIPT' WHEN 3 THEN 'RUST' WHEN 4 THEN 'CSHARP' ELSE 'SVELTE' END AS language,
CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN o_custkey % 9 = 0 THEN '' ELSE concat('d', o_custkey % 5, '.m', o_custkey % 11) END WHEN 3 THEN CASE o_custkey % 6 WHEN 0 THEN 'crate::a' WHEN 1 THEN 'std::{a,b}' WHEN 2 THEN 'mine::x' WHEN 3 THEN 'serde::de' WHEN 4 THEN 'superb::x' ELSE 'self' END
 ELSE CASE o_custkey % 9 WHEN 0 THEN './m1' WHEN 1 THEN '../d2/m3' WHEN 2 THEN '../../../x' WHEN 3 THEN '/abs' WHEN 4 THEN '@s/pkg/y' WHEN 5 THEN '@s' WHEN 6 THEN 'lodash/fp' WHEN 7 THEN './../d1/./m2.js' ELSE '' END END AS specifier,
CASE WHEN o_orderkey % 6 = 0 AND o_custkey % 3 < 2 THEN CAST(o_custkey % 3 + 1 AS INT) END AS levels FROM orders"""
_MODULES = "SELECT concat('r', p_partkey) AS uid, concat('src/d', p_partkey % 5, '/m', p_partkey % 13, CASE p_size % 5 WHEN 0 THEN '.py' WHEN 1 THEN '/__init__.pyi' WHEN 2 THEN '.ts' WHEN 3 THEN '/index.js' ELSE '.js' END) AS path_key FROM part WHERE p_partkey <= 190"
_RESOLVED_PATH = {"./m1": "'src/d' || d || '/m1'", "../d2/m3": "'src/d2/m3'", "./../d1/./m2.js": "'src/d1/m2.js'"}


@query("G14_import_resolution", f"""WITH i AS (SELECT *, split_part(split_part(path_key, '/', 2), 'd', 2) AS d, replace(specifier, '.', '/') AS dots FROM ({_IMPORTS})), m AS ({_MODULES}),
b AS (SELECT *, CASE WHEN language = 'PYTHON' THEN CASE levels WHEN 1 THEN 'src/d' || d WHEN 2 THEN 'src' END || CASE WHEN dots = '' THEN '' ELSE '/' || dots END WHEN language LIKE '%SCRIPT' THEN CASE specifier {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _RESOLVED_PATH.items())} END END AS base FROM i),
c AS (SELECT use, base || e AS want FROM b, (SELECT unnest([{", ".join(f"'{x}.{e}'" for e in resolve_code.PYTHON_EXTENSIONS for x in ("", "/__init__"))}]) AS e) WHERE language = 'PYTHON' AND base IS NOT NULL
 UNION ALL SELECT use, base || e FROM b, (SELECT unnest(['', {", ".join(f"'{x}.{e}'" for e in resolve_code.JS_EXTENSIONS for x in ("", "/index"))}]) AS e) WHERE language LIKE '%SCRIPT' AND base IS NOT NULL),
a AS (SELECT use, dots || e AS want FROM i, (SELECT unnest([{", ".join(f"'{x}.{e}'" for e in resolve_code.PYTHON_EXTENSIONS for x in ("", "/__init__"))}]) AS e) WHERE language = 'PYTHON' AND levels IS NULL AND dots <> ''),
h AS (SELECT use, count(DISTINCT uid) AS n, min(uid) AS uid FROM (SELECT use, uid FROM c JOIN m ON m.path_key = c.want UNION ALL SELECT use, uid FROM a JOIN m ON m.path_key = a.want OR ends_with(m.path_key, '/' || a.want)) GROUP BY use),
r AS (SELECT b.*, coalesce(h.n, 0) AS n, h.uid, CASE WHEN language = 'CSHARP' THEN 'NAMESPACE_REQUIRES_SEMANTICS' WHEN language = 'SVELTE' THEN 'COMPOUND_SPECIFIER' WHEN language = 'RUST' THEN CASE specifier WHEN 'std::{{a,b}}' THEN 'COMPOUND_SPECIFIER' WHEN 'crate::a' THEN 'MODULE_TREE_REQUIRES_SEMANTICS' WHEN 'self' THEN 'MODULE_TREE_REQUIRES_SEMANTICS' WHEN 'mine::x' THEN 'RUST_WORKSPACE_CRATE_REQUIRES_SEMANTICS' END
 WHEN (language = 'PYTHON' AND levels IS NOT NULL OR language LIKE '%SCRIPT' AND specifier LIKE '.%') AND n IS NULL THEN 'MISSING_RELATIVE_TARGET' WHEN language LIKE '%SCRIPT' AND specifier LIKE '/%' THEN 'CONFIG_DEPENDENT_SPECIFIER' WHEN specifier IN ('', '@s') AND levels IS NULL THEN 'COMPOUND_SPECIFIER' END AS reason FROM b LEFT JOIN h ON h.use = b.use)
SELECT use, CASE WHEN reason IS NOT NULL THEN 'UNRESOLVED' WHEN n = 1 THEN 'INTERNAL' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'EXTERNAL' END AS outcome, CASE WHEN reason IS NULL AND n = 1 THEN uid END AS target,
 CASE WHEN reason IS NULL AND n = 0 THEN CASE WHEN language = 'PYTHON' THEN split_part(specifier, '.', 1) WHEN language = 'RUST' THEN split_part(specifier, '::', 1) WHEN specifier LIKE '@%' THEN '@s/pkg' ELSE split_part(specifier, '/', 1) END END AS package, reason FROM r""")
def _(f):
    return resolve_code.resolve_imports(f.sql(_IMPORTS), f.sql(_MODULES), f.spark.createDataFrame([("mine",)], "name string"))


@query("G15_inheritance_kind", "SELECT uid, CASE WHEN kind = 'INTERFACE' THEN 'IMPLEMENTS' ELSE 'EXTENDS' END AS relation FROM b_symbol")
def _(f):
    return f("b_symbol").select("uid", resolve_code.inheritance_kind(F.col("kind")).alias("relation"))


@query("G17_gap_mapping", "SELECT uid, CASE reason WHEN 'AMBIGUOUS' THEN 'AMBIGUOUS_CANDIDATES' WHEN 'NOT_FOUND' THEN 'NO_STRUCTURAL_BINDING' WHEN 'DYNAMIC' THEN 'DYNAMIC_KEY_EXPRESSION' ELSE 'CONFIG_DEPENDENT_SPECIFIER' END AS gap FROM b_gap")
def _(f):
    return f("b_gap").select("uid", resolve_code.gap_reason(F.col("reason")).alias("gap"))


_MEMBERS = "SELECT concat('p', p_partkey) AS uid, concat('c', p_partkey % 60) AS owner, p_brand AS name, concat('k', p_size % 3) AS kind FROM part"


_WALK = f"""WITH RECURSIVE e AS (SELECT concat('c', i) AS s, concat('c', i // 2) AS t FROM (SELECT unnest(range(2, 60)) AS i)), m AS ({_MEMBERS}), w AS (SELECT uid, name, kind, owner AS base, 0 AS d FROM m UNION ALL SELECT w.uid, w.name, w.kind, e.t, w.d + 1 FROM w JOIN e ON e.s = w.base WHERE w.d < 16),
h AS (SELECT w.uid, w.d, count(DISTINCT m.uid) AS n, min(m.uid) AS t FROM w JOIN m ON m.owner = w.base AND m.name = w.name AND m.kind = w.kind WHERE w.d > 0 GROUP BY 1, 2), f AS (SELECT *, min(d) OVER (PARTITION BY uid) AS first FROM h),
o AS (SELECT uid, CASE WHEN n = 1 THEN t END AS target, CASE WHEN n = 1 THEN 'OVERRIDES' ELSE 'AMBIGUOUS' END AS outcome FROM f WHERE d = first)"""


def _hierarchy(f: Facts) -> tuple[DataFrame, DataFrame]:
    return f.sql(_MEMBERS), f.spark.range(2, 60).select(F.concat(F.lit("c"), "id").alias("source"), F.concat(F.lit("c"), F.floor(F.col("id") / 2)).alias("target"))


@query("G18_overrides", f"{_WALK} SELECT * FROM o")
def _(f):
    return resolve_code.overrides(*_hierarchy(f))


@query("G18_opaque_bases", f"{_WALK} SELECT * FROM o UNION ALL SELECT DISTINCT uid, NULL, 'OPAQUE' FROM w WHERE base IN ('c3', 'c10') AND uid NOT IN (SELECT uid FROM o)")
def _(f):
    """The owners c3 and c10 extend something outside the workspace."""
    return resolve_code.overrides(*_hierarchy(f), opaque=f.spark.createDataFrame([("c3",), ("c10",)], "owner string"))


_TYPES = "SELECT concat('c', i) AS owner, concat('I', i) AS name, i < 10 AS interface FROM (SELECT CAST(n_nationkey AS BIGINT) AS i FROM nation UNION ALL SELECT CAST(n_nationkey + 25 AS BIGINT) FROM nation UNION ALL SELECT CAST(n_nationkey + 50 AS BIGINT) FROM nation WHERE n_nationkey < 10) t"
_BASES = "SELECT concat('c', i) AS source, concat('c', CASE WHEN i < 30 THEN i % 9 + k ELSE i - 20 END) AS target FROM (SELECT CAST(substring(owner, 2) AS BIGINT) AS i FROM (" + _TYPES + ") x) y, (SELECT 0 AS k UNION ALL SELECT 1) z WHERE i >= 10"
_IMPLEMENTING = "SELECT concat('p', p_partkey) AS uid, concat('c', p_partkey % 60) AS owner, concat('n', p_size % 4) AS name, CASE WHEN p_partkey % 5 = 0 THEN 'FIELD' ELSE 'METHOD' END AS kind, CASE WHEN p_partkey % 60 >= 10 AND p_partkey % 7 = 0 THEN concat('I', p_partkey % 10) END AS explicit FROM part WHERE p_partkey % 60 >= 10 OR p_partkey < 120"


@query("G19_implements", f"""WITH RECURSIVE t AS ({_TYPES}), b AS (SELECT DISTINCT * FROM ({_BASES})), m AS ({_IMPLEMENTING}), w AS (SELECT owner, owner AS base, 0 AS d FROM t UNION SELECT w.owner, b.target, w.d + 1 FROM w JOIN b ON b.source = w.base WHERE w.d < 16),
i AS (SELECT DISTINCT w.owner, w.base, t.name FROM w JOIN t ON t.owner = w.base AND t.interface WHERE w.base <> w.owner),
h AS (SELECT m.uid, o.uid AS target FROM m JOIN t ON t.owner = m.owner AND NOT t.interface JOIN i ON i.owner = m.owner JOIN m o ON o.owner = i.base AND o.name = m.name AND o.kind = m.kind
  WHERE CASE WHEN m.explicit IS NOT NULL THEN m.explicit = i.name ELSE NOT EXISTS (SELECT 1 FROM m x WHERE x.owner = m.owner AND x.explicit = i.name AND x.name = m.name) END)
SELECT uid, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target, CASE WHEN count(DISTINCT target) = 1 THEN 'IMPLEMENTS' ELSE 'AMBIGUOUS' END AS outcome FROM h GROUP BY uid""")
def _(f):
    return resolve_code.implements(f.sql(_IMPLEMENTING), f.sql(_TYPES), f.sql(_BASES))


_LOGICAL = "SELECT uid, concat('ctx', start_byte % 2) AS context, concat('p', end_byte % 3) AS project, qualified_name, kind, CAST(revision % 2 AS STRING) AS arity, '' AS discriminator FROM b_symbol"


@query("G20_logical_symbols", "SELECT sha256(" + " || ".join(f"octet_length(encode({c}))::VARCHAR || ':' || {c}" for c in resolve_code.IDENTITY) + f") AS identity, count(*) AS declarations, min(uid) AS first FROM ({_LOGICAL.replace('STRING', 'VARCHAR')}) GROUP BY " + ", ".join(resolve_code.IDENTITY))
def _(f):
    return resolve_code.logical_symbols(f.sql(_LOGICAL))


_CLAIMS = "SELECT concat(l_orderkey, ':', l_linenumber) AS claim, CASE WHEN l_partkey % 17 <> 0 THEN concat('occ:', l_orderkey, ':', l_linenumber) END AS site, l_suppkey % 11 <> 0 AS resolved, CASE WHEN l_suppkey % 13 <> 0 THEN CASE WHEN l_linenumber = 1 AND l_partkey % 4 <> 0 THEN 'USES_TYPE' ELSE 'CALLS' END END AS kind, CASE WHEN l_suppkey % 7 <> 0 THEN concat('order:', l_orderkey) END AS source, CASE WHEN l_linenumber = 1 THEN concat('supplier:', l_suppkey) ELSE concat('part:', l_partkey - l_partkey % 3 % 2) END AS target FROM lineitem"
_BOUND = "SELECT o.uid AS site, o.revision, CASE WHEN o.start_byte % 70 = 0 THEN o.revision + 1 ELSE o.revision END AS current, CASE WHEN o.start_byte % 20 <> 0 THEN o.relation_kind END AS bound_kind, o.source AS bound_source, o.target AS bound_target FROM b_occurrence o"


@query("G21_semantic_merge", f"""SELECT claim, CASE WHEN c.site IS NULL THEN 'REJECT_NO_OCCURRENCE' WHEN NOT resolved THEN 'REJECT_NOT_RESOLVED' WHEN kind IS NULL THEN 'REJECT_NO_KIND' WHEN c.source IS NULL THEN 'REJECT_NO_SOURCE' WHEN s.site IS NULL THEN 'REJECT_UNANCHORED' WHEN revision <> current THEN 'REJECT_STALE'
WHEN bound_kind IS NULL THEN 'BINDING' WHEN bound_kind <> kind OR bound_source <> c.source THEN 'REJECT_BOUND_ELSEWHERE' WHEN bound_target = c.target THEN 'CORROBORATING' ELSE 'CONFLICT' END AS outcome FROM ({_CLAIMS}) c LEFT JOIN ({_BOUND}) s ON s.site = c.site""")
def _(f):
    return resolve_code.merge_evidence(f.sql(_BOUND), f.sql(_CLAIMS))


@query("N18_command_routes", "SELECT event_id, CASE event_type WHEN 'view' THEN 'SOURCE_READ' WHEN 'click' THEN 'TEXT_SEARCH' WHEN 'purchase' THEN 'DISCOVERY' ELSE 'OPAQUE' END AS route FROM events")
def _(f):
    command = F.when(F.col("event_type") == "view", "cat src/a.py").when(F.col("event_type") == "click", "grep -n x src").when(F.col("event_type") == "purchase", "ls -la src").otherwise("cat a | sh")
    return f("events").select("event_id", command_route(command).alias("route"))


def command_route(command: Column) -> Column:
    """What a shell command does; anything composed of several commands is opaque."""
    simple = ~F.regexp_like(command, F.lit(r"[|;&<>`$(]"))
    head = F.substring_index(F.trim(command), " ", 1)
    return F.when(simple & head.isin("cat", "head", "tail", "sed"), "SOURCE_READ").when(simple & head.isin("grep", "rg"), "TEXT_SEARCH").when(simple & head.isin("ls", "find", "tree", "fd"), "DISCOVERY").otherwise("OPAQUE")
