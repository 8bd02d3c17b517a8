"""Fact tables (resources, symbols, relations, gaps, rules, work, journal) as views over base tables.

The text is the same for Spark and DuckDB, so that an oracle starts from the same facts.  Each view
is a CTE; an engine reads only those a query names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

VIEWS: dict[str, str] = {
    "b_resource": """
SELECT concat('customer:', c_custkey) AS uid, concat('region', n_regionkey, '/nation', c_nationkey, '/customer/', c_custkey) AS path_key,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'TEST' WHEN 'FURNITURE' THEN 'CONFIG' WHEN 'HOUSEHOLD' THEN 'DOCS' ELSE 'SOURCE' END AS role,
  CASE c_custkey % 4 WHEN 0 THEN 'PYTHON' WHEN 1 THEN 'RUST' WHEN 2 THEN 'TYPESCRIPT' END AS language,
  CASE WHEN c_acctbal < -500 THEN 'DELETED' ELSE 'ACTIVE' END AS state, 'FILE' AS kind, CAST(c_custkey % 3 + 1 AS BIGINT) AS revision, CAST(c_custkey % 1000 AS BIGINT) AS size
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('supplier:', s_suppkey), concat('region', n_regionkey, '/nation', s_nationkey, '/supplier/', s_suppkey), 'SOURCE', 'CSHARP', 'ACTIVE', 'FILE', CAST(1 AS BIGINT), CAST(s_suppkey % 1000 AS BIGINT)
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('part:', p_partkey), concat('parts/', p_brand, '/', p_partkey), 'SOURCE', NULL, 'ACTIVE', 'FILE', CAST(1 AS BIGINT), CAST(p_size AS BIGINT) FROM part
UNION ALL SELECT concat('nation:', n_nationkey), concat('region', n_regionkey, '/nation', n_nationkey), 'UNKNOWN', NULL, 'ACTIVE', 'DIRECTORY', CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM nation""",
    "b_structure": """
SELECT uid AS resource_uid, CASE WHEN revision = 1 THEN 'COMPLETE' WHEN language = 'RUST' THEN 'PARTIAL' WHEN language = 'PYTHON' THEN 'CONTAINER_ONLY' WHEN size % 7 = 0 THEN 'UNAVAILABLE' ELSE 'COMPLETE' END AS state,
  CASE WHEN size % 5 = 0 THEN 'DIRTY' ELSE 'CURRENT' END AS freshness, revision AS basis_revision
FROM b_resource WHERE kind = 'FILE' AND size % 11 <> 0""",
    "b_symbol": """
SELECT concat('order:', o_orderkey) AS uid, concat('customer:', o_custkey) AS resource_uid, CASE WHEN o_orderkey % 3 = 0 THEN concat('order:', o_orderkey - 1) END AS parent_uid,
  CASE o_orderkey % 5 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'FUNCTION' WHEN 2 THEN 'METHOD' WHEN 3 THEN 'FIELD' ELSE 'INTERFACE' END AS kind,
  concat('f', o_orderkey % 97) AS name, concat('m', o_custkey % 10, '.f', o_orderkey % 97) AS qualified_name, concat('(', o_orderpriority, ')') AS signature, o_orderkey % 2 = 0 AS exported,
  CAST(o_orderkey % 50 * 100 AS BIGINT) AS start_byte, CAST(o_orderkey % 50 * 100 + 80 + o_orderkey % 7 * 60 AS BIGINT) AS end_byte, CAST(o_orderkey % 3 + 1 AS BIGINT) AS revision
FROM orders""",
    "b_relation": """
SELECT DISTINCT kind, source, target FROM (
  SELECT 'CALLS' AS kind, concat('order:', l_orderkey) AS source, concat('part:', l_partkey) AS target FROM lineitem WHERE l_returnflag <> 'R'
  UNION ALL SELECT 'USES_TYPE', concat('order:', l_orderkey), concat('supplier:', l_suppkey) FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT 'IMPLEMENTS', concat('supplier:', l_suppkey), concat('part:', l_partkey) FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45
  UNION ALL SELECT 'CALLS', concat('customer:', o_custkey), concat('order:', o_orderkey) FROM orders
  UNION ALL SELECT 'IMPORTS', concat('nation:', c_nationkey), concat('customer:', c_custkey) FROM customer) t""",
    "b_owner": """
SELECT concat('order:', o_orderkey) AS entity, concat('customer:', o_custkey) AS resource_uid FROM orders UNION ALL SELECT uid, uid FROM b_resource""",
    "b_occurrence": """
SELECT concat('occ:', l_orderkey, ':', l_linenumber) AS uid, concat('customer:', o_custkey) AS resource_uid, CASE WHEN l_linenumber % 5 <> 0 THEN concat('order:', l_orderkey) END AS symbol_uid,
  CASE WHEN l_linenumber = 1 THEN 'TYPE_SITE' ELSE 'CALL_SITE' END AS kind, CAST(l_orderkey % 50 * 100 + l_linenumber * 10 AS BIGINT) AS start_byte, CAST(l_orderkey % 50 * 100 + l_linenumber * 10 + l_quantity AS BIGINT) AS end_byte,
  CASE WHEN l_linenumber = 1 THEN 'USES_TYPE' ELSE 'CALLS' END AS relation_kind, concat('order:', l_orderkey) AS source, CASE WHEN l_linenumber = 1 THEN concat('supplier:', l_suppkey) ELSE concat('part:', l_partkey) END AS target, CAST(o_custkey % 3 + 1 AS BIGINT) AS revision
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' OR l_linenumber = 1""",
    "b_gap": """
SELECT concat('gap:', l_orderkey, ':', l_linenumber) AS uid, concat('customer:', o_custkey) AS resource_uid, CASE WHEN l_linenumber % 4 <> 0 THEN concat('order:', l_orderkey) END AS symbol_uid,
  CAST(l_orderkey % 50 * 100 + l_linenumber * 10 AS BIGINT) AS start_byte, CAST(l_orderkey % 50 * 100 + l_linenumber * 10 + 5 AS BIGINT) AS end_byte,
  CASE l_linenumber % 3 WHEN 0 THEN 'CALLS' WHEN 1 THEN 'INHERITANCE' ELSE 'IMPORTS' END AS intended, concat(CASE WHEN l_partkey % 2 = 0 THEN 'a::' ELSE 'b.' END, 'f', l_partkey % 97) AS lookup_name,
  CASE l_suppkey % 4 WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'NOT_FOUND' WHEN 2 THEN 'DYNAMIC' ELSE 'CONFIG' END AS reason, l_linenumber % 3 = 2 AS truncated, l_partkey AS first_candidate, CAST(l_linenumber % 3 * 9 AS BIGINT) AS n_candidates
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "b_candidate": """
SELECT g.uid AS gap_uid, concat('part:', (g.first_candidate * 7 + n.i * n.i) % 200 + 1) AS target, n.i AS arrival
FROM b_gap g JOIN (SELECT CAST(n_nationkey AS BIGINT) AS i FROM nation) n ON n.i < g.n_candidates""",
    "b_journal": """
SELECT event_id AS seq, user_id AS path_id, CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'MODIFY' END AS kind, ts FROM events""",
    "b_policy": """
SELECT p_partkey AS uid, CASE WHEN p_size % 10 <> 0 THEN p_brand END AS policy_key, CAST(p_size % 4 AS BIGINT) AS layer, CASE WHEN p_size % 2 = 0 THEN 'PROJECT' ELSE 'USER' END AS tier,
  p_partkey % 23 = 0 AS protected, p_partkey % 2 = 0 AS trusted, p_type AS rule_text, CASE WHEN p_partkey % 13 = 0 THEN 'RETIRED' ELSE 'ACTIVE' END AS status FROM part""",
    "b_decision": """
SELECT p_partkey AS uid, p_brand AS topic, CAST(p_size % 4 AS BIGINT) AS layer, concat('choice', p_partkey % 2) AS chosen, CASE WHEN p_partkey % 9 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status FROM part WHERE p_partkey % 11 = 0""",
    "b_work": """
SELECT o_orderkey AS uid, CASE o_orderkey % 6 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'BLOCKED' WHEN 3 THEN 'PAUSED' WHEN 4 THEN 'COMPLETED' ELSE 'ABANDONED' END AS status, o_orderdate AS updated, o_custkey AS actor FROM orders""",
    "b_work_resource": """
SELECT l_orderkey AS work_uid, concat('part:', l_partkey) AS resource_uid, CASE l_returnflag WHEN 'A' THEN 'TARGET' WHEN 'N' THEN 'AFFECTED' ELSE 'READ' END AS role FROM lineitem""",
    "b_source": """
SELECT concat(source, '/', lang, '/', doc_id) AS path_key, doc_id, text FROM documents""",
}
_NAME = re.compile(r"\b(b_\w+)\b")


def needed(names: set[str]) -> list[str]:
    """The named views and all they read, in order of definition."""
    seen: set[str] = set()
    todo = set(names)
    while todo:
        name = todo.pop()
        seen.add(name)
        todo |= {x for x in _NAME.findall(VIEWS[name]) if x in VIEWS} - seen
    return [x for x in VIEWS if x in seen]


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names put before it."""
    views = needed({x for x in _NAME.findall(sql) if x in VIEWS})
    head = ", ".join(f"{x} AS ({VIEWS[x]})" for x in views)
    sql = sql.strip()
    if not head:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql[15:]}"
    return f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"


_BASE = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")


class Facts:
    """DataFrames of base tables and views of one data directory; the session's own views stay untouched."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        """A query over base tables and fact views."""
        views = needed({x for x in _NAME.findall(text) if x in VIEWS})
        if views:
            text = "WITH " + ", ".join(f"{x} AS ({VIEWS[x]})" for x in views) + " " + text
        used = {m[2] for m in _BASE.finditer(text)}
        text = text.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(_BASE.sub(r"\1 {\2}", text), **{t: self(t) for t in used})
