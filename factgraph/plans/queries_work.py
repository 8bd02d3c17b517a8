"""Queries over rules, work, delivery, the journal and index upkeep, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import text as T
from factgraph.operators import delivery, knowledge, store
from factgraph.operators.answer import bounded, structured_status
from factgraph.plans.bridge import Facts
from factgraph.streaming import journal

ALL: dict[str, tuple[Callable[[Facts], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Facts], DataFrame]):
        ALL[name] = (f, sql)
        return f

    return keep


@query("N2_policy_resolution", """WITH p AS (SELECT *, CASE WHEN tier = 'PROJECT' THEN 100 ELSE 0 END + layer AS r FROM b_policy WHERE status = 'ACTIVE'), b AS (SELECT policy_key, max(r) AS best FROM p WHERE NOT protected AND policy_key IS NOT NULL GROUP BY policy_key)
SELECT uid, CASE WHEN protected AND trusted THEN 'PROTECTED' WHEN protected THEN 'CONFLICT' WHEN p.policy_key IS NULL THEN 'UNKEYED' WHEN r = best THEN 'SELECTED' WHEN tier = 'USER' AND best >= 100 THEN 'SHADOWED_BY_TIER' ELSE 'SHADOWED_BY_LAYER' END AS outcome FROM p LEFT JOIN b ON b.policy_key = p.policy_key""")
def _(f):
    return knowledge.resolve_policies(f("b_policy")).select("uid", "outcome")


def asked(f: Facts, column: str) -> DataFrame:
    """Keys that directives of the request name: brands that end with 2."""
    return f("part").where(F.endswith("p_brand", F.lit("2"))).select(F.col("p_brand").alias(column)).distinct()


_ASKED = "SELECT DISTINCT p_brand AS k FROM part WHERE p_brand LIKE '%2'"
_GUARDED = "SELECT policy_key FROM b_policy WHERE status = 'ACTIVE' AND protected AND trusted AND policy_key IS NOT NULL"


@query("N2_policy_directives", f"""WITH p AS (SELECT *, CASE WHEN tier = 'PROJECT' THEN 100 ELSE 0 END + layer AS r FROM b_policy WHERE status = 'ACTIVE'), b AS (SELECT policy_key, max(r) AS best FROM p WHERE NOT protected AND policy_key IS NOT NULL GROUP BY policy_key)
SELECT uid, CASE WHEN protected AND trusted THEN 'PROTECTED' WHEN protected THEN 'CONFLICT' WHEN p.policy_key IS NULL THEN 'UNKEYED' WHEN p.policy_key IN ({_ASKED}) AND p.policy_key NOT IN ({_GUARDED}) THEN 'SHADOWED_BY_REQUEST' WHEN r = best THEN 'SELECTED' WHEN tier = 'USER' AND best >= 100 THEN 'SHADOWED_BY_TIER' ELSE 'SHADOWED_BY_LAYER' END AS outcome FROM p LEFT JOIN b ON b.policy_key = p.policy_key""")
def _(f):
    return knowledge.resolve_policies(f("b_policy"), asked(f, "policy_key")).select("uid", "outcome")


@query("N2_rejected_directives", f"SELECT k AS policy_key FROM ({_ASKED}) WHERE k IN ({_GUARDED})")
def _(f):
    return knowledge.rejected_directives(f("b_policy"), asked(f, "policy_key"))


@query("N3_decision_resolution", f"SELECT topic, CASE WHEN count(DISTINCT chosen) = 1 AND topic NOT IN ({_ASKED}) THEN min(chosen) END AS chosen, count(DISTINCT chosen) > 1 AND topic NOT IN ({_ASKED}) AS conflict, count(*) AS votes, topic IN ({_ASKED}) AS shadowed FROM b_decision d WHERE status = 'ACTIVE' AND layer = (SELECT max(layer) FROM b_decision e WHERE e.topic = d.topic AND e.status = 'ACTIVE') GROUP BY topic")
def _(f):
    return knowledge.resolve_decisions(f("b_decision"), asked(f, "topic"))


@query("N4_preference_resolution", f"""WITH p AS (SELECT * FROM b_policy WHERE status = 'ACTIVE' AND (policy_key LIKE 'Brand#1%' OR policy_key LIKE 'Brand#3%')), d AS (SELECT topic FROM b_decision WHERE uid % 3 = 0),
v AS (SELECT policy_key, count(DISTINCT rule_text) AS n, min(rule_text) AS v, CASE WHEN policy_key IN ({_ASKED}) THEN 'SHADOWED_BY_REQUEST' WHEN policy_key IN (SELECT topic FROM d) THEN 'SHADOWED_BY_DECISION' END AS shadowed FROM p WHERE layer = (SELECT max(layer) FROM p q WHERE q.policy_key = p.policy_key) GROUP BY policy_key)
SELECT policy_key, CASE WHEN n = 1 AND shadowed IS NULL THEN v END AS value, n > 1 AND shadowed IS NULL AS conflict, shadowed FROM v""")
def _(f):
    named = f("b_policy").where("policy_key LIKE 'Brand#1%' OR policy_key LIKE 'Brand#3%'").select("policy_key").distinct()
    keys = [r[0] for r in bounded(named, "named keys").collect()]
    return knowledge.resolve_preferences(f("b_policy"), f("b_decision").where("uid % 3 = 0"), keys, asked(f, "policy_key"))


@query("N5_layer_evidence", "SELECT layer, tier, count(*) AS n, count(DISTINCT policy_key) AS keys FROM b_policy WHERE status = 'ACTIVE' GROUP BY layer, tier")
def _(f):
    return knowledge.layer_counts(f("b_policy"))


_LINKS = "SELECT uid AS from_uid, below AS to_uid, CASE WHEN uid % 2 = 0 THEN 'REVERSES' ELSE 'SUPERSEDES' END AS kind FROM (SELECT uid, lag(uid) OVER (PARTITION BY topic ORDER BY uid) AS below FROM b_decision) t WHERE below IS NOT NULL"


@query("N7_lineage", f"SELECT from_uid AS uid, to_uid AS linked, kind, 'OUT' AS way FROM ({_LINKS}) UNION ALL SELECT to_uid, from_uid, kind, 'IN' FROM ({_LINKS})")
def _(f):
    return knowledge.lineage(f.sql(_LINKS))


@query("N8_supersede", "SELECT uid, CASE WHEN status = 'ACTIVE' AND uid < (SELECT max(uid) FROM b_decision e WHERE e.topic = d.topic) THEN 'SUPERSEDED' ELSE status END AS status FROM b_decision d")
def _(f):
    return knowledge.superseded(f("b_decision"))


@query("N9_note_promotion", "SELECT n.o_orderkey AS uid, CASE WHEN r.receipt IS NULL THEN 'NEW' WHEN r.digest = n.o_orderpriority THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome FROM orders n LEFT JOIN (SELECT o_orderkey AS receipt, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderpriority END AS digest FROM orders WHERE o_orderkey % 2 = 0) r ON r.receipt = n.o_orderkey")
def _(f):
    notes = f("orders").select(F.col("o_orderkey").alias("receipt"), F.col("o_orderpriority").alias("digest"))
    known = f("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("receipt"), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(F.col("o_orderpriority")).alias("digest"))
    return knowledge.promote(notes, known).select(F.col("receipt").alias("uid"), "outcome")


@query("N10_transitions", """SELECT status, action, count(*) AS n, CASE WHEN action = 'START' AND status IN ('OPEN', 'PAUSED', 'BLOCKED') THEN 'ACTIVE' WHEN action = 'COMPLETE' AND status = 'ACTIVE' THEN 'COMPLETED' WHEN action = 'ABANDON' AND status IN ('OPEN', 'ACTIVE', 'BLOCKED', 'PAUSED') THEN 'ABANDONED' END AS next
FROM (SELECT status, CASE actor % 3 WHEN 0 THEN 'START' WHEN 1 THEN 'COMPLETE' ELSE 'ABANDON' END AS action FROM b_work) GROUP BY status, action""")
def _(f):
    action = F.when(F.col("actor") % 3 == 0, "START").when(F.col("actor") % 3 == 1, "COMPLETE").otherwise("ABANDON")
    w = f("b_work").withColumn("action", action).withColumn("next", knowledge.transition(F.col("status"), F.col("action")))
    return w.groupBy("status", "action", "next").agg(F.count("*").alias("n"))


@query("N11_work_snapshot", "SELECT w.uid, w.status, count(r.resource_uid) AS resources, count(DISTINCT r.role) AS roles FROM b_work w LEFT JOIN b_work_resource r ON r.work_uid = w.uid GROUP BY w.uid, w.status")
def _(f):
    return knowledge.work_snapshot(f("b_work"), f("b_work_resource"))


@query("N12_staleness", "SELECT uid, CASE WHEN status IN ('COMPLETED', 'ABANDONED') THEN 'CLOSED' WHEN actor % 10 = 0 THEN 'NOT_EVALUATED' WHEN updated < TIMESTAMP '1996-01-01' THEN 'POSSIBLY_STALE' ELSE 'CURRENT' END AS staleness FROM b_work")
def _(f):
    cutoff = F.when(F.col("actor") % 10 != 0, F.lit("1996-01-01").cast("timestamp_ntz"))
    return f("b_work").select("uid", knowledge.staleness(F.col("status"), F.col("updated"), cutoff).alias("staleness"))


@query("N13_overlap", """SELECT o.resource_uid, o.work_uid, w.status, array_to_string(list_sort(list_distinct(list(o.role))), ',') AS other_roles, (SELECT array_to_string(list_sort(list_distinct(list(m.role))), ',') FROM b_work_resource m WHERE m.work_uid = 7 AND m.resource_uid = o.resource_uid) AS this_roles
FROM b_work_resource o JOIN b_work w ON w.uid = o.work_uid AND w.status IN ('OPEN', 'ACTIVE', 'BLOCKED', 'PAUSED') WHERE o.work_uid <> 7 AND o.resource_uid IN (SELECT resource_uid FROM b_work_resource WHERE work_uid = 7) GROUP BY o.resource_uid, o.work_uid, w.status""")
def _(f):
    o = knowledge.overlaps(f("b_work"), f("b_work_resource"), 7)
    return o.select("resource_uid", "work_uid", "status", F.array_join("other_roles", ",").alias("other_roles"), F.array_join("this_roles", ",").alias("this_roles"))


@query("J9_work_overlap", "SELECT resource_uid, work_uid, others FROM (SELECT resource_uid, work_uid, count(*) OVER (PARTITION BY resource_uid) - 1 AS others FROM (SELECT DISTINCT resource_uid, work_uid FROM b_work_resource WHERE role = 'TARGET')) WHERE others > 0")
def _(f):
    return knowledge.overlap_members(f("b_work_resource"), "TARGET")


@query("A16_role_sets", "SELECT resource_uid, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM b_work_resource GROUP BY resource_uid")
def _(f):
    return f("b_work_resource").groupBy("resource_uid").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("N14_generation_reference", "SELECT w.uid, CASE WHEN g.n_nationkey IS NULL THEN 'ABSENT' WHEN g.n_regionkey = w.uid % 5 THEN 'PRESENT_MATCHING' ELSE 'PRESENT_DIFFERENT' END AS reference FROM b_work w LEFT JOIN nation g ON g.n_nationkey = w.uid % 40")
def _(f):
    asked = f("b_work").select("uid", (F.col("uid") % 40).alias("generation"), (F.col("uid") % 5).alias("basis"))
    return store.generation_reference(asked, f("nation").select(F.col("n_nationkey").cast("long").alias("generation"), F.col("n_regionkey").alias("basis")))


@query("N15_job_log", "SELECT conv_id, turn AS seq, role AS kind, coalesce(max(turn) OVER (PARTITION BY conv_id), 0) + 1 AS next_seq FROM conversations")
def _(f):
    jobs = f("conversations").select("conv_id", F.col("turn").alias("seq"), F.col("role").alias("kind"))
    return jobs.join(store.next_sequence(jobs, "conv_id", "seq").withColumnRenamed("next", "next_seq"), "conv_id")


@query("O9_event_poll", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn > 1 ORDER BY turn LIMIT 64")
def _(f):
    return f("conversations").where("conv_id = 3 AND turn > 1").orderBy("turn").limit(64).select("conv_id", "turn", "role")


@query("A13_next_sequence", "SELECT status, max(uid) + 1 AS next FROM b_work GROUP BY status")
def _(f):
    return store.next_sequence(f("b_work"), "status", "uid")


@query("N17_head_tail_capture", """WITH t AS (SELECT doc_id, hex(encode(text)) AS x, strlen(text) AS n FROM b_source WHERE strlen(text) > 0) SELECT doc_id, CAST(0 AS BIGINT) AS "offset", substr(x, 1, 400) AS kept, greatest(n - 400, 0) AS omitted FROM t UNION ALL SELECT doc_id, greatest(n - 200, 200), substr(x, 2 * greatest(n - 200, 200) + 1), greatest(n - 400, 0) FROM t WHERE n > 200""")
def _(f):
    """Texts as streams of one chunk of bytes; 200 bytes of either end are kept."""
    chunks = f("b_source").select("doc_id", F.lit(0).cast("long").alias("offset"), F.encode("text", "UTF-8").alias("data"))
    return store.head_tail(chunks, "doc_id", "offset", "data", 200, 200).select("doc_id", "offset", F.hex("data").alias("kept"), "omitted")


@query("N20_list_by_status", "SELECT uid FROM b_policy WHERE status = 'RETIRED' ORDER BY uid LIMIT 512")
def _(f):
    return f("b_policy").where("status = 'RETIRED'").orderBy("uid").limit(512).select("uid")


@query("O8_status_order", "SELECT uid, status, place FROM (SELECT uid, status, row_number() OVER (PARTITION BY status ORDER BY uid) AS place FROM b_work) WHERE place <= 20")
def _(f):
    return knowledge.by_status(f("b_work"), 20).select("uid", "status", F.col("place").cast("long").alias("place"))


@query("W2_most_specific_layer", "SELECT uid FROM b_policy p WHERE policy_key IS NOT NULL AND layer = (SELECT max(layer) FROM b_policy q WHERE q.policy_key = p.policy_key)")
def _(f):
    return f("b_policy").withColumn("top", F.max("layer").over(Window.partitionBy("policy_key"))).where("policy_key IS NOT NULL AND layer = top").select("uid")


@query("W3_latest_handoff", "SELECT actor, uid FROM (SELECT actor, uid, row_number() OVER (PARTITION BY actor ORDER BY updated DESC, uid DESC) AS k FROM b_work) WHERE k = 1")
def _(f):
    return knowledge.latest(f("b_work"), "actor", [F.col("updated"), F.col("uid")]).select("actor", "uid")


# journal -----------------------------------------------------------------------------------------

_HOURS = 6 * 3600 * 1000
_RUNS = """WITH e AS (SELECT *, lag(ts) OVER w AS pt, lag(kind) OVER w AS pk FROM b_journal WINDOW w AS (PARTITION BY path_id ORDER BY ts, seq)),
r AS (SELECT *, sum(CASE WHEN pt IS NULL OR epoch_us(ts) - epoch_us(pt) > 21600000000 OR kind = 'CREATE' OR pk = 'DELETE' THEN 1 ELSE 0 END) OVER (PARTITION BY path_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM e),
x AS (SELECT path_id, run, min_by(seq, (ts, seq)) AS first_seq, max_by(seq, (ts, seq)) AS last_seq, min_by(kind, (ts, seq)) AS fk, max_by(kind, (ts, seq)) AS lk, count(*) AS events FROM r GROUP BY path_id, run)"""


@query("ST2_coalesced_runs", f"{_RUNS} SELECT path_id, first_seq, last_seq, CASE WHEN lk = 'DELETE' THEN 'DELETE' ELSE fk END AS kind, events FROM x")
def _(f):
    return journal.runs(f("b_journal"), _HOURS).drop("run")


@query("W5_journal_states", """SELECT seq, CASE WHEN f THEN 'COALESCED' ELSE 'PENDING' END AS state, CASE WHEN f THEN nx END AS into_seq FROM (SELECT seq, lead(seq) OVER w AS nx, coalesce(lead(seq) OVER w IS NOT NULL AND epoch_us(lead(ts) OVER w) - epoch_us(ts) <= 21600000000 AND lead(kind) OVER w <> 'CREATE' AND kind <> 'DELETE', false) AS f FROM b_journal WINDOW w AS (PARTITION BY path_id ORDER BY ts, seq))""")
def _(f):
    return journal.coalesced(f("b_journal"), _HOURS).select("seq", "state", "into_seq")


@query("ST1_event_filter", "SELECT seq, path_id, kind FROM b_journal WHERE path_id % 7 <> 0")
def _(f):
    ignored = f("b_journal").select("path_id").where("path_id % 7 = 0").distinct()
    return f("b_journal").join(ignored, "path_id", "left_anti").select("seq", "path_id", "kind")


@query("ST3_transients", f"{_RUNS} SELECT path_id, first_seq FROM x WHERE fk = 'CREATE' AND lk = 'DELETE' AND path_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _(f):
    r = journal.runs(f("b_journal"), _HOURS)
    first = f("b_journal").select(F.col("seq").alias("first_seq"), F.col("kind").alias("first_kind"))
    return journal.transient(r.join(first, "first_seq"), f("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("path_id"))).select("path_id", "first_seq")


_MOVES = "SELECT p_partkey AS path, (p_partkey * 7919) % 1009 AS digest FROM part WHERE p_partkey % 2 = {}"


@query("ST4_moves", f"WITH p AS (SELECT a.path AS source, b.path AS destination FROM ({_MOVES.format(0)}) a JOIN ({_MOVES.format(1)}) b ON a.digest = b.digest) SELECT source, destination FROM p WHERE source IN (SELECT source FROM p GROUP BY source HAVING count(*) = 1) AND destination IN (SELECT destination FROM p GROUP BY destination HAVING count(*) = 1)")
def _(f):
    p = f("part").select(F.col("p_partkey").alias("path"), ((F.col("p_partkey") * 7919) % 1009).alias("digest"))
    return journal.unambiguous_moves(p.where("path % 2 = 0"), p.where("path % 2 = 1"))


_SPACES = "SELECT CAST(c_custkey AS BIGINT) AS workspace, CASE WHEN c_custkey % 19 = 0 THEN 'LOST' ELSE 'CONTINUOUS' END AS continuity FROM customer"
_PENDING = "SELECT path_id AS workspace, seq, CASE WHEN path_id % 3 = 0 THEN kind ELSE 'MODIFY' END AS kind, CASE WHEN path_id % 11 <> 1 OR seq % 2 = 0 THEN CASE WHEN path_id % 5 = 0 THEN seq % 40 ELSE path_id END END AS resource_uid FROM b_journal"
_KNOWN = "SELECT CAST(c_custkey AS BIGINT) AS resource_uid, CASE WHEN c_acctbal < 0 THEN 'DELETED' ELSE 'ACTIVE' END AS state, CASE WHEN c_custkey % 6 = 1 THEN 'DIRECTORY' ELSE 'FILE' END AS kind, 'SOURCE' AS role, CASE WHEN c_custkey % 2 = 0 THEN 'RUST' END AS language FROM customer WHERE c_custkey % 4 <> 0"
_SEEN = "SELECT CAST(c_custkey AS BIGINT) AS resource_uid, c_nationkey <> 1 AS present, c_nationkey = 2 AS excluded, 'FILE' AS kind, CASE WHEN c_nationkey = 3 THEN 'TEST' ELSE 'SOURCE' END AS role, CASE WHEN c_custkey % 2 = 0 AND c_nationkey <> 4 THEN 'RUST' END AS language, c_nationkey <> 5 AS same_identity FROM customer"


@query("ST7_refresh_decision", f"""WITH n AS (SELECT workspace, count(*) AS n, count(DISTINCT resource_uid) AS ids, min(resource_uid) AS uid, min_by(kind, seq) FILTER (kind <> 'MODIFY' OR resource_uid IS NULL) AS odd FROM ({_PENDING}) GROUP BY workspace)
SELECT s.workspace, CASE WHEN continuity = 'LOST' THEN 'WATCHER_CONTINUITY_LOST' WHEN n IS NULL THEN 'NOTHING_PENDING' WHEN odd <> 'MODIFY' THEN 'UNSUPPORTED_EVENT' WHEN odd IS NOT NULL THEN 'NOT_AN_EXISTING_RESOURCE' WHEN ids > 1 THEN 'MULTIPLE_PENDING_RESOURCES' WHEN r.state IS DISTINCT FROM 'ACTIVE' THEN 'NOT_AN_EXISTING_RESOURCE' WHEN r.kind = 'DIRECTORY' THEN 'NOT_A_FILE'
 WHEN o.excluded THEN 'TARGET_EXCLUDED' WHEN NOT coalesce(o.present, false) THEN 'TARGET_PATH_MISSING' WHEN r.kind <> o.kind OR r.role <> o.role OR r.language IS DISTINCT FROM o.language THEN 'CLASSIFICATION_CHANGED' WHEN NOT o.same_identity THEN 'IDENTITY_NOT_CONTINUOUS' ELSE 'REFRESH' END AS decision
FROM ({_SPACES}) s LEFT JOIN n ON n.workspace = s.workspace LEFT JOIN ({_KNOWN}) r ON r.resource_uid = n.uid LEFT JOIN ({_SEEN}) o ON o.resource_uid = n.uid""")
def _(f):
    return journal.refresh_decision(f.sql(_SPACES), f.sql(_PENDING), f.sql(_KNOWN), f.sql(_SEEN))


@query("ST10_applied_marking", "SELECT seq, CASE WHEN seq <= (SELECT max(seq) // 2 FROM b_journal) THEN 'APPLIED' ELSE 'PENDING' END AS state, CASE WHEN seq <= (SELECT max(seq) // 2 FROM b_journal) THEN 7 END AS generation FROM b_journal")
def _(f):
    through = f("b_journal").agg(F.max("seq")).first()[0] or 0
    return journal.applied(f("b_journal"), through // 2, 7).select("seq", "state", "generation")


@query("ST11_publication_freshness", "SELECT r.uid, CASE WHEN s.resource_uid IS NULL THEN 'NEVER_PUBLISHED' WHEN s.state = 'UNAVAILABLE' THEN 'PROFILE_INCOMPATIBLE' WHEN s.freshness = 'DIRTY' THEN 'CONFIG_CHANGED' WHEN s.basis_revision <> r.revision THEN 'SOURCE_CHANGED' ELSE 'CURRENT' END AS verdict FROM b_resource r LEFT JOIN b_structure s ON s.resource_uid = r.uid WHERE r.kind = 'FILE'")
def _(f):
    s = f("b_structure").select(F.col("resource_uid").alias("uid"), F.col("state").alias("s"), "freshness", "basis_revision")
    j = f("b_resource").where("kind = 'FILE'").join(s, "uid", "left")
    verdict = F.when(F.col("s").isNull(), "NEVER_PUBLISHED").when(F.col("s") == "UNAVAILABLE", "PROFILE_INCOMPATIBLE").when(F.col("freshness") == "DIRTY", "CONFIG_CHANGED").when(F.col("basis_revision") != F.col("revision"), "SOURCE_CHANGED").otherwise("CURRENT")
    return j.select("uid", verdict.alias("verdict"))


# index upkeep --------------------------------------------------------------------------------------


@query("K1_index_upsert", """WITH n AS (SELECT uid, size + 1 AS size, 'ACTIVE' AS state FROM b_resource WHERE size % 10 = 0)
SELECT r.uid, r.size, CASE WHEN r.size % 10 = 1 THEN 'DELETED' ELSE r.state END AS state FROM b_resource r WHERE uid NOT IN (SELECT uid FROM n) UNION ALL SELECT * FROM n""")
def _(f):
    r = f("b_resource").select("uid", "size", "state")
    return store.upsert(r, r.where("size % 10 = 0").select("uid", (F.col("size") + 1).alias("size"), F.lit("ACTIVE").alias("state")), r.where("size % 10 = 1"), "uid")


@query("K2_evidence_replacement", """WITH o AS (SELECT * FROM b_occurrence WHERE resource_uid <> 'customer:1') SELECT kind, source, target FROM b_relation r WHERE EXISTS (SELECT 1 FROM o WHERE o.relation_kind = r.kind AND o.source = r.source AND o.target = r.target) UNION SELECT 'CALLS', 'customer:1', 'part:1'""")
def _(f):
    new = f.spark.range(1).select(F.lit("CALLS").alias("kind"), F.lit("customer:1").alias("source"), F.lit("part:1").alias("target"))
    return store.replace_evidence(f("b_relation"), f("b_occurrence").drop("kind").withColumnRenamed("relation_kind", "kind"), "customer:1", new)


@query("G23_ensured_relations", """WITH n AS (SELECT 'CALLS' AS kind, concat('order:', o_orderkey) AS source, concat('part:', o_custkey % 200 + 1) AS target FROM orders) SELECT kind, source, target FROM b_relation UNION SELECT * FROM n""")
def _(f):
    new = f.sql("SELECT 'CALLS' AS kind, concat('order:', o_orderkey) AS source, concat('part:', o_custkey % 200 + 1) AS target FROM orders")
    return store.ensure(f("b_relation").select("kind", "source", "target"), new.unionByName(new), ["kind", "source", "target"])


@query("G23_deleted_by_source", """WITH e AS (SELECT relation_kind AS kind, source, target, resource_uid FROM b_occurrence), g AS (SELECT uid FROM b_resource WHERE size % 3 = 0)
SELECT kind, source, target FROM b_relation r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.kind = r.kind AND e.source = r.source AND e.target = r.target) OR EXISTS (SELECT 1 FROM e WHERE e.kind = r.kind AND e.source = r.source AND e.target = r.target AND e.resource_uid NOT IN (SELECT uid FROM g))""")
def _(f):
    evidence = f("b_occurrence").select(F.col("relation_kind").alias("kind"), "source", "target", "resource_uid")
    return store.delete_by_source(f("b_relation"), evidence, f("b_resource").where("size % 3 = 0").select(F.col("uid").alias("resource_uid")))[0]


_PROJECTS = "SELECT CAST(n_nationkey AS BIGINT) AS uid, concat('region', n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE concat('/nation', n_nationkey) END) AS path, CASE WHEN n_nationkey % 7 = 1 THEN 'DETACHED' WHEN n_nationkey % 7 = 2 THEN 'MISSING' ELSE 'ACTIVE' END AS state FROM nation"


@query("N19_located_projects", f"""WITH p AS ({_PROJECTS}), r AS (SELECT DISTINCT path_key AS path FROM b_resource), h AS (SELECT r.path, p.path AS root, count(*) AS n, min(uid) AS u FROM r JOIN p ON p.state = 'ACTIVE' AND (r.path = p.path OR starts_with(r.path, p.path || '/')) GROUP BY 1, 2), b AS (SELECT path, max_by(n, length(root)) AS n, max_by(u, length(root)) AS u FROM h GROUP BY path)
SELECT r.path, CASE WHEN n = 1 THEN u END AS uid, CASE WHEN n IS NULL THEN 'NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS outcome FROM r LEFT JOIN b ON b.path = r.path""")
def _(f):
    return store.locate_project(f.sql(_PROJECTS), f("b_resource").select(F.col("path_key").alias("path")))


@query("N19_registry", f"SELECT uid, CASE WHEN state = 'DETACHED' THEN path WHEN uid % 2 = 0 THEN concat('moved/', uid) ELSE path END AS path, CASE WHEN state = 'DETACHED' THEN state WHEN uid % 2 = 0 THEN 'ACTIVE' ELSE 'MISSING' END AS state FROM ({_PROJECTS}) UNION ALL SELECT 100, 'moved/100', 'ACTIVE'")
def _(f):
    found = f.sql("SELECT CAST(n_nationkey AS BIGINT) AS uid, concat('moved/', n_nationkey) AS path FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT CAST(100 AS BIGINT), 'moved/100'")
    return store.register(f.sql(_PROJECTS), found)


@query("K3_latest_wins", "SELECT path_id, kind, seq FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY ts DESC, seq DESC) AS k FROM b_journal) WHERE k = 1")
def _(f):
    return knowledge.latest(f("b_journal"), "path_id", [F.col("ts"), F.col("seq")]).select("path_id", "kind", "seq")


@query("K5_artifact_retention", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(strlen(text)) OVER w AS kept, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)) WHERE kept <= 1500 AND n <= 4")
def _(f):
    return store.retained(f("conversations"), "conv_id", "turn", F.octet_length("text"), 1500, 4).select("conv_id", "turn")


# delivery ------------------------------------------------------------------------------------------

_ITEMS = "SELECT uid, resource_uid, CASE reason WHEN 'AMBIGUOUS' THEN 'TEST' WHEN 'NOT_FOUND' THEN 'DIRECT' WHEN 'DYNAMIC' THEN 'SOURCE' ELSE 'TARGET' END AS category, length(lookup_name) * 10 AS bytes, start_byte FROM b_gap"
_TIER = "CASE category WHEN 'TARGET' THEN 1 WHEN 'DIRECT' THEN 2 WHEN 'TEST' THEN 4 ELSE 8 END"


def items(f: Facts) -> DataFrame:
    category = F.when(F.col("reason") == "AMBIGUOUS", "TEST").when(F.col("reason") == "NOT_FOUND", "DIRECT").when(F.col("reason") == "DYNAMIC", "SOURCE").otherwise("TARGET")
    return f("b_gap").select("uid", "resource_uid", category.alias("category"), (F.length("lookup_name") * 10).alias("bytes"), "start_byte").withColumn("tier", delivery.tier(F.col("category")))


@query("B4_tiers", f"SELECT uid, {_TIER} AS tier FROM ({_ITEMS})")
def _(f):
    return items(f).select("uid", "tier")


@query("B2_delivery_budget", f"SELECT resource_uid, uid FROM (SELECT resource_uid, uid, row_number() OVER w AS k, sum(bytes) OVER (PARTITION BY resource_uid ORDER BY {_TIER}, uid, bytes ROWS UNBOUNDED PRECEDING) AS upto FROM ({_ITEMS}) WINDOW w AS (PARTITION BY resource_uid ORDER BY {_TIER}, uid, bytes)) WHERE k <= 8 AND upto <= 300")
def _(f):
    return delivery.page(items(f), ["tier", "uid", "bytes"], "bytes", 8, 300, ["resource_uid"]).select("resource_uid", "uid")


@query("B3_required_first", f"SELECT resource_uid, uid FROM (SELECT *, sum(bytes) OVER (PARTITION BY resource_uid ORDER BY {_TIER}, uid, bytes ROWS UNBOUNDED PRECEDING) AS upto FROM ({_ITEMS}) WHERE category = 'TARGET') WHERE upto <= 150")
def _(f):
    return delivery.page(items(f).where("category = 'TARGET'"), ["tier", "uid", "bytes"], "bytes", None, 150, ["resource_uid"]).select("resource_uid", "uid")


@query("B6_reuse_ledger", f"SELECT i.uid, coalesce(l.version = i.bytes AND 40 < i.bytes, false) AS reuse FROM ({_ITEMS}) i LEFT JOIN (SELECT uid AS identity, resource_uid AS scope, CASE WHEN start_byte % 3 = 0 THEN 0 ELSE bytes END AS version FROM ({_ITEMS}) WHERE start_byte % 2 = 0) l ON l.identity = i.uid AND l.scope = i.resource_uid")
def _(f):
    i = items(f).select("start_byte", F.col("resource_uid").alias("scope"), F.col("uid").alias("identity"), F.col("bytes").alias("version"), "bytes")
    ledger = i.where("start_byte % 2 = 0").select("scope", "identity", F.when(F.col("start_byte") % 3 == 0, 0).otherwise(F.col("version")).alias("version"))
    return delivery.reused(i, ledger, 40).select(F.col("identity").alias("uid"), "reuse")


@query("O6_canonical_order", "SELECT lookup_name, reason, min(uid) AS uid FROM b_gap GROUP BY lookup_name, reason")
def _(f):
    return delivery.first_wins(f("b_gap").select("lookup_name", "reason", "uid"), ["lookup_name", "reason"], "uid")


@query("W4_merged_ranges", """WITH r AS (SELECT DISTINCT resource_uid, start_byte AS s, end_byte AS e FROM b_symbol), f AS (SELECT *, CASE WHEN s >= max(e) OVER (PARTITION BY resource_uid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM r),
i AS (SELECT *, sum(n) OVER (PARTITION BY resource_uid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT resource_uid, min(s) AS start, max(e) AS "end" FROM i GROUP BY resource_uid, island""")
def _(f):
    r = f("b_symbol").select("resource_uid", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))
    return delivery.merge_ranges(r, "resource_uid").select("resource_uid", "start", "end")


@query("B1_search_budget", "SELECT path_key FROM (SELECT path_key, coalesce(sum(results) OVER w, 0) AS r, coalesce(count(*) OVER w, 0) AS n, coalesce(sum(bytes) OVER w, 0) AS b FROM (SELECT path_key, length(text) % 5 AS results, length(text) AS bytes FROM b_source) WINDOW w AS (ORDER BY path_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE r < 400 AND n < 300 AND b < 500000")
def _(f):
    files = f("b_source").select("path_key", (F.length("text") % 5).alias("results"), F.length("text").alias("bytes"))
    return delivery.search_budget(files, 400, 300, 500000).select("path_key")


@query("A15_projection_economy", f"SELECT category, count(*) AS prepared, sum(bytes)::BIGINT AS bytes, count(*) FILTER (start_byte % 2 = 0) AS delivered, round(count(*) FILTER (start_byte % 2 = 0) / count(*), 6) AS ratio FROM ({_ITEMS}) GROUP BY category")
def _(f):
    half = F.count_if(F.col("start_byte") % 2 == 0)
    return items(f).groupBy("category").agg(F.count("*").alias("prepared"), F.sum("bytes").cast("long").alias("bytes"), half.alias("delivered"), F.round(F.try_divide(half, F.count("*")), 6).alias("ratio"))


@query("A18_telemetry_funnel", "SELECT event_type AS route, CASE WHEN value > 50 THEN 'ACCEPT' ELSE 'FALLBACK' END AS decision, count(*) AS n FROM events GROUP BY 1, 2")
def _(f):
    return f("events").groupBy(F.col("event_type").alias("route"), F.when(F.col("value") > 50, "ACCEPT").otherwise("FALLBACK").alias("decision")).agg(F.count("*").alias("n"))


_LOCATED = "SELECT name, max(end_byte) % 5 <> 0 AS published, max(end_byte) % 7 = 3 AS dirty, max(end_byte) % 11 = 3 AS truncated, length(name) = 2 AS exact, count(*) FILTER (WHERE revision = 1 AND exported AND start_byte % 800 = 100) AS found, count(*) FILTER (WHERE revision = 2 AND start_byte % 900 = 100) AS last_valid, count(*) FILTER (WHERE kind = 'FIELD' AND start_byte % 700 = 100) AS partial, count(*) FILTER (WHERE kind = 'CLASS' AND end_byte % 3 = 0) AS incomplete FROM b_symbol GROUP BY name, start_byte % 1300, length(name)"


@query("P15_structured_status", f"SELECT name, published, dirty, truncated, exact, found, last_valid, partial, incomplete, CASE WHEN NOT published THEN 'UNAVAILABLE' WHEN dirty THEN 'REFRESHING' WHEN truncated THEN 'TRUNCATED' WHEN exact AND found > 1 THEN 'AMBIGUOUS' WHEN found > 0 THEN 'FOUND' WHEN last_valid > 0 OR partial > 0 THEN 'REFRESHING' WHEN incomplete > 0 THEN 'UNSUPPORTED' ELSE 'NOT_FOUND' END AS status FROM ({_LOCATED})")
def _(f):
    return f.sql(_LOCATED).withColumn("status", structured_status(*[F.col(c) for c in ("published", "dirty", "truncated", "exact", "found", "last_valid", "partial", "incomplete")]))


_BUNDLES = "SELECT uid, resource_uid, reason = 'CONFIG' AS required, CASE reason WHEN 'AMBIGUOUS' THEN 4 WHEN 'NOT_FOUND' THEN 2 WHEN 'DYNAMIC' THEN 8 ELSE 1 END AS tier, CAST(length(lookup_name) * 10 AS BIGINT) AS bytes, CASE WHEN start_byte % 90 <> 0 THEN CAST(length(lookup_name) * 3 AS BIGINT) END AS tokens FROM b_gap"
_PAGED = f"SELECT *, row_number() OVER w <= 8 AND sum(bytes) OVER w <= 300 AND coalesce(sum(tokens) OVER w, 0) <= 90 AND count(*) FILTER (tokens IS NULL) OVER w = 0 AS fits FROM ({_BUNDLES}) WINDOW w AS (PARTITION BY resource_uid ORDER BY required DESC, tier, uid ROWS UNBOUNDED PRECEDING)"


@query("B2_delivery_caps", f"SELECT uid, CASE WHEN fits THEN 'DELIVERED' ELSE 'LATER' END AS outcome FROM ({_PAGED})")
def _(f):
    return delivery.deliver(f.sql(_BUNDLES), "RELATIONS", delivery.Caps(8, 300, 90), ["resource_uid"], ["uid"]).select("uid", "outcome")


@query("B3_atomic_bundles", f"SELECT uid, CASE WHEN bool_or(required AND NOT fits) OVER (PARTITION BY resource_uid) THEN 'OVERFLOW' WHEN fits THEN 'DELIVERED' ELSE 'LATER' END AS outcome FROM ({_PAGED})")
def _(f):
    return delivery.deliver(f.sql(_BUNDLES), "CHANGE", delivery.Caps(8, 300, 90), ["resource_uid"], ["uid"]).select("uid", "outcome")


@query("ST11_framed_digest", "SELECT uid, sha256(octet_length(encode(path_key))::VARCHAR || ':' || path_key || octet_length(encode(coalesce(language, '')))::VARCHAR || ':' || coalesce(language, '')) AS digest FROM b_resource")
def _(f):
    return f("b_resource").select("uid", T.framed_digest(F.col("path_key"), F.col("language")).alias("digest"))
