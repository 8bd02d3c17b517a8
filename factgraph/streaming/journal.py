"""The change journal: coalescing of events by path, in batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: events of a path at most this far apart may merge.
WINDOW_MS = 250


def merged(pending: str | None, incoming: str) -> str | None:
    """The kind of the run after an event, or None if the event begins a new run."""
    if pending == "CREATE" and incoming == "MODIFY":
        return "CREATE"
    if pending == "MODIFY" and incoming == "MODIFY":
        return "MODIFY"
    if pending in ("CREATE", "MODIFY") and incoming == "DELETE":
        return "DELETE"
    return None


def runs(events: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Batch form: (path_id, first_seq, last_seq, kind, events) of each run.

    A run breaks at a gap over the window, at a CREATE, and after a DELETE.  Paths are independent, so
    the only shuffle is by path; a run's kind follows from its first and last event.
    """
    w = Window.partitionBy("path_id").orderBy("ts", "seq")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) > window_ms * 1000
    new = F.lag("ts").over(w).isNull() | gap | (F.col("kind") == "CREATE") | (F.lag("kind").over(w) == "DELETE")
    run = F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first, last = F.min_by("kind", F.struct("ts", "seq")), F.max_by("kind", F.struct("ts", "seq"))
    kind = F.when(last == "DELETE", "DELETE").otherwise(first)
    out = events.withColumn("new", new).withColumn("run", run).groupBy("path_id", "run")
    return out.agg(F.min_by("seq", F.struct("ts", "seq")).alias("first_seq"), F.max_by("seq", F.struct("ts", "seq")).alias("last_seq"), kind.alias("kind"), F.count("*").alias("events"))


def coalesced(events: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """Each event with its state: the last of a run is PENDING, the others COALESCED into it."""
    w = Window.partitionBy("path_id").orderBy("ts", "seq")
    gap = (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) > window_ms * 1000
    follows = F.lead("seq").over(w).isNotNull() & ~gap & (F.lead("kind").over(w) != "CREATE") & (F.col("kind") != "DELETE")
    return events.withColumn("state", F.when(follows, "COALESCED").otherwise("PENDING")).withColumn("into_seq", F.when(follows, F.lead("seq").over(w)))


def stream_runs(events: DataFrame, window_ms: int = WINDOW_MS, idle_ms: int | None = None) -> DataFrame:
    """Stateful form over a stream of (seq, path_id, kind, ts_ms): a row for every event, with the run it
    is part of and the run's kind so far.  State is one pending run a path; it is dropped when time runs out.
    """
    schema = "path_id long, seq long, run_seq long, kind string"
    state_schema = "run_seq long, kind string, at long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        run, kind, at = state.get if state.exists else (None, None, None)
        rows = []
        for e in pd.concat(list(batches)).sort_values(["ts_ms", "seq"]).itertuples():
            new = merged(kind, e.kind) if at is not None and e.ts_ms - at <= window_ms else None
            run, kind, at = (e.seq, e.kind, e.ts_ms) if new is None else (run, new, e.ts_ms)
            rows.append((key[0], e.seq, run, kind))
        state.update((int(run), kind, int(at)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["path_id", "seq", "run_seq", "kind"])

    return events.groupBy("path_id").applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def transient(events_runs: DataFrame, active_paths: DataFrame) -> DataFrame:
    """Runs that created and deleted a path which no active resource has: nothing is left to do."""
    return events_runs.where("kind = 'DELETE' AND first_kind = 'CREATE'").join(active_paths, "path_id", "left_anti")


def unambiguous_moves(gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pairs of a vanished and a new path with equal content, where both sides have just one partner.

    Pairs are not listed: a partner is the only one if its content has one row on either side, and if no other row
    of its path has content that the other side has too.
    """
    sides = gone.select("digest", F.col("path").alias("source"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(fresh.select("digest", F.col("path").alias("destination"), F.lit(0).alias("a"), F.lit(1).alias("b")), allowMissingColumns=True)
    both = sides.where("digest IS NOT NULL").groupBy("digest").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("source").alias("source"), F.min("destination").alias("destination")).where("a > 0 AND b > 0")
    pairs = both.where("a = 1 AND b = 1 AND source IS NOT NULL AND destination IS NOT NULL").select("digest", "source", "destination")
    shared = both.select(F.col("digest").alias("_d"))
    for side, name in ((gone, "source"), (fresh, "destination")):
        again = side.select("digest", F.col("path").alias(name)).join(pairs.select(name, F.col("digest").alias("_own")), name).where("digest <> _own")
        more = again.select(name, F.col("digest").alias("_d")).join(shared, "_d", "left_semi").select(name)
        pairs = pairs.join(more, name, "left_anti")
    return pairs.select("source", "destination")


def refresh_decision(workspaces: DataFrame, pending: DataFrame, resources: DataFrame, observed: DataFrame) -> DataFrame:
    """(workspace, decision): REFRESH the one pending resource of a workspace, or why a reconcile must do it.

    workspaces: (workspace, continuity); pending: (workspace, seq, kind, resource_uid); resources: (resource_uid, state,
    kind, role, language); observed: (resource_uid, present, excluded, kind, role, language, same_identity), what is
    now at its path.  The first rule that fits decides.
    """
    odd = F.min(F.when((F.col("kind") != "MODIFY") | F.col("resource_uid").isNull(), F.struct("seq", "kind", "resource_uid"))).alias("odd")
    n = pending.groupBy("workspace").agg(F.count("*").alias("n"), F.count_distinct("resource_uid").alias("ids"), F.min("resource_uid").alias("resource_uid"), odd)
    r = resources.select("resource_uid", "state", F.col("kind").alias("r_kind"), F.col("role").alias("r_role"), F.col("language").alias("r_language"))
    o = observed.select("resource_uid", "present", "excluded", "same_identity", F.col("kind").alias("o_kind"), F.col("role").alias("o_role"), F.col("language").alias("o_language"))
    j = workspaces.join(n, "workspace", "left").join(r, "resource_uid", "left").join(o, "resource_uid", "left")
    same = F.lit(True)
    for c in ("kind", "role", "language"):
        same &= F.col(f"r_{c}").eqNullSafe(F.col(f"o_{c}"))
    decision = (
        F.when(F.col("continuity") == "LOST", "WATCHER_CONTINUITY_LOST")
        .when(F.col("n").isNull(), "NOTHING_PENDING")
        .when(F.col("odd.kind") != "MODIFY", "UNSUPPORTED_EVENT")
        .when(F.col("odd").isNotNull(), "NOT_AN_EXISTING_RESOURCE")
        .when(F.col("ids") > 1, "MULTIPLE_PENDING_RESOURCES")
        .when(~F.col("state").eqNullSafe("ACTIVE"), "NOT_AN_EXISTING_RESOURCE")
        .when(F.col("r_kind") == "DIRECTORY", "NOT_A_FILE")
        .when(F.coalesce("excluded", F.lit(False)), "TARGET_EXCLUDED")
        .when(~F.coalesce("present", F.lit(False)), "TARGET_PATH_MISSING")
        .when(~same, "CLASSIFICATION_CHANGED")
        .when(~F.coalesce("same_identity", F.lit(True)), "IDENTITY_NOT_CONTINUOUS")
        .otherwise("REFRESH")
    )
    return j.select("workspace", decision.alias("decision"))


def applied(events: DataFrame, through: int, generation: int) -> DataFrame:
    """Events with their state after a publication: those up to ``through`` are APPLIED in ``generation``."""
    done = F.col("seq") <= through
    return events.withColumn("state", F.when(done, "APPLIED").otherwise("PENDING")).withColumn("generation", F.when(done, generation))
