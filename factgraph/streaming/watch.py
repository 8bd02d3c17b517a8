"""The watch source: file events as a stream into the journal, dirty marks, and what follows lost events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

EVENTS = "seq long, event string, path string, path_after string, ts timestamp"
#: The journal kind of each raw event.
KINDS = {"Created": "CREATE", "Modified": "MODIFY", "Removed": "DELETE", "RenamedPair": "MOVE", "ContinuityLost": "BULK_HINT"}


def watch(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Raw events (JSON lines that a watcher appends as files) as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).json(folder)


def normalised(events: DataFrame, root: str, ignored: Callable[[Column], Column] = lambda path: F.lit(False)) -> DataFrame:
    """Journal rows (seq, kind, path_before, path_after, ts) of raw events, with paths below ``root``.

    Events outside the root and on ignored paths are dropped.  A rename with one end outside is the creation or
    deletion of the other; a loss of continuity has no path and is always kept.
    """
    below = lambda c: F.when(F.startswith(c, F.lit(root.rstrip("/") + "/")), F.substr(c, F.lit(len(root.rstrip("/")) + 2)))
    kept = lambda c: F.when(~ignored(below(c)), below(c))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event"))
    rows = events.select("seq", kind.alias("k"), kept(F.col("path")).alias("a"), kept(F.col("path_after")).alias("b"), "ts")
    move, lost = F.col("k") == "MOVE", F.col("k") == "BULK_HINT"
    out = F.when(move & F.col("a").isNull(), "CREATE").when(move & F.col("b").isNull(), "DELETE").otherwise(F.col("k"))
    before = F.when(out.isin("MODIFY", "DELETE", "MOVE"), F.col("a"))
    after = F.when(out == "MOVE", F.col("b")).when(out == "CREATE", F.coalesce("b", "a")).when(out == "MODIFY", F.col("a"))
    return rows.where(lost | F.col("a").isNotNull() | move & F.col("b").isNotNull()).select("seq", out.alias("kind"), before.alias("path_before"), after.alias("path_after"), "ts")


def journal_sink(journal: str, marks: str, reconcile: Callable[[], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each micro-batch becomes one directory of journal rows and one of dirty marks.

    Both directories carry the number of the batch and are overwritten if it runs again, so a replay after a
    failure writes nothing twice.  A batch with a BULK_HINT is not trusted: its marks say LOST, and
    ``reconcile`` rebuilds from the source, after which the journal is whole again.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            rows.write.mode("overwrite").parquet(f"{journal}/batch={number}")
            lost = not rows.where("kind = 'BULK_HINT'").isEmpty()
            mark = F.explode(F.array_compact(F.array("path_before", "path_after"))).alias("path_key")
            dirty = rows.select(mark, "seq").groupBy("path_key").agg(F.max("seq").alias("seq"))
            dirty.select("path_key", "seq", F.lit("DIRTY").alias("freshness"), F.lit("LOST" if lost else "CONTINUOUS").alias("continuity")).write.mode("overwrite").parquet(f"{marks}/batch={number}")
            if lost and reconcile is not None:
                reconcile()
        finally:
            rows.unpersist()

    return write


def start(events: DataFrame, journal: str, marks: str, checkpoint: str, reconcile: Callable[[], None] | None = None, once: bool = False) -> StreamingQuery:
    """Runs normalised events into the journal; ``once`` takes what there is and ends."""
    out = events.writeStream.foreachBatch(journal_sink(journal, marks, reconcile)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
