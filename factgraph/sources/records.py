"""Status records, diagnostics and telemetry as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_entries(outputs: DataFrame) -> DataFrame:
    """Entries of NUL-separated porcelain-v2 text (id, value): kind, path, original path.

    A rename record takes the next record as its original path, which is no entry of its own.
    """
    parts = outputs.select("id", F.posexplode(F.split("value", "\\x00")).alias("pos", "rec")).where("rec <> ''")
    w = Window.partitionBy("id").orderBy("pos")
    tag = F.substr("rec", F.lit(1), F.lit(1))
    taken = F.coalesce(F.substr(F.lag("rec").over(w), F.lit(1), F.lit(2)) == "2 ", F.lit(False))
    rows = parts.withColumn("taken", taken).withColumn("next", F.lead("rec").over(w)).where(~F.col("taken")).withColumn("tag", tag)
    skip = F.when(F.col("tag") == "1", 8).when(F.col("tag") == "2", 9).when(F.col("tag") == "u", 10).when(F.col("tag") == "?", 1)
    fields = F.split("rec", " ")
    path = F.array_join(F.slice(fields, skip + 1, F.greatest(F.size(fields) - skip, F.lit(0))), " ")
    kind = F.when(F.col("tag") == "1", "CHANGED").when(F.col("tag") == "2", "RENAMED").when(F.col("tag") == "u", "UNMERGED").when(F.col("tag") == "?", "UNTRACKED")
    return rows.where(kind.isNotNull()).select("id", kind.alias("kind"), path.alias("path"), F.when(F.col("tag") == "2", F.col("next")).alias("original"))


_LINE = r"^([^:\s][^:]*):([0-9]+):([0-9]+):\s*(?:(error|warning|note)[^:]*:\s*)?(.*)$"


def diagnostics(lines: DataFrame) -> DataFrame:
    """``path:line:col: severity: text`` lines (id, line): parsed fields, or parsed = false."""
    ok = F.regexp_like("line", F.lit(_LINE))
    get = lambda k: F.when(ok, F.regexp_extract("line", _LINE, k))
    severity = F.when(ok, F.coalesce(F.nullif(F.regexp_extract("line", _LINE, 4), F.lit("")), F.lit("error")))
    return lines.select("id", get(1).alias("path"), get(2).cast("long").alias("row"), get(3).cast("long").alias("col"), severity.alias("severity"), get(5).alias("message"), ok.alias("parsed"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def summary(parsed: DataFrame, keep: int = 64) -> DataFrame:
    """The worst diagnostics, equal ones counted once: by severity, then arrival."""
    fields = ["path", "row", "col", "severity", "message"]
    one = parsed.where("parsed").groupBy(*fields).agg(F.min("id").alias("first"), F.count("*").alias("times"))
    return one.orderBy(severity_rank(F.col("severity")), "first").limit(keep)


def diagnostics_counts(parsed: DataFrame, keep: int = 64) -> DataFrame:
    """One row: lines observed, distinct diagnostics, those beyond the first ``keep``, and lines that are none."""
    fields = ["path", "row", "col", "severity", "message"]
    n = parsed.groupBy("parsed", *fields).agg(F.count("*").alias("n"))
    out = n.agg(F.sum("n").alias("observed"), F.count_if("parsed").alias("deduplicated"), F.coalesce(F.sum(F.when(~F.col("parsed"), F.col("n"))), F.lit(0)).alias("parse_misses"))
    return out.select(F.coalesce("observed", F.lit(0)).alias("observed"), "deduplicated", F.greatest(F.col("deduplicated") - keep, F.lit(0)).cast("long").alias("omitted"), "parse_misses")


def append_telemetry(events: DataFrame, folder: str) -> None:
    """One JSON line an event, appended; each task writes a file of its own, so no two writers share one."""
    events.write.mode("append").json(folder)
