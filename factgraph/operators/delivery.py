"""Order, budgets, pages and reuse of delivered rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Delivery tiers by category.
TIERS = {"TARGET": 1, "DIRECT": 2, "RULE": 3, "TEST": 4, "COVERAGE": 5, "TRANSITIVE": 6, "WORK": 7, "SOURCE": 8, "SELECTION": 9}


def tier(category: Column) -> Column:
    out = F.lit(10)
    for name, t in TIERS.items():
        out = F.when(category == name, t).otherwise(out)
    return out


def first_wins(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row a key: the first to arrive."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), arrival).alias("r")).select(*keys, "r.*")


def page(rows: DataFrame, order: list, size: str, items: int | None, size_limit: int | None, scope: list[str]) -> DataFrame:
    """Rows of the first page of each scope: the longest prefix whose number and sizes fit; None is no limit.

    A unit that does not fit ends the page, even if a later one would fit.
    """
    run = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("at", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).withColumn("upto", F.sum(size).over(run))
    fits = (F.lit(True) if items is None else F.col("at") <= items) & (F.lit(True) if size_limit is None else F.col("upto") <= size_limit)
    return out.where(fits)


@dataclass(frozen=True)
class Caps:
    """Caps of a delivery; None is no cap, but one must be set, and none is zero."""

    items: int | None = None
    bytes: int | None = None
    tokens: int | None = None

    def __post_init__(self) -> None:
        given = [x for x in (self.items, self.bytes, self.tokens) if x is not None]
        if not given or min(given) < 1:
            raise ValueError("at least one cap, and none below 1")


#: Named caps, and the intents whose required rows are one bundle.
PROFILES = {"SMALL": Caps(16, 16 << 10), "MEDIUM": Caps(64, 64 << 10), "LARGE": Caps(128, 128 << 10)}
ATOMIC = ("CHANGE", "IMPACT", "RESUME_HANDOFF")


def deliver(rows: DataFrame, intent: str, caps: Caps, scope: list[str], order: list) -> DataFrame:
    """Rows of each scope's first page, with ``outcome``: DELIVERED, LATER or OVERFLOW.

    rows hold ``required``, ``tier``, ``bytes`` and ``tokens``.  Required rows come first, then tiers.  A page is the longest
    prefix that fits all caps; a token cap cannot be met by rows whose cost is unknown (null).  For the intents in
    ``ATOMIC`` a scope whose required rows do not all fit delivers nothing: all its rows are OVERFLOW.
    Where ``order`` leaves rows equal, the cheaper comes first and unknown costs last, so outcomes are the same each time.
    """
    by = [F.col("required").desc(), "tier", *order, "bytes", F.col("tokens").asc_nulls_last()]
    w = Window.partitionBy(*scope).orderBy(*by)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.lit(True)
    for cap, x in ((caps.items, F.count(F.lit(1))), (caps.bytes, F.sum("bytes"))):
        if cap is not None:
            fits &= x.over(upto) <= cap
    if caps.tokens is not None:
        fits &= (F.sum("tokens").over(upto) <= caps.tokens) & (F.count_if(F.col("tokens").isNull()).over(upto) == 0)
    out = rows.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    broken = F.bool_or(F.col("required") & ~F.col("_fits")).over(Window.partitionBy(*scope)) if intent in ATOMIC else F.lit(False)
    return out.withColumn("outcome", F.when(broken, "OVERFLOW").when(F.col("_fits"), "DELIVERED").otherwise("LATER")).drop("_fits")


#: The steps of each intent, in order.  A step with a star runs only if a target was selected.
INTENTS = {
    "LOCATE": ("currentness", "select"),
    "UNDERSTAND": ("currentness", "select", "caller_owners*", "declarations*", "outline*", "direct:both*"),
    "RELATIONS": ("currentness", "select", "caller_owners*", "direct:asked*"),
    "CHANGE": ("currentness", "select", "caller_owners*", "declarations*", "change_graph*", "knowledge", "work"),
    "IMPACT": ("currentness", "select", "caller_owners*", "change_graph*"),
    "RESUME_HANDOFF": ("currentness", "select", "caller_owners*", "declarations*", "direct:callers*", "knowledge", "work"),
}


def plan(intent: str, selected: bool, incoming: bool = True, work_item: bool = False, symbol: bool = True) -> list[str]:
    """The operators that an intent runs, given whether a target was selected, whether relations are asked for
    inwards, whether a work item is named, and whether the target is a symbol."""
    out = []
    for step in INTENTS[intent]:
        name = step.rstrip("*")
        if step.endswith("*") and not selected:
            continue
        if name == "caller_owners" and (not symbol or intent == "RELATIONS" and not incoming):
            continue
        if name == "outline" and symbol or name == "work" and not work_item:
            continue
        out.append(name)
    return out


def search_budget(files: DataFrame, max_results: int, max_files: int, max_bytes: int, range_rows: int = 200_000) -> DataFrame:
    """Files that a budgeted search still opens, in order of path.

    The budget is checked before a file: the file that crosses it is searched whole, the next is not.
    Prefix sums are formed over ranges of paths, so no task sees all files, whatever directory holds them.
    """
    n = max(1, -(-files.count() // range_rows))
    dealt = files.repartitionByRange(n, "path_key").withColumn("_range", F.spark_partition_id()).persist()
    sums = dealt.groupBy("_range").agg(F.sum("results").alias("r"), F.count("*").alias("n"), F.sum("bytes").alias("b"))
    w = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}0") for c in ("r", "n", "b")])
    inside = Window.partitionBy("_range").orderBy("path_key").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(base, "_range")
    for c, x in (("results", "r0"), ("one", "n0"), ("bytes", "b0")):
        out = out.withColumn(x, F.col(x) + F.coalesce(F.sum(F.lit(1) if c == "one" else F.col(c)).over(inside), F.lit(0)))
    return out.where((F.col("r0") < max_results) & (F.col("n0") < max_files) & (F.col("b0") < max_bytes)).drop("_range")


def published(attempts: DataFrame, span: int = 1 << 16) -> DataFrame:
    """(generation, state) of attempts (generation, basis, ok) on one workspace, one row a generation.

    An attempt is STABLE if its basis is the last earlier generation that was ok, or 0, else ABORTED.  The
    running maximum is formed over ranges of ``span`` generations, so no task sees all attempts.
    """
    done = F.when(F.col("ok"), F.col("generation"))
    a = attempts.select("generation", "basis", done.alias("done"), F.expr(f"generation div {span}").alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = a.groupBy("range").agg(F.max("done").alias("last")).select("range", F.max("last").over(before).alias("base"))
    inside = Window.partitionBy("range").orderBy("generation").rowsBetween(Window.unboundedPreceding, -1)
    now = F.coalesce(F.max("done").over(inside), "base", F.lit(0))
    return a.join(base, "range").select("generation", F.when(F.col("basis") == now, "STABLE").otherwise("ABORTED").alias("state"))


def merge_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges [start, end) of a key that overlap or are equal become one; touching ones stay apart."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.max("end").over(w).isNull() | (F.col("start") >= F.max("end").over(w))).cast("int")
    island = F.sum("fresh").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranges.select(key, "start", "end").distinct().withColumn("fresh", fresh).withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def reused(rows: DataFrame, ledger: DataFrame, reference_bytes: int) -> DataFrame:
    """Whether a reference can stand for each row: same identity and version were delivered, and it is smaller."""
    j = rows.join(ledger.withColumnRenamed("version", "known"), ["scope", "identity"], "left")
    return j.withColumn("reuse", F.coalesce((F.col("known") == F.col("version")) & (F.lit(reference_bytes) < F.col("bytes")), F.lit(False)))


#: What a continuation is bound to, in the order in which mismatches are reported.
BINDINGS = ("workspace", "incarnation", "revision", "generation", "request", "projection", "budget")


def continuation_mismatch(token: dict, now: dict) -> str | None:
    """The first binding that differs, or None if the continuation is valid."""
    return next((b for b in BINDINGS if token.get(b) != now.get(b)), None)
