"""What an answer may claim: rows, limits of coverage, currentness, and whether it was cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Answer:
    """rows: the answer; limits: one row a coverage limit; current: whether the snapshot is.

    truncated: a one-row table (truncated boolean).  All are lazy.
    """

    rows: DataFrame
    limits: DataFrame
    truncated: DataFrame

    def state(self) -> DataFrame:
        """CONFIRMED, NONE_UNDER_COMPLETE_COVERAGE or NONE_WITH_INCOMPLETE_COVERAGE.

        An empty answer is a safe negative only if nothing limits its coverage.
        """
        found = self.rows.limit(1).agg(F.count("*").alias("n"))
        gaps = self.limits.limit(1).agg(F.count("*").alias("g"))
        name = F.when(F.col("n") > 0, "CONFIRMED").when(F.col("g") == 0, "NONE_UNDER_COMPLETE_COVERAGE").otherwise("NONE_WITH_INCOMPLETE_COVERAGE")
        return found.join(gaps).select(name.alias("state"))


def limited(rows: DataFrame, order: list, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first rows in an order, and whether there are more: one row beyond the limit is fetched."""
    more = rows.orderBy(*order).limit(limit + 1)
    return rows.orderBy(*order).limit(limit), more.agg((F.count("*") > limit).alias("truncated"))


def numbered(rows: DataFrame, order: list[str], name: str = "place", range_rows: int = 200_000) -> DataFrame:
    """Adds places from 1 in the order of columns that no two rows share, with no task that sees all rows.

    Rows are dealt to ranges of the order and kept, so that both uses see the same ranges.  A place is the
    number of rows in earlier ranges plus the place inside the range.  The number of ranges follows the rows.
    """
    n = max(1, -(-rows.count() // range_rows))
    dealt = rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).persist()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_in", inside).join(starts, "_range").withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_range", "_in", "_before")


def structured_status(published: Column, dirty: Column, truncated: Column, exact: Column, found: Column, last_valid: Column, partial: Column, incomplete: Column) -> Column:
    """What a structured answer may claim; the first rule that fits decides.

    found, last_valid: numbers of current and of last valid candidates; partial, incomplete: numbers of resources
    in scope whose structure is partial, and whose coverage is not complete.
    """
    return (
        F.when(~published, "UNAVAILABLE")
        .when(dirty, "REFRESHING")
        .when(truncated, "TRUNCATED")
        .when(exact & (found > 1), "AMBIGUOUS")
        .when(found > 0, "FOUND")
        .when((last_valid > 0) | (partial > 0), "REFRESHING")
        .when(incomplete > 0, "UNSUPPORTED")
        .otherwise("NOT_FOUND")
    )


def search_status(cut: Column, found: Column, unavailable: Column, oversize: Column) -> Column:
    """What a text search may claim: of a budget that ended it, and of matches, unreadable and oversize files."""
    return F.when(cut, "TRUNCATED").when(found > 0, "FOUND").when(unavailable > 0, "UNAVAILABLE").when(oversize > 0, "TRUNCATED").otherwise("NOT_FOUND")


def fallback_permitted(reason: Column, status: Column) -> Column:
    """Whether a text search may follow a structured answer: if asked for, or where coverage was incomplete."""
    return reason.isin("EXPLICIT_TEXT_SEARCH", "NON_STRUCTURAL_TARGET") | ((reason == "INCOMPLETE_STRUCTURAL_COVERAGE") & F.coalesce(status.isin("UNSUPPORTED", "TRUNCATED", "REFRESHING"), F.lit(False)))


def selection(identity: Column, exact: Column, candidates: Column, incomplete: Column) -> Column:
    """What chose a target: EXACT, or why none was chosen.

    identity: the selector is an id of this index; exact: it names one thing at most (an id, a path); a search that
    matches once is no identity.
    """
    return (
        F.when(candidates > 1, "TARGET_AMBIGUOUS")
        .when((candidates == 1) & exact, "EXACT")
        .when(candidates == 1, "TARGET_NOT_EXACT")
        .when(identity, "TARGET_NOT_CURRENT")
        .when(incomplete > 0, "TARGET_NOT_FOUND_WITH_INCOMPLETE_COVERAGE")
        .otherwise("TARGET_NOT_FOUND")
    )


class Overflow(RuntimeError):
    """More rows than a bounded read may hold: an error, never a shorter answer."""


def bounded(rows: DataFrame, what: str, limit: int = 512) -> DataFrame:
    """The rows, if there are fewer than ``limit``."""
    if rows.limit(limit).count() >= limit:
        raise Overflow(f"{what}: {limit} rows or more")
    return rows
