"""Size-checked broadcasts, joins on hot keys, distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.scratch import Scratch

#: Rows of one long column that may be broadcast: 16 MB of keys, under 100 MB as a hash relation.
BROADCAST_IDS = 2_000_000
#: Rows of a key that one task may get in a join, and the most keys that are broadcast as hot ones.
HOT_ROWS, HOT_KEYS = 1_000, 200_000


def small(df: DataFrame, limit: int = BROADCAST_IDS) -> bool:
    """Whether a table has at most ``limit`` rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def keep_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a set of keys: broadcast if the set is proven small, else a shuffle."""
    return df.join(F.broadcast(ids) if small(ids) else ids, key, how)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join of tables with ``_parts``, the same for all rows of a key: its rows of ``left`` are dealt to so
    many tasks, and its rows of ``right`` are repeated for each.  The deal follows the rows' values, so it
    is the same if a task runs again."""
    flat = [c for c, t in left.dtypes if c != "_parts" and not t.startswith(("array", "map", "struct"))]
    one = left.withColumn("_salt", F.pmod(F.xxhash64(*flat, F.lit("salt")), F.col("_parts")).cast("int")).drop("_parts")
    other = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts").cast("int") - 1))).drop("_parts")
    return one.join(other, [*keys, "_salt"], how).drop("_salt")


def parts_of(rows: Column) -> Column:
    """Parts for a key with so many rows."""
    return F.ceil(rows / F.lit(HOT_ROWS)).cast("int")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], scratch: Scratch, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Join of ``left`` with ``right``, which has few rows a key, where a key may hold any share of left's rows.

    counts: keys and ``_c``, left's rows with the key (counted here if not given).  Keys with more than ``HOT_ROWS``
    rows, and more than a ``HOT_KEYS``-th of all, are at most ``HOT_KEYS``; they are broadcast, and their rows
    are dealt to several tasks.  The plan has the same shape with and without hot keys.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_c")) if counts is None else counts
    most, total = counts.agg(F.max("_c"), F.sum("_c")).first()
    limit = max(HOT_ROWS, -(-(total or 0) // HOT_KEYS))
    if (most or 0) <= limit:
        one = F.lit(1)
        return salted_join(left.withColumn("_parts", one), right.withColumn("_parts", one), keys, how)
    hot = scratch.write(counts.where(F.col("_c") > limit).select(*keys, F.ceil(F.col("_c") / limit).cast("int").alias("_parts")))
    dealt = lambda df: df.join(F.broadcast(hot), keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    return salted_join(dealt(left), dealt(right), keys, how)


def ranked(df: DataFrame, scratch: Scratch, group: list[str], order: list[str], name: str, rows_a_bucket: int = 200_000) -> DataFrame:
    """Adds ranks from 0, gapless in each group, without bringing a group into one task.

    Rows are dealt to buckets by a hash of ``order``; a rank is the number of rows of the group in
    smaller buckets plus the place inside the bucket.  The number of buckets follows the rows.
    """
    total = df.count()
    n = max(16, -(-total // rows_a_bucket))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit("rank")), F.lit(n)).cast("int"))
    sizes = scratch.write(df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n")))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    df = df.withColumn("_in", F.row_number().over(inside) - 1)
    same: Column = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return df.join(starts, same).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_bucket", "_b", "_before", "_in", *[f"_g{i}" for i in range(len(group))])
