"""Joins dealt to as many tasks as their input needs.

Adaptive execution merges partitions up to a number of compressed bytes.  Ids and names compress well, so such a task
may hold many times that in memory.  Here the number of tasks follows from the size of the tables that are read,
so what one task holds does not grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of stored tables a task: some hundred thousand rows of ids and names.
TASK_BYTES = 8 << 20
#: What a plan says of a table whose size it does not know.
_UNKNOWN = 1 << 62


def tasks(*tables: DataFrame) -> int:
    """Tasks for a shuffle of tables, by the stored size of all that they read; at least one a core."""
    known, least = 0, tables[0].sparkSession.sparkContext.defaultParallelism
    for t in tables:
        leaves = t._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        known += sum(x for x in sizes if x < _UNKNOWN)
        if any(x >= _UNKNOWN for x in sizes):
            least = max(least, int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-known // TASK_BYTES))


def deal(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows dealt to ``n`` tasks by their keys; what one task a core can hold is left to adaptive execution."""
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def join(left: DataFrame, right: DataFrame, keys: list[str], n: int, how: str = "inner") -> DataFrame:
    """Equi-join over ``n`` tasks.  Rows of a left join that have a null key meet nothing and go to any task."""
    if how != "left":
        return deal(left, n, *keys).join(deal(right, n, *keys), keys, how)
    lost = F.lit(False)
    for k in keys:
        lost |= F.col(k).isNull()
    spread = left.withColumn("_salt", F.when(lost, F.pmod(F.xxhash64(*left.columns), F.lit(n))).otherwise(0).cast("long"))
    zero = F.length(F.col(keys[0]).cast("string")) % 1  # 0, but no literal: the optimizer would take it out of the key
    met = right.withColumn("_salt", zero.cast("long"))
    return deal(spread, n, *keys, "_salt").join(deal(met, n, *keys, "_salt"), [*keys, "_salt"], "left").drop("_salt")
