"""Connected components by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch, spread_join


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) of longs -> (id, label): each linked id with the smallest id of its component.

    Each step only aggregates and joins on ids; a hub's star is dealt to several tasks.  Nothing is
    collected; the steps end when each id has one edge, to an id that has none.
    """
    e = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        near = e.unionByName(up).groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("_c"))
        near = scratch.write(near.where("_c > 0").select("u", F.least("u", "m").alias("m"), "_c"))
        stars = spread_join(up, near.drop("_c"), ["u"], scratch, near.select("u", "_c"))
        large = scratch.write(stars.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_c")))
        joined = spread_join(large, least.drop("_c"), ["u"], scratch, least.select("u", "_c"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = scratch.write(small)
        scratch.drop(large, e, near, least)
        e = new
        between = e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi")
        if between.unionByName(e.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).where("v <> w").select("v")).isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("label"))
