"""Operator 2, sharding: k-d tree partitioning, with DataFrame functions only.

Rows are points in metadata space.  A node of the tree that still holds several shards is split
along its widest dimension at a weighted median, the weights being bytes (or the quantile that
matches the shards on either side, as 40 is no power of two), until each leaf is one shard.  All
nodes of a level are split at once.  Medians are found by refining histograms of bytes, so a level
costs a few aggregations, whose results have at most (nodes x bins) rows, and no row is moved.

A split never stops at ties: rows equal in the dimension are told apart by a hash of their id, so a
source with a third of all rows divides as evenly as any other.  Sizes obey the law ``bytes``.

Defined cases: a null or empty text has the fixed 16 bytes and crc 0; null metadata come first;
rows equal in id and metadata cannot be told apart and share a shard; an empty table gives an empty
result; a shard may be empty if there are fewer rows than shards.  Only named columns are read, so
other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, ranked

#: Bins of one refinement; a round divides the range that holds a median by this number.
BINS = 4096
OVERHEAD = 16


def _tie(*cols: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 28)


def kd_shards(rows: DataFrame, dims: list[str], size: str, tie: str, shards: int, scratch: Scratch) -> DataFrame:
    """Adds ``shard`` to rows with long columns ``dims``, ``size`` and ``tie``."""
    spans = rows.agg(*[f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if spans[0] is None:
        return rows.withColumn("shard", F.lit(0))
    whole = [max(1, spans[f"hi{i}"] - spans[f"lo{i}"]) for i in range(len(dims))]
    nodes: dict[int, tuple[int, int]] = {0: (0, shards)}  # node -> first shard, number of shards
    node: Column = F.lit(0)
    fresh = 1
    while any(n > 1 for _, n in nodes.values()):
        level = rows.withColumn("_node", node)
        facts = level.groupBy("_node").agg(
            F.sum(size).alias("bytes"), F.min(tie).alias("tlo"), F.max(tie).alias("thi"), *[f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]
        )
        known = {r["_node"]: r for r in facts.collect()}  # one row a node: at most ``shards``
        goals = {}
        for k, (_, n) in nodes.items():
            if n > 1 and k in known:
                r = known[k]
                widest = max(range(len(dims)), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / whole[i], -i))
                goals[k] = {"dim": widest, "want": r["bytes"] * (n // 2) // n, "lo": r[f"lo{widest}"], "hi": r[f"hi{widest}"], "tlo": r["tlo"], "thi": r["thi"], "below": 0}
        _refine(level, dims, size, goals, "lo", "hi", None, scratch)
        _refine(level, dims, size, goals, "tlo", "thi", tie, scratch)
        later = node
        new = dict(nodes)
        for k, (first, n) in nodes.items():
            if n < 2:
                continue
            left, right, fresh = fresh, fresh + 1, fresh + 2
            del new[k]
            new[left], new[right] = (first, n // 2), (first + n // 2, n - n // 2)
            if k in goals:
                g, d = goals[k], F.col(dims[goals[k]["dim"]])
                low = (d < g["lo"]) | ((d == g["lo"]) & (F.col(tie) < g["tlo"]))
                later = F.when(node == k, F.when(low, left).otherwise(right)).otherwise(later)
        old, rows = rows, scratch.write(level.withColumn("_node", later)) if goals else level
        if goals:
            scratch.drop(old)
        node, nodes = F.col("_node"), new
    shard = F.lit(0)
    for k, (first, _) in nodes.items():
        shard = F.when(F.col("_node") == k, first).otherwise(shard)
    return rows.withColumn("shard", shard.cast("int")).drop("_node")


def _refine(level: DataFrame, dims: list[str], size: str, goals: dict[int, dict], lo: str, hi: str, tie: str | None, scratch: Scratch) -> None:
    """Narrows [lo, hi] of every goal to the value at which the bytes below reach what it wants.

    Without ``tie`` along the goal's dimension; with it, among the rows that have the value found.
    """
    while active := {k: g for k, g in goals.items() if g[lo] < g[hi]}:
        value: Column = F.lit(None).cast("long")
        base: Column = F.lit(None).cast("long")
        step: Column = F.lit(None).cast("long")
        inside: Column = F.lit(False)
        for k, g in active.items():
            g["step"] = -(-(g[hi] - g[lo] + 1) // BINS)
            here = F.col("_node") == k
            d = F.col(dims[g["dim"]])
            x = F.col(tie) if tie else d
            ok = x.between(g[lo], g[hi]) & ((d == g["lo"]) if tie else F.lit(True))
            value, base, step = F.when(here, x).otherwise(value), F.when(here, g[lo]).otherwise(base), F.when(here, g["step"]).otherwise(step)
            inside = F.when(here, ok).otherwise(inside)
        bins = level.where(F.col("_node").isin(list(active)) & inside).groupBy("_node", ((value - base) / step).cast("long").alias("bin")).agg(F.sum(size).alias("b")).collect()
        by: dict[int, dict[int, int]] = {}
        for r in bins:  # at most BINS a node
            by.setdefault(r["_node"], {})[r["bin"]] = r["b"]
        for k, g in active.items():
            last = (g[hi] - g[lo]) // g["step"]
            at = last + 1
            for b in sorted(by.get(k, {})):
                if g["below"] + by[k][b] > g["want"]:
                    at = b
                    break
                g["below"] += by[k][b]
            if tie and g["step"] == 1 and at <= last and g["below"] + by[k][at] - g["want"] < g["want"] - g["below"]:
                at += 1  # the row at the median goes where it leaves the smaller difference
            g[lo], g[hi] = (g[hi] + 1, g[hi] + 1) if at > last else (g[lo] + at * g["step"], min(g[hi], g[lo] + (at + 1) * g["step"] - 1))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (a rank inside the shard) for every row.

    Numbers are dimensions as they are; strings are placed by a hash, which groups equal ones.
    """
    scratch = Scratch(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def number(d: str) -> Column:
        x = F.col(d).cast("long") if kinds[d] in ("bigint", "int", "smallint", "tinyint") else F.when(F.col(d).isNotNull(), F.shiftrightunsigned(F.xxhash64(F.col(d)), 40))
        return F.coalesce(x, F.lit(-1).cast("long"))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *[number(d).alias(f"_d{i}") for i, d in enumerate(dims)],
    ).withColumn("_tie", _tie("doc_id", "size", "text_crc32"))
    names = [f"_d{i}" for i in range(len(dims))]
    placed = scratch.write(kd_shards(scratch.write(rows), names, "size", "_tie", shards, scratch).drop(*names, "_tie"))
    return ranked(placed, scratch, ["shard"], ["doc_id", "text_crc32"], "slot")


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
