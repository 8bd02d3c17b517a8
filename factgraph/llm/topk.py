"""Operator 9, exact top-k search: distributed histogram selection.

Every query is scored against every row, in blocks.  Rounds of global score histograms, each finer
than the last, narrow the k-th best score of every query down to one value; a last pass
keeps what is above it and, of the ties at it, the smallest ids.  A task sends only the bins from
its best down to its own k-th score: a global k-th score is never below a local one.

Queries travel in blocks of bounded bytes; a block is broadcast, and all rows are scored against it.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part,
nor does a row without an id; vectors of different lengths have no score; equal rows are candidates of
their own (a query's own rows are those with its id); an id that several usable vectors share is one
query, asked by the least of them (compared component by component, a prefix first); fewer than k
candidates are all returned; an empty table gives no rows.  Scores must fit a 64-bit integer.  Only
the id and vector columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch

SCALE = 256.0
#: Bytes of query vectors (as 64-bit numbers) that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Width of the bins of each round, as bits: the first round's bins cover scores of any size.
SHIFTS = (16, 8, 0)
_SCORES = 1 << 21  # scores held at once by a task


def integers(column: pa.Array, scale: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows that take part, and by vector length (rows, vectors) with vectors of floor(scale * x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # without null lists
    if flat.null_count:
        flat = pc.fill_null(flat.cast(pa.float64()), float("nan"))
    x = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))
    start = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = (size > 0) & (bad[start[1:]] == bad[start[:-1]])
    out = []
    for n in np.unique(size[good]):
        rows = np.flatnonzero(good & (size == n))
        out.append((rows, x[start[rows][:, None] + np.arange(n)]))
    return np.flatnonzero(good), out


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products (queries, candidates) of integer-valued float64 vectors."""
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("a score does not fit a 64-bit integer")
    return q.astype(np.int64) @ c.astype(np.int64).T


def _scored(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple[np.ndarray, np.ndarray]], scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(vector length, places of queries, candidate ids, scores) with a query's own rows marked by the least score."""
    for batch in batches:
        _, groups = integers(batch.column("v"), scale)
        ids = batch.column("id")
        for rows, x in groups:
            if x.shape[1] not in queries:
                continue
            qid, qv = queries[x.shape[1]]
            cid = ids.take(pa.array(rows)).to_numpy()
            width = max(1, _SCORES // max(1, len(cid)))
            for a in range(0, len(qid), width):
                yield x.shape[1], np.arange(a, min(a + width, len(qid))), cid, scores(qv[a : a + width], x)


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th best score (its least, if it has fewer)."""
    n = s.shape[1]
    return np.partition(s, n - k, axis=1)[:, n - k] if n > k else s.min(axis=1)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every row of ``queries`` (same columns)."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    table = pick(rows)
    usable = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    asked = scratch.write(pick(queries).where(usable).groupBy("id").agg(F.min("v").alias("v")))
    parts = [_block(table, some, k, scale, scratch) for some in _blocks(asked)]
    schema = "query_id long, rank int, vec_id long, score long"
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _blocks(asked: DataFrame) -> Iterator[pa.RecordBatch]:
    """Queries in blocks of bounded bytes; the driver holds one at a time."""
    width = asked.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return
    per = max(1, BLOCK_BYTES // (8 * width))
    total = asked.count()
    n = -(-total // per)
    for i in range(n):
        some = asked if n == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i)
        yield some.toArrow().combine_chunks()


def _block(table: DataFrame, block: pa.Table, k: int, scale: float, scratch: Scratch) -> DataFrame:
    spark = table.sparkSession
    _, groups = integers(block.column("v"), scale)
    ids = block.column("id").to_numpy()
    queries = {x.shape[1]: (ids[rows], x) for rows, x in groups}
    shared = spark.sparkContext.broadcast(queries)
    # per vector length and query: score >> shift equals prefix for the k-th best; above: how many are better
    state = {n: {"prefix": np.zeros(len(q), np.int64), "above": np.zeros(len(q), np.int64), "open": np.ones(len(q), bool)} for n, (q, _) in queries.items()}
    for before, shift in zip((None, *SHIFTS), SHIFTS):
        seen = spark.sparkContext.broadcast((before, shift, state))
        found = _histogram(table, shared, seen, k, scale).groupBy("n", "q", "bin").agg(F.sum("c").alias("c"))
        better = F.sum("c").over(Window.partitionBy("n", "q").orderBy(F.col("bin").desc()))
        at = found.withColumn("upto", better).join(_needs(spark, state, k), ["n", "q"]).where("upto >= need AND upto - c < need")
        hit = {(r["n"], r["q"]): r for r in at.select("n", "q", "bin", "c", "upto").collect()}  # a row a query of the block
        for n, s in state.items():
            for q in np.flatnonzero(s["open"]):
                if r := hit.get((n, int(q))):
                    s["prefix"][q] = r["bin"]
                    s["above"][q] += r["upto"] - r["c"]
                else:
                    s["open"][q] = False  # fewer than k candidates: all are results
    final = spark.sparkContext.broadcast(state)
    kept = _kept(table, shared, final, k, scale)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return scratch.write(out)


def _needs(spark: SparkSession, state: dict, k: int) -> DataFrame:
    rows = [(n, int(q), int(k - s["above"][q])) for n, s in state.items() for q in np.flatnonzero(s["open"])]
    return spark.createDataFrame(pa.Table.from_pydict({"n": pa.array([r[0] for r in rows], pa.int64()), "q": pa.array([r[1] for r in rows], pa.int64()), "need": pa.array([r[2] for r in rows], pa.int64())}))


def _histogram(table: DataFrame, shared, seen, k: int, scale: float) -> DataFrame:
    """Counts of scores by bin, for scores whose higher bits are those located so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, (before, shift, state) = shared.value, seen.value
        for n, q, cid, s in _scored(batches, queries, scale):
            qid, st = queries[n][0], state[n]
            ok = (cid[None, :] != qid[q][:, None]) & st["open"][q][:, None]
            if before is not None:
                ok &= (s >> before) == st["prefix"][q][:, None]
            low = np.iinfo(np.int64).min
            s = np.where(ok, s, low)
            ok &= s >= _best(s, k)[:, None]
            row, col = np.nonzero(ok)
            if len(row):
                pair, c = np.unique(np.stack([q[row], s[row, col] >> shift]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), n)), pa.array(pair[0]), pa.array(pair[1]), pa.array(c.astype(np.int64))], ["n", "q", "bin", "c"])

    return table.mapInArrow(run, "n long, q long, bin long, c long")


def _kept(table: DataFrame, shared, final, k: int, scale: float) -> DataFrame:
    """Scores above each query's k-th best, and the smallest ids of the ties at it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, state = shared.value, final.value
        for n, q, cid, s in _scored(batches, queries, scale):
            qid, st = queries[n][0], state[n]
            ok = cid[None, :] != qid[q][:, None]
            least = np.where(st["open"][q], st["prefix"][q], np.iinfo(np.int64).min)[:, None]
            row, col = np.nonzero(ok & (s >= least))
            value, ids = s[row, col], cid[col]
            order = np.lexsort((ids, -value, row))
            row, value, ids = row[order], value[order], ids[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            top = place < k
            if top.any():
                yield pa.RecordBatch.from_arrays([pa.array(qid[q[row[top]]]), pa.array(ids[top]), pa.array(value[top])], ["query_id", "vec_id", "score"])

    return table.mapInArrow(run, "query_id long, vec_id long, score long")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5"""
