"""Stores of entities, relations, knowledge and projects: the next snapshot of a table as an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ensure(store: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The store with those rows whose key it does not hold; a key that comes twice is taken once, by its least row."""
    rest = [c for c in store.columns if c not in key]
    one = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, "r.*") if rest else rows.select(*key).distinct()
    return store.unionByName(one.join(store.select(*key), key, "left_anti"))


def lookup(store: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Asked keys with what the store holds for them; keys it does not hold keep nulls and ``found`` is false."""
    held = store.withColumn("found", F.lit(True))
    return keys.select(*key).distinct().join(held, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def delete_by_source(relations: DataFrame, evidence: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations and evidence (kind, source, target, resource_uid) without the evidence of resources (resource_uid) and
    without the relations that lose their last evidence by it; relations that had none before stay."""
    key = ["kind", "source", "target"]
    left = evidence.join(sources.select("resource_uid").distinct(), "resource_uid", "left_anti")
    lost = evidence.select(*key).distinct().join(left.select(*key).distinct(), key, "left_anti")
    return relations.join(lost, key, "left_anti"), left


def upsert(old: DataFrame, new: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The next snapshot: new rows replace old ones of their key; vanished keys become tombstones."""
    kept = old.join(new.select(key), key, "left_anti").join(gone.select(key).withColumn("_gone", F.lit(True)), key, "left")
    kept = kept.withColumn("state", F.when(F.col("_gone"), "DELETED").otherwise(F.col("state"))).drop("_gone")
    return kept.unionByName(new)


def register(projects: DataFrame, found: DataFrame) -> DataFrame:
    """The registry (uid, path, state) after a look at what is there (uid, path).

    A project that is found is ACTIVE at its path; one that is not is MISSING; one that was DETACHED stays so.  A
    known project found elsewhere has moved there.
    """
    j = projects.join(found.select("uid", F.col("path").alias("_path")), "uid", "full")
    state = F.when(F.col("state") == "DETACHED", "DETACHED").when(F.col("_path").isNotNull(), "ACTIVE").otherwise("MISSING")
    return j.select("uid", F.when(F.col("state") == "DETACHED", F.col("path")).otherwise(F.coalesce("_path", "path")).alias("path"), state.alias("state"))


def locate_project(projects: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, uid, outcome) of paths: the project whose root holds it most closely; FOUND, AMBIGUOUS or NOT_FOUND."""
    up = paths.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("depth", "root"))
    hit = up.join(projects.where("state = 'ACTIVE'").select("uid", F.col("path").alias("root")), "root")
    best = hit.groupBy("path", "depth").agg(F.count_distinct("uid").alias("n"), F.min("uid").alias("u")).groupBy("path").agg(F.max_by(F.struct("n", "u"), "depth").alias("b"))
    j = paths.select("path").distinct().join(best, "path", "left")
    return j.select("path", F.when(F.col("b.n") == 1, F.col("b.u")).alias("uid"), F.when(F.col("b").isNull(), "NOT_FOUND").when(F.col("b.n") > 1, "AMBIGUOUS").otherwise("FOUND").alias("outcome"))


def replace_evidence(relations: DataFrame, evidence: DataFrame, resource: str, new: DataFrame) -> DataFrame:
    """Relations after one resource's evidence is replaced by what was found in it now (kind, source, target): those
    that keep evidence elsewhere, and the new ones."""
    key = ["kind", "source", "target"]
    left = evidence.where(F.col("resource_uid") != resource)
    return relations.join(left, key, "left_semi").select(*key).unionByName(new.select(*key)).distinct()


#: What a store of artifacts keeps.
ARTIFACT_BYTES, ARTIFACTS = 64 << 20, 64


def retained(artifacts: DataFrame, owner: str, order: str, size: Column, most_bytes: int = ARTIFACT_BYTES, most: int = ARTIFACTS) -> DataFrame:
    """The latest artifacts of each owner that fit both limits; the first that does not fit and all older ones go."""
    w = Window.partitionBy(owner).orderBy(F.col(order).desc())
    upto = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = artifacts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return out.withColumn("_upto", upto).where(F.col("_upto") <= most_bytes).drop("_n", "_upto")


#: Bytes kept of the beginning and of the end of a stream.
HEAD_BYTES, TAIL_BYTES = 4 << 20, 4 << 20


def head_tail(chunks: DataFrame, stream: str, offset: str, data: str, head: int = HEAD_BYTES, tail: int = TAIL_BYTES) -> DataFrame:
    """Pieces (stream, offset, data, omitted) that are kept of streams of binary chunks (stream, offset, data).

    A chunk is cut where it leaves the first ``head`` or enters the last ``tail`` bytes; ``omitted`` is what the
    stream has lost in all.  Streams are never put together; only their lengths are aggregated.
    """
    end = F.col(offset) + F.octet_length(data)
    total = chunks.groupBy(stream).agg(F.max(end).alias("_total"))
    c = chunks.join(total, stream).withColumn("_from", F.greatest(F.col("_total") - tail, F.lit(head).cast("long")))
    length = F.octet_length(data)
    first = F.least(F.greatest(F.lit(head) - F.col(offset), F.lit(0)), length)
    last = F.least(F.greatest(end - F.col("_from"), F.lit(0)), length)
    pieces = [(F.col(offset), F.substring(data, F.lit(1), first.cast("int")), first), (end - last, F.substring(data, (length - last + 1).cast("int"), last.cast("int")), last)]
    listed = F.array(*[F.struct(at.cast("long").alias("offset"), cut.alias("data"), n.alias("n")) for at, cut, n in pieces])
    out = c.select(stream, F.greatest(F.col("_from") - head, F.lit(0)).cast("long").alias("omitted"), F.explode(listed).alias("_p")).where("_p.n > 0")
    return out.select(stream, "_p.offset", "_p.data", "omitted")


def poll(events: DataFrame, owner: str, order: str, after: int, limit: int) -> DataFrame:
    """Of each owner the first ``limit`` events after a place."""
    k = F.row_number().over(Window.partitionBy(owner).orderBy(order))
    return events.where(F.col(order) > after).withColumn("_k", k).where(F.col("_k") <= limit).drop("_k")


def next_sequence(rows: DataFrame, owner: str, seq: str) -> DataFrame:
    """(owner, next): one more than the highest number of each owner."""
    return rows.groupBy(owner).agg((F.coalesce(F.max(seq), F.lit(0)) + 1).alias("next"))


def generation_reference(asked: DataFrame, generations: DataFrame) -> DataFrame:
    """(uid, reference) of rows (uid, generation, basis) against stable generations (generation, basis)."""
    g = generations.select("generation", F.col("basis").alias("_basis"))
    j = asked.join(g, "generation", "left")
    return j.select("uid", F.when(F.col("_basis").isNull(), "ABSENT").when(F.col("_basis") == F.col("basis"), "PRESENT_MATCHING").otherwise("PRESENT_DIFFERENT").alias("reference"))
