"""The first scan of a source tree: discovery, hashes, roles, structure and ids, published as one generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions.text import framed_digest
from factgraph.sources import python_code, tree
from factgraph.sources.snapshot import Snapshots


def scan(spark: SparkSession, root: str, extra_excluded: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """resource, structure, symbol and occurrence tables of a tree.

    Files outside excluded directories are read and hashed by the executors.  Structure is read from files of
    every language that has a reader; a language without one keeps the coverage UNSUPPORTED.  An id is a digest of what names a thing, so that
    a scan of the same tree gives the same ids.
    """
    files = tree.with_content(tree.excluded(tree.list_tree(spark, root), extra_excluded), root)
    path = F.col("path_key")
    resource = files.select(
        framed_digest(F.lit("resource"), path).alias("uid"), "path_key", tree.role_of(path).alias("role"), tree.resource_language(path).alias("language"),
        F.lit("FILE").alias("kind"), F.lit("ACTIVE").alias("state"), F.sha2("content", 256).alias("hash"), "size", F.lit(1).cast("long").alias("revision"),
    )
    code = files.withColumn("language", tree.resource_language(path)).where("language IS NOT NULL")
    found = python_code.parse(code).withColumn("resource_uid", framed_digest(F.lit("resource"), path))
    known = found.where("record = 'STATUS'").select("resource_uid", F.col("kind").alias("_state"))
    structure = resource.select(F.col("uid").alias("resource_uid"), F.col("revision").alias("basis_revision"), "language").join(known, "resource_uid", "left")
    state = F.coalesce("_state", F.when(F.col("language").isNotNull(), "UNSUPPORTED"))
    structure = structure.select("resource_uid", state.alias("state"), F.lit("CURRENT").alias("freshness"), "basis_revision").where("state IS NOT NULL")
    uid = framed_digest(F.lit("symbol"), F.col("resource_uid"), F.col("qualified_name"), F.col("kind"), F.col("start_byte"))
    one = F.lit(1).cast("long").alias("revision")
    symbol = found.where("record = 'SYMBOL'").select(uid.alias("uid"), "resource_uid", "kind", "name", "qualified_name", "start_byte", "end_byte", one)
    sites = {"IMPORT": "IMPORT_SITE", "CALL": "CALL_SITE", "KEY": "KEY_SITE"}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in sites.items() for x in pair]), F.col("record"))
    occurrence = found.where(F.col("record").isin(*sites)).select(
        framed_digest(F.lit("occurrence"), F.col("resource_uid"), F.col("record"), F.col("qualified_name"), F.col("start_byte"), F.col("end_byte")).alias("uid"),
        "resource_uid", kind.alias("kind"), "name", F.col("qualified_name").alias("lookup_name"), "start_byte", "end_byte", one,
    )
    return {"resource": resource, "structure": structure, "symbol": symbol, "occurrence": occurrence}


def baseline(snapshots: Snapshots, root: str, extra_excluded: tuple[str, ...] = ()) -> dict:
    """Publishes the first generation of a workspace, or raises Stale if there is one."""
    return snapshots.publish(scan(snapshots.spark, root, extra_excluded), 0, 1)
