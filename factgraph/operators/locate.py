"""Files, symbols, places in files, and what is known about their structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph import parts
from factgraph.functions.text import basename, contains_ascii, direct_child, path_suffixes

LIMIT = 200


def active(resources: DataFrame) -> DataFrame:
    return resources.where(F.col("state") == "ACTIVE")


def list_files(resources: DataFrame, directory: str | None = None, recursive: bool = True, prefix: str | None = None, role: str | None = None, language: str | None = None, kind: str | None = None) -> DataFrame:
    """Active resources below a directory or prefix, of a role, language and kind."""
    path, out = F.col("path_key"), active(resources)
    if directory is not None:
        out = out.where(F.startswith(path, F.lit(directory + "/")) if recursive else direct_child(path, directory))
    if prefix is not None:
        out = out.where(F.startswith(path, F.lit(prefix)))
    for name, value in (("role", role), ("language", language), ("kind", kind)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def locate(resources: DataFrame, uid: str | None = None, path: str | None = None, name: str | None = None, prefix: str | None = None) -> DataFrame:
    """Active resources by id, path, basename or prefix; ``exact`` tells whether the selector names one at most."""
    out = active(resources)
    if uid is not None:
        hit, exact = F.col("uid") == uid, True
    elif path is not None:
        hit, exact = F.col("path_key") == path, True
    elif name is not None:
        hit, exact = basename(F.col("path_key")) == name, False
    else:
        hit, exact = F.startswith("path_key", F.lit(prefix or "")), False
    return out.where(hit).withColumn("exact", F.lit(exact))


def symbol_order() -> list[Column]:
    return [F.col("path_key"), F.col("start_byte"), F.col("end_byte").desc(), F.col("name"), F.col("uid")]


def search_symbols(symbols: DataFrame, resources: DataFrame, name: str | None = None, partial: str | None = None, qualified: str | None = None, kinds: tuple[str, ...] = (), language: str | None = None, prefix: str | None = None) -> DataFrame:
    """Symbols of active resources with ``current``: whether they were read from the resource's revision."""
    if name is not None:
        symbols = symbols.where(F.col("name") == name)
    if qualified is not None:
        symbols = symbols.where(F.col("qualified_name") == qualified)
    if partial is not None:
        symbols = symbols.where(contains_ascii(F.col("name"), partial) | contains_ascii(F.col("qualified_name"), partial))
    if kinds:
        symbols = symbols.where(F.col("kind").isin(*kinds))
    files = list_files(resources, language=language, prefix=prefix).select(F.col("uid").alias("resource_uid"), "path_key", F.col("revision").alias("_revision"))
    return symbols.join(files, "resource_uid").withColumn("current", F.col("revision") == F.col("_revision")).drop("_revision")


def symbol_at(symbols: DataFrame, points: DataFrame, width: int = 4096) -> DataFrame:
    """For points (point_uid, resource_uid, offset) the innermost symbol around each: the shortest span,
    then the latest start, then the least id.  Points without one are left out.

    Spans are listed under each stretch of ``width`` bytes that they meet, so a point meets the spans near it
    and not all of a large file.
    """
    at = lambda x: F.floor(x / width)
    s = symbols.where("start_byte < end_byte").select("resource_uid", F.col("uid").alias("symbol_uid"), "start_byte", "end_byte", F.explode(F.sequence(at(F.col("start_byte")), at(F.col("end_byte") - 1))).alias("_at"))
    n = parts.tasks(symbols, points)
    hit = parts.join(points.withColumn("_at", at(F.col("offset"))), s, ["resource_uid", "_at"], n).where((F.col("start_byte") <= F.col("offset")) & (F.col("offset") < F.col("end_byte")))
    best = F.min_by("symbol_uid", F.struct((F.col("end_byte") - F.col("start_byte")).alias("n"), (-F.col("start_byte")).alias("s"), F.col("symbol_uid").alias("u")))
    return parts.deal(hit, n, "point_uid").groupBy("point_uid").agg(best.alias("symbol_uid"))


def outline(symbols: DataFrame, resources: DataFrame, path: str) -> DataFrame:
    """Current symbols of one file with their place in its outline."""
    found = search_symbols(symbols, resources).where((F.col("path_key") == path) & F.col("current"))
    order = Window.partitionBy("path_key").orderBy("start_byte", F.col("end_byte").desc(), "uid")
    return found.withColumn("place", F.row_number().over(order).cast("long"))


def coverage_of(state: Column, language: Column) -> Column:
    """Structural coverage: as recorded, or by what the language's reader can do."""
    return F.coalesce(state, F.when(language.isin("PYTHON", "TYPESCRIPT", "RUST", "CSHARP"), "COMPLETE").otherwise("UNSUPPORTED"))


def support_of(coverage: Column) -> Column:
    return F.when(coverage == "COMPLETE", "SUPPORTED").when(coverage.isin("PARTIAL", "CONTAINER_ONLY"), "PARTIAL").otherwise("UNSUPPORTED")


def with_structure(resources: DataFrame, structure: DataFrame) -> DataFrame:
    """Adds coverage, support and freshness to resources.

    Evidence of another revision is STALE; else it is as fresh as its component.
    """
    s = structure.select(F.col("resource_uid").alias("uid"), F.col("state").alias("structure"), "freshness", "basis_revision")
    out = resources.join(s, "uid", "left").withColumn("coverage", coverage_of(F.col("structure"), F.col("language")))
    fresh = F.when(~F.col("basis_revision").eqNullSafe(F.col("revision")), "STALE").when(F.col("freshness") == "CURRENT", "FRESH").otherwise("DIRTY")
    return out.withColumn("support", support_of(F.col("coverage"))).withColumn("fresh", fresh)


def currentness(structure: DataFrame) -> DataFrame:
    """One row: CURRENT, or why not."""
    n = structure.agg(F.count("*").alias("n"), F.count_if(F.col("freshness") == "DIRTY").alias("dirty"))
    return n.select(F.when(F.col("n") == 0, "NEVER_PUBLISHED").when(F.col("dirty") > 0, "DIRTY").otherwise("CURRENT").alias("currentness"))


def symbol_places(symbols: DataFrame, resources: DataFrame) -> DataFrame:
    """Symbols with the path of their file and the id of their parent, null if the parent is not there."""
    p = symbols.select(F.col("uid").alias("parent_uid"), F.col("uid").alias("parent"))
    return symbols.join(resources.select(F.col("uid").alias("resource_uid"), "path_key"), "resource_uid").join(p, "parent_uid", "left")


def diff(known: DataFrame, observed: DataFrame) -> DataFrame:
    """What a scan has found (uid, size) against what is known: one change a resource."""
    a, b = known.select("uid", F.col("size").alias("old")), observed.select("uid", F.col("size").alias("new"))
    out = a.join(b, "uid", "full")
    change = F.when(F.col("old").isNull(), "CREATE").when(F.col("new").isNull(), "DELETE").when(F.col("old") != F.col("new"), "MODIFY").otherwise("SAME")
    return out.select("uid", change.alias("change"))


def by_suffix(wanted: DataFrame, resources: DataFrame) -> DataFrame:
    """(want, hits, outcome): how many paths are a wanted path or end with it after a slash."""
    ends = resources.select("uid", F.explode(path_suffixes(F.col("path_key"))).alias("want"))
    n = wanted.join(ends, "want", "left").groupBy("want").agg(F.count("uid").alias("hits"))
    return n.withColumn("outcome", F.when(F.col("hits") == 0, "EXTERNAL").when(F.col("hits") == 1, "INTERNAL").otherwise("AMBIGUOUS"))


def first_named(wanted: DataFrame, resources: DataFrame) -> DataFrame:
    """(k, uid): the active resource of least path whose file name is wanted, null without one."""
    r = active(resources).select(basename(F.col("path_key")).alias("k"), "uid", "path_key")
    return wanted.join(r, "k", "left").groupBy("k").agg(F.min_by("uid", "path_key").alias("uid"))
