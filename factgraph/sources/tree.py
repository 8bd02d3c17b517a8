"""Discovery of a source tree: exclusion, role and language of paths, stable identities."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Directory names that are never read.
EXCLUDED = (".git", "node_modules", "venv", ".venv", "virtualenv")
#: Directory names that are not read where one of the markers stands beside them: file names, or
#: extensions (with a dot, in any case).
CONTEXTUAL = {
    "target": ("Cargo.toml",),
    "bin": (".csproj", ".sln"),
    "obj": (".csproj", ".sln"),
    "build": ("package.json", "pyproject.toml", "setup.py", "setup.cfg", "Cargo.toml"),
    "dist": ("package.json", "pyproject.toml", "setup.py", "setup.cfg", "Cargo.toml"),
}
#: What names say about roles; all compared in lower case.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs")
TEST_STARTS, TEST_ENDS = ("test_",), ("_test", ".test", "_spec", ".spec")
CONFIG_NAMES = ("cargo.toml", "cargo.lock", "package.json", "package-lock.json", "pyproject.toml", "tsconfig.json", "jsconfig.json", ".gitignore", ".gitattributes", ".editorconfig")
CONFIG_EXTENSIONS = ("toml", "yaml", "yml", "ini", "cfg", "conf", "csproj")
DOCS_STEMS = ("readme", "changelog", "license", "contributing", "authors")
DOCS_EXTENSIONS = ("md", "mdx", "rst", "adoc")
ASSET_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "svg", "ico", "bmp", "webp", "woff", "woff2", "ttf", "otf", "pdf", "mp4", "mp3", "wav", "wasm", "zip")
LANGUAGES = {
    "py": "PYTHON", "pyi": "PYTHON", "js": "JAVASCRIPT", "mjs": "JAVASCRIPT", "cjs": "JAVASCRIPT", "jsx": "JAVASCRIPT",
    "ts": "TYPESCRIPT", "mts": "TYPESCRIPT", "cts": "TYPESCRIPT", "tsx": "TYPESCRIPT", "svelte": "SVELTE", "cs": "CSHARP", "rs": "RUST",
}


def walk(root: str) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime_ns) of files below root in order of name, links skipped."""
    for base, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not os.path.islink(os.path.join(base, d)) and d not in EXCLUDED)
        for name in sorted(files):
            full = os.path.join(base, name)
            if not os.path.islink(full):
                s = os.stat(full)
                yield os.path.relpath(full, root).replace(os.sep, "/"), s.st_size, s.st_mtime_ns


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path_key, size) of all files of a tree: the driver lists names, as Spark's own reader leaves out
    names that begin with a dot or an underscore, and empty files."""
    if "://" in root:
        fs, base = pafs.FileSystem.from_uri(root)
        found = [(i.path[len(base.rstrip("/")) + 1 :], i.size) for i in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if i.type == pafs.FileType.File]
    else:
        found = [x[:2] for x in walk(root)]
    return spark.createDataFrame(pa.table({"path_key": pa.array([x[0] for x in found], pa.string()), "size": pa.array([x[1] for x in found], pa.int64())}))


def with_content(files: DataFrame, root: str, task_bytes: int = 64 << 20) -> DataFrame:
    """Listed files with their content, read by the executors; null if a file is gone or cannot be read."""
    total = files.agg(F.sum("size")).first()[0] or 0
    home = root if "://" in root else "file://" + os.path.abspath(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(home)
        for batch in batches:
            for path, size in zip(batch.column("path_key").to_pylist(), batch.column("size").to_pylist(), strict=True):
                try:
                    with fs.open_input_stream(f"{base}/{path}") as f:
                        raw = f.read()
                except OSError:
                    raw = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([raw], pa.binary())], ["path_key", "size", "content"])

    return files.select("path_key", "size").repartition(max(1, -(-total // task_bytes)), "path_key").mapInArrow(run, "path_key string, size long, content binary")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files of a tree as rows (path_key, size, content)."""
    return with_content(list_tree(spark, root), root)


def excluded(paths: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Paths outside excluded directories; contextual ones only count where a marker stands beside them.

    extra: further directory names that are never read, such as a tool's own data directory.
    """
    parts = F.split("path_key", "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    always = F.arrays_overlap(above, F.array(*[F.lit(x) for x in (*EXCLUDED, *extra)]))
    kept = paths.where(~always)
    name = F.substring_index("path_key", "/", -1)
    marker = F.lit(None).cast("string")
    for m in sorted({m for ms in CONTEXTUAL.values() for m in ms}):
        marker = F.when(F.lower(_extension(F.lower(name))) == m[1:] if m.startswith(".") else name == m, m).otherwise(marker)
    beside = kept.select(F.regexp_replace("path_key", r"[^/]*$", "").alias("home"), marker.alias("marker")).where("marker IS NOT NULL").distinct()
    wanted = F.create_map(*[x for d, ms in CONTEXTUAL.items() for x in (F.lit(d), F.array(*[F.lit(m) for m in ms]))])
    places = F.transform(above, lambda d, i: F.struct(F.array_join(F.transform(F.slice(parts, F.lit(1), i), lambda x: F.concat(x, F.lit("/"))), "").alias("home"), wanted[d].alias("markers")))
    inside = kept.select("path_key", F.explode(F.filter(places, lambda p: p["markers"].isNotNull())).alias("p")).select("path_key", "p.home", F.explode("p.markers").alias("marker"))
    return kept.join(inside.join(beside, ["home", "marker"], "left_semi").select("path_key").distinct(), "path_key", "left_anti")


def _extension(name: Column) -> Column:
    """What follows the last dot of a file name, or null; a leading dot begins a name, no extension."""
    return F.when(F.regexp_like(name, F.lit(r"^.+\.[^.]*$")), F.substring_index(name, ".", -1))


def language_of(path: Column) -> Column:
    """Language by extension, whatever the role."""
    ext = _extension(F.lower(F.substring_index(path, "/", -1)))
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def role_of(path: Column) -> Column:
    """TEST, then CONFIG, DOCS, SOURCE (with a language), ASSET, UNKNOWN."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    ext = _extension(name)
    stem = F.when(ext.isNotNull(), F.substr(name, F.lit(1), F.length(name) - F.length(ext) - 1)).otherwise(name)
    test = F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(x) for x in TEST_DIRS]))
    for x in TEST_STARTS:
        test |= F.startswith(stem, F.lit(x))
    for x in TEST_ENDS:
        test |= F.endswith(stem, F.lit(x))
    held = lambda x, names: F.coalesce(x.isin(*names), F.lit(False))
    config = held(name, CONFIG_NAMES) | held(ext, CONFIG_EXTENSIONS)
    docs = held(stem, DOCS_STEMS) | held(ext, DOCS_EXTENSIONS)
    return F.when(test, "TEST").when(config, "CONFIG").when(docs, "DOCS").when(language_of(path).isNotNull(), "SOURCE").when(held(ext, ASSET_EXTENSIONS), "ASSET").otherwise("UNKNOWN")


def resource_language(path: Column) -> Column:
    """The language that a resource keeps: configuration, documents and assets have none."""
    return F.when(role_of(path).isin("TEST", "SOURCE"), language_of(path))


def observed_hash(found: DataFrame, known: DataFrame) -> DataFrame:
    """Content hashes; a known one is reused where size and mtime are unchanged."""
    k = known.select("path_key", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("hash").alias("_h"))
    j = found.join(k, "path_key", "left")
    same = (F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m"))
    return j.select("path_key", "size", F.when(same, F.col("_h")).otherwise(F.sha2("content", 256)).alias("hash"), F.coalesce(same, F.lit(False)).alias("reused"))


def stable_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of new symbols (n, qualified_name, kind, signature): an old id goes over where the key is
    unique on both sides, first by name and kind, then by signature too; no id is given twice."""

    def unique(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.withColumn("_c", F.count("*").over(Window.partitionBy(*keys))).where("_c = 1").drop("_c")

    first = ["qualified_name", "kind"]
    one = unique(new, first).select("n", *first).join(unique(old, first).select("uid", *first), first).select("n", "uid")
    rest_new = new.join(one.select("n"), "n", "left_anti")
    rest_old = old.join(one.select("uid"), "uid", "left_anti")
    second = [*first, "signature"]
    two = unique(rest_new, second).select("n", *second).join(unique(rest_old, second).select("uid", *second), second).select("n", "uid")
    return new.select("n").join(one.unionByName(two), "n", "left")
