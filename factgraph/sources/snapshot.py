"""Generations of a snapshot: written in a place of their own, published by compare and swap."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Stale(RuntimeError):
    """The revision has moved since the generation was begun; the generation is dropped."""


class Snapshots:
    """Tables of one workspace below a folder that all executors share.

    Each attempt to publish writes its tables into a directory of its own.  Generation N is published by
    creating the file ``pointers/N``, which the file system grants to one writer only; it names the
    directory.  The current generation is the largest pointer, so readers see one generation or the next,
    never a mixture, and a writer that loses deletes its own directory and nothing else.  A writer that
    dies between the creation of its pointer and the one line in it blocks later ones until ``repair``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._stream = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> dict:
        """generation, revision and home; 0, 0 and None before the first publication."""
        at = self._path(f"{self.root}/pointers")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        for name in sorted((n for n in names if n.isdigit()), reverse=True):
            raw = self._fs.open(self._path(f"{self.root}/pointers/{name}"))
            try:
                text = self._stream.toString(raw, "UTF-8")
            finally:
                raw.close()
            if text.endswith("\n"):  # else its writer is between the creation and the content
                return json.loads(text)
        return {"generation": 0, "revision": 0, "home": None}

    def begin(self, tables: dict[str, DataFrame]) -> str:
        """Writes the tables of an attempt and returns their directory."""
        home = f"{self.root}/attempts/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{home}/{name}")
        return home

    def publish(self, tables: dict[str, DataFrame], basis: int, revision: int) -> dict:
        """Writes a generation and makes it current, if the current revision still is ``basis``."""
        now = self.current()
        if now["revision"] != basis:
            raise Stale(f"basis {basis}, current {now['revision']}")
        return self.swap(now, self.begin(tables), revision)

    def swap(self, now: dict, home: str, revision: int) -> dict:
        """Publishes ``home`` as the generation after ``now``, or drops it if there is one already."""
        new = {"generation": now["generation"] + 1, "revision": revision, "home": home}
        try:
            out = self._fs.create(self._path(f"{self.root}/pointers/{new['generation']:012}"), False)
        except Exception as e:
            self._fs.delete(self._path(home), True)
            raise Stale("another generation was published meanwhile") from e
        out.write(bytearray(json.dumps(new) + "\n", "utf-8"))
        out.close()
        return new

    def repair(self) -> None:
        """Removes a pointer without content; only to be called when no writer is at work."""
        now = self.current()
        self._fs.delete(self._path(f"{self.root}/pointers/{now['generation'] + 1:012}"), False)

    def table(self, name: str, at: dict | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{(at or self.current())['home']}/{name}")


def reconcile(snapshots: Snapshots, observed: DataFrame) -> dict:
    """A full rescan: publishes ``observed`` as the resources, one revision on, only if anything changed."""
    now = snapshots.current()
    if now["generation"]:
        old = snapshots.table("resource", now)
        if old.exceptAll(observed).isEmpty() and observed.exceptAll(old).isEmpty():
            return now
    return snapshots.publish({"resource": observed}, now["revision"], now["revision"] + 1)
