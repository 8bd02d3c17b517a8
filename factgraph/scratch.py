"""Tables written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only if none is set on a local master, as in tests."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factgraph-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Tables written once and read again: they cut lineage and survive the loss of any executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        self.written = 0
        atexit.register(self.clear)

    def write(self, df: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.base}/{self.written}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read again, and lets Spark remove finished shuffles."""
        for _, path in [x for x in self.tables if any(x[0] is t for t in tables)]:
            self._delete(path)
        self.tables = [x for x in self.tables if not any(x[0] is t for t in tables)]
        self.release()

    def release(self) -> None:
        """The files of a shuffle go when the driver's JVM has collected its handle, not before."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001  the session may have ended
            pass
