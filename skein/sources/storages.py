"""Datasets, key-value stores and request queues by name under one folder, and request sources besides tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.datasets import Dataset, KeyValueStore

# The folders of the kinds of storage.
FOLDERS = {"dataset": "datasets", "store": "key_value_stores", "queue": "request_queues"}


class Storage:
    """Storages under root, a folder that all machines share. Those named `default` are emptied by purge()."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str, name: str = "default") -> str:
        if not name or "/" in name:
            raise ValueError(f"not a name: {name!r}")
        return f"{self.root}/{FOLDERS[kind]}/{name}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def exists(self, kind: str, name: str = "default") -> bool:
        fs, p = self._fs(self.path(kind, name))
        return fs.exists(p)

    def names(self, kind: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{FOLDERS[kind]}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def append(self, kind: str, rows: DataFrame, name: str = "default") -> None:
        rows.write.mode("append").parquet(self.path(kind, name))

    def dataset(self, name: str = "default", seq: str = "seq") -> Dataset:
        return Dataset.open(self.spark, self.path("dataset", name), seq)

    def store(self, name: str = "default") -> KeyValueStore:
        return KeyValueStore(self.spark.read.parquet(self.path("store", name)))

    def queue(self, name: str = "default") -> DataFrame:
        """The journal of a queue, see requests.queue_state()."""
        return self.spark.read.parquet(self.path("queue", name))

    def drop(self, kind: str, name: str = "default") -> bool:
        """Removes a storage; false if there was none."""
        fs, p = self._fs(self.path(kind, name))
        return fs.delete(p, True)

    def purge(self) -> None:
        """Empties what is named `default`; the record INPUT stays."""
        self.drop("dataset")
        self.drop("queue")
        if self.exists("store"):
            fs, old = self._fs(self.path("store"))
            _, new = self._fs(self.path("store", "default.purged"))
            self.store().purged().write.mode("overwrite").parquet(str(new))
            fs.delete(old, True)
            fs.rename(new, old)


def with_function(static: DataFrame, more: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """sources(seq, ...) followed by what a function makes of the session, its rows numbered after the static ones."""
    last = static.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("_last"))
    rows = more(static.sparkSession).join(F.broadcast(last)).withColumn("seq", F.col("seq") + F.col("_last")).drop("_last")  # one row
    return static.unionByName(rows, allowMissingColumns=True)


def downloaded(spark: SparkSession, path: str) -> DataFrame:
    """Files as binary bodies: path, body, size, modified_at."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("body"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
