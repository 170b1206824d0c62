"""Intermediate tables in the folder that driver and executors share.

A written Parquet table cuts lineage, survives the loss of an executor, carries its size for Spark's choice
of join, and leaves both sides of a later join as plain exchanges that adaptive execution can split.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``. Where it is unset, one of our own, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        root = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, so that any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one operator call. ``drop`` frees those that no later plan reads; the rest go when Python exits."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._clear)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it as read back."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete_path(self.spark, t._scratch_path)

    def _clear(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the session has ended; the cluster clears its checkpoint folder
            pass
