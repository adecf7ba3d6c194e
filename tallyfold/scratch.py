"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where none is set."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        root = tempfile.mkdtemp(prefix="tallyfold-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the path, as the JVM has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = file_system(spark, path)
    return system.exists(where)


class Scratch:
    """Named Parquet tables of one operator run.

    ``keep`` cuts lineage: it writes a plan and reads it back, so that a lost
    executor costs the running stage only. ``drop`` deletes what no later step
    reads; tables that the returned plan still needs stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def keep(self, df: DataFrame, table: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
        writer = df.write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        # What is written is read from there, and its shuffle files by nobody.
        before = self.spark.conf.get(CLEANUP_KEY, None)
        self.spark.conf.set(CLEANUP_KEY, "true")
        try:
            writer.parquet(self.path(table))
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP_KEY)
            else:
                self.spark.conf.set(CLEANUP_KEY, before)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for table in tables:
            system, where = file_system(self.spark, self.path(table))
            system.delete(where, True)
