"""Versioned tables: append-only rows whose latest version per key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key: a maximum of structs, taken before the shuffle too."""
    rest = [c for c in versions.columns if c not in {*keys, *order}]
    best = versions.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("v"))
    return best.select(*keys, *[F.col(f"v.{c}").alias(c) for c in [*order, *rest]])


class VersionedTable:
    """Upserts on Parquet: every write appends with a version, reads take the latest of each key.

    ``order`` names columns that tell which of two rows of one key and version is the later one.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str] | None = None):
        self.spark, self.path, self.keys, self.order = spark, path, keys, order or []

    def upsert(self, rows: DataFrame, version: int) -> None:
        rows.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """Later versions may have more columns; earlier rows have null there."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        return latest(rows, self.keys, ["version", *self.order])

    def merged(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """``rows`` completed by what the table holds of their keys: columns of ``keep``, and those that ``rows`` doesn't have, stay."""
        held = self.read().drop("version")
        stay = [c for c in held.columns if c not in self.keys and (c in keep or c not in rows.columns)]
        old = held.select(*self.keys, *[F.col(c).alias(f"held_{c}") for c in stay])
        joined = rows.join(old, self.keys, "left")
        both = {c: F.coalesce(f"held_{c}", c) if c in rows.columns else F.col(f"held_{c}") for c in stay}
        return joined.withColumns(both).drop(*[f"held_{c}" for c in stay])

    def replace(self, rows: DataFrame) -> None:
        rows.withColumn("version", F.lit(0).cast("long")).write.mode("overwrite").parquet(self.path)

    def compact(self, into: str) -> "VersionedTable":
        """The latest rows alone, at another path."""
        self.read().write.mode("overwrite").parquet(into)
        return VersionedTable(self.spark, into, self.keys, self.order)


def pending(wanted: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """What has not succeeded yet; partial and failed entries come again."""
    return wanted.join(manifest.where(F.col("status") == "success"), key, "left_anti")


def latest_unfinished(jobs: DataFrame) -> DataFrame:
    """The job that was touched last of those not completed."""
    return jobs.where(F.col("status") != "completed").orderBy(F.desc("updated_at"), F.desc("job_id")).limit(1)


def progress(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    joined = files.join(manifest.select(key, "status"), key, "left")
    return joined.agg(F.count_if(F.col("status") == "success").alias("done"), F.count("*").alias("total"))


def file_status(files: DataFrame, papers: DataFrame) -> DataFrame:
    """failed without papers, partial where one isn't a success, else success."""
    counts = papers.groupBy("file_id").agg(F.count("*").alias("papers"), F.bool_or(F.col("status") != "success").alias("bad"))
    joined = files.select("file_id").join(counts, "file_id", "left")
    state = F.when(F.col("papers").isNull(), "failed").when(F.col("bad"), "partial").otherwise("success")
    return joined.select("file_id", F.coalesce("papers", F.lit(0).cast("long")).alias("papers"), state.alias("file_status"))
