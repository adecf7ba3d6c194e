"""Incremental ingest: a growing folder as a stream, upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.tables import VersionedTable


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """First event of each key; state is dropped ``late`` after the watermark passes."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    counts = events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), kind, "n")


def upsert_stream(rows: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Every micro-batch is one version, named by its id, so that a repeated batch changes nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there now, then stop."""
    rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
