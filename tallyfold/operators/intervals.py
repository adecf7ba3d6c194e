"""Joins of points with the spans they lie in, by bins.

A span is sent to every bin of ``width`` that it touches, a point to the bin it is
in, so that a key with very many points or spans is spread over its bins instead of
meeting in one task. A row with several points gives one result for each span, in
the bin of its first point inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a bin.
BIN_WIDTH = 16


def bin_of(point: Column, width: int) -> Column:
    return F.floor(point / width).cast("long")


def span_totals(rows: DataFrame, points: Column, spans: DataFrame, key: str, low: str, high: str, value: Column, width: int = BIN_WIDTH) -> DataFrame:
    """``spans`` with the number of ``rows`` that have one of their ``points`` in it (n) and the sum of ``value`` over these (total); spans without rows are left out.

    The pairs of ``points_in_spans`` are counted without being made: rows of the same
    points and spans of the same ends go through the join as one, so that its size
    follows the different points and ends of a key, not the rows.
    """
    places = rows.select(F.col(key).alias("_place"), points.alias("_at"), value.alias("_value"))
    places = places.groupBy("_place", "_at").agg(F.count("*").alias("_n"), F.sum("_value").alias("_total"))
    ends = spans.select(F.col(key).alias("_of"), F.col(low).alias("_low"), F.col(high).alias("_high")).distinct()
    met = points_in_spans(places.withColumnRenamed("_place", "_file"), F.col("_at"), ends.withColumnRenamed("_of", "_file"), "_file", "_low", "_high", width)
    totals = met.groupBy("_file", "_low", "_high").agg(F.sum("_n").alias("n"), F.sum("_total").alias("total"))
    return spans.join(totals, (F.col(key) == F.col("_file")) & (F.col(low) == F.col("_low")) & (F.col(high) == F.col("_high"))).drop("_file", "_low", "_high")


def points_in_spans(rows: DataFrame, points: Column, spans: DataFrame, key: str, low: str, high: str, width: int = BIN_WIDTH) -> DataFrame:
    """``rows`` joined with the ``spans`` (key, low, high and other columns, named unlike those of ``rows``) that hold one of their ``points`` (an array).

    Both ends of a span belong to it. Null keys, ends and points match nothing, and
    neither does a span that ends before it begins.
    """
    held = rows.withColumn("_points", points).withColumn("_bins", F.array_distinct(F.transform("_points", lambda p: bin_of(p, width))))
    held = held.withColumn("_bin", F.explode("_bins")).drop("_bins")
    cut = spans.where(F.col(low) <= F.col(high)).withColumnRenamed(key, "_key")
    cut = cut.withColumn("_span_bin", F.explode(F.sequence(bin_of(F.col(low), width), bin_of(F.col(high), width))))
    joined = held.join(cut, (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_span_bin")))
    first = F.array_min(F.filter("_points", lambda p: (p >= F.col(low)) & (p <= F.col(high))))
    return joined.where(bin_of(first, width) == F.col("_bin")).drop("_points", "_bin", "_span_bin", "_key")
