"""Bounded samples that are the same at every partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 40


def first_in_hash_order(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Up to ``most`` rows of distinct ``key``, the first in hash order.

    Of a large table only the part of the hash range that should hold twice as many
    rows is sorted, so that what tasks send on doesn't grow with the table.
    """
    place = F.pmod(F.xxhash64(key), F.lit(_RANGE))
    total = rows.count()
    if total > 4 * most:
        inside = rows.where(place < int(_RANGE * (2 * most + 1_000) / total))
        # Many rows of one key may leave too few; then all are sorted.
        if inside.select(key).distinct().count() >= most:
            rows = inside
    return rows.dropDuplicates([key]).orderBy(place, key).limit(most)
