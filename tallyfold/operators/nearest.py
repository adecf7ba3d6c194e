"""Nearest earlier rows with a smaller value, without gathering a group.

Values are ranked within their group, and ranks are filed in a binary indexed tree: a
row is filed under the nodes that hold its rank (as many as the ranks have binary
digits) and looks at the nodes that cover all smaller ranks. Within a node the last
row filed so far is a running maximum, and of the nodes that a row looks at the
latest counts. So n rows of d different values cost some n * log(d) small rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Binary digits of a rank at most.
DIGITS = 31


def _low_bit(k: Column) -> Column:
    return k.bitwiseAND(-k)


def _filed_under(rank: Column, ranks: Column) -> Column:
    step = lambda held: F.element_at(held, -1) + _low_bit(F.element_at(held, -1))
    return F.aggregate(F.sequence(F.lit(1), F.lit(DIGITS)), F.array(rank), lambda held, _: F.when(step(held) <= ranks, F.concat(held, F.array(step(held)))).otherwise(held))


def _looked_at(rank: Column) -> Column:
    """Nodes that cover the ranks below ``rank``; none for the smallest."""
    step = lambda held: F.element_at(held, -1) - _low_bit(F.element_at(held, -1))
    all_ = F.aggregate(F.sequence(F.lit(1), F.lit(DIGITS)), F.array(rank - 1), lambda held, _: F.when(step(held) > 0, F.concat(held, F.array(step(held)))).otherwise(held))
    return F.filter(all_, lambda k: k > 0)


def nearest_smaller(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """group, order, before: the order of the nearest earlier row of the group with a smaller value; null where there is none.

    ``order`` is unique in its group; rows with a null group, order or value are left out.
    """
    kept = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).alias("v")).where("g IS NOT NULL AND o IS NOT NULL AND v IS NOT NULL")
    values = kept.select("g", "v").distinct()
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("v"))).withColumn("ranks", F.count("*").over(Window.partitionBy("g")).cast("int"))
    placed = kept.join(ranked, ["g", "v"])
    filed = placed.select("g", F.explode(_filed_under(F.col("rank"), F.col("ranks"))).alias("node"), "o", F.col("o").alias("mark"))
    asked = placed.select("g", F.explode(_looked_at(F.col("rank"))).alias("node"), "o", F.lit(None).cast(filed.schema["mark"].dataType).alias("mark"))
    running = Window.partitionBy("g", "node").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    seen = filed.unionByName(asked).withColumn("last", F.max("mark").over(running)).where("mark IS NULL")
    best = seen.groupBy("g", "o").agg(F.max("last").alias("before"))
    out = kept.select("g", "o").join(best, ["g", "o"], "left")
    return out.select(F.col("g").alias(group), F.col("o").alias(order), "before")


def depths(pointers: DataFrame, scratch) -> DataFrame:
    """group, order, depth (from 1) of rows that point at an earlier row or at none (g, o, before); steps double from round to round."""
    current = scratch.keep(pointers.select("g", "o", "before", F.when(F.col("before").isNull(), 1).otherwise(2).alias("depth")), "depth-0")
    step = 0
    while current.where("before IS NOT NULL").limit(1).count():
        step += 1
        up = current.select(F.col("g").alias("ug"), F.col("o").alias("uo"), F.col("before").alias("above"), F.col("depth").alias("more"))
        joined = current.join(up, (F.col("g") == F.col("ug")) & (F.col("before") == F.col("uo")), "left")
        current = scratch.keep(joined.select("g", "o", F.col("above").alias("before"), F.coalesce(F.col("depth") - 1 + F.col("more"), "depth").cast("int").alias("depth")), f"depth-{step}")
        scratch.drop(f"depth-{step - 1}")
    return current.select("g", "o", "depth")
