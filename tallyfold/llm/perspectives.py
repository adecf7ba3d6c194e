"""Chat formatting by perspective rotation (DataFrame functions only).

A dialogue is rendered once for every participant: that speaker's turns become the
assistant's, the others' turns those of named users, and only the assistant's own
words are trained on. The rendering is a table of segments with their offsets, so
that a conversation of any length is never gathered in one task; the segments of a
perspective, in order, are its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, NOBODY = "system", "unknown"
#: Turns whose offsets are summed together first.
TURNS_PER_BUCKET = 256


def rotate_perspectives(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, position, speaker, segment, start, stop, mask_start, mask_stop.

    Participants are the distinct roles of a conversation but ``system``, whose
    turns are the same in every perspective; a conversation of system turns alone
    has the one perspective ``system``, in which nothing is trained. A null role is
    named ``unknown``, a null text is empty. Turns are ordered by turn, role and
    text, nulls first; repeated rows are turns of their own. Offsets count code
    points, ends exclusive; mask_start and mask_stop bound what is trained (the
    text and the closing mark) and are null for others' segments. A null conv_id is
    a conversation like any other.
    """
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(NOBODY)).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("said"),
        F.coalesce(F.floor(F.col("turn") / TURNS_PER_BUCKET), F.lit(-(1 << 62))).alias("bucket"),
    )
    roles = turns.groupBy("conv_id", "speaker").agg(F.lit(1).alias("one"))
    others = roles.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("other"))
    rotated = turns.join(others, F.col("conv_id").eqNullSafe(F.col("of")), "left").withColumn("perspective", F.coalesce("other", F.lit(SYSTEM)))
    own = (F.col("speaker") == F.col("perspective")) & (F.col("speaker") != SYSTEM)
    header = (
        F.when(F.col("speaker") == SYSTEM, F.lit("system"))
        .when(own, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    )
    opening = F.concat(F.lit(OPEN), header, F.lit("\n"))
    made = rotated.select(
        "conv_id", "perspective", "bucket", "turn", "speaker", "said", own.alias("own"), F.length(opening).alias("lead"),
        F.concat(opening, F.col("said"), F.lit(CLOSE)).alias("segment"),
    ).withColumn("size", F.length("segment").cast("long"))
    within = Window.partitionBy("conv_id", "perspective", "bucket").orderBy("turn", "speaker", "said")
    made = made.withColumns(
        {"place": F.row_number().over(within), "until": F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))}
    )
    buckets = made.groupBy("conv_id", "perspective", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        F.col("conv_id").alias("c"),
        F.col("perspective").alias("p"),
        F.col("bucket").alias("b"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("bucket") == F.col("b"))
    joined = made.join(offsets, same)
    start = F.col("chars_before") + F.col("until") - F.col("size")
    return joined.select(
        "conv_id",
        "perspective",
        (F.col("turns_before") + F.col("place") - 1).cast("long").alias("position"),
        "speaker",
        "segment",
        start.cast("long").alias("start"),
        (start + F.col("size")).cast("long").alias("stop"),
        F.when(F.col("own"), start + F.col("lead")).cast("long").alias("mask_start"),
        F.when(F.col("own"), start + F.col("size")).cast("long").alias("mask_stop"),
    )
