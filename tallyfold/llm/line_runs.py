"""Line deduplication against levelled sorted runs (DataFrame functions only).

A store of runs holds, for every line key seen so far, the document that owns
it. A batch of documents brings its own keys; a merge anti-join against the runs
finds the new ones, which become one more sorted run. Two runs of a level are
merged into one run of the next, so that n batches leave O(log n) runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_KEY_CHARS = 10
BATCHES = 4
KEY = ["key_a", "key_b"]


def split_lines(text: Column) -> Column:
    """Lines between \\n; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_keys(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """doc_id, text_hash, pos and a 128-bit key hash of each line long enough to be shared."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    key = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return key.where(F.length("key") >= min_chars).select(
        "doc_id",
        "text_hash",
        "pos",
        F.xxhash64("key").alias("key_a"),
        F.xxhash64(F.lit("second"), F.col("key")).alias("key_b"),
    )


class LineRunStore:
    """Runs of (key, owner), sorted by key within hash partitions."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fan_in: int = 2):
        self.spark, self.scratch, self.fan_in = spark, scratch, fan_in
        self.levels: dict[int, list[str]] = {}
        self.made = 0

    def _write(self, run: DataFrame, level: int) -> None:
        self.made += 1
        name = f"run-{level}-{self.made}"
        self.scratch.keep(run.repartition(*KEY).sortWithinPartitions(*KEY), name)
        self.levels.setdefault(level, []).append(name)
        if len(self.levels[level]) >= self.fan_in:
            old = self.levels.pop(level)
            self._write(self._read(old), level + 1)
            self.scratch.drop(*old)

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema("key_a long, key_b long, owner long").parquet(*map(self.scratch.path, names))

    def runs(self) -> DataFrame | None:
        names = [name for level in self.levels.values() for name in level]
        return self._read(names) if names else None

    def add(self, keys: DataFrame) -> None:
        """Add the keys of one batch; those already in a run keep their owner."""
        own = keys.groupBy(*KEY).agg(F.min("doc_id").alias("owner"))
        known = self.runs()
        if known is not None:
            own = own.join(known.select(*KEY).hint("merge"), KEY, "left_anti")
        self._write(own, 0)


def _batch_bounds(keys: DataFrame, batches: int) -> list[int]:
    """Document ids that cut the keys into about equal batches, in ascending order."""
    if batches < 2:
        return []
    cuts = keys.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02)
    return sorted({int(x) for x in cuts})


def dropped_lines(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """doc_id, text_hash and the sorted positions of the lines that an earlier document owns."""
    spark = docs.sparkSession
    keys = scratch.keep(line_keys(docs, min_chars), "keys")
    store = LineRunStore(spark, scratch)
    low = None
    for high in [*_batch_bounds(keys, batches), None]:
        batch = keys if low is None else keys.where(F.col("doc_id") > low)
        store.add(batch if high is None else batch.where(F.col("doc_id") <= high))
        low = high
    owners = store.runs()
    lost = keys.join(owners.hint("merge"), KEY).where(F.col("doc_id") > F.col("owner"))
    return lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("lost"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text.

    Keys of at least ``min_chars`` code points lose their lines in all documents
    but the one with the smallest doc_id. A null text is one empty line; a null
    doc_id neither owns nor loses lines; repeated rows of one doc_id count as one
    document. Other columns pass through; those named like an added one are replaced.
    """
    scratch = Scratch(docs.sparkSession, "line-runs")
    lost = dropped_lines(docs.select("doc_id", "text"), scratch, batches, min_chars)
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    row, gone = F.col(f"{mark}row"), F.col(f"{mark}lost")
    lost = lost.select(*[F.col(c).alias(mark + c) for c in ("doc_id", "text_hash", "lost")])
    whole = docs.select(F.struct("*").alias(f"{mark}row"))
    text = row["text"]
    joined = whole.join(lost, (row["doc_id"] == F.col(f"{mark}doc_id")) & (F.xxhash64(text) == F.col(f"{mark}text_hash")), "left")
    lines = split_lines(text)
    first = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    until = F.concat(gone, F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(first, until, lambda a, b: F.slice(lines, a + 1, b - a)))
    added = {
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.when(gone.isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long"),
        "kept_text": F.when(gone.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n")),
    }
    passed = [row.getField(c).alias(c) for c in docs.columns if c not in added]
    return joined.select(*passed, *[c.alias(name) for name, c in added.items()])
