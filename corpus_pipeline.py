"""Corpus cleaning: toxic documents go, repeated lines go, one of each group of
near copies stays, contaminated documents go, and the rest is encoded.

Each stage is written as Parquet and read again by the next, so that a lost
executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import stages
from tallyfold.scratch import Scratch

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("ngram_jaccard", stages.keep_one_of_near_copies),
    ("decontamination", stages.drop_contaminated),
    ("bpe", stages.encode),
]

#: Learning, similarity joins and BPE are not expressible in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
