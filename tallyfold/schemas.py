"""Enumerations and record rules of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Question types with their labels in display order.
QUESTION_TYPES = [
    ("mcq", "MCQ"),
    ("short_answer", "Short Answer"),
    ("short_essay", "Short Essay"),
    ("long_answer", "Long Answer"),
    ("essay", "Essay"),
    ("other", "Other"),
    ("unknown", "Unknown"),
]
#: States of a topic classification.
STATUSES = ["classified", "ambiguous", "no_match", "unclassified"]
#: Record lists and the most entries that each may have.
LIST_CAPS = {"topics": 600, "chapter_names": 50, "boundaries": 100, "sections": 30, "questions": 300, "classifications": 300, "pair_verdicts": 300}


def dimension(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    """The legal values of an enumeration with their order, for dense counts."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, ord int")


def confidence_ok(confidence: Column) -> Column:
    return F.coalesce(confidence.between(0, 1), F.lit(True))


def status_ok(status: Column, topic_id: Column) -> Column:
    """Classified exactly where there is a topic."""
    return (status == "classified") == (F.coalesce(topic_id, F.lit("")) != "")


def evidence_ok(value: Column, evidence: Column) -> Column:
    """A value exactly where there is evidence for it."""
    return value.isNotNull() == (F.coalesce(evidence, F.lit("")) != "")


def correction_ok(applied: Column, original: Column) -> Column:
    return ~applied | (F.coalesce(original, F.lit("")) != "")


def pair_ok(a: Column, b: Column) -> Column:
    return a < b


def over_cap(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """Keys with more list entries than allowed."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > cap)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule for each record that breaks one: one pass, one row per breach."""
    broken = F.filter(F.array(*[F.when(~rule, F.lit(name)) for name, rule in sorted(rules.items())]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))
