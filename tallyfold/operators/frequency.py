"""Frequency analytics: dense counts, rankings and integrity of the occurrence table.

Occurrences (questions) have question_id, paper_id, paper_year, question_type,
topic_id; links map question_id to canonical_question_id. Every aggregate is
partial before its shuffle; dimension tables are a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_parseable_year, year_key
from ..schemas import QUESTION_TYPES, STATUSES, dimension
from ..scratch import Scratch


def dense_counts(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """``column``, ord and n for every legal value, zero where there are no rows."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return dimension(rows.sparkSession, column, values).join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def type_counts(questions: DataFrame) -> DataFrame:
    return dense_counts(questions, "question_type", [k for k, _ in QUESTION_TYPES])


def status_counts(questions: DataFrame) -> DataFrame:
    return dense_counts(questions, "classification_status", STATUSES)


def type_shares(questions: DataFrame) -> DataFrame:
    """Counts by type with their share in percent of all types, one decimal, 0.0 of nothing."""
    counts = type_counts(questions)
    total = counts.agg(F.sum("n").alias("total"))
    share = F.when(F.col("total") > 0, F.round(F.col("n") * 100 / F.col("total"), 1)).otherwise(F.lit(0.0))
    # One row of totals.
    return counts.crossJoin(F.broadcast(total)).select("question_type", "n", share.alias("share_pct"))


def years_represented(questions: DataFrame) -> DataFrame:
    """Distinct years in label order; null and empty ones don't count."""
    years = questions.where(F.coalesce("paper_year", F.lit("")) != "").select("paper_year").distinct()
    # Distinct years are few; the rank needs them together.
    return years.select("paper_year", F.row_number().over(Window.orderBy(year_key(F.col("paper_year")))).cast("long").alias("ord"))


def first_and_latest_year(questions: DataFrame, keys: list[str]) -> DataFrame:
    parseable = F.when(is_parseable_year(F.col("paper_year")), year_key(F.col("paper_year")))
    return questions.groupBy(*keys).agg(F.min(parseable)["label"].alias("first_year"), F.max(parseable)["label"].alias("latest_year"))


def year_conflict_papers(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("year_conflict")).select("paper_id").distinct()


def last_link(links: DataFrame, order: str | None = None) -> DataFrame:
    """One canonical per question: the last of duplicates."""
    best = F.max_by("canonical_question_id", order) if order else F.max("canonical_question_id")
    return links.groupBy("question_id").agg(best.alias("canonical_question_id"))


def topic_summary(topics: DataFrame, questions: DataFrame, links: DataFrame) -> DataFrame:
    """Per topic, questions or none: occurrences, canonicals, papers, and each type's count."""
    linked = questions.join(last_link(links), "question_id", "left")
    per_type = [F.count_if(F.col("question_type") == k).alias(f"n_{k}") for k, _ in QUESTION_TYPES]
    counts = linked.groupBy("topic_id").agg(
        F.count("*").alias("total_occurrences"),
        F.countDistinct("canonical_question_id").alias("unique_canonical"),
        F.countDistinct("paper_id").alias("papers"),
        *per_type,
    )
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in counts.columns if c != "topic_id"}
    return topics.join(counts, "topic_id", "left").withColumns(zeros)


def ranked(rows: DataFrame, order: list[Column], name: str = "rnk") -> DataFrame:
    """1..n by ``order``. Meant for summaries: all of their rows meet in one sort."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def ranked_widely(rows: DataFrame, order: list[Column], name: str = "rnk") -> DataFrame:
    """1..n by ``order`` for tables that grow: numbers within range partitions, and the partitions' running totals."""
    scratch = Scratch(rows.sparkSession, "ranked")
    spread = scratch.keep(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "spread")
    within = spread.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    totals = spread.groupBy("part").agg(F.count("*").alias("n"))
    # One row a partition.
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return within.join(F.broadcast(before), "part").withColumn(name, F.col("before") + F.col("place")).drop("part", "place", "before")


def rank_topics(summary: DataFrame) -> DataFrame:
    """Topics with occurrences by occurrences, canonicals, id."""
    seen = summary.where(F.col("total_occurrences") > 0)
    return ranked(seen, [F.desc("total_occurrences"), F.desc("unique_canonical"), F.asc("topic_id")])


def rank_topics_by_unique(summary: DataFrame) -> DataFrame:
    seen = summary.where(F.col("total_occurrences") > 0)
    return ranked(seen, [F.desc("unique_canonical"), F.desc("total_occurrences"), F.asc("topic_id")])


def topic_repeated(questions: DataFrame, links: DataFrame) -> DataFrame:
    """Canonicals that occur more than once within a topic."""
    counts = questions.join(last_link(links), "question_id").groupBy("topic_id", "canonical_question_id").agg(F.count("*").alias("occurrences"))
    within = Window.partitionBy("topic_id").orderBy(F.desc("occurrences"), "canonical_question_id")
    return counts.where(F.col("occurrences") > 1).withColumn("ord", F.row_number().over(within).cast("long"))


def repetition_by_type(questions: DataFrame, links: DataFrame) -> DataFrame:
    """Per type: occurrences, canonicals, and canonicals that repeat within the type; zeros kept."""
    linked = questions.join(last_link(links), "question_id", "left")
    each = linked.groupBy("question_type", "canonical_question_id").agg(F.count("*").alias("n"))
    known = F.col("canonical_question_id").isNotNull()
    counts = each.groupBy("question_type").agg(
        F.sum("n").alias("occurrences"), F.count_if(known).alias("unique_canonical"), F.count_if(known & (F.col("n") > 1)).alias("repeated")
    )
    kinds = dimension(questions.sparkSession, "question_type", [k for k, _ in QUESTION_TYPES])
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("occurrences", "unique_canonical", "repeated")}
    return kinds.join(counts, "question_type", "left").withColumns(zeros).drop("ord")


def canonical_frequency(canonicals: DataFrame, links: DataFrame, questions: DataFrame) -> DataFrame:
    """Per canonical: linked occurrences (found or not), papers and types of the found ones."""
    members = links.join(questions.select("question_id", "paper_id", "question_type", "paper_year"), "question_id", "left")
    counts = members.groupBy("canonical_question_id").agg(
        F.count("*").alias("occurrences"),
        F.countDistinct("paper_id").alias("papers"),
        F.array_join(F.array_sort(F.collect_set("question_type")), ",").alias("types"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("paper_year", F.lit("")))), ",").alias("years"),
    )
    filled = {"occurrences": F.coalesce("occurrences", F.lit(0).cast("long")), "papers": F.coalesce("papers", F.lit(0).cast("long"))}
    filled |= {c: F.coalesce(c, F.lit("")) for c in ("types", "years")}
    return canonicals.join(counts, "canonical_question_id", "left").withColumns(filled)


def rank_canonicals(frequency: DataFrame) -> DataFrame:
    return ranked_widely(frequency, [F.desc("occurrences"), F.desc("papers"), F.asc("canonical_question_id")])


def most_repeated(ranking: DataFrame) -> DataFrame:
    """Ranks stay those of the whole list."""
    return ranking.where(F.col("occurrences") > 1)


def orphans(questions: DataFrame, links: DataFrame) -> DataFrame:
    return questions.join(links, "question_id", "left_anti").select("question_id")


def duplicate_links(links: DataFrame) -> DataFrame:
    """Questions in more than one group."""
    counts = links.groupBy("question_id").agg(F.countDistinct("canonical_question_id").alias("groups"))
    return counts.where(F.col("groups") > 1)


def data_integrity(questions: DataFrame, canonicals: DataFrame, links: DataFrame) -> DataFrame:
    """One row: raw, linked and canonical counts, orphans, duplicates, and whether all agree."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        one(questions, "raw_occurrences"),
        one(links, "linked_occurrences"),
        canonicals.agg(F.countDistinct("canonical_question_id").alias("canonicals")),
        one(orphans(questions, links), "orphaned"),
        one(duplicate_links(links), "duplicated"),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)
    good = (F.col("raw_occurrences") == F.col("linked_occurrences")) & (F.col("orphaned") == 0) & (F.col("duplicated") == 0)
    return row.withColumn("reconciled", good)
