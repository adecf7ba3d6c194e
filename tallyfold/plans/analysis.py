"""The record model end to end: topics, deduplication, frequencies, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import exact_key
from ..operators import dedup, frequency, report, topics
from ..sources import files

EMPTY_DECISIONS = "a string, b string, decision_source string, verdict string, confidence double"
NOTES = [
    "Counts are of occurrences that were extracted; a missed question is not counted.",
    "Years are labels as printed; those that don't begin with four digits have no place in time.",
]


def load_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topics of an outline or JSON file, by its ending."""
    kind = files.source_kind(path)
    if kind == "outline":
        return topics.outline_topics(files.outline_lines(spark, path))
    if kind == "json":
        texts = files.json_texts(spark, path)
        # A flat list has a level in every entry.
        levels = F.from_json("json", "array<map<string,string>>")
        flat = texts.where(F.forall(levels, lambda m: m["level"].isNotNull()))
        nested = texts.where(~F.coalesce(F.forall(levels, lambda m: m["level"].isNotNull()), F.lit(False)))
        return topics.flat_json_topics(flat).unionByName(topics.nested_json_topics(nested))
    raise ValueError("paged topic sources need a provider; see tallyfold.providers")


def deduplicate(questions: DataFrame, judged: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical records and links from exact groups and recorded verdicts; see ``exact_and_judged`` for their union."""
    return dedup.assemble_canonicals(questions, exact_and_judged(questions, judged))


def exact_and_judged(questions: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Decisions of exact groups (each later member with the first) and recorded ones."""
    spark = questions.sparkSession
    keyed = questions.select("question_id", exact_key(F.col("question_type"), F.col("question_text"), F.col("options")).alias("exact_key"))
    exact = dedup.exact_duplicate_links(keyed).select("a", "b", F.lit(dedup.EXACT).alias("decision_source"), F.lit("same_question").alias("verdict"), F.lit(1.0).alias("confidence"))
    judged = judged if judged is not None else spark.createDataFrame([], EMPTY_DECISIONS)
    return exact.unionByName(judged.select(*exact.columns))


def paper_flags(questions: DataFrame, papers: DataFrame | None) -> DataFrame:
    """paper_id, year_conflict: whether a paper's own year contradicts its file name's, from its metadata; false where none is known."""
    own = questions.select("paper_id").distinct()
    if papers is None:
        return own.withColumn("year_conflict", F.lit(False))
    known = papers.select("paper_id", F.coalesce("metadata.year.conflict", F.lit(False)).alias("year_conflict"))
    return own.join(known, "paper_id", "full").select("paper_id", F.coalesce("year_conflict", F.lit(False)).alias("year_conflict"))


def analyze(topic_list: DataFrame, questions: DataFrame, canonicals: DataFrame, links: DataFrame, papers: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table of the frequency analysis and the report by name; ``papers`` (paper_id, metadata) say where years contradict."""
    named = topic_list.select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name"), "parent_id")
    summary = frequency.topic_summary(named, questions, links)
    ranking = frequency.rank_canonicals(frequency.canonical_frequency(canonicals.select("canonical_question_id"), links, questions))
    tree = summary.select(F.col("topic_id").alias("id"), "parent_id", "total_occurrences")
    flags = paper_flags(questions, papers)
    return {
        "summary": report.executive_summary(flags, questions, canonicals, summary),
        "topics": frequency.rank_topics(summary),
        "topics_by_unique": frequency.rank_topics_by_unique(summary),
        "tree": topics.tested_topics(tree),
        "types": frequency.type_shares(questions),
        "repetition": frequency.repetition_by_type(questions, links),
        "repeated": frequency.most_repeated(ranking),
        "years": frequency.years_represented(questions),
        "integrity": frequency.data_integrity(questions, canonicals, links),
        "quality": report.data_quality(questions, flags),
        "unclassified": report.unclassified_report(questions).select("question_id", "paper_id", "question_type"),
    }
