"""Listings and counts over the stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import best_of, field_conflict, filename_metadata
from ..schemas import STATUSES
from .intervals import points_in_spans

#: Pages around the expected one that are searched for a topic's heading: so many before and after.
CANDIDATE_BEFORE, CANDIDATE_AFTER = 1, 2
FIELDS = ["exam_name", "institution", "subject", "date", "year", "paper_identifier"]


def blocks_of_papers(blocks: DataFrame, papers: DataFrame) -> DataFrame:
    """Blocks with the paper_id of the paper (file_id, start_page, end_page) that has one of their pages; of two papers both."""
    spans = papers.select("file_id", "paper_id", "start_page", "end_page")
    return points_in_spans(blocks, F.col("page_numbers"), spans, "file_id", "start_page", "end_page").select("paper_id", *blocks.columns)


def candidate_blocks(topics: DataFrame, blocks: DataFrame, offset: DataFrame) -> DataFrame:
    """Blocks near the page on which a topic (id, file_id, declared_page_number) should begin; none without an offset."""
    expected = topics.where(F.col("declared_page_number").isNotNull()).join(offset.select("file_id", "offset"), "file_id")
    page = F.col("declared_page_number") + F.col("offset")
    near = expected.select("file_id", F.col("id").alias("topic_id"), (page - CANDIDATE_BEFORE).alias("low"), (page + CANDIDATE_AFTER).alias("high"))
    return points_in_spans(blocks, F.col("page_numbers"), near, "file_id", "low", "high").select("topic_id", *blocks.columns)


def section_id(ids: Column, index: Column) -> Column:
    """The id at a 0-based index; null for none or one outside."""
    return F.when(index >= 0, F.get(ids, index))


def merged_metadata(structure: DataFrame, filename: str = "filename") -> DataFrame:
    """``structure`` with metadata: each field's document value, evidence, pages and confidence beside the file name's value, and whether they conflict.

    Only date and year have a file name's value (its first candidate); neither side wins.
    """
    named = filename_metadata(F.col(filename))
    of_name = {"date": F.get(named["dates"], F.lit(0)), "year": F.get(named["years"], F.lit(0))}
    merged = []
    for field in FIELDS:
        given, other = F.col(field), of_name.get(field, F.lit(None).cast("string"))
        conflict = field_conflict(F.trim(given["value"]), other) if field in of_name else F.lit(False)
        merged.append(
            F.struct(
                F.nullif(given["value"], F.lit("")).alias("document_value"), given["evidence"].alias("document_evidence"), given["source_pages"].alias("document_source_pages"),
                given["confidence"].alias("document_confidence"), other.alias("filename_value"), conflict.alias("conflict"),
            ).alias(field)
        )
    return structure.withColumn("metadata", F.struct(*merged, named["tokens"].alias("filename_tokens")))


def best_value(field: Column) -> tuple[Column, Column]:
    """The document's value or else the file name's, and which of them it is."""
    given = F.coalesce(F.nullif(field["document_value"], F.lit("")).isNotNull(), F.lit(False))
    value = best_of(field["document_value"], field["filename_value"])
    return value, F.when(given, "document").when(value.isNotNull(), "filename")


def classification_counts(questions: DataFrame, keys: list[str]) -> DataFrame:
    """Questions of each key, in all and in every state."""
    state = F.coalesce(F.nullif("classification_status", F.lit("")), F.lit("unclassified"))
    return questions.groupBy(*keys).agg(F.count("*").alias("questions"), *[F.count_if(state == s).alias(s) for s in STATUSES])


def type_counts_of_papers(questions: DataFrame) -> DataFrame:
    return questions.groupBy("paper_id", "question_type").agg(F.count("*").alias("n"))


def classification_totals(questions: DataFrame, papers: DataFrame, files: DataFrame) -> DataFrame:
    """Per file that was read in whole or part: its papers, questions and states; other files are left out."""
    usable = files.where(F.col("status").isin("success", "partial")).select("file_id")
    owned = papers.select("paper_id", "file_id").join(usable, "file_id", "left_semi")
    papers_of = owned.groupBy("file_id").agg(F.countDistinct("paper_id").alias("papers"))
    counts = classification_counts(questions.join(owned, "paper_id"), ["file_id"])
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ["papers", "questions", *STATUSES]}
    return usable.join(papers_of, "file_id", "left").join(counts, "file_id", "left").withColumns(zeros)


def dedup_statistics(decisions: DataFrame, canonicals: DataFrame) -> DataFrame:
    """kind, name, n: pair decisions by source and verdict, canonical records by state, and those with several members."""
    pairs = decisions.groupBy(F.lit("pairs").alias("kind"), F.concat_ws(":", "decision_source", "verdict").alias("name")).agg(F.count("*").alias("n"))
    # Both counts of a record in one pass over the records; where there are none, none is repeated.
    state = F.struct(F.lit("canonicals").alias("kind"), F.col("dedup_status").alias("name"), F.lit(1).alias("n"))
    repeated = F.struct(F.lit("groups").alias("kind"), F.lit("repeated").alias("name"), (F.col("members") > 1).cast("int").alias("n"))
    none = decisions.sparkSession.createDataFrame([("groups", "repeated", 0)], "kind string, name string, n int")
    records = canonicals.select(F.explode(F.array(state, repeated)).alias("r")).select("r.*").unionByName(none)
    return pairs.unionByName(records.groupBy("kind", "name").agg(F.sum("n").alias("n")))


def pair_decisions(decisions: DataFrame, verdict: str | None = None) -> DataFrame:
    """Pair decisions by both ids, all or those of one verdict."""
    kept = decisions.where(F.col("verdict") == verdict) if verdict else decisions
    return kept.orderBy("a", "b")


def canonical_list(canonicals: DataFrame) -> DataFrame:
    return canonicals.orderBy("canonical_question_id")


def canonical_detail(canonicals: DataFrame, links: DataFrame, questions: DataFrame, canonical_id: str) -> DataFrame:
    """One canonical record with its questions."""
    one = canonicals.where(F.col("canonical_question_id") == canonical_id)
    return one.join(links, "canonical_question_id").join(questions, "question_id").orderBy("question_id")


def leading_topics(ranking: DataFrame, most: int = 5) -> DataFrame:
    """The first ranks, as a summary prints them."""
    return ranking.orderBy("rnk").limit(most)


def all_papers(papers: DataFrame) -> DataFrame:
    return papers.orderBy("paper_id")


def papers_of_file(papers: DataFrame, file_id: str) -> DataFrame:
    return papers.where(F.col("file_id") == file_id).orderBy("start_page")


def paper(papers: DataFrame, paper_id: str) -> DataFrame:
    return papers.where(F.col("paper_id") == paper_id)


def questions_of_paper(questions: DataFrame, paper_id: str) -> DataFrame:
    return questions.where(F.col("paper_id") == paper_id).orderBy("question_id")


def decoded_questions(rows: DataFrame) -> DataFrame:
    """Stored rows with lists from JSON, flags from numbers, and unclassified where no state is given."""
    return rows.withColumns(
        {
            "options": F.coalesce(F.from_json("options", "array<string>"), F.array().cast("array<string>")),
            "source_pages": F.coalesce(F.from_json("source_pages", "array<int>"), F.array().cast("array<int>")),
            "ambiguous": F.coalesce(F.col("ambiguous").cast("int"), F.lit(0)) != 0,
            "correction_applied": F.coalesce(F.col("correction_applied").cast("int"), F.lit(0)) != 0,
            "classification_status": F.coalesce(F.nullif("classification_status", F.lit("")), F.lit("unclassified")),
        }
    )
