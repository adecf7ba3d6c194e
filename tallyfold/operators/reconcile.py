"""Reconciling recorded model answers with what was asked, and extracted questions with their evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_text, leading_number, strip

PREFIX, LEAST = 30, 12
#: Fixed values.
STEM = r"(?s)STEM:\s*(.*?)(?=\nOPTION:|\z)"
PRINTED_NUMBER = r"(?U)^(\d{1,3}[a-zA-Z]?)[.\):]?\z"


def reconcile_topics(asked: DataFrame, topics: DataFrame, verdicts: DataFrame) -> DataFrame:
    """question_id, status, topic_id, confidence of every asked question.

    The last verdict counts. A missing one, or one for a topic that isn't in the
    list, is unclassified with confidence 0; verdicts for other questions go.
    """
    last = verdicts.groupBy("question_id").agg(F.max(F.struct("seq", "status", "topic_id", "confidence")).alias("v"))
    known = topics.select(F.col("topic_id").alias("known_topic")).distinct()
    joined = asked.select("question_id").join(last, "question_id", "left").join(known, F.col("v.topic_id") == F.col("known_topic"), "left")
    good = F.col("v.status").isNotNull() & ((F.col("v.status") != "classified") | F.col("known_topic").isNotNull())
    classified = good & (F.col("v.status") == "classified")
    return joined.select(
        "question_id",
        F.when(good, F.col("v.status")).otherwise("unclassified").alias("status"),
        F.when(classified, F.col("known_topic")).alias("topic_id"),
        F.when(good, F.col("v.confidence")).otherwise(F.lit(0.0)).alias("confidence"),
    )


def apply_classifications(questions: DataFrame, classified: DataFrame, topics: DataFrame) -> DataFrame:
    """``questions`` with topic columns of ``classified``; unknown ids do nothing, unclassified ones have no confidence."""
    names = topics.select("topic_id", "topic_name")
    new = classified.join(names, "topic_id", "left").select(
        "question_id",
        F.col("status").alias("s"),
        F.col("topic_id").alias("t"),
        F.col("topic_name").alias("n"),
        F.when(F.col("status") != "unclassified", F.col("confidence")).alias("c"),
    )
    has = F.col("s").isNotNull()
    pick = {"classification_status": "s", "topic_id": "t", "topic_name": "n", "topic_confidence": "c"}
    joined = questions.join(new, "question_id", "left")
    return joined.withColumns({old: F.when(has, F.col(c)).otherwise(F.col(old)) for old, c in pick.items()}).drop(*pick.values())


def evidence_candidates(blocks: DataFrame) -> DataFrame:
    """paper_id, pos, number, snippet, options of the option groups, list items and texts that may hold a question's stem."""
    marker = F.coalesce("marker", F.lit(""))
    stem = strip(F.regexp_extract("text", STEM, 1))
    group = F.col("block_type") == "mcq_group"
    source = F.when(group & F.col("text").rlike(STEM), stem).otherwise(F.col("text"))
    number, rest = leading_number(source)
    printed = F.nullif(F.regexp_extract(strip(marker), PRINTED_NUMBER, 1), F.lit(""))
    found = F.when(group, number).when(marker != "", printed).otherwise(number)
    body = F.when(~group & (marker != ""), F.col("text")).when(number.isNotNull(), rest).otherwise(source)
    options = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^OPTION:\s*(.*)$"), F.lit(1)), strip), lambda o: o != "")
    rows = blocks.where(F.col("block_type").isin("mcq_group", "list_item", "text"))
    rows = rows.select("paper_id", "pos", found.alias("number"), alnum_text(body).alias("snippet"), F.when(group, options).otherwise(F.array().cast("array<string>")).alias("options"), group.alias("grouped"))
    return rows.where((F.col("grouped") | F.col("number").isNotNull()) & (F.length("snippet") >= LEAST)).drop("grouped")


def _backfill(key: tuple, questions: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """Greedy in question order; an index by the shortest comparable start keeps it from comparing everything."""
    rows = candidates.sort_values("pos")
    free: dict[str, list[int]] = {}
    for i, snippet in zip(rows.index, rows["snippet"]):
        free.setdefault(snippet[:LEAST], []).append(i)
    out = []
    for q in questions.sort_values("pos").itertuples():
        number, options = q.question_number, list(q.options) if q.options is not None else []
        no_number, no_options = number is None, q.question_type == "mcq" and not options
        near = []
        # A question that misses nothing leaves the blocks to the others.
        for i in free.get(q.snippet[:LEAST], []) if (no_number or no_options) and len(q.snippet) >= LEAST else []:
            other = rows.at[i, "snippet"]
            n = min(len(other), len(q.snippet), PREFIX)
            if other[:n] == q.snippet[:n]:
                near.append(i)
        if len(near) == 1:
            free[q.snippet[:LEAST]].remove(near[0])
            number = rows.at[near[0], "number"] if no_number else number
            options = list(rows.at[near[0], "options"]) if no_options else options
        out.append((q.paper_id, q.pos, number, q.question_text, options))
    return pd.DataFrame(out, columns=["paper_id", "pos", "question_number", "question_text", "options"])


def backfill_questions(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Extracted questions with the number and, of type mcq, the options that they miss, from the one unused block whose start agrees.

    Greedy and stateful within a paper, so each paper is one group; papers are
    bounded by the list caps of the record model.
    """
    schema = "paper_id string, pos long, question_number string, question_text string, options array<string>"
    left = questions.withColumn("snippet", alnum_text(F.col("question_text"))).groupBy("paper_id")
    return left.cogroup(evidence_candidates(blocks).groupBy("paper_id")).applyInPandas(_backfill, schema)


def recovered_names(topics: DataFrame, answers: DataFrame) -> DataFrame:
    """Unresolved topics with recovered names: resolved takes the name, ambiguous and not_found only change the state."""
    new = answers.groupBy("id").agg(F.max(F.struct("seq", "status", "recovered")).alias("a"))
    state = F.when(F.col("a.status") == "resolved", "resolved").when(F.col("a.status") == "ambiguous", "ambiguous").when(F.col("a.status") == "not_found", "unidentified")
    open_ = F.col("resolution_status") != "resolved"
    joined = topics.join(new, "id", "left")
    return joined.withColumns(
        {
            "name": F.when(open_ & (F.col("a.status") == "resolved"), F.col("a.recovered")).otherwise(F.col("name")),
            "resolution_status": F.when(open_, F.coalesce(state, "resolution_status")).otherwise(F.col("resolution_status")),
        }
    ).drop("a")
