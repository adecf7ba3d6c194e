"""Texts that are shown to a provider, one per list, question, pair or paper."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from .topics import tree_paths

#: Fixed values.
TOPIC_LIST_CHARS = 20_000
TOPICS_CUT = "\n...[topic list truncated]..."
BETWEEN_PAIRS = "\n\n---\n\n"
NO_SECTIONS = "(no sections were detected for this paper)"


def _lines(rows: DataFrame, key: str, order: str, line: Column, between: str = "\n") -> DataFrame:
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x: x["t"]), between).alias("text"))


def topic_lists(topics: DataFrame) -> DataFrame:
    """forest and its topics as an indented tree, depth first in list order, cut with a note at TOPIC_LIST_CHARS."""
    placed = tree_paths(topics).join(topics.select("id", "forest"), "id")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- ["), "id", F.lit("] "), "name")
    text = F.col("text")
    cut = F.when(F.length(text) > TOPIC_LIST_CHARS, F.concat(F.substring(text, 1, TOPIC_LIST_CHARS), F.lit(TOPICS_CUT))).otherwise(text)
    return _lines(placed, "forest", "path", line).withColumn("text", cut)


def lettered(options: Column) -> Column:
    """Options as lines '  A. ...'; nothing without options."""
    return F.array_join(F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o, i: F.concat(F.lit("\n  "), F.char(F.lit(65) + i), F.lit(". "), o)), "")


def question_text(with_topic: bool = True) -> Column:
    """One question: type, topic if known, text, options."""
    topic = F.when(F.coalesce("topic_name", F.lit("")) != "", F.concat(F.lit("\ntopic="), "topic_name")).otherwise("") if with_topic else F.lit("")
    return F.concat(F.lit("type="), "question_type", topic, F.lit("\ntext: "), "question_text", lettered(F.col("options")))


def question_lists(questions: DataFrame, key: str = "paper_id") -> DataFrame:
    """``key`` and its questions: a head with id, type and number, the text, the options."""
    number = F.when(F.coalesce("question_number", F.lit("")) != "", F.concat(F.lit(" #"), "question_number")).otherwise("")
    line = F.concat(F.lit("["), "question_id", F.lit("] ("), "question_type", F.lit(")"), number, F.lit("\n"), "question_text", lettered(F.col("options")), F.lit("\n"))
    return _lines(questions, key, "question_id", line)


def pair_rows(pairs: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """Rows (key, a, b, told): every text of ``told`` (question_id, told) once for each key whose ``pairs`` name it, without b, and the pairs themselves."""
    uses = pairs.select(key, F.explode(F.array("a", "b")).alias("question_id")).distinct()
    texts = told.where("told IS NOT NULL").join(uses, "question_id").select(key, F.col("question_id").alias("a"), F.lit(None).cast("string").alias("b"), "told")
    return texts.unionByName(pairs.select(key, "a", "b", F.lit(None).cast("string").alias("told")))


def pair_order(key: str) -> list[Column]:
    """The order in which ``pair_texts`` takes the rows of ``pair_rows``: by key, texts before pairs."""
    return [F.col(key), F.col("b").isNotNull(), F.col("a"), F.col("b"), F.col("told")]


def pair_texts(rows: Iterator[pa.RecordBatch], most: int | None = None, head: str = "") -> Iterator[tuple[object, list[tuple[str, str]], str]]:
    """Key, pairs and text of up to ``most`` pairs (or of all of a key) of rows as ``pair_order`` sorts them: both questions below their pair's id.

    It holds the texts of one key and those of one list. A list may go on in the next
    key, and then counts to that; a pair without both texts is left out.
    """
    now, held, pairs, pieces = None, {}, [], [head]
    for batch in rows:
        for key, a, b, told in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if pairs and most is None:
                    yield now, pairs, "".join(pieces)
                    pairs, pieces = [], [head]
                now, held = key, {}
            if b is None:
                held.setdefault(a, told)
            elif a in held and b in held:
                between = BETWEEN_PAIRS if pairs else ""
                pieces += (f"{between}[{a}::{b}]\nQuestion A ({a}):\n", held[a], f"\n\nQuestion B ({b}):\n", held[b])
                pairs.append((a, b))
                if len(pairs) == most:
                    yield now, pairs, "".join(pieces)
                    pairs, pieces = [], [head]
    if pairs:
        yield now, pairs, "".join(pieces)


def pair_lists(pairs: DataFrame, questions: DataFrame, key: str = "batch") -> DataFrame:
    """``key`` and its pairs (a, b): both questions below their pair's id. A text is sent once to each key that shows it, not once for each of its pairs."""
    rows = pair_rows(pairs, questions.select("question_id", question_text().alias("told")), key)
    schema = StructType([pairs.schema[key], StructField("text", StringType())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, _, text in pair_texts(batches):
            yield pa.RecordBatch.from_pylist([{key: k, "text": text}], schema=to_arrow_schema(schema))

    return rows.repartition(key).sortWithinPartitions(*pair_order(key)).mapInArrow(listed, schema)


def section_list(sections: Column) -> Column:
    """Sections (array of raw_label, section_type, start_page, end_page) with their numbers."""
    label = lambda s: F.coalesce(F.nullif(s["raw_label"], F.lit("")), s["section_type"])
    line = lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), label(s), F.lit(" (pages "), s["start_page"].cast("string"), F.lit("-"), s["end_page"].cast("string"), F.lit(")"))
    return F.when(F.coalesce(F.size(sections), F.lit(0)) > 0, F.array_join(F.transform(sections, line), "\n")).otherwise(NO_SECTIONS)
