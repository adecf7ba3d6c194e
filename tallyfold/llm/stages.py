"""Operators as pipeline stages: each takes and returns the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .contamination import find_contamination
from .jaccard_join import shingle_components
from .line_runs import dedup_lines
from .queries import table, tokenizer_path, toxicity_held_out
from .toxicity import THRESHOLD, score_toxicity, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score reaches the threshold."""
    model = train_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~toxicity_held_out())
    scored = score_toxicity(docs, model)
    return scored.where(F.col("score") < THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the lines that an earlier one owns taken out of text, and n_chars to match."""
    out = dedup_lines(docs).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; rows of a null doc_id stay."""
    groups = shingle_components(docs.select("doc_id", "text"), count_links=False)
    others = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth or more are benchmark passages."""
    marked = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(~F.col("contaminated")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with hashes of the ids and of the text they decode to."""
    coded = encode_documents(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), keep_text=False)
    return coded.select(
        "doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
