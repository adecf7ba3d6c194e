"""The record model over the test tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QUESTION_TYPES

TYPES = [k for k, _ in QUESTION_TYPES]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def question_id() -> Column:
    return F.concat(F.lit("q"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("question_id")


def questions(spark: SparkSession, sf_dir: str, sent: Callable[[DataFrame], DataFrame] = lambda labels: labels) -> DataFrame:
    """Documents as questions: the source is the paper, the language the topic. ``sent`` may have the labels sent to the texts."""
    docs, labels = table(spark, sf_dir, "documents"), sent(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality", "toxic"))
    status = (
        F.when(F.col("l_id").isNull(), "unclassified").when(F.col("toxic") == 1, "ambiguous").when(F.col("quality") == 1, "classified").otherwise("no_match")
    )
    kinds = F.array(*[F.lit(k) for k in TYPES])
    return docs.join(labels, F.col("doc_id") == F.col("l_id"), "left").select(
        question_id(),
        "doc_id",
        F.col("source").alias("paper_id"),
        F.col("lang").alias("topic_id"),
        F.nullif(F.regexp_extract("text", "(?:19|20)[0-9]{2}", 0), F.lit("")).alias("paper_year"),
        F.get(kinds, (F.col("doc_id") % 7).cast("int")).alias("question_type"),
        status.alias("classification_status"),
        ((F.col("n_chars") % 100) / 100.0).alias("extraction_confidence"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("ambiguous"),
        F.col("text").alias("question_text"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents; every 97th has none, every 101st a second one."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    qid = question_id()
    some = docs.where(F.col("doc_id") % 97 != 0).select(qid, F.concat(F.lit("c"), (F.col("doc_id") % 311).cast("string")).alias("canonical_question_id"))
    return some.union(docs.where(F.col("doc_id") % 101 == 0).select(qid, F.lit("c_extra").alias("canonical_question_id")))


_CASES = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(TYPES))
Q = f"""q AS (
  SELECT 'q' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS question_id, d.doc_id AS doc_id, d.source AS paper_id, d.lang AS topic_id,
         nullif(regexp_extract(d.text, '(?:19|20)[0-9]{{2}}'), '') AS paper_year, CASE d.doc_id % 7 {_CASES} END AS question_type,
         CASE WHEN l.doc_id IS NULL THEN 'unclassified' WHEN l.toxic = 1 THEN 'ambiguous' WHEN l.quality = 1 THEN 'classified' ELSE 'no_match' END AS classification_status,
         CAST(d.n_chars % 100 AS DOUBLE) / 100.0 AS extraction_confidence, coalesce(l.toxic, 0) = 1 AS ambiguous, d.text AS question_text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
LINKS = """lk AS (
  SELECT 'q' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS question_id, 'c' || CAST(doc_id % 311 AS VARCHAR) AS canonical_question_id
  FROM documents WHERE doc_id % 97 <> 0
  UNION ALL SELECT 'q' || lpad(CAST(doc_id AS VARCHAR), 8, '0'), 'c_extra' FROM documents WHERE doc_id % 101 = 0),
ll AS (SELECT question_id, max(canonical_question_id) AS canonical_question_id FROM lk GROUP BY question_id)"""
KINDS = "kinds AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i})" for i, k in enumerate(TYPES)) + ") AS t(question_type, ord))"


def orders_by_nation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics (nations and, without questions of their own, regions), questions (orders), links (to customers)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    topics = nation.select(F.col("n_nationkey").alias("topic_id"), F.col("n_name").alias("topic_name")).union(
        region.select((1000 + F.col("r_regionkey")).alias("topic_id"), "r_name")
    )
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    kinds = F.array(*[F.lit(k) for k in TYPES])
    asked = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("question_id"),
        F.col("o_custkey").alias("canonical_question_id"),
        F.col("c_nationkey").alias("topic_id"),
        F.col("o_orderpriority").alias("paper_id"),
        F.get(kinds, (F.col("o_orderkey") % 7).cast("int")).alias("question_type"),
    )
    return topics, asked.drop("canonical_question_id"), asked.select("question_id", "canonical_question_id")


OCC = f"""occ AS (
  SELECT o.o_orderkey AS question_id, o.o_custkey AS canonical_question_id, c.c_nationkey AS topic_id, o.o_orderpriority AS paper_id,
         CASE o.o_orderkey % 7 {_CASES} END AS question_type
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
topics AS (SELECT n_nationkey AS topic_id, n_name AS topic_name FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name FROM region)"""


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations below them, market segments below those, in preorder."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    r = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_id"), (F.col("r_regionkey") * 1000000).cast("long").alias("ord"))
    n = nation.select(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.lit(2), F.concat(F.lit("r"), "n_regionkey"), (F.col("n_regionkey") * 1000000 + (F.col("n_nationkey") + 1) * 100).cast("long"))
    segments = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_nationkey", "n_regionkey", "c_mktsegment").agg(F.lit(1))
    s = segments.select(
        F.concat(F.lit("s"), "c_nationkey", F.lit("_"), "c_mktsegment"), "c_mktsegment", F.lit(3), F.concat(F.lit("n"), "c_nationkey"),
        (F.col("n_regionkey") * 1000000 + (F.col("c_nationkey") + 1) * 100 + F.ascii("c_mktsegment") - 64).cast("long"),
    )
    return r.union(n).union(s)


FOREST = """forest AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, 1 AS level, CAST(NULL AS VARCHAR) AS parent_id, r_regionkey * 1000000 AS ord FROM region
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), n_name, 2, 'r' || CAST(n_regionkey AS VARCHAR), n_regionkey * 1000000 + (n_nationkey + 1) * 100 FROM nation
  UNION ALL SELECT DISTINCT 's' || CAST(c_nationkey AS VARCHAR) || '_' || c_mktsegment, c_mktsegment, 3, 'n' || CAST(c_nationkey AS VARCHAR),
    n_regionkey * 1000000 + (c_nationkey + 1) * 100 + ascii(c_mktsegment) - 64 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as ordered blocks, four to a page, of types and markers by their number."""
    t = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 7 + F.col("turn") * 3
    kinds = ["text", "list_item", "title", "text", "page_header", "list_item", "table"]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (n % 7).cast("int"))
    marker = F.when(n % 5 == 0, F.lit("A.")).when(n % 5 == 1, F.lit("(b)")).when(n % 5 == 2, (F.col("turn") % 4 + 1).cast("string"))
    return t.select(
        F.col("conv_id").cast("string").alias("file_id"), F.col("turn").alias("pos"), F.array((F.floor(F.col("turn") / 4) + 1).cast("int")).alias("page_numbers"),
        kind.alias("block_type"), F.coalesce("text", F.lit("")).alias("text"), marker.alias("marker"),
    )


BLOCKS = """blocks AS (
  SELECT CAST(conv_id AS VARCHAR) AS file_id, turn AS pos, turn // 4 + 1 AS page,
         CASE (conv_id * 7 + turn * 3) % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'list_item' WHEN 2 THEN 'title' WHEN 3 THEN 'text' WHEN 4 THEN 'page_header' WHEN 5 THEN 'list_item' ELSE 'table' END AS block_type,
         coalesce(text, '') AS text,
         CASE (conv_id * 7 + turn * 3) % 5 WHEN 0 THEN 'A.' WHEN 1 THEN '(b)' WHEN 2 THEN CAST(turn % 4 + 1 AS VARCHAR) END AS marker
  FROM conversations)"""
