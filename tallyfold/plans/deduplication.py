"""Deduplication end to end: exact classes, vectors of their representatives, candidate pairs, judgement, union.

Two stores carry over from run to run: vectors by id, model and hash of the text, and
decisions on pairs by model and both hashes. A text that changes drops out of both
by its hash; everything else is neither embedded nor judged again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import embedding_text, exact_key
from ..operators import dedup, listings
from ..providers import Provider, embed_new
from ..scratch import Scratch, exists
from . import stages

VECTORS = "id string, content_hash string, model string, vector array<double>"
DECISIONS = "a string, b string, model_used string, hash_a string, hash_b string, decision_source string, verdict string, confidence double"
JUDGE = "llm_judge"
EDGES = ["a", "b", "decision_source", "verdict", "confidence"]


class GrowingTable:
    """An append-only table of one schema; empty until something is appended."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        if exists(self.spark, self.path):
            return self.spark.read.schema(self.schema).parquet(self.path)
        return self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        names = [c.split()[0] for c in self.schema.split(", ")]
        rows.select(*names).write.mode("append").parquet(self.path)


@dataclass
class Deduplicated:
    canonicals: DataFrame
    links: DataFrame
    decisions: DataFrame
    statistics: DataFrame


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the smallest by ``order``: a minimum of structs, so that it is taken before the shuffle too."""
    rest = [c for c in rows.columns if c not in {*keys, *order}]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("v"))
    return best.select(*keys, *[F.col(f"v.{c}").alias(c) for c in [*order, *rest]])


def united(exact: DataFrame, cached: DataFrame, new: DataFrame) -> DataFrame:
    """Decisions of three sources, each with a row a pair, as one a pair: an exact one before a cached one before a new one."""
    out = exact.select(*EDGES)
    for later in (cached, new):
        if later.limit(1).count():
            out = out.unionByName(later.select(*EDGES).join(dedup.small_side(out.select("a", "b")), ["a", "b"], "left_anti"))
    return out


def still_valid(decisions: DataFrame, hashes: DataFrame) -> DataFrame:
    """``decisions`` whose two texts are as they were (id, content_hash). Texts that changed are found first, as they are fewer than the decisions."""
    ends = [F.struct(F.col(e).alias("id"), F.col(f"hash_{e}").alias("content_hash")) for e in "ab"]
    gone = decisions.select(F.explode(F.array(*ends)).alias("end")).select("end.*").distinct().join(hashes, ["id", "content_hash"], "left_anti")
    gone = Scratch(decisions.sparkSession, "gone").keep(gone, "gone")
    if not gone.limit(1).count():
        return decisions
    gone = dedup.small_side(gone)
    for e in "ab":
        decisions = decisions.join(gone.select(F.col("id").alias(e), F.col("content_hash").alias(f"hash_{e}")), [e, f"hash_{e}"], "left_anti")
    return decisions


def run_deduplication(
    questions: DataFrame,
    folder: str,
    judge: Provider,
    load: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None,
    model: str = "",
    same_type: float = dedup.SAME_TYPE,
    cross_type: float = dedup.CROSS_TYPE,
) -> Deduplicated:
    """Canonical records of ``questions``, with stores in ``folder``.

    ``load`` gives the embedder named ``model``; without one only stored vectors are
    used. ``judge`` may be a recorded provider, so that a run that stops amid the
    judgement goes on there. Rows without text are classes of their own and have no
    candidates. Of candidates that lost their place (a text changed) old decisions
    stay in the store, unused.
    """
    spark = questions.sparkSession
    scratch = Scratch(spark, "dedup")
    vectors, decisions = GrowingTable(spark, f"{folder}/vectors", VECTORS), GrowingTable(spark, f"{folder}/decisions", DECISIONS)
    key = exact_key(F.col("question_type"), F.col("question_text"), F.col("options"))
    text = embedding_text(F.col("question_type"), F.col("question_text"), F.coalesce("options", F.array().cast("array<string>")))
    # One pass over the texts; what follows needs their hashes and lengths alone.
    about = dedup.lean(questions).columns[1:]
    keyed = questions.withColumn("text_length", F.length("question_text")).select(
        "question_id", *about, F.col("question_type").alias("kind"), F.sha2(key, 256).alias("exact_key"), F.sha2(text, 256).alias("content_hash")
    )
    keyed = scratch.keep(keyed, "keyed")
    exact = dedup.exact_duplicate_links(keyed).select("a", "b", F.lit(dedup.EXACT).alias("decision_source"), F.lit("same_question").alias("verdict"), F.lit(1.0).alias("confidence"))
    exact = scratch.keep(exact.distinct(), "exact")
    classes = keyed.withColumn("class", F.coalesce("exact_key", F.concat(F.lit("id:"), "question_id")))
    chosen = dedup.representatives(classes, "class").select(F.col("representative_question_id").alias("question_id"))
    wanted = keyed.where("text_length IS NOT NULL").join(chosen, "question_id", "left_semi")
    wanted = scratch.keep(wanted.select(F.col("question_id").alias("id"), "kind", "content_hash"), "wanted")

    if load is not None:
        texts = questions.select(F.col("question_id").alias("id"), text.alias("text"))
        missing = wanted.join(vectors.read().where(F.col("model") == model), ["id", "content_hash"], "left_anti")
        missing = scratch.keep(missing.select("id", "content_hash"), "missing")
        vectors.append(embed_new(dedup.only_rows_of(texts, missing, "id").join(missing, "id"), vectors.read(), load, model))
    held = vectors.read().where(F.col("model") == model).select("id", "content_hash", "vector")
    # Written once: the search for pairs reads it several times.
    placed = scratch.keep(wanted.join(first_of(held, ["id", "content_hash"], ["vector"]), ["id", "content_hash"]), "placed")
    found = dedup.cosine_candidates(placed.select("id", "kind", "vector"), same_type, cross_type).select("a", "b").distinct()
    # Pairs are many, so they go without the hashes of their texts: these stand in the store of decisions alone.
    hashes = placed.select("id", "content_hash").distinct()
    held = decisions.read().where(F.col("model_used") == judge.name)
    if held.limit(1).count():
        known = first_of(still_valid(held, hashes).select(*EDGES), ["a", "b"], ["decision_source", "verdict", "confidence"])
        met = scratch.keep(found.join(known, ["a", "b"], "left"), "met")
        cached, todo = met.where("verdict IS NOT NULL"), met.where("verdict IS NULL").select("a", "b")
    else:
        cached, todo = spark.createDataFrame([], DECISIONS), scratch.keep(found, "todo")
    if todo.limit(1).count():
        new = stages.judged_pairs(todo, questions, judge).select("a", "b", F.lit(JUDGE).alias("decision_source"), "verdict", "confidence")
        texts = dedup.small_side(hashes)
        ends = [texts.select(F.col("id").alias(e), F.col("content_hash").alias(f"hash_{e}")) for e in "ab"]
        decisions.append(new.withColumn("model_used", F.lit(judge.name)).join(ends[0], "a").join(ends[1], "b"))
    else:
        new = spark.createDataFrame([], DECISIONS)

    union = scratch.keep(united(exact, cached, new), "union")
    canonicals, links = dedup.assemble_canonicals(questions, union, written=True)
    return Deduplicated(canonicals, links, union, run_statistics(keyed, cached, new, union, canonicals))


def run_statistics(keyed: DataFrame, cached: DataFrame, new: DataFrame, union: DataFrame, canonicals: DataFrame) -> DataFrame:
    """kind, name, n: decisions and records as listed elsewhere, exact groups and the pairs they stand for, and where the judged pairs came from."""
    groups = dedup.exact_groups(keyed.select("question_id", "exact_key")).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("members") * (F.col("members") - 1) / 2), F.lit(0)).cast("long").alias("pairs"))
    run = F.lit("run").alias("kind")
    rows = groups.select(run, F.explode(F.create_map(F.lit("exact_groups"), "groups", F.lit("exact_pairs"), "pairs")).alias("name", "n"))
    for name, part in (("pairs_from_store", cached), ("pairs_judged", new)):
        rows = rows.unionByName(part.agg(F.count("*").alias("n")).select(run, F.lit(name).alias("name"), "n"))
    return listings.dedup_statistics(union, canonicals).unionByName(rows)
