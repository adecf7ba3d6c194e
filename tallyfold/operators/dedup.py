"""Deduplication: exact groups, candidate pairs by cosine, verdicts and canonical records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_id
from ..scratch import Scratch
from .graph import connected_components
from .similarity import SLICE_ROWS, cosine_join

SAME_TYPE, CROSS_TYPE = 0.85, 0.95
MERGE_FLOOR = 0.6
PAIR_BATCH = 40
#: Members of a group that one task compares with as many others.
PAIR_SLICE = 1_000
#: Rows of ids that are sent to all tasks at most.
BROADCAST_IDS = 100_000
EXACT = "exact_duplicate"
DETERMINISTIC_MODEL = "deterministic"


def small_side(rows: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``rows``, to be sent to all tasks by a join if they are few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def only_rows_of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` with one of the ``ids``. Up to BROADCAST_IDS of them go to the rows; more are joined, and the texts of the rows with them."""
    return rows.join(small_side(ids.select(key)), key, "left_semi")


def exact_groups(keyed: DataFrame) -> DataFrame:
    """key_hash, members, first_id of the keys that several rows share; the key is hashed for the shuffle, a null key is no key."""
    groups = keyed.where("exact_key IS NOT NULL").groupBy(F.sha2("exact_key", 256).alias("key_hash")).agg(F.count("*").alias("members"), F.min("question_id").alias("first_id"))
    return groups.where(F.col("members") > 1)


def exact_duplicate_links(keyed: DataFrame) -> DataFrame:
    """Each later member of a group with the group's first: n - 1 edges instead of all pairs, the same components."""
    hashed = keyed.select("question_id", F.sha2("exact_key", 256).alias("key_hash"))
    first = hashed.groupBy("key_hash").agg(F.min("question_id").alias("a"))
    return hashed.join(first, "key_hash").where(F.col("a") < F.col("question_id")).select("a", F.col("question_id").alias("b"))


def _meeting(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each two ``rows`` (slice, slices) of the same ``keys`` once, as ..._a and ..._b: a pair of slices meets in one task of its own."""
    payload = [c for c in rows.columns if c not in (*keys, "slice", "slices")]
    lower = rows.select("*", F.explode(F.sequence(F.col("slice"), F.col("slices") - 1)).alias("hi")).withColumnRenamed("slice", "lo")
    upper = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("slice"))).alias("lo")).withColumnRenamed("slice", "hi")
    left, right = (side.select(*keys, "lo", "hi", *[F.col(c).alias(f"{c}_{end}") for c in payload]) for side, end in ((lower, "a"), (upper, "b")))
    return left.join(right, [*keys, "lo", "hi"]).where((F.col("lo") < F.col("hi")) | (F.col("id_a") < F.col("id_b")))


def exact_classes(keyed: DataFrame) -> DataFrame:
    """question_id, first_id, members of every row whose key others share: all pairs of a class, in rows that grow with the input."""
    hashed = keyed.where("exact_key IS NOT NULL AND question_id IS NOT NULL").select("question_id", F.sha2("exact_key", 256).alias("key_hash"))
    # Written once: the key is dear to make, and its hash is small.
    hashed = Scratch(keyed.sparkSession, "classes").keep(hashed, "hashed")
    groups = hashed.groupBy("key_hash").agg(F.count("*").alias("members"), F.min("question_id").alias("first_id")).where(F.col("members") > 1)
    return hashed.join(groups, "key_hash").select("question_id", "first_id", "members")


def exact_membership(keyed: DataFrame) -> DataFrame:
    """question_id, first_id, members, links of every row: its class by key, the class's size and its links to others; a row without a key is a class of its own."""
    own = F.concat(F.lit("id:"), F.coalesce("question_id", F.lit("")))
    hashed = keyed.select("question_id", F.coalesce(F.sha2("exact_key", 256), own).alias("class"), F.col("exact_key").isNotNull().alias("has_key"))
    # Written once: the key is dear to make, and its hash is small.
    hashed = Scratch(keyed.sparkSession, "membership").keep(hashed, "hashed")
    groups = hashed.where("has_key").groupBy("class").agg(F.count("*").alias("n"), F.min("question_id").alias("first")).where(F.col("n") > 1)
    members = F.coalesce("n", F.lit(1).cast("long"))
    joined = hashed.join(groups, "class", "left")
    return joined.select("question_id", F.coalesce("first", "question_id").alias("first_id"), members.alias("members"), (members - 1).alias("links"))


def exact_duplicate_pairs(keyed: DataFrame) -> DataFrame:
    """All pairs a < b of each group (a record-level report).

    A group is cut into slices of about ``PAIR_SLICE`` members and each pair of
    slices meets once, so a large group is spread over many tasks.
    """
    hashed = keyed.where(F.col("question_id").isNotNull()).select(F.col("question_id").alias("id"), F.sha2("exact_key", 256).alias("key_hash"))
    sizes = hashed.groupBy("key_hash").agg(F.ceil(F.count("*") / PAIR_SLICE).cast("int").alias("slices"), F.count("*").alias("members"))
    rows = hashed.join(sizes.where(F.col("members") > 1).drop("members"), "key_hash")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    return _meeting(rows, ["key_hash"]).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def representative_order() -> list[Column]:
    """Unambiguous first, then confident, long, and small in id."""
    return [F.asc("ambiguous"), F.desc("extraction_confidence"), F.desc(F.length("question_text")), F.asc("question_id")]


def lean(questions: DataFrame) -> DataFrame:
    """What the choice of representatives needs of questions, without their texts, so that no join carries these."""
    return questions.select("question_id", "ambiguous", "extraction_confidence", F.length("question_text").alias("text_length"))


def representatives(members: DataFrame, group: str) -> DataFrame:
    """The best member of each group: a minimum of structs, so that it is taken before the shuffle too. See ``lean`` for the columns."""
    length = F.col("text_length") if "text_length" in members.columns else F.length("question_text")
    best = F.min(F.struct("ambiguous", (-F.col("extraction_confidence")).alias("c"), (-length).alias("l"), "question_id"))
    return members.groupBy(group).agg(best.alias("best")).select(group, F.col("best.question_id").alias("representative_question_id"))


def cosine_candidates(vectors: DataFrame, same_type: float = SAME_TYPE, cross_type: float = CROSS_TYPE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """a, b, sim, same of the pairs whose cosine reaches the threshold of their types; see ``similarity.cosine_join``."""
    return cosine_join(vectors, same_type, cross_type, slice_rows)[0]


def reconcile_pairs(asked: DataFrame, verdicts: DataFrame, floor: float = MERGE_FLOOR) -> DataFrame:
    """pair_id, verdict, confidence of every asked pair: the last verdict counts, a missing one is uncertain, an unsure match too."""
    last = verdicts.groupBy("pair_id").agg(F.max(F.struct("seq", "verdict", "confidence")).alias("v"))
    joined = asked.join(last, "pair_id", "left")
    verdict, confidence = F.col("v.verdict"), F.coalesce(F.col("v.confidence"), F.lit(0.0))
    unsure = (verdict == "same_question") & (confidence < floor)
    return joined.select("pair_id", F.when(verdict.isNull() | unsure, F.lit("uncertain")).otherwise(verdict).alias("verdict"), confidence.alias("confidence"))


def unasked_verdicts(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    return verdicts.join(asked, "pair_id", "left_anti")


def groups(questions: DataFrame, merges: DataFrame) -> DataFrame:
    """question_id, component of every question; edges to unknown ids are ignored."""
    ids = questions.select("question_id")
    known = merges.join(ids.withColumnRenamed("question_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("question_id", "b"), "b", "left_semi")
    labels = connected_components(known)
    joined = ids.join(labels, ids.question_id == labels.id, "left")
    return joined.select("question_id", F.coalesce("component", "question_id").alias("component"))


def assemble_canonicals(questions: DataFrame, decisions: DataFrame, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """Canonical records and links.

    ``decisions`` has a, b, decision_source, verdict, confidence. A group of one is
    a singleton, or needs review where an uncertain decision touches it (with the
    largest confidence); a larger one is an exact duplicate where all its merging
    edges are, else a semantic merge with the least confidence of its edges.
    Decisions are written once more unless they are ``written`` already.
    """
    scratch = Scratch(questions.sparkSession, "canonicals")
    # Both are read several times below; decisions hold the keys of all texts in their plan.
    decisions = decisions if written else scratch.keep(decisions, "decisions")
    # Lengths alone: the texts are read once for them.
    questions = scratch.keep(lean(questions), "lean")
    merges = decisions.where(F.col("verdict") == "same_question")
    labels = scratch.keep(groups(questions, merges.select("a", "b")), "labels")
    members = questions.join(labels, "question_id")
    sizes = members.groupBy("component").agg(F.count("*").alias("members"), F.collect_list("question_id").alias("ids"))
    # Decisions within a group only: another end that isn't a question says nothing of it.
    ends = [labels.select(F.col("question_id").alias(e), F.col("component").alias(f"component_{e}")) for e in "ab"]
    inner = merges.join(ends[0], "a").join(ends[1], "b").groupBy(F.col("component_a").alias("component")).agg(
        F.bool_and(F.col("decision_source") == EXACT).alias("all_exact"), F.min("confidence").alias("least")
    )
    unsure = decisions.where(F.col("verdict") == "uncertain")
    touched = unsure.select(F.col("a").alias("question_id"), "confidence").union(unsure.select("b", "confidence"))
    touched = touched.join(labels, "question_id").groupBy("component").agg(F.max("confidence").alias("most"))
    best = representatives(members, "component")
    one = F.col("members") == 1
    state = F.when(one & F.col("most").isNotNull(), "needs_review").when(one, "singleton").when(F.col("all_exact"), EXACT).otherwise("semantic_merge")
    sure = F.when(one, F.col("most")).when(F.col("all_exact"), F.lit(1.0)).otherwise(F.col("least"))
    rows = sizes.join(inner, "component", "left").join(touched, "component", "left").join(best, "component")
    canonicals = rows.select(
        "component", canonical_id(F.col("ids")).alias("canonical_question_id"), "representative_question_id", "members", state.alias("dedup_status"), sure.alias("dedup_confidence")
    )
    links = labels.join(canonicals.select("component", "canonical_question_id"), "component").select("question_id", "canonical_question_id")
    return canonicals.drop("component"), links


def batches(rows: DataFrame, order: list[str], size: int = PAIR_BATCH) -> DataFrame:
    """``rows`` with the number of their batch of ``size`` in order.

    Two levels: row numbers within range partitions, then the partitions' running
    totals, so that no task sorts all rows.
    """
    # Written once, so that both uses see the same partitions.
    scratch = Scratch(rows.sparkSession, "batches")
    spread = scratch.keep(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "spread")
    within = spread.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    totals = spread.groupBy("part").agg(F.count("*").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("place") - 1
    return within.join(F.broadcast(before), "part").withColumn("batch", F.floor(number / size).cast("long")).drop("part", "place", "before")


def to_be_embedded(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose text has no cached vector, or one of another text (id, content_hash)."""
    return wanted.join(cache.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def not_yet_judged(pairs: DataFrame, decisions: DataFrame, model: str) -> DataFrame:
    return pairs.join(decisions.where(F.col("model_used") == model), ["a", "b"], "left_anti")
