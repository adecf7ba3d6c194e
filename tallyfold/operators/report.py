"""The final report: reshaped summaries, distributions, notes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frequency import most_repeated, type_counts

#: Bounds: words of all reference texts sent to every worker, matches counted at once, ids broadcast.
LISTED_WORDS, COUNTED_MATCHES, BROADCAST_IDS = 2_000_000, 1_000_000, 1_000_000


def executive_summary(papers: DataFrame, questions: DataFrame, canonicals: DataFrame, topics: DataFrame) -> DataFrame:
    """One row of counts; ``topics`` has total_occurrences."""
    status = lambda s: F.count_if(F.col("classification_status") == s).alias(s)
    row = papers.agg(F.countDistinct("paper_id").alias("papers"))
    row = row.crossJoin(questions.agg(F.count("*").alias("occurrences"), status("no_match"), status("ambiguous"), status("unclassified")))
    row = row.crossJoin(canonicals.agg(F.countDistinct("canonical_question_id").alias("canonicals")))
    tested = F.count_if(F.col("total_occurrences") > 0)
    return row.crossJoin(topics.agg(F.count("*").alias("topics"), tested.alias("tested"), (F.count("*") - tested).alias("untested")))


def data_quality(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """One row: questions without a topic by state, and papers whose years disagree."""
    counts = questions.agg(*[F.count_if(F.col("classification_status") == s).alias(f"n_{s}") for s in ("unclassified", "no_match", "ambiguous")])
    return counts.crossJoin(papers.agg(F.count_if("year_conflict").alias("year_conflict_papers")))


def repeated_report(ranking: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Repeated canonicals with their record; status 'unknown' where there is none."""
    record = canonicals.select("canonical_question_id", "dedup_status", "topic_id")
    joined = most_repeated(ranking).join(record, "canonical_question_id", "left")
    return joined.withColumn("dedup_status", F.coalesce("dedup_status", F.lit("unknown")))


def unclassified_report(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("classification_status") == "unclassified")


def type_distribution(questions: DataFrame, labels: DataFrame) -> DataFrame:
    return type_counts(questions).join(labels, "question_type")


def adjudication_outcomes(rows: DataFrame) -> DataFrame:
    """kind, outcome, n: errors corrected, still wrong or turned ambiguous; controls unchanged or regressed.

    ``rows`` has kind ('error' or 'control'), expected, answered (null: ambiguous).
    """
    right = F.col("answered").eqNullSafe(F.col("expected"))
    unsure = F.col("answered").isNull()
    error = F.when(right, "corrected").when(unsure, "became_ambiguous").otherwise("still_wrong")
    control = F.when(right, "unchanged_correct").when(unsure, "regressed_to_ambiguous").otherwise("regressed_to_wrong")
    return rows.groupBy("kind", F.when(F.col("kind") == "error", error).otherwise(control).alias("outcome")).agg(F.count("*").alias("n"))


def identical_trials(trials: DataFrame) -> DataFrame:
    """label and whether all fingerprints of its trials (label, trial, fingerprint) agree."""
    return trials.groupBy("label").agg((F.countDistinct("fingerprint") == 1).alias("identical"), F.count("*").alias("trials"))


def differing_names(trials: DataFrame, a: int, b: int) -> DataFrame:
    """Places at which two trials' lists (label, trial, pos, name) differ."""
    left = trials.where(F.col("trial") == a).select("label", "pos", F.col("name").alias("name_a"))
    right = trials.where(F.col("trial") == b).select("label", "pos", F.col("name").alias("name_b"))
    return left.join(right, ["label", "pos"], "full").where(~F.col("name_a").eqNullSafe(F.col("name_b")))


def token_jaccard(left: DataFrame, right: DataFrame, top: int, least_shared: int = 2) -> DataFrame:
    """left_id, rnk, right_id, jaccard: each left text's best right texts by the Jaccard similarity of word sets.

    The right side is meant to be a reference list: up to LISTED_WORDS its words go
    to every worker, and a left row finds its best texts where it lies, without a
    shuffle of its words. A longer list, and left rows that share an id and so
    count as one, are joined on words.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) > 0))
    a, b = (df.where(F.col("id").isNotNull()).select("id", words.alias("words")) for df in (left, right))
    listed = b.select("id", F.explode("words").alias("word")).groupBy("id", "word").agg(F.count("*").alias("times"))
    if listed.count() > LISTED_WORDS:
        return _jaccard_joined(a, b, top, least_shared)
    reference = left.sparkSession.sparkContext.broadcast(_Reference(listed.toArrow()))
    kinds = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    schema = f"left_id {kinds[0]}, rnk long, right_id {kinds[1]}, jaccard double"
    best = _jaccard_listed(reference, top, least_shared)
    again = a.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    repeated = again.count()
    if not repeated:
        return a.mapInArrow(best, schema)
    ids = F.broadcast(again) if repeated <= BROADCAST_IDS else again
    alone, others = a.join(ids, "id", "left_anti"), a.join(ids, "id", "left_semi")
    return alone.mapInArrow(best, schema).unionByName(_jaccard_joined(others, b, top, least_shared))


def _jaccard_joined(left: DataFrame, right: DataFrame, top: int, least_shared: int) -> DataFrame:
    """``token_jaccard`` of (id, words) by a join on words."""
    a, b = (df.select(F.col("id").alias(name), F.explode("words").alias("word")) for df, name in ((left, "left_id"), (right, "right_id")))
    size_a, size_b = a.groupBy("left_id").agg(F.count("*").alias("n_a")), b.groupBy("right_id").agg(F.count("*").alias("n_b"))
    shared = a.join(b, "word").groupBy("left_id", "right_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)
    scored = shared.join(size_a, "left_id").join(size_b, "right_id")
    scored = scored.withColumn("jaccard", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), 6))
    order = Window.partitionBy("left_id").orderBy(F.desc("jaccard"), "right_id")
    return scored.withColumn("rnk", F.row_number().over(order).cast("long")).where(F.col("rnk") <= top).select("left_id", "rnk", "right_id", "jaccard")


class _Reference:
    """Word by word the texts (numbered in the order of their ids) that have it, and how often."""

    def __init__(self, listed: pa.Table):
        listed = listed.sort_by([("word", "ascending"), ("id", "ascending")]).combine_chunks()
        self.words = pc.unique(listed["word"])
        self.ids = pc.unique(listed["id"].combine_chunks())
        self.ids = self.ids.take(pc.sort_indices(self.ids))
        self.text = pc.index_in(listed["id"], value_set=self.ids).to_numpy().astype(np.int64)
        self.times = listed["times"].to_numpy()
        word = pc.index_in(listed["word"], value_set=self.words).to_numpy()
        self.texts_of = np.bincount(word, minlength=len(self.words))
        self.begin = np.cumsum(self.texts_of) - self.texts_of
        self.size = np.bincount(self.text, self.times, len(self.ids)).astype(np.int64)


def _jaccard_listed(sent, top: int, least_shared: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``token_jaccard`` of batches (id, words) with distinct ids against the broadcast reference."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = sent.value
        for batch in batches:
            words = batch.column(1)
            size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.fill_null(pc.index_in(pc.list_flatten(words), value_set=ref.words), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)[found >= 0]
            found = found[found >= 0]
            matches = np.cumsum(ref.texts_of[found])
            begin = 0
            while begin < len(found):
                # Whole rows, as many as have so many matches, but one at least.
                before = matches[begin - 1] if begin else 0
                end = np.searchsorted(matches, before + COUNTED_MATCHES, side="right")
                if end < len(found):
                    end = np.searchsorted(row, row[end])
                    if end <= begin:
                        end = np.searchsorted(row, row[begin], side="right")
                yield told(ref, batch.column(0), row[begin:end], found[begin:end], size)
                begin = end

    def told(ref: _Reference, ids: pa.Array, row: np.ndarray, found: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        many = ref.texts_of[found]
        at = np.arange(many.sum()) + np.repeat(ref.begin[found] - (np.cumsum(many) - many), many)
        first, last = row[0], row[-1] + 1
        keys, place = np.repeat(row - first, many) * len(ref.ids) + ref.text[at], ref.times[at]
        if (last - first) * len(ref.ids) <= 4 * len(keys):
            shared = np.bincount(keys, place, (last - first) * len(ref.ids)).astype(np.int64)
            keys = np.flatnonzero(shared >= least_shared)
            shared = shared[keys]
        else:
            keys, inverse = np.unique(keys, return_inverse=True)
            shared = np.bincount(inverse, place, len(keys)).astype(np.int64)
            keys, shared = keys[shared >= least_shared], shared[shared >= least_shared]
        row, text = np.divmod(keys, len(ref.ids))
        union = size[row + first] + ref.size[text] - shared
        # Millionths, halves rounded up.
        score = (2_000_000 * shared + union) // (2 * union)
        order = np.lexsort((text, -score, row))
        row, text, score = row[order], text[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        kept = np.flatnonzero(rank <= top)
        columns = [ids.take(pa.array(row[kept] + first)), pa.array(rank[kept]), ref.ids.take(pa.array(text[kept])), pa.array(score[kept] / 1e6)]
        return pa.RecordBatch.from_arrays(columns, names=["left_id", "rnk", "right_id", "jaccard"])

    return best
