"""Language-model scores by logistic context mixing, beside a word-unigram base.

The byte model (``byte_model``) is learned by learners that each run along a share of
the training text, predicting every block from what came before it; their tables,
weights and maps are summed segment by segment, in rounds of bounded fan-in, and
the sum is sent to every worker. Which learner a row goes to, and its place there,
are hashes of its id and text, and the number of learners follows the bytes, so that
a score depends on the table alone and not on how its rows are dealt. Scoring is one pass over all texts. The base needs
the count of each word: those of common words go to every worker, the others are
joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .byte_model import BEFORE, Code, Learner, Model, Scorer, Sizes, finished, follower_counts, merged
from .words import utf8

#: Bounds: word counts sent to every worker (and their length), distinct words counted before they are sent on.
COMMON_WORDS = 250_000
COMMON_BYTES = 64
COUNTED_WORDS = 400_000
#: Training text of one learner (some run side by side from so many bytes each on), and learners summed by one task.
LEARNER_BYTES, LEAST_BYTES, LEAST_LEARNERS, FAN_IN = 115_000_000, 60_000_000, 4, 16
SCORED_ROWS = 500
#: Partitions for each learner, so that few learners share one.
SPREAD = 8
_FOLLOWERS = b" "


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-cased words, and behind a blank the places in ``follower_counts``, with their counts."""

    def out(items: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(items), pa.binary()), pa.array(list(items.values()), pa.int64())], names=["word", "n"])

    words: Counter[bytes] = Counter()
    followers = np.zeros((BEFORE, 256), np.int64)
    for batch in batches:
        for begin in range(0, batch.num_rows, SCORED_ROWS):
            texts = [utf8(t) for t in batch.column(0).slice(begin, SCORED_ROWS).to_pylist()]
            follower_counts(texts, followers)
            for raw in texts:
                words.update(raw.lower().split())
            if len(words) >= COUNTED_WORDS:
                yield out(words)
                words = Counter()
    yield out(words)
    seen = np.flatnonzero(followers)
    yield out({_FOLLOWERS + int(k).to_bytes(4, "big"): n for k, n in zip(seen.tolist(), followers.ravel()[seen].tolist())})


def _followers(counted: DataFrame) -> np.ndarray:
    out = np.zeros(BEFORE * 256, np.int64)
    # At most one row for each place.
    rows = counted.where(F.substring("word", 1, 1) == F.lit(_FOLLOWERS)).toArrow()
    places = [int.from_bytes(w[1:], "big") for w in rows.column(0).to_pylist()]
    out[places] = rows.column(1).to_numpy()
    return out.reshape(BEFORE, 256)


def _add_segments(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    # In the order of the learners, as sums of fractions depend on theirs.
    contents = list(rows.sort_values("part")["content"])
    return pd.DataFrame({"part": [int(key[2])], "table": [key[0]], "segment": [key[1]], "content": [merged(key[0], contents)]})


def train(texts: DataFrame, followers: np.ndarray, scratch: Scratch) -> Model:
    """The model of all ``texts`` (doc_id, text) whose follower counts are given."""
    size = int(followers.sum())
    learners = max(1, min(LEAST_LEARNERS, size // LEAST_BYTES), round(size / LEARNER_BYTES))
    code, sizes = Code.of(followers), Sizes.of(size)
    sent = texts.sparkSession.sparkContext.broadcast((code, sizes))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by learner; a partition may hold several, one after the other."""
        learner, number = None, None

        def told() -> Iterator[pa.RecordBatch]:
            learner.learn([], last=True)
            for table, segment, content in learner.segments():
                columns = [pa.array([number], pa.int32()), pa.array([table], pa.int32()), pa.array([segment], pa.int32()), pa.array([content], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "table", "segment", "content"])

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for first, last in zip(cuts, cuts[1:]):
                if first < last and (learner is None or numbers[first] != number):
                    if learner is not None:
                        yield from told()
                    learner, number = Learner(*sent.value), int(numbers[first])
                for begin in range(first, last, SCORED_ROWS):
                    learner.learn([utf8(t) for t in batch.column(1).slice(begin, min(SCORED_ROWS, last - begin)).to_pylist()])
        if learner is not None:
            yield from told()

    schema = "part int, table int, segment int, content binary"
    place = F.xxhash64("doc_id", "text")
    dealt = texts.select(F.pmod(place, F.lit(learners)).cast("int").alias("learner"), F.xxhash64(place).alias("place"), "text")
    dealt = dealt.repartition(SPREAD * learners, "learner").sortWithinPartitions("learner", "place", "text")
    rows = dealt.select("learner", "text").mapInArrow(learn, schema)
    step = 0
    while True:
        rows = rows.groupBy("table", "segment", F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).applyInPandas(_add_segments, schema)
        learners = -(-learners // FAN_IN)
        if learners == 1:
            break
        rows, step = scratch.keep(rows, f"segments-{step}"), step + 1
    segments = {(r["table"], r["segment"]): finished(r["table"], bytes(r["content"])) for r in rows.toLocalIterator()}
    if not segments:
        # Without a training row no learner starts.
        segments = {(t, k): finished(t, c) for t, k, c in Learner(code, sizes).segments()}
    return Model.of(code, sizes, segments)


def _least_common(words: DataFrame, most: int) -> int:
    """The count from which on there are at most ``most`` words, by counts of counts in bands."""
    band = F.floor(F.log2("n") * 8)
    rows = words.groupBy(band.alias("band")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("band")).collect()
    total, least = 0, 1 << 62
    for row in rows:
        total += row["words"]
        if total > most:
            break
        least = row["least"]
    return least


SCORED = "row_id long, doc_id {kind}, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double, rest array<struct<word:binary,times:int>>"
REST = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))


def score_documents(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row.

    Rows of ``docs`` (doc_id, text) for which ``training`` is true are learned
    from; held_out is true where it is false, rows where it is null are neither.
    Null texts are empty: one token, the end. Repeated rows count as often as they
    stand. Texts of any length are taken whole, in parts that see the bytes before
    them. Without training rows every base probability is one, and every decision
    costs one bit. score counts the end of the text too; bits_per_byte shares the
    cost among the bytes and that end.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    scratch = Scratch(spark, "mixing")
    texts = docs.select("doc_id", "text", training.alias("training"))
    learned = texts.where("training").select("doc_id", "text")
    counted = learned.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = scratch.keep(counted, "counted")
    followers = _followers(counted)
    words = counted.where(F.substring("word", 1, 1) != F.lit(_FOLLOWERS))
    n_docs = int(followers[:, 0xFF].sum())
    size = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_train, n_distinct = size[1] + n_docs, size[0] + (n_docs > 0)
    divisor = n_train + 0.5 * (n_distinct + 1)
    model = context.broadcast(train(learned, followers, scratch))

    base = F.log10((F.col("n") + 0.5) / F.lit(float(divisor)))
    short = words.where(F.length("word") <= COMMON_BYTES)
    common = short.where(F.col("n") >= _least_common(short, COMMON_WORDS)).select("word", base.alias("base")).toArrow()
    frequent = context.broadcast(dict(zip(common.column(0).to_pylist(), common.column(1).to_pylist())))
    end = float(np.log10((n_docs + 0.5) / divisor))
    unknown = float(np.log10(0.5 / divisor))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, price = Scorer(model.value), frequent.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for begin in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(begin, SCORED_ROWS)
                raws = [utf8(t) for t in part.column(1).to_pylist()]
                rows, rare, times, bounds = [], [], [], [0]
                for raw, value in zip(raws, scorer.scores(raws).tolist()):
                    own = raw.lower().split()
                    prices = list(map(price.get, own))
                    rest = Counter([w for w, p in zip(own, prices) if p is None])
                    rare += rest
                    times += rest.values()
                    bounds.append(len(rare))
                    known = [p for p in prices if p is not None]
                    # Words of the rest count as unknown until the join.
                    rows.append((len(own) + 1, len(raw), len(known) + (n_docs > 0), end + sum(known) + unknown * (len(own) - len(known)), value))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                kept = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int32())], fields=list(REST.value_type))
                made.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), kept))
                ids = pa.array(range(number, number + part.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, part.column(0), part.column(2), *made], names=names)
                number += part.num_rows

    names = ["row_id", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base_score", "score", "rest"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = texts.select("doc_id", "text", F.coalesce(~F.col("training"), F.lit(False)).alias("held_out"))
    scored = scratch.keep(held.mapInArrow(score, SCORED.format(kind=kind)), "scored")
    rare = scored.select("row_id", F.explode("rest").alias("r")).select("row_id", "r.word", F.col("r.times").alias("had"))
    met = rare.join(words.select("word", (base - F.lit(unknown)).alias("more")), "word")
    late = met.groupBy(F.col("row_id").alias("late_id")).agg(F.sum(F.col("had") * F.col("more")).alias("late_base"), F.sum("had").alias("late_known"))
    whole = scored.drop("rest").join(late, F.col("row_id") == F.col("late_id"), "left")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("late_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("late_base", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
