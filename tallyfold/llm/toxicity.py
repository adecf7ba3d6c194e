"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive sample; all training text, whatever
its label, is the unlabelled sample. Linear classifiers over word and word-start
features minimise the class-prior-corrected risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

whose second term is kept from going below zero, as it does when a model
overfits. Features are proposed by the positive sample, counted in every
training document, and kept where they are much more frequent in positives
(Benjamini and Hochberg's procedure over the proposed ones).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..scratch import Scratch
from .rows import with_computed
from .samples import first_in_hash_order
from .words import alnum_words

#: Bounds of the fitting sample: documents confirmed toxic, and documents taken as unlabelled.
POSITIVE_ROWS = 6_000
UNLABELLED_ROWS = 18_000
#: Features proposed by the positives, and features that a model may have.
PROPOSED_FEATURES = 60_000
MODEL_FEATURES = 8_192
WORD_STARTS = (4, 5, 6)
#: A feature must be in so many positives, and in this share of them.
LEAST_POSITIVES, LEAST_SHARE = 3, 0.005
LEAST_RATIO = 4.0
FALSE_DISCOVERIES = 0.01
CLASSIFIERS = 3
THRESHOLD = 0.7


def features(text: str | None) -> set[bytes]:
    """Distinct words, marked '=', and starts of longer words, marked by their length in bytes."""
    words = set(alnum_words(text))
    out = {b"=" + w for w in words}
    for k in WORD_STARTS:
        mark = b"%d" % k
        out |= {mark + w[:k] for w in words if len(w) > k}
    return out


@dataclass
class PUModel:
    """score(text) = mean over classifiers of sigmoid(bias + sum of the weights of its features)."""

    names: list[bytes]
    weights: np.ndarray
    biases: np.ndarray

    def lookup(self) -> tuple[set[bytes], list[tuple[int, set[bytes]]], dict[bytes, int]]:
        words = {n[1:] for n in self.names if n[:1] == b"="}
        starts = [(k, {n[1:] for n in self.names if n[:1] == b"%d" % k}) for k in WORD_STARTS]
        return words, starts, {n: i for i, n in enumerate(self.names)}

    def score_rows(self, texts: list[str | None]) -> list[float]:
        known, starts, index = self.lookup()
        out = []
        for text in texts:
            words = set(alnum_words(text))
            found = [index[b"=" + w] for w in words & known]
            for k, of_length in starts:
                if of_length:
                    found += [index[b"%d" % k + w] for w in {w[:k] for w in words if len(w) > k} & of_length]
            logits = self.biases + self.weights[:, sorted(found)].sum(axis=1)
            out.append(float(_sigmoid(logits).mean()))
        return out


class _Rows:
    """Distinct feature rows and how often each occurs in a sample."""

    def __init__(self, rows: list[tuple[int, ...]]):
        counts = Counter(rows)
        distinct = sorted(counts)
        self.index = np.array([i for row in distinct for i in row], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum([len(row) for row in distinct])]).astype(np.int64)
        self.counts = np.array([counts[row] for row in distinct], float)

    def resampled(self, rng: np.random.Generator) -> np.ndarray:
        """Shares of the distinct rows in a bootstrap sample."""
        total = int(self.counts.sum())
        return rng.multinomial(total, self.counts / total) / total

    def logits(self, theta: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(theta[self.index])])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]] + theta[-1]

    def gradient(self, slopes: np.ndarray, size: int) -> np.ndarray:
        out = np.bincount(self.index, np.repeat(slopes, np.diff(self.offsets)), size + 1)
        out[size] = slopes.sum()
        return out


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def fit_nnpu(pos: _Rows, unl: _Rows, size: int, prior: float, seed: int, steps: int = 600, rate: float = 0.1, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier: Adam steps on a bootstrap of both samples."""
    rng = np.random.default_rng(seed)
    share_p, share_u = pos.resampled(rng), unl.resampled(rng)
    theta = np.zeros(size + 1)
    theta[size] = np.log(prior / (1 - prior))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        gp, gu = pos.logits(theta), unl.logits(theta)
        negative = (share_u * np.logaddexp(0, gu)).sum() - prior * (share_p * np.logaddexp(0, gp)).sum()
        of_negative = unl.gradient(share_u * _sigmoid(gu), size) - prior * pos.gradient(share_p * _sigmoid(gp), size)
        if negative >= 0:
            grad = of_negative + prior * pos.gradient(share_p * (_sigmoid(gp) - 1), size)
        else:
            grad = -of_negative
        grad[:size] += l2 * theta[:size]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:size], float(theta[size])


def _count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(features(text.as_py()))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["name", "n"])


def _count_known(names) -> object:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PUModel(names.value, np.zeros((1, 0)), np.zeros(1))
        known, starts, index = model.lookup()
        counts = np.zeros(len(index), np.int64)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                words = set(alnum_words(text.as_py()))
                found = [index[b"=" + w] for w in words & known]
                for k, of_length in starts:
                    found += [index[b"%d" % k + w] for w in {w[:k] for w in words if len(w) > k} & of_length]
                counts[found] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(counts[seen], rows), pa.int64())], names=["i", "n"]
        )

    return count


def _project(names) -> object:
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {n: i for i, n in enumerate(names.value)}
        for batch in batches:
            found = [sorted(index[f] for f in features(t.as_py()) if f in index) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "found"])

    return project


def _excess(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Logarithm of a bound (Chernoff's) on the chance that a Poisson count reaches ``seen``; 0 where it isn't above its mean."""
    return np.where(seen > expected, seen - expected - seen * np.log(seen / expected), 0.0)


def train_toxicity(docs: DataFrame, labels: DataFrame, training: Column) -> PUModel:
    """A model from the rows of ``docs`` (doc_id, text) for which ``training`` holds.

    ``labels`` has doc_id and toxic; a document with any toxic = 1 is confirmed,
    and the share of confirmed ones among labelled training rows is the class
    prior. Without a confirmed document the model is the prior alone (0.5 % where
    there are no labels). At most POSITIVE_ROWS + UNLABELLED_ROWS documents are
    fitted, feature counts cover all training documents.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    usable = docs.where(training & F.col("doc_id").isNotNull()).select("doc_id", "text")
    judged = labels.where(training & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = judged.agg(F.count("*"), F.sum("toxic")).first()
    prior = float(min(0.9, max(0.005, (share[1] or 0) / share[0] if share[0] else 0)))
    constant = PUModel([], np.zeros((1, 0)), np.array([np.log(prior / (1 - prior))]))
    positive_ids = F.broadcast(first_in_hash_order(judged.where("toxic = 1").select("doc_id"), "doc_id", POSITIVE_ROWS))
    positive = usable.join(positive_ids, "doc_id", "left_semi")
    scratch = Scratch(spark, "toxicity")
    proposed = positive.select("text").mapInArrow(_count_all, "name binary, n long").groupBy("name").agg(F.sum("n").alias("n"))
    proposed = scratch.keep(proposed.where(F.col("n") >= LEAST_POSITIVES), "proposed")
    # Counts of counts say from which count on there are few enough; a sort would send each task's best to the driver.
    room, least = PROPOSED_FEATURES, None
    for row in proposed.groupBy("n").agg(F.count("*").alias("features")).orderBy(F.desc("n")).collect():
        room -= row["features"]
        if room < 0:
            break
        least = row["n"]
    proposed = proposed.where(F.col("n") >= least).orderBy("name").collect() if least else []
    scratch.drop("proposed")
    if not proposed:
        return constant
    names = [bytes(r["name"]) for r in proposed]
    in_positive = np.array([r["n"] for r in proposed], float)
    sent = context.broadcast(names)
    counted = usable.select("text").mapInArrow(_count_known(sent), "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    counts = {r["i"]: r["n"] for r in counted.collect()}
    in_all = np.array([counts.get(i, 0) for i in range(len(names))], float)
    n_all = max(1, counts.get(-1, 0))
    n_positive = max(1, positive.count())
    u = (in_all + 1) / (n_all + 2)
    evidence = _excess(in_positive, u * n_positive)
    ranked = np.sort(evidence)
    allowed = np.log(FALSE_DISCOVERIES * np.arange(1, len(names) + 1) / len(names))
    passed = np.flatnonzero(ranked <= allowed)
    limit = ranked[passed[-1]] if len(passed) else -np.inf
    good = np.flatnonzero((evidence <= limit) & (in_positive >= LEAST_RATIO * u * n_positive) & (in_positive >= LEAST_SHARE * n_positive))
    good = np.sort(good[np.argsort(evidence[good], kind="stable")][:MODEL_FEATURES])
    chosen = [names[i] for i in good]
    sent.unpersist()
    if not chosen:
        return constant
    sent = context.broadcast(chosen)
    unlabelled_ids = F.broadcast(first_in_hash_order(usable.select("doc_id"), "doc_id", UNLABELLED_ROWS))
    unlabelled = usable.join(unlabelled_ids, "doc_id", "left_semi")
    project = _project(sent)
    rows = lambda df: _Rows([tuple(r["found"]) for r in df.mapInArrow(project, "doc_id long, found array<int>").collect()])
    pos, unl = rows(positive), rows(unlabelled)
    fits = [fit_nnpu(pos, unl, len(chosen), prior, seed) for seed in range(CLASSIFIERS)]
    return PUModel(chosen, np.array([w for w, _ in fits]), np.array([b for _, b in fits]))


def score_toxicity(docs: DataFrame, model: PUModel, keep_text: bool = True) -> DataFrame:
    """``docs`` with score (0 to 1, higher: more likely toxic); empty and null texts have one too."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    start = lambda: lambda texts: [(s,) for s in sent.value.score_rows(texts)]
    return with_computed(docs, StructType().add("score", DoubleType()), start, keep_text)
