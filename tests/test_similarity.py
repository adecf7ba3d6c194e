"""Thresholded cosine pairs against all pairs, and what they take."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.functions.text import exact_key
from tallyfold.operators import dedup
from tallyfold.operators.similarity import cosine_join

SCHEMA = "id long, kind string, vector array<double>"


def all_pairs(rows, same, cross):
    out = {}
    for x, (a, k, v) in enumerate(rows):
        for b, m, w in rows[x + 1 :]:
            if None in (a, b, k, m) or a == b or not v or not w or any(c is None or not math.isfinite(c) for c in (*v, *w)):
                continue
            na, nb = math.sqrt(sum(c * c for c in v)), math.sqrt(sum(c * c for c in w))
            if na and nb:
                sim = sum(c * d for c, d in zip(v, w)) / (na * nb)
                if sim >= (same if k == m else cross):
                    out[min(a, b), max(a, b)] = (round(sim, 9), k == m)
    return out


def clustered(seed=3, n=240, homes=8, dims=12, spread=0.12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(homes, dims))
    return [(i, "ab"[i % 2], (centers[i % homes] * rng.uniform(0.2, 3) + rng.normal(size=dims) * spread).tolist()) for i in range(n)]


def found(pairs):
    rows = pairs.collect()
    assert len(rows) == len({(r["a"], r["b"]) for r in rows})
    return {(r["a"], r["b"]): (round(r["sim"], 9), r["same"]) for r in rows}


@pytest.mark.parametrize("slice_rows", [7, 40, 4000])
def test_same_pairs_as_all_pairs(spark, slice_rows):
    rows = clustered()
    rows += [(1000 + i, "a", [1.0] * 12) for i in range(30)]  # copies
    rows += [(2000, "a", None), (2001, None, [1.0] * 12), (None, "a", [1.0] * 12), (2002, "a", [0.0] * 12), (2003, "a", [float("nan")] * 12), (2004, "a", [1.0, None]), (2005, "b", [1.0] * 5)]
    pairs, _ = cosine_join(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.85, 0.95, slice_rows)
    assert found(pairs) == all_pairs(rows, 0.85, 0.95)


def test_cells_that_are_too_far_do_not_meet(spark):
    rows = clustered(n=400)
    pairs, work = cosine_join(spark.createDataFrame(rows, SCHEMA), 0.95, 0.98, 25)
    assert found(pairs) == all_pairs(rows, 0.95, 0.98)
    took = work.first()
    assert took["pairs"] == 400 * 399 // 2 and took["compared"] <= took["met"] < 0.6 * took["pairs"]


def test_random_directions_meet_but_few_are_compared_in_full(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(rng.normal(size=(300, 64)))]
    pairs, work = cosine_join(spark.createDataFrame(rows, SCHEMA), 0.85, 0.95, 50)
    assert found(pairs) == all_pairs(rows, 0.85, 0.95)
    took = work.first()
    assert took["compared"] < 0.5 * took["met"] < took["pairs"]


def test_empty_tables_and_floors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    pairs, work = cosine_join(empty, 0.85, 0.95)
    assert pairs.collect() == [] and tuple(work.first()) == (0, 0, 0)
    with pytest.raises(ValueError):
        cosine_join(empty, 0.0, 0.95)
    names = spark.createDataFrame([("x", 1, [1.0, 0.0]), ("y", 1, [1.0, 0.1]), ("x", 1, [1.0, 0.0])], "id string, kind int, vector array<float>")
    assert {(r["a"], r["b"], r["same"]) for r in cosine_join(names, 0.85, 0.95)[0].collect()} == {("x", "y", True)}


def test_null_texts_and_options_in_exact_classes(spark):
    rows = [("a", "Same?", ["x"]), ("b", "same?", ["X."]), ("c", None, ["x"]), ("d", None, ["x"]), ("e", "Other", None), ("f", "other", []), ("g", "alone", None)]
    keyed = spark.createDataFrame(rows, "question_id string, question_text string, options array<string>")
    keyed = keyed.withColumn("exact_key", exact_key(F.lit("mcq"), F.col("question_text"), F.col("options")))
    assert {tuple(r) for r in dedup.exact_classes(keyed).collect()} == {("a", "a", 2), ("b", "a", 2), ("e", "e", 2), ("f", "e", 2)}
    assert {(r["first_id"], r["members"]) for r in dedup.exact_groups(keyed).collect()} == {("a", 2), ("e", 2)}
    assert {tuple(r) for r in dedup.exact_duplicate_links(keyed).collect()} == {("a", "b"), ("e", "f")}
    assert {tuple(r) for r in dedup.exact_duplicate_pairs(keyed).collect()} == {("a", "b"), ("e", "f")}


def test_pairs_leave_a_task_tile_by_tile():
    import pandas as pd

    from tallyfold.operators.similarity import TILE_ROWS, _compare

    rng = np.random.default_rng(7)
    vectors = 1 + rng.normal(size=(3 * TILE_ROWS, 8)) * 0.01
    side = pd.DataFrame({"id": range(len(vectors)), "kind": "a", "vector": [v.tobytes() for v in vectors], "norm": np.linalg.norm(vectors, axis=1)})
    parts = [found for found, _, _ in _compare(side, None, 0.5, 0.5)]
    assert sum(map(len, parts)) == len(side) * (len(side) - 1) // 2 and max(map(len, parts)) <= 1 << 13
