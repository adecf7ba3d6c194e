"""Ball-tree filtering against plain loops over every vector and centroid."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import ball_tree
from tallyfold.llm.ball_tree import ball_tree_clusters, descend, gather, plant, squares


def plain_clusters(rows, k, rounds, dims, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    h = lambda i: ("~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (h(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        owned = {}
        for _, v in kept:
            owned.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(owned[n]) for x in zip(*owned[n])] if n in owned else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    name = lambda n: hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()
    whole = sum(d for _, d, _ in found)
    return sorted(((i, n, d, sum(x for _, x, m in found if m == n), whole, name(n)) for i, d, n in found), key=repr)


def collected(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def fixture_rows():
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(2)]) for i in range(300)]
    rows += [(i, [float(x) for x in 9 * (i % 3) + rng.normal(size=4) * 0.01]) for i in range(300, 500)]
    rows += [(500 + i, [0.5, -0.5, 0.25, 0.0]) for i in range(150)] + [(7, [1.0, 1.0, 1.0, 1.0])] * 3  # copies and a repeated id
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan"), 0.0, 0.0, 0.0])]
    return rows + [(905, [float("-inf"), 0.0, 0.0, 0.0]), (None, [0.0, 0.0, 0.0, 1.0]), (906, [-0.0, 1e-9, -1e-9, 3.0]), (907, [1.0] * 5)]


@pytest.mark.parametrize("k, rounds", [(5, 3), (16, 1), (3, 0)])
def test_against_plain_loops(spark, monkeypatch, k, rounds):
    monkeypatch.setattr(ball_tree, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ball_tree, "LEAF_ROWS", 4)
    rows = fixture_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    clash = frame.withColumns({c: F.lit("kept") for c in ("cluster", "distance", "ids", "points", "vector", "n")})
    assert collected(ball_tree_clusters(clash, k, rounds, dims=4)) == plain_clusters(rows, k, rounds, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    few = [(3, [1.0, 2.0]), (4, [1.0, 2.0])]
    frame = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert collected(ball_tree_clusters(frame, dims=2)) == plain_clusters(few, 16, 3, 2)
    assert collected(ball_tree_clusters(frame.where("false"), dims=2)) == []
    assert collected(ball_tree_clusters(frame, dims=64)) == []


def test_ids_of_another_type(spark):
    rows = [(c, [float(ord(c)), 0.0]) for c in "abcdefgh"]
    frame = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    assert collected(ball_tree_clusters(frame, 3, 2, dims=2)) == plain_clusters(rows, 3, 2, 2)


def test_results_do_not_depend_on_how_rows_are_dealt(spark):
    frame = spark.createDataFrame([r for r in fixture_rows()], "vec_id long, embedding array<double>")
    one = collected(ball_tree_clusters(frame.coalesce(1), 6, 3, dims=4))
    assert collected(ball_tree_clusters(frame.repartition(7, "vec_id"), 6, 3, dims=4)) == one


def test_balls_are_assigned_whole_and_leaves_lose_centroids():
    rng = np.random.default_rng(3)
    homes = rng.integers(-4000, 4000, (8, 16))
    points = (homes[rng.integers(0, 8, 3000)] + rng.integers(-40, 40, (3000, 16))).astype(np.int64)
    order, tree = plant(points)
    assert sorted(order.tolist()) == list(range(3000)) and (tree.points == points[order]).all()
    for (begin, end, left, right), total, center, radius in zip(tree.spans, tree.sums, tree.centers, tree.radii):
        inside = tree.points[begin:end].astype(np.int64)
        assert (inside.sum(axis=0) == total).all() and squares(inside, center[None]).max() <= radius**2 * (1 + 1e-9) + 1e-6
        assert (left < 0) == (right < 0) and (left < 0 or (tree.spans[left][1] == tree.spans[right][0]))
    whole, leaves = descend(tree, homes)
    in_whole = sum(tree.spans[b][1] - tree.spans[b][0] for b, _ in whole)
    assert in_whole > 2500 and max(tree.spans[b][1] - tree.spans[b][0] for b, _ in whole) > ball_tree.LEAF_ROWS
    assert in_whole + sum(tree.spans[b][1] - tree.spans[b][0] for b, _ in leaves) == 3000
    counts, sums = np.zeros(8, np.int64), np.zeros((8, 16), np.int64)
    gather(tree, homes, counts, sums)
    owners = squares(points, homes).argmin(axis=1)
    assert (counts == np.bincount(owners, minlength=8)).all()
    assert all((sums[c] == points[owners == c].sum(axis=0)).all() for c in range(8))


def test_large_components_stay_exact_and_larger_ones_are_refused(spark):
    big = np.array([[1 << 27, -(1 << 27)], [(1 << 27) - 1, 5]])
    assert squares(big, big[:1]).tolist() == [[0], [1 + (5 + (1 << 27)) ** 2]]
    frame = spark.createDataFrame([(1, [1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceed a long"):
        ball_tree_clusters(frame, dims=1).collect()
