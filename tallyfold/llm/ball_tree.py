"""Centroid clustering by ball-tree filtering.

Every partition files its vectors in metric trees of at most BLOCK_ROWS rows: a
ball holds its radius, count and integer sum. In a round each tree passes the
centroids down: by the triangle inequality a centroid that is more than two radii
farther from the ball's centre than the nearest one can own no vector of the ball,
so a ball with one centroid left is assigned as a whole by its count and sum, and
others are opened down to leaves, which are compared exactly. All sums are those of
integers, so neither the trees nor the order of rows can change a result.

What leaves a task in a round is a count and a sum for each centroid; only the
centroids (``k`` times ``dims`` integers) are known to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StructType

from ..scratch import Scratch

#: Vectors of one tree, and of a leaf.
BLOCK_ROWS = 4096
LEAF_ROWS = 32
#: Integers up to this size have squared distances that fit into a long (and sums of 64 squares of their differences).
LARGEST = 1 << 27
#: Up to this size, float64 products of 64 components are exact.
EXACT_IN_FLOAT = 1 << 21


def squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as int64."""
    if points.size and centers.size and max(np.abs(points).max(), np.abs(centers).max()) > EXACT_IN_FLOAT:
        return np.stack([np.square(points - c).sum(axis=1) for c in centers], axis=1)
    p, c = points.astype(np.float64), centers.astype(np.float64)
    return (np.square(p).sum(axis=1)[:, None] + np.square(c).sum(axis=1) - 2 * (p @ c.T)).astype(np.int64)


@dataclass
class BallTree:
    """Balls in arrays: ``spans`` has the first and last place of a ball's rows and its two children (-1 for a leaf)."""

    points: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    sums: np.ndarray
    spans: np.ndarray

    def pack(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name)).tobytes() for name in PACKED}

    @classmethod
    def unpack(cls, row: dict[str, bytes], dims: int) -> BallTree:
        shapes = {"points": (-1, dims), "centers": (-1, dims), "radii": (-1,), "sums": (-1, dims), "spans": (-1, 4)}
        return cls(**{name: np.frombuffer(row[name], kind).reshape(shapes[name]) for name, kind in PACKED.items()})


PACKED = {"points": np.int32, "centers": np.int64, "radii": np.float64, "sums": np.int64, "spans": np.int32}


def plant(points: np.ndarray) -> tuple[np.ndarray, BallTree]:
    """The order in which a tree files the rows of ``points``, and the tree; halves lie around two far ends of their ball."""
    order = np.arange(len(points))
    centers, radii, sums, spans = [], [], [], []
    todo = [(0, len(points), -1)]
    while todo:
        begin, end, above = todo.pop()
        rows = points[order[begin:end]]
        total = rows.sum(axis=0)
        center = total // len(rows)
        away = squares(rows, center[None])[:, 0]
        here = len(radii)
        if above >= 0:
            spans[above][2 if spans[above][2] < 0 else 3] = here
        centers.append(center)
        radii.append(np.sqrt(float(away.max())))
        sums.append(total)
        spans.append([begin, end, -1, -1])
        if len(rows) > LEAF_ROWS and radii[-1] > 0:
            near = squares(rows, rows[away.argmax()][None])[:, 0]
            lean = near - squares(rows, rows[near.argmax()][None])[:, 0]
            half = len(rows) // 2
            order[begin:end] = order[begin:end][np.argpartition(lean, half)]
            todo += [(begin + half, end, here), (begin, begin + half, here)]
    tree = BallTree(points[order].astype(np.int32), np.array(centers), np.array(radii), np.array(sums), np.array(spans, np.int32))
    return order, tree


def descend(tree: BallTree, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
    """Balls that one centroid owns whole, as (ball, centroid), and leaves with the centroids left to compare."""
    whole, leaves = [], []
    balls, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    while len(balls):
        away = np.where(left, np.sqrt(squares(tree.centers[balls], centroids).astype(np.float64)), np.inf)
        nearest = away.min(axis=1, keepdims=True)
        # the margin covers the rounding of square roots: a centroid is only dropped when it is surely farther
        left &= away <= nearest + 2 * tree.radii[balls][:, None] + 1e-6 + 1e-9 * nearest
        single = left.sum(axis=1) == 1
        whole += zip(balls[single].tolist(), left[single].argmax(axis=1).tolist())
        last = ~single & (tree.spans[balls, 2] < 0)
        leaves += [(int(b), np.flatnonzero(m)) for b, m in zip(balls[last], left[last])]
        opened = ~single & ~last
        balls, left = tree.spans[balls[opened], 2:].ravel().astype(np.int64), np.repeat(left[opened], 2, axis=0)
    return whole, leaves


def gather(tree: BallTree, centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Adds what each centroid owns of the tree; whole balls give their count and sum."""
    whole, leaves = descend(tree, centroids)
    for ball, owner in whole:
        counts[owner] += tree.spans[ball, 1] - tree.spans[ball, 0]
        sums[owner] += tree.sums[ball]
    for ball, rivals in leaves:
        rows = tree.points[tree.spans[ball, 0] : tree.spans[ball, 1]].astype(np.int64)
        owners = rivals[squares(rows, centroids[rivals]).argmin(axis=1)]
        np.add.at(counts, owners, 1)
        np.add.at(sums, owners, rows)


def assign(tree: BallTree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid (ties: the smaller number) and the squared distance of every row of the tree."""
    owners, away = np.zeros(len(tree.points), np.int32), np.zeros(len(tree.points), np.int64)
    whole, leaves = descend(tree, centroids)
    for ball, rivals in [*((b, np.array([owner])) for b, owner in whole), *leaves]:
        begin, end = tree.spans[ball, :2]
        found = squares(tree.points[begin:end].astype(np.int64), centroids[rivals])
        best = found.argmin(axis=1)
        owners[begin:end], away[begin:end] = rivals[best], found[np.arange(len(found)), best]
    return owners, away


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(values * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ArithmeticError(f"a component beyond {LARGEST} after scaling: its squared distances exceed a long")
    return scaled.astype(np.int64)


def usable(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, finite), F.lit(False))


def ball_tree_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """Clusters of the usable vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A component x counts as floor(scale * x). The first centroids are the ``k``
    vectors with the smallest sha256 of ``seed:vec_id`` (ties of a repeated vec_id by
    the vector, a null vec_id last); fewer vectors give fewer centroids. ``rounds``
    times every vector goes to the nearest centroid (ties: the smaller number) and
    centroids become floor(sum / count) of theirs, empty ones stay; then vectors are
    assigned once more. Vectors that are null, of another size or hold null or
    non-finite components have no row; repeated rows are vectors of their own; an
    empty table gives an empty result. Other columns are left out, whatever their
    names. A scaled component beyond 2**27 raises, as squared distances would exceed
    a long.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ball_tree")
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(usable(F.col("vector"), dims))
    id_type = vectors.schema["vec_id"].dataType
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(hashed.alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(k)
    centroids = _integers(np.array([r["vector"] for r in first.collect()], np.float64).reshape(-1, dims), scale)

    trees = scratch.keep(_planted(kept, id_type, dims, scale), "trees")
    for _ in range(rounds):
        if len(centroids):
            centroids = _moved(trees, centroids, dims)

    found = scratch.keep(_assigned(trees, centroids, id_type, dims), "assigned")
    whole = F.col("distance").cast("decimal(20,0)")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(whole).alias("s")).collect()}
    scratch.drop("trees")
    names = {c: hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest() for c, v in enumerate(centroids)}
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), name) for c, name in names.items()]
    # k rows: small whatever the input
    about = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _planted(kept: DataFrame, id_type: DataType, dims: int, scale: int) -> DataFrame:
    arrow_ids = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filed(rows: pa.Table) -> pa.RecordBatch:
            flat = rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            order, tree = plant(_integers(flat.reshape(-1, dims), scale))
            ids = rows.column(0).take(pa.array(order)).combine_chunks()
            packed = tree.pack()
            arrays = [pa.array([ids.to_pylist()], pa.list_(arrow_ids)), *(pa.array([packed[n]], pa.binary()) for n in PACKED)]
            return pa.RecordBatch.from_arrays(arrays, ["ids", *PACKED])

        waiting: list[pa.Table] = []
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            while sum(t.num_rows for t in waiting) >= BLOCK_ROWS:
                rows = pa.concat_tables(waiting)
                yield filed(rows.slice(0, BLOCK_ROWS))
                waiting = [rows.slice(BLOCK_ROWS)]
        rows = pa.concat_tables(waiting) if waiting else None
        if rows is not None and rows.num_rows:
            yield filed(rows)

    return kept.mapInArrow(run, _tree_schema(id_type))


def _tree_schema(id_type: DataType) -> StructType:
    schema = StructType().add("ids", ArrayType(id_type))
    for name in PACKED:
        schema = schema.add(name, BinaryType())
    return schema


def _each_tree(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, BallTree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in PACKED}
            yield batch.slice(i, 1), BallTree.unpack(row, dims)


def _moved(trees: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The centroids after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, tree in _each_tree(batches, dims):
            gather(tree, centroids, counts, sums)
        some = np.flatnonzero(counts)
        arrays = [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["cluster", "n", "sums"])

    parts = trees.select(*PACKED).mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]
    moved = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        moved[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return moved


def _assigned(trees: DataFrame, centroids: np.ndarray, id_type: DataType, dims: int) -> DataFrame:
    arrow_ids = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, tree in _each_tree(batches, dims):
            owners, away = assign(tree, centroids)
            ids = row.column("ids").flatten().cast(arrow_ids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(owners), pa.array(away)], ["vec_id", "cluster", "distance"])

    schema = StructType().add("vec_id", id_type).add("cluster", IntegerType()).add("distance", LongType())
    return trees.mapInArrow(run, schema)
