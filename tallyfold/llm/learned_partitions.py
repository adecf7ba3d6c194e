"""Approximate nearest neighbours over learned partitions.

A bounded sample gives a neighbour graph, which is cut into balanced parts with few
edges between them. A small network learns which part a vector's neighbours lie
in; it files every row of the table under its likeliest part and sends each query
to several likely parts, whose rows are ranked by the exact inner product. How many
parts are searched is chosen on the sample, so that the wanted recall is met.

Parts are dealt to groups of about BLOCK_ROWS rows (a larger part is cut into
blocks), so that a query is sent once to a group, with the parts that it asks for
there, and no task depends on the size of a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .samples import first_in_hash_order

TOP = 20
#: Bounds of the fit: sampled vectors (of each part, and at least), and of them those that choose the number of searched parts.
PART_SAMPLE, LEAST_SAMPLE, PROBE_ROWS = 12, 3_000, 500
GRAPH_NEIGHBOURS = 10
#: Parts follow the rows between these numbers; the upper one bounds the sample. A small table has a part for every SMALL_PART rows.
ROWS_PER_PART, LEAST_PARTS, MOST_PARTS, SMALL_PART = 4_000, 256, 1_024, 8
WANTED_RECALL = 0.95
HIDDEN, STEPS = 96, 300
#: Rows and queries that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 8_000, 20_000


def neighbours(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k largest inner products with other rows."""
    out = []
    for begin in range(0, len(vectors), 500):
        scores = vectors[begin : begin + 500] @ vectors.T
        rows = np.arange(len(scores))
        scores[rows, begin + rows] = -np.inf
        out.append(np.argsort(-scores, axis=1, kind="stable")[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, vectors: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """A part for each node; no part exceeds the mean size by more than a twentieth (and one)."""
    n = len(graph)
    room = int(np.ceil(n / parts * 1.05)) + 1
    centres = vectors[rng.choice(n, parts, replace=False)]
    likes = vectors @ centres.T
    part = np.full(n, -1)
    sizes = np.zeros(parts, int)
    for node in np.argsort(-likes.max(axis=1), kind="stable"):
        for choice in np.argsort(-likes[node], kind="stable"):
            if sizes[choice] < room:
                part[node], sizes[choice] = choice, sizes[choice] + 1
                break
    sources = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(rounds):
        pull = np.zeros((n, parts))
        np.add.at(pull, (sources, part[graph.ravel()]), 1)
        np.add.at(pull, (graph.ravel(), part[sources]), 1)
        gain = pull - pull[np.arange(n), part][:, None]
        best = gain.argmax(axis=1)
        moved = 0
        waiting: dict[tuple[int, int], int] = {}
        for node in np.argsort(-gain.max(axis=1), kind="stable"):
            a, b = part[node], best[node]
            if gain[node, b] <= 0:
                break
            if sizes[b] < room:
                part[node], sizes[a], sizes[b] = b, sizes[a] - 1, sizes[b] + 1
                moved += 1
            elif (b, a) in waiting:
                other = waiting.pop((b, a))
                part[node], part[other] = b, a
                moved += 1
            else:
                waiting[(a, b)] = node
        if not moved:
            break
    return part


@dataclass
class Router:
    """Log odds of the parts: tanh layer over the unit vector, then a linear one."""

    layers: list[np.ndarray]
    searched: int

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Parts from the likeliest on."""
        return np.argsort(-self._odds(vectors), axis=1, kind="stable")

    def _odds(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        a, b, c, d = self.layers
        return np.tanh(unit @ a + b) @ c + d


def fit_router(vectors: np.ndarray, parts: int, seed: int = 11) -> Router:
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, len(vectors) // 2))
    if parts == 1:
        size = vectors.shape[1]
        return Router([np.zeros((size, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1)
    graph = neighbours(vectors, min(GRAPH_NEIGHBOURS, len(vectors) - 1))
    part = balanced_parts(graph, vectors, parts, rng)
    goal = np.zeros((len(vectors), parts))
    np.add.at(goal, (np.repeat(np.arange(len(vectors)), graph.shape[1]), part[graph.ravel()]), 1.0)
    goal[np.arange(len(vectors)), part] += graph.shape[1]
    goal /= goal.sum(axis=1, keepdims=True)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    layers = [rng.normal(0, 2, (vectors.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, parts)), np.zeros(parts)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in layers]
    for step in range(1, STEPS + 1):
        rows = rng.choice(len(unit), min(len(unit), 1_024), replace=False)
        x, y = unit[rows], goal[rows]
        hidden = np.tanh(x @ layers[0] + layers[1])
        odds = hidden @ layers[2] + layers[3]
        share = np.exp(odds - odds.max(axis=1, keepdims=True))
        slope = (share / share.sum(axis=1, keepdims=True) - y) / len(rows)
        back = (slope @ layers[2].T) * (1 - hidden**2)
        grads = [x.T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
        for i, grad in enumerate(grads):
            m, v = moments[i]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            layers[i] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    router = Router(layers, parts)
    order = router.order(vectors)
    asked = rng.choice(len(vectors), min(PROBE_ROWS, len(vectors)), replace=False)
    nearest = neighbours(vectors, min(TOP, len(vectors) - 1))[asked]
    place = np.argsort(order[asked], axis=1)
    depth = np.take_along_axis(place, order[:, 0][nearest], axis=1)
    recall = [(depth < m).mean() for m in range(1, parts + 1)]
    router.searched = 1 + int(np.argmax(np.array(recall) >= WANTED_RECALL))
    return router


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a finite, non-zero vector."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", e.cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & e.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0)
    )


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.stack([np.asarray(v, float) for v in column])


def _nearest(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """The TOP rows of a block for each query, from the parts that it asks for; equal vectors are scored once, by one and the same sum."""
    if rows.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    rows = rows.sort_values(["part", "vec_id"], kind="stable")
    vectors, first, copies = np.unique(_matrix(rows["embedding"]), axis=0, return_index=True, return_inverse=True)
    part = rows["part"].to_numpy()[first]
    by_part = np.argsort(part, kind="stable")
    vectors, part = vectors[by_part], part[by_part]
    place = np.empty(len(by_part), np.int64)
    place[by_part] = np.arange(len(by_part))
    copies = place[copies.ravel()]
    by_vector = np.argsort(copies, kind="stable")
    starts = np.searchsorted(copies[by_vector], np.arange(len(vectors) + 1))
    ids = rows["vec_id"].to_numpy()[by_vector]
    parts, begins = np.unique(part, return_index=True)
    ends = np.append(begins[1:], len(part))
    asked, names = _matrix(queries["embedding"]), queries["query_id"].to_numpy()
    wants = np.zeros((len(asked), len(parts)), bool)
    for q, own in enumerate(queries["parts"]):
        wants[q] = np.isin(parts, own)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, len(asked), 256):
        some = asked[begin : begin + 256]
        scores = np.full((len(some), len(vectors)), -np.inf)
        for k, (a, b) in enumerate(zip(begins, ends)):
            here = np.flatnonzero(wants[begin : begin + 256, k])
            scores[here, a:b] = some[here] @ vectors[a:b].T
        wanted = min(TOP + 1, len(vectors))
        least = np.partition(scores, -wanted, axis=1)[:, -wanted]
        for q, row in enumerate(scores):
            open_ = np.isfinite(row)
            if not open_.any():
                continue
            slack = 1e-9 * (1 + np.abs(row[open_]).max())
            near = np.flatnonzero(open_ & (row >= least[q] - slack))
            exact = (asked[begin + q] * vectors[near]).sum(axis=1)
            held = [ids[starts[v] : min(starts[v + 1], starts[v] + TOP + 1)] for v in near]
            found = np.concatenate(held)
            value = np.repeat(exact, [len(h) for h in held])
            other = found != names[begin + q]
            found, value = found[other], value[other]
            best = np.lexsort((found, -value))[:TOP]
            out.append((np.full(len(best), names[begin + q]), found[best], value[best]))
    if not out:
        return _nearest(key, rows.iloc[:0], queries)
    return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("query_id", "vec_id", "score"))})


def _groups(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each part its group and, of its own, the number of blocks: parts side by side up to BLOCK_ROWS rows, a larger one alone."""
    out: dict[int, tuple[int, int]] = {}
    group, held = 0, 0
    for part in sorted(sizes):
        if held and held + sizes[part] > BLOCK_ROWS:
            group, held = group + 1, 0
        out[part] = (group, max(1, -(-sizes[part] // BLOCK_ROWS)))
        held += sizes[part]
    return out


def search_neighbours(vectors: DataFrame, is_query: Column, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` picks, its nearest other rows.

    ``vectors`` has vec_id and embedding. Nearness is the inner product in double
    precision; equal scores rank by smaller vec_id; fewer than ``top`` candidates
    give all of them. Vectors that are null, zero, or hold null or non-finite
    components take no part; vectors of several widths only meet their like, each
    width with parts of its own. A repeated vec_id is one query, and none of its
    rows is a candidate of it.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # Widths are a handful; each is a table of its own.
    widths = usable.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).orderBy("w").collect()
    found = [_search(usable.where(F.size("embedding") == r["w"]), r["n"], is_query) for r in widths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scored = found[0]
    for other in found[1:]:
        scored = scored.union(other)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, top)
    ranked = scored.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("i", "b"))
    return ranked.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def _search(usable: DataFrame, total: int, is_query: Column) -> DataFrame:
    """query_id, vec_id, score of the best rows of each block that a query asks for."""
    context = usable.sparkSession.sparkContext
    parts = min(max(LEAST_PARTS, total // ROWS_PER_PART), MOST_PARTS, max(1, total // SMALL_PART))
    sample = first_in_hash_order(usable, "vec_id", max(LEAST_SAMPLE, PART_SAMPLE * parts)).collect()
    fitted = fit_router(np.array([r["embedding"] for r in sample]), parts) if len(sample) > 1 else None
    router = context.broadcast(fitted)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = router.value.order(_matrix(batch.column(1)))[:, 0] if router.value else np.zeros(batch.num_rows, int)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32))], names=["vec_id", "embedding", "part"])

    scratch = Scratch(usable.sparkSession, "neighbours")
    filed = scratch.keep(usable.mapInArrow(file, "vec_id long, embedding array<double>, part int"), "filed")
    # One row a part, at most MOST_PARTS.
    groups = _groups({r["part"]: r["n"] for r in filed.groupBy("part").agg(F.count("*").alias("n")).collect()})
    dealt = context.broadcast(groups)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = router.value.order(_matrix(batch.column(1)))[:, : router.value.searched] if router.value else np.zeros((batch.num_rows, 1), int)
            sent = []
            for own in order.tolist():
                by_group: dict[tuple[int, int], list[int]] = {}
                for part in own:
                    if part in dealt.value:
                        by_group.setdefault(dealt.value[part], []).append(part)
                sent.append([{"grp": g, "blocks": b, "parts": p} for (g, b), p in by_group.items()])
            kind = pa.list_(pa.struct([("grp", pa.int32()), ("blocks", pa.int32()), ("parts", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sent, kind)], names=["query_id", "embedding", "sent"])

    queries = usable.where(is_query).dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "query_id")
    across = max(1, -(-queries.count() // BLOCK_QUERIES))
    routed = queries.mapInArrow(route, "query_id long, embedding array<double>, sent array<struct<grp:int,blocks:int,parts:array<int>>>")
    asked = routed.select("query_id", "embedding", F.explode("sent").alias("s")).select(
        F.col("s.grp").alias("grp"),
        F.explode(F.sequence(F.lit(0), F.col("s.blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("int").alias("side"),
        "query_id",
        "embedding",
        F.col("s.parts").alias("parts"),
    )
    places = usable.sparkSession.createDataFrame([(part, g, n) for part, (g, n) in groups.items()], "part int, grp int, blocks int")
    rows = filed.join(F.broadcast(places), "part").select(
        "grp",
        F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("side"),
        "part",
        "vec_id",
        "embedding",
    )
    keys = ["grp", "block", "side"]
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_nearest, "query_id long, vec_id long, score double")
