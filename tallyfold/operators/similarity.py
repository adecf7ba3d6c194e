"""Pairs of vectors whose cosine reaches a floor, exactly, without comparing all pairs.

Vectors are unit directions. A bounded number of pivots cuts the table into cells;
a cell knows the largest angle between its pivot and a member. Two directions whose
cosine reaches the floor are at most ``acos(floor)`` apart, so by the triangle
inequality a vector can only meet a member of another cell if its angle to that
cell's pivot is at most this and the cell's radius; it is sent to no other cell.
Cells are cut into slices of a bounded size, and two slices meet in a task of their
own. There a part of the coordinates, those with the most weight, is multiplied
first: what the others can add is bounded by their norms, and only pairs that can
still reach the floor are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..scratch import Scratch

#: Vectors of a slice, and the fewest and most cells of a table.
SLICE_ROWS, FEWEST_CELLS, MOST_CELLS = 16_000, 8, 256
#: The share of coordinates that is multiplied first, and rows of a tile of the product.
FIRST_SHARE, TILE_ROWS = 0.5, 256
#: Where more of a tile than this share may reach the floor, the tile is multiplied in full.
DENSE_SHARE = 0.02
#: Pairs compared in full at once.
PAIRS_AT_ONCE = 1 << 13
#: Covers rounding: nothing is left out for being this close to a bound.
MARGIN = 1e-7
#: Of a product of two unit vectors in single precision, for each coordinate.
SINGLE_ROUNDING = 2.0**-23


def _meetings(cells: np.ndarray, angles: np.ndarray, radii: np.ndarray, slices: np.ndarray, homes: np.ndarray, places: np.ndarray, reach: float) -> list[list[dict]]:
    """For each row the pairs of slices it takes part in; ``first`` says on which side."""
    out = []
    near = angles <= radii + reach + MARGIN
    for home, place, row in zip(homes, places, near):
        meets = []
        for other in np.flatnonzero(row | (cells == home)):
            for slice_ in range(slices[other]):
                mine, theirs = (int(home), int(place)), (int(other), slice_)
                low, high = min(mine, theirs), max(mine, theirs)
                meets.append({"c": low[0], "s": low[1], "d": high[0], "t": high[1], "first": mine == low})
        out.append(meets)
    return out


def _compare(left: pd.DataFrame, right: pd.DataFrame | None, same_type: float, cross_type: float) -> Iterator[tuple[pd.DataFrame, int, int]]:
    """Of two slices (of one with itself if there is no right one), tile by tile: pairs that reach the floor, pairs that met, and pairs compared in full."""
    whole = [np.stack([np.frombuffer(v) for v in side["vector"]]) for side in (left, left if right is None else right)]
    norms = [side["norm"].to_numpy() for side in (left, left if right is None else right)]
    units = [v / n[:, None] for v, n in zip(whole, norms)]
    weight = np.square(units[0]).sum(axis=0) + np.square(units[1]).sum(axis=0)
    order = np.argsort(-weight)
    first = order[: max(1, int(len(order) * FIRST_SHARE))]
    heads = [u[:, first].astype(np.float32) for u in units]
    rests = [np.sqrt(np.maximum(0.0, 1.0 - np.square(u[:, first]).sum(axis=1))).astype(np.float32) for u in units]
    units = [u.astype(np.float32) for u in units]
    ids = [(left if s == 0 or right is None else right)["id"].to_numpy() for s in (0, 1)]
    kinds = [(left if s == 0 or right is None else right)["kind"].to_numpy() for s in (0, 1)]
    none = pd.DataFrame({"a": [], "b": [], "sim": [], "same": []})
    # Single precision only says which pairs are compared; the margin covers its rounding over all coordinates.
    floor = np.float32(min(same_type, cross_type) - MARGIN - (len(order) + 8) * SINGLE_ROUNDING)
    dense = False
    for begin in range(0, len(heads[0]), TILE_ROWS):
        rows = slice(begin, begin + TILE_ROWS)
        # Of a slice with itself only the columns from the tile on; the tile's own are halved below.
        start = begin if right is None else 0
        if not dense:
            bound = heads[0][rows] @ heads[1][start:].T
            bound += rests[0][rows, None] * rests[1][start:]
            able = bound >= floor
            dense = np.count_nonzero(able) > DENSE_SHARE * able.size
        # Where one tile is dense, the others are taken to be, and the bound isn't tried again.
        compared = None
        if dense:
            able = units[0][rows] @ units[1][start:].T >= floor
        else:
            compared = int(np.count_nonzero(able))
        if right is None:
            able[:, : len(able)] = np.triu(able[:, : len(able)], 1)
            here = sum(able.shape[1] - 1 - i for i in range(len(able)))
            compared = here if compared is None else int(np.count_nonzero(able))
        else:
            here = able.size
            compared = here if compared is None else compared
        yield none, here, compared
        i, j = np.divmod(np.flatnonzero(able), able.shape[1])
        for at in range(0, len(i), PAIRS_AT_ONCE):
            x, y = i[at : at + PAIRS_AT_ONCE] + begin, j[at : at + PAIRS_AT_ONCE] + start
            # Summed in the order of the coordinates, as a plan over arrays sums them.
            sim = np.cumsum(whole[0][x] * whole[1][y], axis=1)[:, -1] / (norms[0][x] * norms[1][y])
            same = kinds[0][x] == kinds[1][y]
            good = (sim >= np.where(same, same_type, cross_type)) & (ids[0][x] != ids[1][y])
            a, b = ids[0][x[good]], ids[1][y[good]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": sim[good], "same": same[good]}), 0, 0


def cosine_join(vectors: DataFrame, same_type: float, cross_type: float, slice_rows: int = SLICE_ROWS, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b (a, b, sim, same) whose cosine reaches the floor of their kinds, and what it took (pairs, met, compared).

    ``vectors`` has id, kind, vector; the floors must be above 0. Null ids, kinds and
    vectors, zero vectors and those with null or non-finite components give no pair;
    of vectors of several lengths the shorter counts as followed by zeros. Rows of
    one id give no pair with each other. ``met`` counts the pairs of slices that came
    together, ``compared`` those multiplied in all coordinates, ``pairs`` all pairs of the table.
    """
    if min(same_type, cross_type) <= 0:
        raise ValueError("the floors of the cosine must be above 0")
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "cosine")
    id_type, kind_type = (vectors.schema[c].dataType for c in ("id", "kind"))
    rows = vectors.select("id", "kind", F.col("vector").cast("array<double>").alias("vector")).where("id IS NOT NULL AND kind IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    count, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    schema = StructType().add("a", id_type).add("b", id_type)
    for field in StructType.fromDDL("sim double, same boolean, met long, compared long"):
        schema = schema.add(field)
    if not count:
        empty = spark.createDataFrame([], schema)
        return empty.select("a", "b", "sim", "same"), spark.createDataFrame([(0, 0, 0)], "pairs long, met long, compared long")
    cells = min(MOST_CELLS, max(FEWEST_CELLS, 2 * -(-count // slice_rows)))
    # A bounded number of rows, the same ones whatever the partitions.
    picked = [r["vector"] for r in rows.select("vector").orderBy(F.xxhash64("id"), "id", "vector").limit(cells).collect()]
    pivots = np.stack([np.pad(v, (0, dims - len(v))) for v in map(np.array, picked)])
    pivots = pivots / np.linalg.norm(pivots, axis=1)[:, None]

    placed_schema = StructType().add("id", id_type).add("kind", kind_type)
    for field in StructType.fromDDL("vector binary, norm double, cell int, angle double"):
        placed_schema = placed_schema.add(field)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            if (lists.value_lengths().to_numpy() == dims).all():
                whole = lists.flatten().to_numpy().reshape(len(lists), dims)
            else:
                whole = np.stack([np.pad(np.array(v, np.float64), (0, dims - len(v))) for v in lists.to_pylist()])
            norm = np.sqrt(np.cumsum(np.square(whole), axis=1)[:, -1])
            near = np.clip((whole / norm[:, None]) @ pivots.T, -1, 1)
            cell = near.argmax(axis=1)
            angle = np.arccos(near[np.arange(len(near)), cell])
            arrays = [batch.column(0), batch.column(1), pa.array([v.tobytes() for v in whole], pa.binary()), pa.array(norm), pa.array(cell.astype(np.int32)), pa.array(angle)]
            yield pa.RecordBatch.from_arrays(arrays, schema=to_arrow_schema(placed_schema))

    placed = scratch.keep(rows.mapInArrow(place, placed_schema), "placed")
    radii, slices = np.full(len(pivots), -np.inf), np.zeros(len(pivots), int)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():
        radii[r["cell"]], slices[r["cell"]] = r["radius"], -(-r["n"] // slice_rows)
    reach = float(np.arccos(min(1.0, same_type, cross_type)))
    meets_schema = StructType.fromDDL(placed_schema.simpleString()[7:-1] + ", meets array<struct<c: int, s: int, d: int, t: int, first: boolean>>")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.stack([np.frombuffer(v) for v in batch.column("vector").to_pylist()])
            near = np.arccos(np.clip((whole / batch.column("norm").to_numpy()[:, None]) @ pivots.T, -1, 1))
            homes, places = batch.column("cell").to_numpy(), batch.column("place").to_numpy()
            meets = _meetings(np.arange(len(pivots)), near, radii, slices, homes, places, reach)
            kept = [batch.column(i) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(meets, to_arrow_schema(meets_schema).field("meets").type)], schema=to_arrow_schema(meets_schema))

    counts = F.array(*[F.lit(int(n)) for n in slices])
    dealt = placed.withColumn("place", F.pmod(F.xxhash64("id"), F.greatest(F.get(counts, F.col("cell")), F.lit(1))).cast("int"))
    sent = dealt.mapInArrow(meet, meets_schema).select("id", "kind", "vector", "norm", F.explode("meets").alias("m")).select("id", "kind", "vector", "norm", "m.*")

    out_schema = to_arrow_schema(schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).to_pandas()
        one = group.iloc[0]
        if (one["c"], one["s"]) == (one["d"], one["t"]):
            sides = group, None
        else:
            sides = group[group["first"]], group[~group["first"]]
            if not len(sides[0]) or not len(sides[1]):
                return
        met, compared = 0, 0
        # Pairs leave tile by tile, so that a task holds two slices and one tile whatever they come to.
        for found, here, whole in _compare(*sides, same_type, cross_type):
            met, compared = met + here, compared + whole
            if len(found):
                columns = [pa.array(found[c], out_schema.field(c).type, from_pandas=False) for c in ("a", "b", "sim", "same")]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(found), pa.int64())] * 2], schema=out_schema)
        # One more row tells what the group took.
        yield pa.RecordBatch.from_pylist([{"met": met, "compared": compared}], schema=out_schema)

    joined = scratch.keep(sent.groupBy("c", "s", "d", "t").applyInArrow(compare, schema), "joined")
    work = joined.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    return joined.where("a IS NOT NULL").select("a", "b", "sim", "same"), work.select(F.lit(count * (count - 1) // 2).alias("pairs"), "met", "compared")
