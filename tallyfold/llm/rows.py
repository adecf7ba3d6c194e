"""Row-wise operators over whole texts: each text goes to Python once, with the columns that stay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows worked on at once.
CHUNK_ROWS = 500

Compute = Callable[[list[str | None]], list[tuple]]


def with_computed(docs: DataFrame, schema: StructType, start: Callable[[], Compute], keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns of ``schema``, which ``start()`` (called once a task) computes from the texts of a chunk.

    It gives a tuple for each text. Columns named like an added one are replaced,
    all others pass through whatever their names; text too, unless it isn't kept.
    """
    added = schema.fieldNames()
    kept = [c for c in docs.columns if c not in added or c == "text"]
    text = kept.index("text")
    back = [i for i, c in enumerate(kept) if i != text or keep_text]
    names = [f"c{i}" for i in back] + [f"a{i}" for i in range(len(added))]
    kinds = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(begin, CHUNK_ROWS)
                columns = zip(*compute(part.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in back] + [pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    sent = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    result = StructType([sent.schema[f"c{i}"] for i in back])
    for i, field in enumerate(schema):
        result = result.add(f"a{i}", field.dataType)
    out = sent.mapInArrow(run, result)
    return out.select(*[F.col(f"c{i}").alias(kept[i]) for i in back], *[F.col(f"a{i}").alias(name) for i, name in enumerate(added)])
