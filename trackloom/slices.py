"""Python stages over rows that hold pixels: they take and give rows in slices of some megabytes.

Spark hands Python up to 64 MB of rows at a time, and a stage that makes a list of its rows and another of what it makes of them
holds several times that. Here a task holds Spark's batch, as it came, and a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MANY, SIZE = 64, 1 << 22


def cut(batch: pa.RecordBatch, many: int = MANY, size: int = SIZE) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``many`` rows and, as its rows are on average, ``size`` bytes; a row at least."""
    rows = max(1, min(many, batch.num_rows * size // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def together(rows: Iterable[dict], many: int = MANY, size: int = SIZE) -> Iterator[list[dict]]:
    """Rows in lists of at most ``many``, cut where their binary values pass ``size`` bytes."""
    held, taken = [], 0
    for r in rows:
        held.append(r)
        taken += sum(len(v) for v in r.values() if isinstance(v, bytes))
        if len(held) >= many or taken >= size:
            yield held
            held, taken = [], 0
    if held:
        yield held


def map_rows(df: DataFrame, run: Callable[[Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """``run`` takes a partition's rows one after the other and gives rows of ``schema``; what it gives as NaN is null."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for piece in cut(b) for r in piece.to_pylist())
        for held in together(run(rows)):
            held = [{c: None if v != v else v for c, v in r.items()} for r in held]
            yield pa.RecordBatch.from_pylist(held, schema=kind)

    return df.mapInArrow(worked, schema)
