"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_path, shared_dir, stored, table, written

__all__ = ["BATCH_ROWS", "WORD", "new_path", "recut", "row_hash", "runs", "seeded", "shared_dir", "stored", "table", "text_bytes", "tokenizer_path", "written"]

#: Words of every operator here: maximal runs without ASCII white space. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]++"

#: Rows and bytes of the slices in which Python stages work. Spark's own batches are of up to 10,000 rows and 64 MB.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def recut(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most so many rows and bytes, without a copy; a row that is larger comes alone, and no slice is empty."""
    for b in batches:
        yield from halved(b, rows, size)
        del b
        pa.default_memory_pool().release_unused()


def halved(b: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    if b.num_rows > rows or b.num_rows > 1 and b.nbytes > size:
        half = b.num_rows // 2
        yield from halved(b.slice(0, half), rows, size)
        yield from halved(b.slice(half), rows, size)
    elif b.num_rows:
        yield b


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Sorted batches cut anew, so that rows that agree in the first ``keys`` columns are together; with the places where such runs start."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.concat_batches([held, b]) if held is not None else b
        edge = np.zeros(b.num_rows - 1, bool)
        for k in range(keys):
            x = b.column(k).to_numpy(zero_copy_only=False)
            edge |= x[1:] != x[:-1]
        starts = [0, *(np.flatnonzero(edge) + 1).tolist()]
        if len(starts) > 1:
            yield b.slice(0, starts[-1]), starts[:-1]
        held = b.slice(starts[-1])
    if held is not None:
        yield held, [0]


def text_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8", "replace")


def seeded(seed: int, *cols: Column) -> Column:
    """A reproducible 60-bit number for the columns' text, the same in any SQL engine that has md5."""
    parts = [F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in cols)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def row_hash(df: DataFrame) -> Column:
    """A hash of a row's columns, but for those that Spark cannot hash and those that share a name: an order for rows that agree otherwise."""
    plain = [f.name for f in df.schema if df.columns.count(f.name) == 1 and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(*(F.col(f"`{n.replace('`', '``')}`") for n in plain))


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed public tokenizers; an existing path is taken as it is."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
