"""Arrays of npz files as rows."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARRAY = "path string, name string, dtype string, shape array<int>, data binary, error string"


def decode(files: DataFrame) -> DataFrame:
    """(path, content) to a row an array; a file that cannot be read is one row with its error."""

    def arrays(path: str, content: bytes) -> list[tuple]:
        try:
            with np.load(io.BytesIO(content), allow_pickle=False) as z:
                return [(path, n, a.dtype.str, list(a.shape), np.ascontiguousarray(a).tobytes(), None) for n, a in z.items()]
        except Exception as e:  # whatever a broken file makes the reader raise
            return [(path, None, None, None, None, f"{type(e).__name__}: {e}")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, c in zip(part.path, part.content, strict=True):
                yield pd.DataFrame(arrays(p, bytes(c)), columns=[x.split()[0] for x in ARRAY.split(", ")])

    return files.select("path", "content").mapInPandas(run, ARRAY)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of all .npz files under a path that Spark can read."""
    return decode(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path))


def array_of(row) -> np.ndarray:
    return np.frombuffer(row.data, row.dtype).reshape(row.shape)


def stacks(arrays: DataFrame) -> DataFrame:
    """Crop stacks of files that hold ``crops``: track_id (the file's name), crop_size, crops as 32-bit floats."""
    x = arrays.where("name = 'crops' and dtype = '<f4' and size(shape) = 3")
    return x.select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("track_id"), F.get("shape", F.lit(1)).alias("crop_size"), F.col("data").alias("crops"))
