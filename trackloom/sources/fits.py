"""FITS files as rows: by the binary-file source, or as a Python data source named ``fits``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import observation_time
from ..kernels import fits
from ..slices import map_rows

FRAME = "path string, height int, width int, dtype string, data binary, date_obs string, telescope string, detector string, instrument string, exposure_seconds double, filter_name string, polarizer string, sun_x double, sun_y double, plate_scale_arcsec double, roll_deg double, binning_x int, binning_y int, header map<string,string>, error string"
NAMES = [c.split()[0] for c in FRAME.split(", ")]


def decoded(path: str, content: bytes) -> dict:
    """A frame's row; a bad file gives its path and error alone."""
    try:
        r = fits.read_image(content)
        return {**dict.fromkeys(NAMES), **r, "path": path, "data": r["data"].tobytes()}
    except fits.FitsError as e:
        return {**dict.fromkeys(NAMES), "path": path, "error": str(e)}


def decode(files: DataFrame) -> DataFrame:
    """(path, content) to frames with ``ts``; files that hold no frame, or whose time cannot be read, carry an error."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            d = decoded(r["path"], r["content"])
            yield d | {"header": None if d["header"] is None else list(d["header"].items())}

    x = map_rows(files.select("path", "content"), run, FRAME).withColumn("ts", observation_time(F.col("date_obs")))
    return x.withColumn("error", F.coalesce("error", F.when(F.col("ts").isNull(), "unparseable observation time")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all .fts and .fits files under a path that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{fts,fits,FTS,FITS}").load(path)
    return decode(files)


def read_dimensions(files: DataFrame) -> DataFrame:
    """path, width, height of each file's first array, null where there is none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            size = [fits.dimensions(bytes(c)) for c in part.content]
            yield pd.DataFrame({"path": part.path, "width": pd.array([w for w, _ in size], "Int32"), "height": pd.array([h for _, h in size], "Int32")})

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int")


class FitsDataSource(DataSource):
    """spark.dataSource.register(FitsDataSource); spark.read.format("fits").load(folder): one partition a file.

    The folder must be one that pyarrow's file systems reach from driver and executors.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> DataSourceReader:
        return FitsReader(self.options["path"])


class FitsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.lower().endswith((".fts", ".fits"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        with store.open_input_stream(partition.value, compression=None) as f:
            row = decoded(partition.value, f.read())
        yield tuple(row[n] for n in NAMES)
