"""Writers: partitioned tables, ledgers of finished work, documents, filmstrips."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import png
from ..operators.scoring import stack_of
from ..operators.upserts import latest


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames by sequence; only the sequences present are replaced."""
    frames.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sequence_id").parquet(path)


def append_ledger(entries: DataFrame, path: str) -> None:
    """Manifest entries are appended; the newest of a name counts."""
    entries.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str, keys: list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return latest(reader.parquet(path), keys, "recorded_at")


def pending(work: DataFrame, ledger: DataFrame, keys: list[str], config_hash: str) -> DataFrame:
    """Work that the ledger does not have with this configuration: makes every stage resumable."""
    done = ledger.where((F.col("config_hash") == config_hash) & (F.col("status") != "failed")).select(*keys)
    return work.join(done, keys, "left_anti")


def stage_summary(entries: DataFrame, by: str = "status") -> DataFrame:
    return entries.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def filmstrips(stacks: DataFrame, scale: int = 4) -> DataFrame:
    """track_id, png of each crop stack."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"track_id": part.track_id, "png": [png.filmstrip(stack_of(c, s), scale) for c, s in zip(part.crops, part.crop_size, strict=True)]})

    return stacks.select("track_id", "crops", "crop_size").mapInPandas(run, "track_id string, png binary")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def located(spark: SparkSession, path: str):
    """The Hadoop file system and path, so documents may lie wherever Spark reads them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = located(spark, path)
    return fs.exists(at)


def write_document(document: DataFrame, path: str) -> None:
    """The one row of a document as one JSON file, in place of what is there. No checksum file: people edit such files by hand."""
    (row,) = document.select(F.to_json(F.struct("*")).alias("text")).collect()
    fs, at = located(document.sparkSession, path)
    fs.setWriteChecksum(False)
    try:
        out = fs.create(at, True)
        out.write(bytearray(row.text.encode()))
        out.close()
    finally:
        fs.setWriteChecksum(True)


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """To a relational database, where its driver is on the class path."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
