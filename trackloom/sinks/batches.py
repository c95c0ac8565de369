"""A table of micro-batches, each committed once by its number.

A batch is written to a folder of its own name; a small file named by the batch's number, which can be made only once,
says which folder counts. A batch that is replayed after its commit is not written again; one that was written but not
committed leaves a folder that no reader sees and the next commit of its number removes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard
from .merged import names_in, write_once


def _name(number: int) -> str:
    return f"{number:012d}"


def committed(spark: SparkSession, path: str) -> dict[int, str]:
    """The folders that count, by batch number."""
    if not names_in(spark, f"{path}/_batches"):
        return {}
    rows = spark.read.text(f"{path}/_batches/*").select("value", F.col("_metadata.file_name").alias("name")).collect()
    return {int(r.name): f"{path}/{r.value}" for r in rows}


def write_batch(batch: DataFrame, number: int, path: str) -> str:
    """Writes a batch's rows to a folder that does not count yet; its name."""
    folder = f"rows-{_name(number)}-{uuid.uuid4().hex}"
    batch.write.parquet(f"{path}/{folder}")
    return folder


def commit_batch(spark: SparkSession, number: int, path: str, folder: str) -> bool:
    """Makes a written folder the batch's; False where the number has one already."""
    if not write_once(spark, f"{path}/_batches/{_name(number)}", folder):
        discard(spark, f"{path}/{folder}")
        return False
    for name in names_in(spark, path):
        if name.startswith(f"rows-{_name(number)}-") and name != folder:
            discard(spark, f"{path}/{name}")
    return True


def append_batch(batch: DataFrame, number: int, path: str) -> bool:
    """For foreachBatch: the batch's rows once, however often it comes."""
    spark = batch.sparkSession
    if _name(number) in names_in(spark, f"{path}/_batches"):
        return False
    return commit_batch(spark, number, path, write_batch(batch, number, path))


def read_batches(spark: SparkSession, path: str, schema, newest: bool = False) -> DataFrame:
    """Rows of all committed batches, or of the newest alone (a complete result's). No batch, no rows."""
    found = committed(spark, path)
    folders = [found[k] for k in sorted(found)][-1 if newest else 0 :]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
