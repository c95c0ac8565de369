"""JSON documents and text lists, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import observation_time, with_event
from ..schemas import LABELS, MANIFEST_ENTRY


def labels(spark: SparkSession, path: str) -> DataFrame:
    """The labels document, one row."""
    return spark.read.schema(LABELS).json(path, multiLine=True)


def day_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Entries of day manifests (JSON maps from name to entry; any glob): name, the entry's fields, observation_time, path."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"map<string,{MANIFEST_ENTRY}>").alias("m"))
    x = raw.select("path", F.explode("m").alias("name", "e")).select("path", "name", "e.*")
    return x.withColumn("observation_time", observation_time(F.col("date_obs")))


def confirmation_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events of a list, and its other lines that are not blank."""
    x = with_event(spark.read.text(path).where(F.trim("value") != ""), "value")
    return x.where("e is not null").select("e.*"), x.where("e is null").select(F.rtrim("value").alias("line"))


def stage_document(spark: SparkSession, path: str, entry: str, field: str = "frames") -> DataFrame:
    """Entries of a stage's manifest (a JSON document whose ``field`` maps names to entries): path, config_hash, name, the entry's fields."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"struct<config_hash:string,`{field}`:map<string,{entry}>>").alias("d"))
    return raw.select("path", "d.config_hash", F.explode(f"d.{field}").alias("name", "e")).select("path", "config_hash", "name", "e.*")


def frame_times(frames: DataFrame, sources: DataFrame, manifests: DataFrame) -> DataFrame:
    """Frames (name) with their time, by way of the source each was made from; one without a time is an error."""
    x = frames.join(sources.select("name", "source"), "name", "left").join(manifests.select(F.col("name").alias("source"), "observation_time"), "source", "left")
    return x.withColumn("observation_time", F.when(F.col("observation_time").isNull(), F.raise_error(F.concat(F.lit("no time for "), F.col("name")))).otherwise(F.col("observation_time")))
