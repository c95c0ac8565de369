"""Sequences on a stream of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frames_stream(spark: SparkSession, schema, path: str, files_per_batch: int | None = 1, **options) -> DataFrame:
    """The files that come, so many a micro-batch; None is all that are there."""
    if files_per_batch is not None:
        options["maxFilesPerTrigger"] = files_per_batch
    return spark.readStream.schema(schema).options(**options).parquet(path)


def sequences(frames: DataFrame, key: str, ts: str, gap_minutes: float = 60.0, lateness: str = "2 hours") -> DataFrame:
    """Sequences of an instrument and UTC day by session windows; a frame up to ``lateness`` late still joins one.

    The watermark needs a TIMESTAMP, so times without zone are cast.
    """
    x = frames.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", lateness)
    g = x.groupBy(key, F.to_date("_t").alias("day"), F.session_window("_t", f"{int(gap_minutes * 60)} seconds"))
    return g.agg(F.min("_t").alias("start_time"), F.max("_t").alias("end_time"), F.count(F.lit(1)).alias("frame_count")).drop("session_window")


def daily(frames: DataFrame, key: str, ts: str, lateness: str = "1 day") -> DataFrame:
    """Frames of each UTC day: tumbling windows."""
    x = frames.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", lateness)
    return x.groupBy(key, F.window("_t", "1 day")).agg(F.count(F.lit(1)).alias("frame_count")).select(key, F.col("window.start").alias("day"), "frame_count")


def first_of_time(frames: DataFrame, keys: list[str], ts: str, lateness: str = "2 hours") -> DataFrame:
    """One frame of each time, within the watermark."""
    return frames.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([*keys, ts])


def run_available(df: DataFrame, sink, checkpoint: str, mode: str = "append"):
    """Works off what has arrived and stops; ``sink`` takes (batch, number). Restarting goes on where it left off."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
