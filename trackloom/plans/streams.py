"""Streaming queries: the events table as a stream that is worked off until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequencing
from ..session import new_path, table
from ..sinks.batches import append_batch, read_batches
from ..streaming import incremental, sessions, tracker
from .frames import DAY0, EVENT_TRACKS, _sequence
from .sequencing import SQL as SEQUENCING


def _stream(spark, sf_dir):
    # the file source wants a pattern where the table is one file; all files are one micro-batch, as their rows are
    # in no order of time across files and a second batch would meet the first one's watermark
    return sessions.frames_stream(spark, table(spark, sf_dir, "events").schema, f"{sf_dir}/event[s].parquet", None)


def _worked_off(spark, df, name, mode):
    out = new_path(spark, name)
    sessions.run_available(df, lambda batch, number: append_batch(batch, number, out), new_path(spark, f"{name}-state"), mode).awaitTermination()
    return read_batches(spark, out, df.schema, mode == "complete")


def stream_sequences(spark, sf_dir):
    """Sequences by session windows on the stream, all of them at its end."""
    x = _worked_off(spark, sessions.sequences(_stream(spark, sf_dir), "event_type", "ts"), "stream-sequences", "complete")
    return x.select("event_type", "day", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_time", "end_time")), "frame_count")


def stream_daily(spark, sf_dir):
    """Frames of each UTC day."""
    x = _worked_off(spark, sessions.daily(_stream(spark, sf_dir), "event_type", "ts"), "stream-daily", "complete")
    return x.select("event_type", F.to_date("day").alias("day"), "frame_count")


def stream_first_of_time(spark, sf_dir):
    """One event of each type and hour: duplicates within the watermark go."""
    e = _stream(spark, sf_dir).select("event_type", F.date_trunc("hour", "ts").alias("hour"))
    x = _worked_off(spark, sessions.first_of_time(e, ["event_type"], "hour"), "stream-first", "append")
    return x.select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"))


def _hourly(events):
    """Events as detections, hours as frames."""
    return events.select((_sequence(F.col("event_type")) * 100_000 + F.datediff("ts", F.lit(DAY0))).alias("sequence_id"), F.date_trunc("hour", "ts").alias("ts"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))


def stream_tracker(spark, sf_dir):
    """Closed tracks of the stateful tracker, hours as frames."""
    e = _hourly(_stream(spark, sf_dir))
    x = _worked_off(spark, tracker.tracks(e, EVENT_TRACKS), "stream-tracker", "append")
    return x.select("sequence_id", F.timestamp_seconds("start").alias("start_time"), "n_frames", F.get("xs", F.lit(0)).alias("first_x"), F.element_at("xs", -1).alias("last_x"))


def _in_batches(spark, rows, ts, late, batches):
    """A folder with a file a micro-batch, and how late rows come at most: rows by time, every so many-th one batch late, and two rows far ahead, which close all."""
    at, (first, last) = new_path(spark, "arrivals"), rows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    span = max(1, last - first + 1) if last is not None else 1
    turn = F.floor((F.unix_micros(ts) - (first or 0)) * batches / span) + F.when(F.col("image_id") % late == 0, 1).otherwise(0)
    x = rows.withColumn("_turn", turn)
    for k in range(batches + 1):
        x.where(F.col("_turn") == k).drop("_turn").coalesce(1).write.parquet(f"{at}/{k}")
    for k in (1, 2):
        ahead = [(-k, None, ((last or 0) + k * 10 * span) / 1e6)]
        spark.createDataFrame(ahead, "image_id long, instrument string, s double").select("image_id", "instrument", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{at}/{batches + k}")
    return at, f"{2 * span // batches // 1_000_000 + 2} seconds"


def stream_extend(spark, sf_dir):
    """The incremental assignment of all events in several micro-batches with late rows: what the assignment in one go gives."""
    e = table(spark, sf_dir, "events")
    old = sequencing.sequences(e.withColumn("instrument", F.lit("all")).where("event_type = 'purchase'"), "instrument", "ts", "event_id")
    old = old.select((F.datediff("day", F.lit(DAY0)) * 1000 + F.col("seq")).alias("sequence_id"), "instrument", "start_time", "end_time")
    rows = e.select(F.col("event_id").alias("image_id"), F.lit("all").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"))
    at, lateness = _in_batches(spark, rows, F.col("ts"), 7, 4)
    arriving = sessions.frames_stream(spark, rows.schema, f"{at}/*", 1)
    x = _worked_off(spark, incremental.extend(arriving, old, lateness=lateness), "stream-extend", "append")
    return x.where("instrument is not null").select("image_id", "sequence_id", "opened")


QUERIES = {q.__name__: q for q in (stream_sequences, stream_daily, stream_first_of_time, stream_tracker, stream_extend)}
SQL = {
    "stream_sequences": SEQUENCING["seq_session_window"],
    "stream_daily": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS frame_count FROM events GROUP BY 1, 2",
    "stream_first_of_time": "SELECT DISTINCT event_type, date_trunc('hour', ts) AS hour FROM events",
    "stream_extend": SEQUENCING["seq_extend"],
}
