"""Sequences: runs of one instrument's frames within a UTC day, without gaps beyond a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seconds

GAP_MINUTES = 60.0


def sessionise(frames: DataFrame, key: str, ts: str, tie: str, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Adds ``day`` and ``seq`` (from 1 within key and day), in place of columns of these names. A gap of exactly the limit does not part.

    Rows without a time are a sequence of their own a row, on no day; of equal times the smaller ``tie`` comes first; repeated
    rows each count; no rows give none.

    Days are parted anyway, so (key, day) is the window's partition: an instrument's years never meet in one task.
    """
    x = frames.withColumn("day", F.to_date(ts))
    w = Window.partitionBy(key, "day").orderBy(ts, tie)
    since = seconds(F.col(ts)) - seconds(F.lag(ts).over(w))
    new = F.when(since <= gap_minutes * 60, 0).otherwise(1)
    return x.withColumn("_new", new).withColumn("seq", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def fold(frames: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """start_time, end_time, frame_count of each group."""
    return frames.groupBy(*keys).agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.count(F.lit(1)).alias("frame_count"))


def sequences(frames: DataFrame, key: str, ts: str, tie: str, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Whole rebuild: one row a sequence. The fold reuses the window's partitioning."""
    return fold(sessionise(frames, key, ts, tie, gap_minutes), [key, "day", "seq"], ts)


def sequences_by_session_window(frames: DataFrame, key: str, ts: str, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """The same by the built-in session window; also of use on streams."""
    x = frames.withColumn("_t", F.col(ts).cast("timestamp")).withColumn("day", F.to_date(ts))
    x = x.groupBy(key, "day", F.session_window("_t", f"{int(gap_minutes * 60)} seconds"))
    return x.agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.count(F.lit(1)).alias("frame_count")).drop("session_window")


def ungrouped(images: DataFrame) -> Column:
    """Images that await a sequence."""
    return F.col("sequence_id").isNull() & (F.col("ingestion_status") == "complete") & F.col("observation_time").isNotNull()


def grouping_counts(images: DataFrame) -> DataFrame:
    """How many images await a sequence, and how many are skipped."""
    waits = F.coalesce(ungrouped(images), F.lit(False))
    return images.agg(F.count_if(waits).alias("waiting"), F.count_if(~waits).alias("skipped"))


def attach(frames: DataFrame, built: DataFrame, frame_key: list[str], instrument: str, ts: str, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Frames with the earliest sequence of their instrument and day whose window, widened by the gap, holds their time; null columns if none does.

    An equi-join on (instrument, day of the sequence's start) with a range condition, then the first by start.
    """
    gap = F.expr(f"interval {int(gap_minutes * 60)} seconds")
    f = frames.withColumn("_day", F.to_date(ts)).alias("f")
    s = built.select(F.col(instrument).alias("_instrument"), F.to_date("start_time").alias("_start_day"), "start_time", "end_time").alias("s")
    joined = f.join(s, (F.col(instrument) == F.col("_instrument")) & (F.col("_day") == F.col("_start_day")) & (F.col(ts) >= F.col("start_time") - gap) & (F.col(ts) <= F.col("end_time") + gap), "left")
    first = Window.partitionBy(*frame_key).orderBy(F.asc_nulls_last("start_time"))
    return joined.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth", "_day", "_start_day", "_instrument")


def extend(frames: DataFrame, existing: DataFrame, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Incremental assignment of (image_id, instrument, ts) to existing (sequence_id, instrument, start_time, end_time).

    Frames of an instrument and day come in time order: each continues the sequence of the frame before it if
    it lies within the gap after that sequence's end, else joins the earliest sequence whose widened window
    holds it, else opens one. A frame that bridges two sequences does not merge them. Returns image_id,
    sequence_id (null for new ones), opened (number of the new sequence within instrument and day, from 1).
    The unit of work is one instrument and day, at most some hundreds of frames. Frames without a time are in none of the
    results; equal times go by image_id; repeated frames are placed each; other columns are not read.
    """
    import pandas as pd

    def run(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        spans = Spans([(micros(a), micros(b), i) for a, b, i in zip(old.start_time, old.end_time, old.sequence_id, strict=True)], gap_minutes)
        out = [(image, *spans.place(micros(t))) for image, t in new.dropna(subset="ts").sort_values(["ts", "image_id"])[["image_id", "ts"]].itertuples(index=False)]
        return pd.DataFrame(out, columns=["image_id", "sequence_id", "opened"]).astype({"sequence_id": "Int64"})

    n = frames.select("image_id", "instrument", F.col("ts").cast("timestamp").alias("ts")).withColumn("day", F.to_date("ts"))
    o = existing.select("sequence_id", "instrument", F.col("start_time").cast("timestamp").alias("start_time"), F.col("end_time").cast("timestamp").alias("end_time")).withColumn("day", F.to_date("start_time"))
    return n.groupBy("instrument", "day").cogroup(o.groupBy("instrument", "day")).applyInPandas(run, "image_id long, sequence_id long, opened int")


def micros(t) -> int:
    return t.value // 1000


class Spans:
    """The sequences of one instrument and day while its frames come in time order. Times are microseconds; a state to keep on a stream."""

    def __init__(self, existing: list[tuple[int, int, int]], gap_minutes: float = GAP_MINUTES):
        """existing: start, end and id of sequences; of those with the same start the first one given counts first."""
        self.gap, self.spans, self.current, self.opened = int(gap_minutes * 60e6), [[a, b, i, 0] for a, b, i in existing], None, 0

    def place(self, t: int) -> tuple[int | None, int]:
        """The id of the sequence that a frame joins, null for a new one, and the new one's number."""
        if self.current is None or t - self.current[1] > self.gap:
            fits = [s for s in self.spans if s[0] - self.gap <= t <= s[1] + self.gap]
            if fits:
                self.current = min(fits, key=lambda s: s[0])
            else:
                self.opened += 1
                self.current = [t, t, None, self.opened]
                self.spans.append(self.current)
        self.current[0], self.current[1] = min(self.current[0], t), max(self.current[1], t)
        return self.current[2], self.current[3]


def internal_gaps(frames: DataFrame, keys: list[str], ts: str, tie: str, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Consecutive frames of one sequence that lie further apart than the gap."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    x = frames.withColumn("previous_time", F.lag(ts).over(w))
    x = x.withColumn("gap_s", seconds(F.col(ts)) - seconds(F.col("previous_time")))
    return x.where(F.col("gap_s") > gap_minutes * 60)


def check(images: DataFrame, built: DataFrame, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Integrity problems (sequence_id, problem, detail) of seven kinds; images: id, sequence_id, instrument, observation_time."""
    seen = images.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.min("observation_time").alias("first"), F.max("observation_time").alias("last"))
    x = built.join(seen, built["id"] == seen["sequence_id"], "left").select(built["*"], F.coalesce("n", F.lit(0)).alias("n"), "first", "last")
    found = lambda df, when, what, detail: df.where(when).select(F.col("id").alias("sequence_id"), F.lit(what).alias("problem"), detail.cast("string").alias("detail"))
    members = images.join(built.select("id", F.col("instrument").alias("_own")), images["sequence_id"] == built["id"]).select(built["id"], images["id"].alias("image"), images["instrument"], "_own", "observation_time", images["sequence_id"])
    parts = [
        found(x, F.col("n") != F.col("frame_count"), "frame_count", F.concat_ws("/", "frame_count", "n")),
        found(x, (F.col("n") > 0) & ~F.col("first").eqNullSafe(F.col("start_time")), "start_time", F.col("first")),
        found(x, (F.col("n") > 0) & ~F.col("last").eqNullSafe(F.col("end_time")), "end_time", F.col("last")),
        found(members, ~F.col("instrument").eqNullSafe(F.col("_own")), "instrument", F.col("image")),
        found(members, F.col("observation_time").isNull(), "no observation_time", F.col("image")),
        found(x, F.to_date("first") != F.to_date("last"), "several days", F.col("last")),
        found(internal_gaps(members.where("observation_time is not null"), ["id"], "observation_time", "image", gap_minutes), F.lit(True), "internal gap", F.col("image")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
