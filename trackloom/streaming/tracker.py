"""The tracker on a stream: one state a sequence, finished tracks leave as they close."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import Tracker, TracksConfig

OUT = "sequence_id long, start double, n_frames int, xs array<double>, ys array<double>"
#: Closed tracks that leave together while a sequence goes on.
MANY = 1024


def in_frames(parts: Iterable[pd.DataFrame]) -> Iterator[tuple[float, np.ndarray]]:
    """Each time of a batch's rows (ts, x, y), in order, with its places by x and y. Rows are held as three numbers each."""
    rows = np.concatenate([np.column_stack((p.ts.to_numpy("datetime64[us]").astype(np.int64) / 1e6, p.x.to_numpy(float), p.y.to_numpy(float))) for p in parts])
    rows = rows[np.lexsort(rows.T[::-1])]
    starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]][: len(rows)])
    for at, end in zip(starts, [*starts[1:], len(rows)], strict=True):
        yield float(rows[at, 0]), rows[at:end, 1:]


def tracks(detections: DataFrame, config: TracksConfig = TracksConfig(), idle: str = "1 hour") -> DataFrame:  # noqa: B008
    """(sequence_id, ts, x, y) to closed persistent tracks.

    A frame's detections must come in one micro-batch, frames in time order; a frame older than the last one
    worked off is left out, as the batch form is there for rebuilding. A track holds its own places and leaves when it
    closes, so what a task holds is a batch's rows of one sequence, as numbers, and the open tracks. When a sequence has been idle for so
    long by the watermark, all its tracks close.
    """

    def leaving(sequence: int, tracker: Tracker) -> pd.DataFrame:
        kept = [t for t in tracker.done if len(t.rows) >= config.min_track_frames]
        tracker.done = []
        return pd.DataFrame({"sequence_id": [sequence] * len(kept), "start": [t.first[0] for t in kept], "n_frames": [len(t.rows) for t in kept], "xs": [[p[0] for p in t.rows] for t in kept], "ys": [[p[1] for p in t.rows] for t in kept]})

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, last = pickle.loads(state.get[0]) if state.exists else (Tracker(config), -np.inf)
        if state.hasTimedOut:
            tracker.finish()
            state.remove()
        else:
            for now, places in in_frames(parts):
                if now > last:
                    tracker.step(now, places, list(map(tuple, places.tolist())))
                    last = now
                if len(tracker.done) >= MANY:
                    yield leaving(key[0], tracker)
            done, tracker.done = tracker.done, []
            state.update((pickle.dumps((tracker, last)),))
            tracker.done = done
            state.setTimeoutTimestamp(max(int(last * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield leaving(key[0], tracker)

    amount, unit = idle.split()
    idle_ms = int(float(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000)
    x = detections.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 seconds")
    return x.select("sequence_id", "ts", "x", "y").groupBy("sequence_id").applyInPandasWithState(run, OUT, "state binary", "append", GroupStateTimeout.EventTimeTimeout)
