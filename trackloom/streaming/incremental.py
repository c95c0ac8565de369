"""Incremental sequencing on a stream: frames join known sequences or open new ones, late frames included."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sequencing import GAP_MINUTES, Spans

OUT = "image_id long, sequence_id long, opened int, instrument string, day date"
DAY_MS = 86_400_000
#: Placed frames that are given back together.
AT_ONCE = 10_000


def arrived(times: pd.Series, ids: pd.Series) -> np.ndarray:
    """(microseconds, image_id) rows of frames: 16 bytes a frame, as a day may hold millions."""
    return np.column_stack((times.to_numpy("datetime64[us]").astype(np.int64), ids.to_numpy(np.int64)))


def extend(frames: DataFrame, existing: DataFrame, gap_minutes: float = GAP_MINUTES, lateness: str = "2 hours") -> DataFrame:
    """``operators.sequencing.extend`` on a stream of (image_id, instrument, ts): image_id, sequence_id, opened, instrument, day.

    existing: a table of sequence_id, instrument, start_time, end_time. An instrument's day is a state: its sequences'
    spans, and the frames that the watermark has not passed. A frame is placed when the watermark passes its time, in
    order of time with all that came by then, so rows up to ``lateness`` late give what a rebuild in one go gives; what
    comes later still is left out by the watermark. The state goes when the day is over and no frame waits.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans, waiting = pickle.loads(state.get[0]) if state.exists else (None, [])
        held = [np.array(waiting, np.int64).reshape(-1, 2)]
        if not state.hasTimedOut:
            for part in parts:
                if spans is None and len(part):
                    known = part.known.iloc[0]
                    spans = Spans([tuple(s) for s in ([] if known is None else json.loads(known))], gap_minutes)
                held.append(arrived(part.ts, part.image_id))
        mark = state.getCurrentWatermarkMs()
        waiting = np.concatenate(held)
        waiting = waiting[np.lexsort((waiting[:, 1], waiting[:, 0]))]
        n = int(np.searchsorted(waiting[:, 0], mark * 1000, "right"))
        ready, waiting = waiting[:n], waiting[n:].copy()
        for at in range(0, max(n, 1), AT_ONCE):
            some = ready[at : at + AT_ONCE]
            out = [(i, *spans.place(t), *key) for t, i in some.tolist()]
            yield pd.DataFrame(out, columns=["image_id", "sequence_id", "opened", "instrument", "day"]).astype({"sequence_id": "Int64", "opened": "int32", "image_id": "int64"})
        end = (key[1] - pd.Timestamp("1970-01-01").date()).days * DAY_MS + DAY_MS
        if len(waiting) or mark < end:
            state.update((pickle.dumps((spans, waiting), 5),))
            # fires once the watermark is past it, so a frame's own millisecond has to be over
            state.setTimeoutTimestamp(max(int(waiting[0, 0]) // 1000 + 1 if len(waiting) else end, mark + 1))
        else:
            state.remove()

    o = existing.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("start_time", "end_time")})
    o = o.groupBy(F.col("instrument").alias("_i"), F.to_date(F.timestamp_micros("start_time")).alias("_d")).agg(F.array_sort(F.collect_list(F.array("start_time", "end_time", F.col("sequence_id").cast("long")))).alias("known"))
    o = o.withColumn("known", F.to_json("known"))  # one text a row, not an object a span
    x = frames.select("image_id", "instrument", F.col("ts").cast("timestamp").alias("ts")).where("ts is not null").withWatermark("ts", lateness).withColumn("day", F.to_date("ts"))
    x = x.join(o, F.col("instrument").eqNullSafe(F.col("_i")) & (F.col("day") == F.col("_d")), "left").select("image_id", "instrument", "day", "ts", "known")
    return x.groupBy("instrument", "day").applyInPandasWithState(run, OUT, "state binary", "append", GroupStateTimeout.EventTimeTimeout)
