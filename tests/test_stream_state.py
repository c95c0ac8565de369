"""What the tracker on a stream holds: few places are measured at once, tracks leave as they close."""

import numpy as np
import pandas as pd
import pytest

from trackloom.operators import tracking
from trackloom.streaming import tracker


class Captured:
    """Stands in for a stream: gives the function that a sequence's rows go through."""

    def __getattr__(self, name):
        return lambda *a, **k: a[0] if name == "applyInPandasWithState" else self


class State:
    def __init__(self):
        self.value, self.exists, self.hasTimedOut = None, False, False

    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.exists = value, True

    def remove(self):
        self.value, self.exists = None, False

    def setTimeoutTimestamp(self, at):
        self.timeout = at

    def getCurrentWatermarkMs(self):
        return 0


def detections(n_frames=40, many=400, seed=5):
    rng = np.random.default_rng(seed)
    t = pd.Timestamp("2024-01-03") + pd.to_timedelta(np.repeat(np.arange(n_frames), many), "h")
    return pd.DataFrame({"sequence_id": 7, "ts": t, "x": rng.integers(0, 2000, len(t)) / 4, "y": rng.integers(0, 400, len(t)) / 4})


def test_tracks_of_a_batch_leave_as_they_close(spark):
    config = tracking.TracksConfig(max_link_px=4.0, min_track_frames=2)
    rows, state = detections(), State()
    run = tracker.tracks(Captured(), config)
    mixed = rows.sample(frac=1, random_state=1)
    found = list(run((7,), iter([mixed[:5000], mixed[5000:]]), state))
    assert len(found) > 2 and len(state.value[0]) < 400_000
    state.hasTimedOut = True
    found += list(run((7,), iter([]), state))
    assert not state.exists
    got = sorted((start, tuple(x), tuple(y)) for f in found for start, x, y in zip(f["start"], f["xs"], f["ys"], strict=True))
    rows = rows.sort_values(["ts", "x", "y"])
    places, times = rows[["x", "y"]].to_numpy(), rows.ts.to_numpy("datetime64[us]").astype(np.int64) / 1e6
    want = [t for t in tracking.link(times, places, config) if len(t.rows) >= 2]
    assert len(want) > 2000
    assert got == sorted((t.first[0], tuple(places[t.rows, 0]), tuple(places[t.rows, 1])) for t in want)


@pytest.mark.parametrize("seed", range(6))
def test_few_places_are_matched_as_many(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 40, (n, 2)) / (1, 4) for n in (90, 70))
    a[::17], b[::13, 1] = np.nan, np.inf
    for reach in (0.0, 1.5, 6.0, 100.0):
        few, rings = tracking.matched(a, b, reach), tracking.matched(a, b, reach, many=50, few=0)
        assert sorted(zip(*(v.tolist() for v in few), strict=True)) == sorted(zip(*(v.tolist() for v in rings), strict=True))
    assert all(len(v) == 0 for v in tracking.matched(a, b[:0], 5.0))
