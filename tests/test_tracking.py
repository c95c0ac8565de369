"""The grid's pairs and the greedy choice against trying every pair; whole queries against a plain tracker."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_plain_versions import plain_tracks

from trackloom.operators import frames as fr
from trackloom.operators import tracking
from trackloom.plans import frames as pf
from trackloom.plans import streams


@pytest.mark.parametrize("seed", range(12))
def test_grid_pairs_are_all_pairs_within_reach(seed):
    r = np.random.default_rng(seed)
    reach = [0.0, 1.0, 0.3, 10.0][seed % 4]
    draw = lambda n: r.integers(-30, 30, (n, 2)) / 4 if seed % 2 else r.normal(0, 5, (n, 2)) * 10.0 ** r.integers(-3, 8)
    a, b = draw(60), draw(80)
    a[:10] = b[:10]  # the same places
    a[11], b[12], b[13, 0] = np.nan, np.inf, -np.inf
    with np.errstate(invalid="ignore"):
        apart = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
        want = sorted((apart[i, j], i, j) for i, j in zip(*np.nonzero(apart <= reach), strict=True))
    assert list(zip(*(x.tolist() for x in tracking.pairs_within(a, b, reach)), strict=True)) == want
    assert [len(x) for x in tracking.pairs_within(a[:0], b, reach)] == [0, 0, 0]


@pytest.mark.parametrize("n", [0, 5, 300, 5000])
def test_first_come_takes_what_one_pass_takes(n):
    r = np.random.default_rng(n)
    i, j = r.integers(0, max(1, n // 5), n), r.integers(0, max(1, n // 4), n)
    linked, used, want = set(), set(), []
    for k in range(n):
        if i[k] not in linked and j[k] not in used:
            linked.add(i[k])
            used.add(j[k])
            want.append(k)
    assert sorted(tracking.first_come(i, j).tolist()) == want


@pytest.mark.parametrize("seed", range(24))
def test_rings_link_what_all_pairs_in_order_link(seed):
    """Places that many share, equal distances, and places alone; also where rings are narrow."""
    r = np.random.default_rng(seed)
    n, m = int(r.integers(1, 150)), int(r.integers(1, 150))
    draw = [lambda k: r.integers(0, 4, (k, 2)) * 3.0, lambda k: r.integers(-9, 9, (k, 2)) / 4, lambda k: r.normal(0, 5, (k, 2))][seed % 3]
    a, b = draw(n), draw(m)
    a[n // 2 :], b[m // 2 :] = a[: n - n // 2], b[: m - m // 2]
    a[0], b[-1] = np.nan, np.inf
    a[1:2] = -0.0
    a, b = a[r.permutation(n)], b[r.permutation(m)]
    reach = [0.0, 3.0, 5.0, 100.0][seed % 4]
    d, i, j = tracking.pairs_within(a, b, reach)
    at = tracking.first_come(i, j)
    want = sorted(zip(d[at].tolist(), i[at].tolist(), j[at].tolist(), strict=True))
    for many in (1, 50, 200_000):
        assert sorted(zip(*(x.tolist() for x in tracking.matched(a, b, reach, many)), strict=True)) == want


@pytest.mark.parametrize("places", [30, 8000])
def test_crowded_frames_do_not_measure_all_pairs(places):
    """8,000 detections a frame within reach of each other: all pairs are 64 million a frame."""
    r = np.random.default_rng(places)
    at = r.random((places, 2))[np.arange(8000) % places] * 20
    tracker = tracking.Tracker(tracking.TracksConfig(max_link_px=40.0))
    tracemalloc.start()
    for k in range(3):
        tracker.step(720.0 * k, at + 0.001 * k, list(range(len(at))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    assert sum(len(t.rows) == 3 for t in tracker.open) == 8000


def test_a_hundred_thousand_detections_in_a_frame():
    """A dense matrix of a frame would take 80 GB; pairs within reach take a few hundred MB."""
    r = np.random.default_rng(1)
    at = r.random((100_000, 2)) * 4000
    tracker = tracking.Tracker(tracking.TracksConfig(max_link_px=5.0))
    tracemalloc.start()
    began = time.time()
    for k in range(3):
        tracker.step(720.0 * k, at + (2.0 * k, 1.0 * k), list(range(len(at))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and time.time() - began < 60
    assert sum(len(t.rows) == 3 for t in tracker.open) > 80_000


def plain(detections, frames, reach, least):
    """(sequence, time, pos, x, y) and all frames' (sequence, time) to the tracks' places."""
    out = []
    for s in {d[0] for d in detections}:
        times = sorted({t for of, t in frames if of == s})
        out += plain_tracks([(t, [d[3:] for d in sorted(d for d in detections if d[:2] == (s, t))]) for t in times], reach, 2, least)
    return sorted(out)


def test_every_track_of_tracker_greedy(spark, sf_dir):
    found = pf._detected(spark, sf_dir)
    rows = fr.exploded(found).join(found.select("sequence_id", "frame", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), ["sequence_id", "frame"])
    frames = found.select("sequence_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()
    want = plain([(r.sequence_id, r.us / 1e6, r.pos, r.x, r.y) for r in rows.collect()], [(r.sequence_id, r.us / 1e6) for r in frames], 6.0, 5)
    got = {}
    for r in pf.tracker_greedy(spark, sf_dir).orderBy("track_id", "seq").collect():
        got.setdefault(r.track_id, []).append((r.x, r.y))
    assert sorted(map(tuple, got.values())) == want and want


def test_stream_tracker_gives_the_batch_trackers_tracks(spark, sf_dir):
    """Whole closed tracks of all sequences: the stream ends with every sequence idle but the last few."""
    e = streams._hourly(spark.read.parquet(f"{sf_dir}/events.parquet"))
    rows = [(r.sequence_id, r.ts.timestamp(), r.x, r.y) for r in e.collect()]
    want = {}
    for s in {r[0] for r in rows}:
        times = sorted({r[1] for r in rows if r[0] == s})
        want[s] = sorted((len(t), t[0][0], t[-1][0]) for t in plain_tracks([(t, sorted(r[2:] for r in rows if r[:2] == (s, t))) for t in times], 40.0, 2, 3))
    got = {}
    for r in streams.stream_tracker(spark, sf_dir).collect():
        got.setdefault(r.sequence_id, []).append((r.n_frames, r.first_x, r.last_x))
    whole = [s for s in want if sorted(got.get(s, [])) == want[s]]
    last = max(rows, key=lambda r: r[1])[1]
    assert set(want) - set(whole) <= {r[0] for r in rows if r[1] > last - 4 * 3600} and len(whole) > len(want) / 2


def test_odd_detections(spark):
    d = spark.createDataFrame([(1, "a", 0, 1.0, 1.0), (1, "a", 1, None, 2.0), (1, "b", 0, 1.5, 1.0), (1, "b", 0, 1.5, 1.0), (1, "no such frame", 0, 1.0, 1.0), (2, "a", 0, 1.0, 1.0), (None, "a", 0, 1.0, 1.0)], "sequence_id long, frame string, pos int, x double, y double")
    d = d.withColumns({c: F.lit(1) for c in ("area", "peak", "flux", "snr")}).withColumn("ts", F.lit("clash"))
    f = spark.createDataFrame([(1, "a", 0), (1, "b", 720), (1, "bb", 720), (1, "c", None)], "sequence_id long, frame string, s int").select("sequence_id", "frame", F.timestamp_seconds("s").alias("ts"), F.lit(1).alias("x"))
    got = tracking.build(d, f, "a%b", tracking.TracksConfig(min_track_frames=1)).orderBy("track_id", "seq").collect()
    assert [(r.track_id, r.seq, r.frame, r.x, r.area) for r in got] == [("seq1_a%b_00000", 0, "a", 1.0, 1.0), ("seq1_a%b_00000", 1, "b", 1.5, 1.0), ("seq1_a%b_00001", 0, "a", None, 1.0), ("seq1_a%b_00002", 0, "b", 1.5, 1.0)]
    assert tracking.build(d.limit(0), f, "t").count() == 0 and tracking.build(d, f.limit(0), "t").count() == 0
