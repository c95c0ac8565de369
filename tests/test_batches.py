"""Streams that fail and go on, and frames that come late."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from trackloom.operators import sequencing
from trackloom.sinks import batches
from trackloom.streaming import incremental, sessions

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("fault", ["before the commit", "after the commit"])
def test_each_row_once_when_a_batch_is_replayed(spark, tmp_path, fault):
    x = spark.createDataFrame([(i, i // 10) for i in range(40)], "id long, part int")
    for k in range(4):
        x.where(F.col("part") == k).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    out, failed = str(tmp_path / "out"), []

    def sink(batch, number):
        if number == 2 and not failed:
            failed.append(number)
            folder = batches.write_batch(batch, number, out)
            if fault == "after the commit":
                assert batches.commit_batch(spark, number, out, folder)
            raise RuntimeError("planted")
        batches.append_batch(batch, number, out)

    run = lambda: sessions.run_available(sessions.frames_stream(spark, x.schema, str(tmp_path / "in" / "*")), sink, str(tmp_path / "c"))
    with pytest.raises(Exception, match="planted"):
        run().awaitTermination(120)
    assert batches.read_batches(spark, out, x.schema).count() == (20 if fault == "before the commit" else 30)
    run().awaitTermination(120)
    assert sorted(map(tuple, batches.read_batches(spark, out, x.schema).collect())) == [(i, i // 10) for i in range(40)]
    assert len([n for n in os.listdir(out) if n.startswith("rows-")]) == len(batches.committed(spark, out)) == 4


def test_a_number_is_committed_once(spark, tmp_path):
    out, x = str(tmp_path / "out"), spark.range(3)
    assert batches.read_batches(spark, out, x.schema).count() == 0
    folders = [batches.write_batch(x, 0, out) for _ in range(2)]
    assert batches.commit_batch(spark, 0, out, folders[0]) and not batches.commit_batch(spark, 0, out, folders[1])
    assert not batches.append_batch(x, 0, out) and batches.append_batch(spark.range(5), 1, out)
    assert batches.read_batches(spark, out, x.schema).count() == 8 and batches.read_batches(spark, out, x.schema, newest=True).count() == 5


def arrivals(spark, tmp_path, groups):
    """A file a micro-batch: (image_id, minutes) each."""
    schema = "image_id long, instrument string, ts timestamp, day string"
    for k, rows in enumerate(groups):
        spark.createDataFrame([(i, None if m is None else "C3", None if m is None else T0 + dt.timedelta(minutes=m), "clash") for i, m in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    return sessions.frames_stream(spark, spark.createDataFrame([], schema).schema, str(tmp_path / "in" / "*"))


def streamed(spark, tmp_path, groups, existing, lateness):
    x = incremental.extend(arrivals(spark, tmp_path, groups), existing, lateness=lateness)
    out = str(tmp_path / "out")
    sessions.run_available(x, lambda b, n: batches.append_batch(b, n, out), str(tmp_path / "c")).awaitTermination(200)
    return sorted((r.image_id, r.sequence_id, r.opened) for r in batches.read_batches(spark, out, x.schema).collect())


KNOWN = [(7, "C3", T0 + dt.timedelta(minutes=300), T0 + dt.timedelta(minutes=310)), (8, "C3", T0 + dt.timedelta(minutes=900), T0 + dt.timedelta(minutes=900)), (9, "C2", T0, T0)]


def test_late_frames_join_as_in_one_go(spark, tmp_path):
    """The late frame at 100 minutes bridges what would be two new sequences; one at 250 joins a known one before it starts."""
    existing = spark.createDataFrame(KNOWN, "sequence_id long, instrument string, start_time timestamp, end_time timestamp")
    groups = [[(1, 0), (2, 50)], [(3, 150), (4, 160)], [(5, 100), (5, 100), (6, None)], [(7, 250), (8, 420), (9, 1500)], [(10, 1439), (11, 1445)], [(12, 2400)]]
    rows = [(i, "C3", T0 + dt.timedelta(minutes=m)) for g in groups for i, m in g if m is not None]
    want = sequencing.extend(spark.createDataFrame(rows, "image_id long, instrument string, ts timestamp"), existing)
    want = sorted((r.image_id, r.sequence_id, r.opened) for r in want.collect())
    far = [(99, 99_999)]
    assert streamed(spark, tmp_path, [*groups, far, [(100, 199_999)]], existing, "3 hours") == sorted([*want, (99, None, 1)])
    assert [x for x in want if x[0] in (1, 3, 5)] == [(1, None, 1), (3, None, 1), (5, None, 1), (5, None, 1)]
    assert (7, 7, 0) in want


def test_frames_beyond_the_lateness_are_left_out(spark, tmp_path):
    existing = spark.createDataFrame([], "sequence_id long, instrument string, start_time timestamp, end_time timestamp")
    got = streamed(spark, tmp_path, [[(1, 0)], [(2, 600)], [(3, 650)], [(4, 30)], [(5, 9000)], [(6, 99_000)]], existing, "1 hour")
    assert got == [(1, None, 1), (2, None, 2), (3, None, 2), (5, None, 1)]


def test_frames_that_wait_take_few_bytes():
    """A day's state holds its frames as two numbers each; as objects they took more than a hundred bytes."""
    import tracemalloc

    import pandas as pd

    n = 200_000
    times, ids = pd.Series(pd.date_range("2024-01-01", periods=n, freq="100ms")), pd.Series(range(n))
    tracemalloc.start()
    x = incremental.arrived(times, ids)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20 * n and x[1].tolist() == [1_704_067_200_100_000, 1]
