import datetime as dt
import os

from pyspark.sql import functions as F

from trackloom.operators import sequencing
from trackloom.plans import streams
from trackloom.streaming import sessions, tracker

T0 = dt.datetime(2024, 1, 1)


def test_sequences_on_a_stream_match_the_batch(spark, tmp_path):
    rows = [(i, "C3", T0 + dt.timedelta(minutes=m)) for i, m in enumerate([0, 12, 24, 264, 276, 2000, 9000])]
    x = spark.createDataFrame(rows, "id long, instrument string, ts timestamp_ntz")
    for i, r in enumerate(rows):
        x.where(F.col("id") == r[0]).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    s = sessions.frames_stream(spark, x.schema, str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")
    q = sessions.run_available(sessions.sequences(s, "instrument", "ts"), lambda b, _: b.write.mode("append").parquet(out), str(tmp_path / "c"))
    q.awaitTermination(120)
    got = sorted((r.start_time, r.frame_count) for r in spark.read.parquet(out).collect())
    want = sorted((r.start_time, r.frame_count) for r in sequencing.sequences(x, "instrument", "ts", "id").collect())
    assert got == want[: len(got)] and len(got) >= len(want) - 1  # the last window waits for the watermark


def test_tracker_on_a_stream(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(minutes=12 * i), 10.0 + 4 * i, 20.0 + 3 * i) for i in range(8)] + [(1, T0 + dt.timedelta(minutes=12 * i), 900.0, 900.0) for i in range(8, 13)]
    x = spark.createDataFrame(rows, "sequence_id long, ts timestamp, x double, y double")
    for i in range(len(rows)):
        x.where(F.col("ts") == rows[i][1]).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:02d}"))
    s = sessions.frames_stream(spark, x.schema, str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")
    q = sessions.run_available(tracker.tracks(s), lambda b, _: b.write.mode("append").parquet(out), str(tmp_path / "c"))
    q.awaitTermination(180)
    got = spark.read.parquet(out).collect()
    assert [(r.n_frames, r.xs[0], r.xs[-1]) for r in got][:1] == [(8, 10.0, 38.0)]


def test_streams_do_not_depend_on_the_number_of_files(spark, sf_dir, tmp_path):
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    e = pq.read_table(f"{sf_dir}/events.parquet")
    later = e.set_column(e.schema.get_field_index("ts"), "ts", pc.add(e["ts"], pa.scalar(dt.timedelta(days=400))))
    e = pa.concat_tables([e, later]).sort_by([("ts", "descending")])
    one, many, n = tmp_path / "one", tmp_path / "many", 1100
    for d in (one, many / "events.parquet"):
        d.mkdir(parents=True)
    pq.write_table(e, one / "events.parquet")
    for i in range(n):  # the newest rows come first
        at = str(many / "events.parquet" / f"{i:04d}.parquet")
        pq.write_table(e.slice(i * len(e) // n, (i + 1) * len(e) // n - i * len(e) // n), at)
        os.utime(at, (1_700_000_000 + i, 1_700_000_000 + i))
    firsts = spark.read.parquet(str(one / "events.parquet")).selectExpr("event_type", "date_trunc('hour', ts) as hour").distinct()
    assert sorted(map(tuple, streams.stream_first_of_time(spark, str(many)).collect())) == sorted((r[0], r[1].replace(tzinfo=None)) for r in firsts.collect())
    tracks = [sorted(map(tuple, streams.stream_tracker(spark, str(d)).collect())) for d in (one, many)]
    assert tracks[0] and tracks[0] == tracks[1]
