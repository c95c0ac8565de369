import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import functions as f
from trackloom.operators import evidence, index, labels, ranking, sequencing, similarity, tracking, tracks, upserts

T0 = dt.datetime(2024, 1, 1)


def frames(spark, minutes, instrument="C3", start=T0):
    return spark.createDataFrame([(i, instrument, start + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)], "id long, instrument string, ts timestamp_ntz")


@pytest.mark.parametrize(("minutes", "counts"), [([0, 12, 24, 264, 276], [3, 2]), ([0, 60], [2]), ([0, 60 + 1 / 60], [1, 1]), ([], [])])
def test_gaps(spark, minutes, counts):
    for x in (sequencing.sequences(frames(spark, minutes), "instrument", "ts", "id"), sequencing.sequences_by_session_window(frames(spark, minutes), "instrument", "ts")):
        assert [r.frame_count for r in x.orderBy("start_time").collect()] == counts


def test_days_part(spark):
    x = sequencing.sequences(frames(spark, [0, 10, 20], start=dt.datetime(2024, 1, 1, 23, 45)), "instrument", "ts", "id")
    assert sorted(r.frame_count for r in x.collect()) == [1, 2]


def test_extend_follows_existing_sequences(spark):
    old = spark.createDataFrame([(7, "C3", T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=3))], "sequence_id long, instrument string, start_time timestamp, end_time timestamp")
    new = frames(spark, [0, 70, 200, 600]).select(F.col("id").alias("image_id"), "instrument", "ts")
    got = {r.image_id: (r.sequence_id, r.opened) for r in sequencing.extend(new, old).collect()}
    assert got == {0: (None, 1), 1: (7, 0), 2: (7, 0), 3: (None, 2)}


def test_check_reports_each_kind(spark):
    images = spark.createDataFrame([(1, 10, "C3", T0), (2, 10, "C2", T0 + dt.timedelta(hours=3)), (3, 11, "C3", None)], "id long, sequence_id long, instrument string, observation_time timestamp")
    built = spark.createDataFrame([(10, "C3", T0, T0, 5), (11, "C3", None, None, 1)], "id long, instrument string, start_time timestamp, end_time timestamp, frame_count int")
    assert {r.problem for r in sequencing.check(images, built).collect()} == {"frame_count", "end_time", "instrument", "no observation_time", "internal gap"}


def run_tracker(places, config=tracking.TracksConfig()):
    times = np.array([i * 720.0 for i, p in enumerate(places) for _ in p])
    flat = np.array([q for p in places for q in p], float).reshape(-1, 2)
    return tracking.link(times, flat, config, np.arange(len(places)) * 720.0)


def test_tracker_follows_gates_and_ends():
    straight = run_tracker([[(10 + 4 * i, 20 + 3 * i)] for i in range(8)])
    assert len(straight) == 1 and len(straight[0].rows) == 8 and np.mean(straight[0].residuals[1:]) < 1.0
    assert len(run_tracker([[(50 * i, 0)] for i in range(5)])) == 5
    gap = [[(4 * i, 0)] if not 4 <= i < 8 else [] for i in range(12)]
    assert [len(t.rows) for t in run_tracker(gap)] == [4, 4]
    coast = [[(4 * i, 0)] if i not in (4, 5) else [] for i in range(10)]
    assert [len(t.rows) for t in run_tracker(coast)] == [8]
    near = run_tracker([[(0, 0), (100, 0)], [(3, 0), (1, 0), (101, 0)]])
    assert sorted(len(t.rows) for t in near) == [1, 2, 2] and min(t.residuals[-1] for t in near if len(t.rows) == 2) == 1.0


def test_tracker_on_spark(spark):
    rows = [(1, f"{i:03d}", 0, 10.0 + 4 * i, 20.0 + 3 * i, 5.0, 1.0, 2.0, 9.0) for i in range(8)]
    d = spark.createDataFrame(rows, "sequence_id long, frame string, pos int, x double, y double, area double, peak double, flux double, snr double")
    fr = spark.createDataFrame([(1, f"{i:03d}", T0 + dt.timedelta(minutes=12 * i)) for i in range(8)], "sequence_id long, frame string, ts timestamp")
    points = tracking.build(d, fr, "abc")
    assert points.count() == 8 and points.first().track_id == "seq1_abc_00000"
    s = tracks.summary(points, "track_id", "ts", "x", "y", "residual").first()
    assert s.displacement_px == 35.0 and s.residual_mean_px < 1


def points(spark, xy, minutes=None, flux=None, center=None):
    minutes = minutes or [12 * i for i in range(len(xy))]
    rows = [("t", T0 + dt.timedelta(minutes=m), float(x), float(y), float(v), 4.0, int(m // 12)) for (x, y), m, v in zip(xy, minutes, flux or [10] * len(xy), strict=True)]
    p = spark.createDataFrame(rows, "track string, ts timestamp, x double, y double, flux double, area double, epoch int")
    return tracks.features(p, "track", "ts", "x", "y", "flux", "area", center and (F.lit(center[0]), F.lit(center[1])), "epoch").first()


def test_features_of_known_motion(spark):
    r = points(spark, [(3 * i, 4 * i) for i in range(6)])
    assert (r.frame_coverage, r.displacement_px, r.path_length_px, r.direction_consistency, r.accel_mean_px_s2, r.linear_rms_px) == (1.0, 25.0, 25.0, 1.0, 0.0, 0.0)
    assert r.r_min_px is None and r.radial_speed_px_s is None
    corner = points(spark, [(0, 0), (10, 0), (20, 0), (20, 10)])
    assert abs(corner.curvature_rad_px - math.pi / 2 / 30 * 1) < 2e-2 and abs(corner.curvature_rad_px * 30 - math.pi / 2) < 1e-3 * 40
    assert points(spark, [(0, 0), (1, 0), (2, 0), (3, 0)], [0, 12, 24, 48]).frame_coverage == 0.8
    rising = points(spark, [(i, 0) for i in range(5)], flux=[100, 120, 140, 160, 180])
    assert abs(rising.flux_slope_frac_h - 20 * 5 / 140) < 1e-4
    inward = points(spark, [(512 + 300 - 50 * i, 512) for i in range(5)], center=(512, 512))
    assert (inward.r_min_px, inward.r_max_px) == (100.0, 300.0) and inward.radial_speed_px_s < 0


def test_features_of_degenerate_tracks(spark):
    still = points(spark, [(5, 5)] * 4)
    assert still.direction_deg is None and still.direction_consistency is None and still.curvature_rad_px is None and still.path_length_px == 0
    one = points(spark, [(5, 5)])
    assert one.n_frames == 1 and one.accel_mean_px_s2 is None and one.flux_slope_frac_h is None
    assert points(spark, [(0, 0), (1, 0), (2, 0)], flux=[-1, -1, -1]).flux_cv is None


def test_robust_sigma_and_stride(spark):
    d = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4, 100)], "k int, v double")
    assert tracks.robust_sigma(d, ["k"], "v").first().sigma == pytest.approx(1.4826)
    n = spark.createDataFrame([(40,), (3,)], "n int").select(tracks.stride(F.col("n"), 16).alias("s")).collect()
    assert n[0].s == np.linspace(0, 39, 16).round().astype(int).tolist() and n[1].s == [0, 1, 2]


def test_ranking_known_case(spark):
    d = spark.createDataFrame(list(zip(["r"] * 5, [1, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.1], range(5), strict=True)), "run string, label int, score double, id int")
    r = ranking.report(d, ["run"], "label", "score", "id", (1, 4, 2)).first()
    assert r.average_precision == pytest.approx((1 + 2 / 3) / 2, abs=1e-6) and (r.precision_at_1, r.precision_at_4, r.recall_at_2, r.precision) == (1.0, 0.5, 0.5, 0.5)
    assert tuple(ranking.report(d, [], "label", "score", "id", (1, 4, 2)).first()) == tuple(r)[1:]
    odd = spark.createDataFrame([(1, 0.5, 1), (0, float("nan"), 2), (1, None, 3), (0, 0.7, 4)], "label int, score double, id int")
    assert [(x.id, x.rank, x.hits) for x in ranking.ranked(odd, [], "label", "score", "id").orderBy("rank").collect()] == [(4, 1, 0), (1, 2, 1), (2, 3, 1), (3, 4, 2)]
    none = ranking.report(d.withColumn("label", F.lit(0)), ["run"], "label", "score", "id").first()
    assert (none.average_precision, none.recall_at_10, none.f1) == (0, 0, 0)


def test_global_rank_with_ties(spark):
    d = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "id int, score double")
    got = {r.id: r.global_rank for r in ranking.global_rank(d, "id").collect()}
    want = {i: n + 1 for n, i in enumerate(sorted(range(500), key=lambda i: (-(i % 7), i)))}
    assert got == want


def test_equal_scores_are_ranked_by_several_tasks(spark):
    d = spark.range(20_000).select("id", F.lit(1.0).alias("score"))
    x = ranking.ranked_together(d, F.col("score"), F.lit(1), "id", parts=8)
    assert x.where("rank != id + 1 or hits != rank").count() == 0 and x.count() == 20_000
    files = spark.read.parquet(x.inputFiles()[0].rsplit("/", 1)[0]).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 8 and max(r["count"] for r in files) < 5_000


def test_a_hot_group_is_ranked_by_several_tasks(spark):
    """One group holds two thirds of the rows, half of them with one score; others are small, one has no key."""
    key = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 101))
    score = F.when(F.col("id") % 2 == 0, 1.0).when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, float("nan")).otherwise(F.pmod(F.xxhash64("id"), F.lit(50)) / 10)
    d = spark.range(20_000).select("id", key.alias("k"), score.alias("score"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    x = ranking.ranked(d, ["k"], "label", "score", "id")
    groups = {}
    for r in d.collect():
        groups.setdefault(r.k, []).append(r)
    want = {}
    for rows in groups.values():
        hits, known = 0, lambda r: r.score is not None and r.score == r.score
        for n, r in enumerate(sorted(rows, key=lambda r: (not known(r), -r.score if known(r) else 0, r.id)), 1):
            hits += r.label
            want[r.id] = (n, hits)
    assert {r.id: (r["rank"], r.hits) for r in x.collect()} == want
    files = spark.read.parquet(x.inputFiles()[0].rsplit("/", 1)[0]).where("k = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 3 and max(r["count"] for r in files) < 7_000


def test_pages_filters_details(spark):
    d = spark.createDataFrame([(1, "A_1", 0.9), (2, "b%2", None), (3, "c", 0.5)], "id int, track_id string, score double")
    assert [r.id for r in index.page(d, "id").collect()] == [1, 3, 2]
    assert index.filtered(d, q="a_").count() == 1 and index.filtered(d, q="").count() == 3 and index.filtered(d, id=3, q=None).count() == 1
    assert index.detail(d, "id", 3).first() == (3, "c", 0.5)
    with pytest.raises(Exception, match="not found"):
        index.detail(d, "id", 9).collect()
    with pytest.raises(ValueError):
        index.page(d, "id", 501)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "id int, s string, n int")
    new = spark.createDataFrame([(2, "b", None), (3, "c", 4), (4, "d", 4)], "id int, s string, n int")
    assert {r.id: r.change for r in upserts.classify(old, new, "id", ["s", "n"]).collect()} == {1: "kept", 2: "unchanged", 3: "updated", 4: "created"}
    log = spark.createDataFrame([(1, 1, "approved", None, ["review"]), (1, 2, None, "note", ["notes"]), (2, 1, "artifact", None, ["review"]), (2, 2, None, None, ["review"])], "id int, at int, review string, notes string, sets array<string>")
    got = {r.id: (r.review, r.reviewer_notes, r.reviewed_at) for r in upserts.reviewed(log, "id", "at").collect()}
    assert got == {1: ("approved", "note", 2), 2: (None, None, None)}
    with pytest.raises(ValueError):
        upserts.check_review("fine", None, ["review"])


def test_bands(spark):
    d = spark.createDataFrame([(i, float(i), "comet" if i == 299 else None, "UNRESOLVED") for i in range(300)], "id int, score double, label string, status string")
    got = {r.id: r.status for r in upserts.bands(d, "id", "score", "label", "status").collect()}
    assert got[299] == "UNRESOLVED" and got[298] == got[249] == "HIGH_PRIORITY" and got[248] == got[49] == "MEDIUM_PRIORITY" and got[48] == "LOW_PRIORITY"


def test_similarity_orders_and_skips_itself(spark):
    d = spark.createDataFrame([("a", {"speed": 1.0, "curv": 0.0}), ("b", {"speed": 1.1, "curv": 0.0}), ("c", {"speed": 9.0})], "track_id string, features map<string,double>")
    got = similarity.nearest(similarity.vector_of_map(d, "track_id", "features"), "track_id", "a").collect()
    assert [r.track_id for r in got] == ["b", "c"]


def test_dates_lists_ids(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    when = lambda s: one(f.observation_time(F.lit(s)))
    assert when("2024/01/01T00:06:06.030") == dt.datetime(2024, 1, 1, 0, 6, 6, 30000) and when("2024/01/01") == T0 and when("2024-01-01") is None and when("nonsense") is None
    line = lambda s: f.with_event(spark.createDataFrame([(s,)], "line string"), "line").first().e
    e = line("4907 x y A. Name C3 Kreutz Apr30-May01,24 note")
    assert (e.soho_number, e.discoverers, list(e.cameras), str(e.obs_start), str(e.obs_end)) == (4907, "A. Name", ["C3"], "2024-04-30", "2024-05-01")
    assert str(line("4908* x y B C3,C2 Meyer Dec30-Jan02,24").obs_end) == "2025-01-02" and line("4908* x y B C3,C2 Meyer Dec30-Jan02,24").flagged
    for bad in ("no event", "4909 x y B C3 Kreutz Xxx99,24", "4909 x y B C3 Kreutz Xxx05,24", "4909 x y B C3 Kreutz anF05,24", "4909 x y B C3 Kreutz Feb31,24", "", "4909 x y C3"):
        assert line(bad) is None
    assert one(f.listed_frames(F.lit('<a href="22812345.fts"><a HREF="22812344.FTS"><a href="22812345.fts"><a href="x.jpg">'))) == ["22812344.FTS", "22812345.fts"]
    assert one(f.sequence_of(F.lit("seq36_ab_00001"))) == 36 and one(f.sequence_of(F.lit("x"))) is None
    assert len(f.config_hash(tracking.TracksConfig())) == 16


def test_events_are_added_from_a_list(spark):
    lines = spark.createDataFrame([("4907 x y A. Name C3 Kreutz Apr30-May01,24 note",), ("no event",)], "line string")
    t = labels.with_listed_event(labels.no_labels(spark), lines, 4907, "list.txt")
    assert sorted(r.day for r in t.days.collect()) == ["2024-04-30", "2024-05-01"]
    for number in (4907, 1):
        with pytest.raises(ValueError, match=str(number)):
            labels.with_listed_event(t, lines, number, "list.txt")
    t = labels.with_day(t, 4907, "2024-05-01", 7)
    assert t.events.first().status == "ingested" and {r.day: r.sequence_id for r in t.days.collect()} == {"2024-04-30": None, "2024-05-01": 7}
    t = labels.with_day(t, 4907, "2024-04-30", track_ids=["seq7_a_00001"])
    assert t.events.first().status == "labeled"
    with pytest.raises(ValueError, match="no day"):
        labels.with_day(t, 4907, "2024-06-01", 7)
    again = labels.flat(labels.document(t))
    assert [sorted(map(repr, x.select(*y.columns).collect())) for x, y in zip(again, t, strict=True)] == [sorted(map(repr, x.collect())) for x in t]


EVENT = {"soho_number": 1, "group": "Kreutz", "cameras": ["C2A"], "obs_start": "2024-01-01", "obs_end": "2024-01-03", "source_file": "f", "source_line": "l", "status": "labeled", "notes": "", "days": {"2024-01-01": {"sequence_id": 5, "positive_track_ids": ["seq5_a_00001"]}, "2024-01-02": {"sequence_id": 6, "positive_track_ids": []}}}


def flat(spark, tmp_path):
    import json

    from trackloom.sources.documents import labels as read

    (tmp_path / "labels.json").write_text(json.dumps({"label_format": labels.FORMAT, "events": [EVENT], "negative_days": [], "splits": {}}))
    d = read(spark, str(tmp_path / "labels.json"))
    assert labels.format_problems(d).count() == 0 and labels.format_problems(d.withColumn("label_format", F.lit("v0"))).count() == 1
    t = labels.with_negative_day(labels.flat(d), "2024-01-05", "c2", 8, ["list"])
    return labels.with_splits(t, {"train": ["2024-01-01", "2024-01-02"], "val": ["2024-01-05"]})


def test_labels_sound_and_unsound(spark, tmp_path):
    t = flat(spark, tmp_path)
    assert labels.validate(*t).count() == 0
    for day in ("2024-01-05", "2024-13-05"):
        with pytest.raises(ValueError, match=day):
            labels.with_negative_day(t, day, "C2", 8, [])
    with pytest.raises(ValueError, match="soon"):
        labels.with_splits(t, {"train": ["soon"]})
    t = labels.with_day(t, 1, "2024-01-02", None, ["bad"])
    t = t._replace(negatives=t.negatives.withColumns({"day": F.lit("2024-01-01"), "verified_against": F.array().cast("array<string>")}))
    t = labels.with_splits(t, {"train": ["2024-01-01"], "val": ["2024-01-02", "2024-01-09"]})
    got = {r.problem for r in labels.validate(*t).collect()}
    assert got == {"track id without sequence", "negative day overlaps an event", "no verification sources", "split day without data", "neighbouring days in different splits"}


def test_split_resolution_excludes_unlabelled_days(spark, tmp_path):
    x = flat(spark, tmp_path)
    _, days, negatives, splits = x
    t = spark.createDataFrame([(5, "seq5_a_00001"), (5, "seq5_a_00002"), (6, "seq6_a_00001"), (8, "seq8_a_00001")], "sequence_id long, track_id string")
    got = sorted((r.split, r.track_id, r.label) for r in labels.resolve(days, negatives, splits, t).collect())
    assert got == [("train", "seq5_a_00001", 1), ("train", "seq5_a_00002", 0), ("val", "seq8_a_00001", 0)]
    assert labels.resolve_split(x, "val", t).count() == 1
    with pytest.raises(ValueError, match="not defined"):
        labels.resolve_split(x, "test", t)
    with pytest.raises(Exception, match="has no crops"):
        labels.resolve(days, negatives, splits, t.where("track_id != 'seq5_a_00001'")).collect()
    a = {r.track_id: r.event and r.event.relation for r in labels.attributed(t, days).collect()}
    assert a == {"seq5_a_00001": "confirmed_positive", "seq5_a_00002": None, "seq6_a_00001": "unrecovered_event_day", "seq8_a_00001": None}


def test_significant_digits(spark):
    values = [0.0, 1.0, 0.25, 123456.0, 1e-6, 9.7e-07, -0.00012346, 1234.0, 12.3456, 99999.0]
    got = [r.s for r in spark.createDataFrame([(v,) for v in values], "v double").select(evidence.significant(F.col("v")).alias("s")).collect()]
    assert got == [f"{v:.4g}" for v in values]


def test_pandas_is_not_needed_for_features(spark):
    assert "Python" not in tracks.features(spark.createDataFrame([("t", T0, 1.0, 1.0)], "track string, ts timestamp, x double, y double"), "track", "ts", "x", "y", "x", "y")._jdf.queryExecution().toString()
