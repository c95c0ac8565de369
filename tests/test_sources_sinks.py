import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.kernels import net
from trackloom.kernels.fits import write_image
from trackloom.operators import evidence, ranking, scoring
from trackloom.session import shared_dir
from trackloom.sinks import files
from trackloom.sources import archive, arrays, documents

DAY = dt.date(2024, 1, 2)


def served(pages):
    return lambda url: pages.get(url, (404, b""))


def test_a_day_is_listed_from_the_first_archive_that_has_it():
    page = b'<a href="22812345.fts"><a HREF="22812344.FTS"><a href="22812345.fts"><a href="x.jpg">'
    fetch = served({"https://b/240102/c3/": (200, page), "https://c/240102/c3/": (500, b"")})
    assert archive.list_day(fetch, ["https://a", "https://b/", "https://c"], DAY, "C3") == ("https://b/240102/c3/", ["22812344.FTS", "22812345.fts"])
    assert archive.list_day(fetch, ["https://a"], DAY, "C3") == (None, [])
    with pytest.raises(OSError, match="500"):
        archive.list_day(fetch, ["https://c"], DAY, "c3")
    with pytest.raises(ValueError, match="c9"):
        archive.day_url("https://a", DAY, "c9")


def test_frames_are_fetched_validated_and_summed_up(spark):
    good = write_image(np.ones((4, 4), np.int16), {"DATE-OBS": "2024/01/02", "TELESCOP": "SOHO", "DETECTOR": "C3"})
    pages = {"https://a/1.fts": (200, good), "https://a/2.fts": (200, b"junk"), "https://a/3.fts": (503, b"")}
    fetch = lambda url: pages[url]
    listed = spark.createDataFrame([(f"{i}.fts",) for i in range(1, 6)], "name string")
    manifest = spark.createDataFrame([("4.fts", "complete"), ("5.fts", "failed")], "name string, status string")
    assert [r.name for r in archive.wanted(listed, manifest, 4).orderBy("name").collect()] == ["1.fts", "2.fts", "3.fts"]
    done = archive.ingest(archive.wanted(listed, manifest, 4), fetch, "https://a/", 2, 0.0).cache()
    got = {r.name: r for r in done.collect()}
    assert got["1.fts"].status == "complete" and bytes(got["1.fts"].content) == good and got["1.fts"].date_obs == "2024/01/02" and got["1.fts"].size_bytes == len(good)
    assert [got[f"{i}.fts"].status for i in (2, 3)] == ["failed"] * 2 and "503" in got["3.fts"].error and got["2.fts"].content is None
    assert tuple(archive.summary(listed.limit(4), done).first()) == (4, 1, 1, 2)
    assert files.stage_summary(done).orderBy("status").collect()[1]["n"] == 2


def test_documents(spark, tmp_path):
    for day in ("a", "b"):
        (tmp_path / "raw" / day).mkdir(parents=True)
        entry = {"status": "complete", "source_url": "u", "date_obs": "2024/01/02T03:04:05.5"}
        (tmp_path / "raw" / day / "manifest.json").write_text(json.dumps({f"{day}1.fts": entry, f"{day}2.fts": {"status": "failed", "error": "x"}}))
    m = documents.day_manifests(spark, str(tmp_path / "raw" / "*" / "manifest.json"))
    assert sorted((r.name, r.status, r.observation_time) for r in m.collect() if r.observation_time) == [(f"{d}1.fts", "complete", dt.datetime(2024, 1, 2, 3, 4, 5, 500000)) for d in "ab"] and m.count() == 4
    (tmp_path / "stage.json").write_text(json.dumps({"config_hash": "h", "frames": {"x": {"status": "ok", "n": 3}}}))
    assert tuple(documents.stage_document(spark, str(tmp_path / "stage.json"), "struct<status:string,n:int>").select("config_hash", "name", "status", "n").first()) == ("h", "x", "ok", 3)
    (tmp_path / "list.txt").write_text("4907 x y A. Name C3 Kreutz Apr30-May01,24 note\n\nno event\n")
    found, other = documents.confirmation_list(spark, str(tmp_path / "list.txt"))
    assert found.first().soho_number == 4907 and [r.line for r in other.collect()] == ["no event"]
    frames = spark.createDataFrame([("f1",), ("f2",)], "name string")
    sources = spark.createDataFrame([("f1", "a1.fts"), ("f2", "a2.fts")], "name string, source string")
    assert documents.frame_times(frames.limit(1), sources, m).first().observation_time.hour == 3
    with pytest.raises(Exception, match="no time for f2"):
        documents.frame_times(frames, sources, m).collect()


def test_ledger_and_pending_work(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda *x: spark.createDataFrame(list(x), "name string, status string, config_hash string")
    files.append_ledger(rows(("a", "failed", "h"), ("b", "ok", "h"), ("c", "ok", "old")), path)
    files.append_ledger(rows(("a", "ok", "h")), path)
    ledger = files.read_ledger(spark, path, ["name"])
    assert {r.name: r.status for r in ledger.collect()} == {"a": "ok", "b": "ok", "c": "ok"}
    work = spark.createDataFrame([(x,) for x in "abcd"], "name string")
    assert sorted(r.name for r in files.pending(work, ledger, ["name"], "h").collect()) == ["c", "d"]


def test_frames_replace_only_their_own_sequences(spark, tmp_path):
    path = str(tmp_path / "frames")
    rows = lambda *x: spark.createDataFrame(list(x), "sequence_id long, frame string")
    files.write_frames(rows((1, "a"), (2, "b")), path)
    files.write_frames(rows((2, "c")), path)
    assert sorted((r.sequence_id, r.frame) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    files.write_json(rows((1, "a")), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().frame == "a"


def test_arrays_and_weights_of_files(spark, tmp_path):
    w = net.seeded_weights(3)
    np.savez(tmp_path / "one.npz", **w, other=np.arange(6).reshape(2, 3))
    np.savez(tmp_path / "seq1_a_00001.npz", crops=np.ones((3, 8, 8), np.float32))
    (tmp_path / "bad.npz").write_bytes(b"junk")
    x = arrays.read(spark, str(tmp_path)).cache()
    assert x.where("error is not null").count() == 1 and (arrays.array_of(x.where("name = 'other'").first()) == np.arange(6).reshape(2, 3)).all()
    s = arrays.stacks(x)
    assert (s.first().track_id, s.first().crop_size, scoring.stack_of(s.first().crops, 8).shape) == ("seq1_a_00001", 8, (3, 8, 8))
    runs = scoring.weights_of(x.where("path like '%one.npz'"))
    assert runs.keys() == {"one"} and all((runs["one"][k] == w[k]).all() for k in w)
    with pytest.raises(ValueError, match="conv0.w"):
        net.known({k: v for k, v in w.items() if k != "conv0.w"})
    one, primary = scoring.score_runs(s, runs)
    both, fused = scoring.score_runs(s, runs | {"two": net.seeded_weights(4)})
    got = {r.run_id: r.score for r in both.collect()}
    assert primary == "one" and one.count() == 1 and fused == ranking.FUSION and got[fused] == pytest.approx((got["one"] + got["two"]) / 2)


def test_summary_text(spark):
    events = spark.createDataFrame([(1, "Kreutz", ["train"], True, 1, 0.9, 3, 1, 40, 1200), (2, "Meyer", ["unsplit"], False, 0, None, None, None, None, 1200)], "soho_number int, group string, splits array<string>, recovered boolean, n_positive_tracks long, best_fusion double, global_rank long, sequence_rank long, sequence_pool long, global_pool long")
    splits = spark.createDataFrame([("val", 1, 1000, 0.5, 0.1, 1.0, 1.0), ("train", 2, 3, 0.25, 0.2, 0.5, 1.0)], "split string, n_positives long, n_negatives long, ap double, p_at_10 double, r_at_50 double, r_at_250 double")
    text = evidence.markdown(events, splits, 1200).split("\n")
    assert text[2] == "Primary score: `fusion_mean_v1` over 1,200 scored tracks." and text[6].startswith("1/2 labeled Sungrazer events") and "1/1 rank" in text[6]
    assert text[10:12] == ["| 1 | Kreutz | train | yes (1 track) | 0.9000 | 1/40 | 3/1200 |", "| 2 | Meyer | unsplit | no | — | — | — |"]
    assert text[17:19] == ["| train | 2 | 3 | 0.2500 | 0.2000 | 0.5000 | 1.0000 |", "| val | 1 | 1,000 | 0.5000 | 0.1000 | 1.0000 | 1.0000 |"] and text[-1] == ""


def test_the_shared_folder_is_the_session_s(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_numbers_as_text(spark):
    from trackloom.functions import fixed

    rng = np.random.default_rng(1)
    values = [*np.round(rng.normal(0, 1, 300), 4).tolist(), *(10 ** rng.uniform(-9, 9, 300)).tolist(), *np.round(rng.uniform(0, 20000, 300), 1).tolist(), 0.0, 1.2345, 2.5e-5, 12345.0, 0.00012345, 9999.5, 99995.0]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    got = d.select(evidence.significant(F.col("v")).alias("s"), fixed(F.col("v"), 4).alias("f")).collect()
    assert [r.s for r in got] == [f"{v:.4g}" for v in values] and [r.f for r in got] == [f"{v:.4f}" for v in values]
