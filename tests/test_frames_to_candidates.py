import json
from pathlib import Path

import numpy as np

from trackloom.__main__ import main
from trackloom.kernels.fits import write_image
from trackloom.operators.frames import pixels
from trackloom.pipeline import Config, Run
from trackloom.sources.fits import FitsDataSource


def frame(i, moves=True):
    y, x = np.mgrid[0:96, 0:96]
    image = np.random.default_rng(i).normal(200, 4, (96, 96))
    stars = [(*np.random.default_rng(k).uniform(12, 84, 2), 150) for k in range(30)]
    for cx, cy, a in [*stars, *([(30 + 3 * i, 60 - 2 * i, 90)] if moves else [])]:
        image += a * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 4.5)
    header = {"DATE-OBS": "2024/01/01", "TIME-OBS": f"{6 + i // 5:02d}:{i % 5 * 12:02d}:00.000", "TELESCOP": "SOHO", "INSTRUME": "LASCO", "DETECTOR": "C3", "EXPTIME": 18.0}
    return write_image(image.astype(np.int16), header)


def test_from_files_to_candidates(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for i in range(10):
        (tmp_path / "in" / f"{i:08d}.fts").write_bytes(frame(i))
    (tmp_path / "in" / "99999999.fts").write_bytes(b"no frame")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = Run(spark, source, out, Config())
    assert run.failures().count() == 1 and run.images().count() == 10 and run.sequences().count() == 1
    assert main(["run", source, out]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (said["frames"], said["failed"], said["sequences"]) == (10, 1, 1) and said["candidates"].get("HIGH_PRIORITY", 0) >= 1
    best = run.features().orderBy("n_frames", ascending=False).first()
    assert best.n_frames >= 8 and best.direction_consistency > 0.95 and best.frame_coverage > 0.8
    assert main(["report", source, out, "--track-id", best.track_id]) == 0 and "## Key evidence" in capsys.readouterr().out
    said = lambda *command: (main([command[0], source, out, *command[1:]]), [json.loads(x) for x in capsys.readouterr().out.splitlines()])
    code, (built,) = said("sequences")
    assert code == 0 and built["frame_count"] == 10 and said("sequences", "--check-only") == (0, [])
    own = built["sequence_id"]
    for name in ("registered", "detected", "points", "features", "crops"):
        assert said("stage", "--name", name, "--sequence-id", str(own)) == (0, [{"sequence_id": own, "n": getattr(run, name)().count()}])
    assert said("stage", "--name", "points", "--sequence-id", "1") == (0, [])
    scores = {r.track_id: (r.score, r.status) for r in run.candidates().collect()}
    assert {r["track_id"]: (r["score"], r["status"]) for r in said("score")[1]} == scores
    assert {r["run_id"] for r in said("score", "--no-status")[1]} == {"seeded_0"}
    day = {"sequence_id": own, "positive_track_ids": [best.track_id]}
    event = {"soho_number": 1, "group": "Kreutz", "cameras": ["C3"], "obs_start": "2024-01-01", "obs_end": "2024-01-01", "source_file": "f", "source_line": "l", "status": "labeled", "notes": "", "days": {"2024-01-01": day}}
    (tmp_path / "labels.json").write_text(json.dumps({"label_format": "labels_v1", "events": [event], "negative_days": [], "splits": {"train": ["2024-01-01"]}}))
    code, (found, split) = said("validation", "--labels", str(tmp_path / "labels.json"))
    assert found["best_track"] == best.track_id and found["sequence_pool"] == len(scores) and (split["split"], split["n_positives"], split["n_negatives"]) == ("train", 1, len(scores) - 1)
    assert main(["validation", source, out, "--labels", str(tmp_path / "labels.json"), "--markdown"]) == 0
    text = capsys.readouterr().out
    assert f"over {len(scores)} scored tracks" in text and "1/1 labeled Sungrazer events" in text and "| train | 1 |" in text
    code, cells = said("stage", "--name", "detected", "--evaluate")
    assert code == 0 and {(c["sequence_id"], c["method"], c["strength"], c["n_frames"]) for c in cells} == {(own, m, s, 10) for m in ("median", "prev_diff") for s in (10.0, 5.0, 3.0)}
    assert max(c["recovered"] for c in cells) >= 6
    code, cells = said("stage", "--name", "registered", "--evaluate", "--sequence-id", str(own))
    assert code == 0 and len(cells) == 4 and all(c["error"] < 0.5 for c in cells)
    assert said("stage", "--name", "crops", "--evaluate") == (2, [])
    spark.dataSource.register(FitsDataSource)
    rows = spark.read.format("fits").load(source).collect()
    assert len(rows) == 11 and sum(r.error is not None for r in rows) == 1
    good = next(r for r in rows if r.error is None)
    assert pixels(good.data, good.height, good.width, good.dtype).mean() > 100


def test_frames_without_a_partner_give_no_candidates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "00000001.fts").write_bytes(frame(1))
    run = Run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert run.candidates().count() == 0 and run.images().count() == 1


def test_labels_are_edited_saved_and_checked(spark, tmp_path, capsys):
    file, listed = str(tmp_path / "labels.json"), str(tmp_path / "list.txt")
    (tmp_path / "list.txt").write_text("4907 x y A. Name C3 Kreutz Apr30-May01,24 note\n")
    edit = lambda *words: main(["labels", file, *words])
    document = lambda: json.loads((tmp_path / "labels.json").read_text())
    assert edit("init") == 0 and edit("init") == 2 and document()["events"] == []
    assert edit("add-event", "--list", listed, "--number", "4907") == 0 and edit("add-event", "--list", listed, "--number", "4907") == 2
    assert edit("set-day", "--number", "4907", "--day", "2024-05-01", "--sequence-id", "7", "--track-ids", "seq7_a_00001") == 0
    (e,) = document()["events"]
    assert e["status"] == "labeled" and e["days"] == {"2024-04-30": {"positive_track_ids": []}, "2024-05-01": {"sequence_id": 7, "positive_track_ids": ["seq7_a_00001"]}}
    assert edit("add-negative-day", "--day", "2024-05-03", "--camera", "c2", "--sequence-id", "8", "--verified-against", "list") == 0
    assert edit("add-negative-day", "--day", "2024-05-03", "--camera", "C2", "--sequence-id", "8") == 2
    assert edit("set-splits", "train=2024-05-01", "val=2024-05-03") == 0 and edit("validate") == 0 and edit() == 0
    assert document()["splits"] == {"train": ["2024-05-01"], "val": ["2024-05-03"]} and len(document()["negative_days"]) == 1
    capsys.readouterr()
    assert edit("set-splits", "train=2024-05-01,2024-05-02") == 1 and "split day without data" in capsys.readouterr().out
    assert len(document()["events"]) == 1 and not list(tmp_path.glob(".*.crc"))
    assert main(["events", listed, "--group", "kreutz", "--min-days", "2"]) == 0 and json.loads(capsys.readouterr().out)["soho_number"] == 4907


def test_crops_follow_the_tracks(spark, tmp_path):
    """Of two sequences the track of one loses its last frame: its crops are cut anew, the other's files stay, and scores follow; without its tracks a sequence has no crops."""
    (tmp_path / "in").mkdir()
    for i in range(10):
        (tmp_path / "in" / f"{i:08d}.fts").write_bytes(frame(i))
        (tmp_path / "in" / f"{i + 20:08d}.fts").write_bytes(frame(i).replace(b"2024/01/01", b"2024/01/05"))
    run = Run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (Path(run.root) / "crops").rglob("*.parquet")}
    tracks = lambda x: sorted(r.track_id for r in x.select("track_id").collect())
    first = tracks(run.crops())
    a, b = sorted({r.sequence_id for r in run.points().select("sequence_id").collect()})
    assert tracks(run.candidates()) == first and len(first) == 2 and run.crops().columns.count("sequence_id") == 1
    was = files()
    assert tracks(run.crops()) == first and files() == was
    every = run.points().collect()
    last = max(r.frame for r in every if r.sequence_id == a)

    def replace(rows):
        spark.createDataFrame(rows, run.points().schema).write.mode("overwrite").parquet(f"{run.root}/points")

    replace([r for r in every if (r.sequence_id, r.frame) != (a, last)])
    lengths = lambda x: {r.track_id: r.n_frames for r in x.collect()}
    want = {t: sum(r.track_id == t and (r.sequence_id, r.frame) != (a, last) for r in every) for t in first}
    assert lengths(run.crops()) == lengths(run.candidates()) == lengths(run.features()) == want and sum(want.values()) == len(every) - 1
    now = files()
    assert {p for p in was if f"sequence_id={b}" in p} == {p for p in now if f"sequence_id={b}" in p} and all(now.get(p, t) == t for p, t in was.items() if f"sequence_id={b}" in p)
    assert not {p for p in was if f"sequence_id={a}" in p} & set(now)
    replace([r for r in every if r.sequence_id == b])
    assert {r.sequence_id for r in run.crops().collect()} == {b} and files() == now
    replace(every)
    assert tracks(run.crops()) == first == tracks(run.predictions())
