"""python -m trackloom COMMAND: run, sequences, stage, train, score, validation, shortlist, evidence, report, similar on a folder of frames; ingest, persist on the archive; events, labels on documents."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingestion
from .functions import config_hash, sequence_of
from .kernels import net
from .kernels.frames import MotionConfig
from .operators import evidence, frames, index, labels, planting, ranking, scoring, sequencing, similarity, tracks, training, upserts
from .operators.tracking import TracksConfig
from .pipeline import Config, Run
from .schemas import FEATURES
from .session import get_session, stored
from .sinks.files import exists, write_document
from .sources import archive, arrays, documents

ON_FRAMES = ("run", "sequences", "stage", "train", "score", "validation", "shortlist", "evidence", "report", "similar")
STAGES = ("registered", "detected", "points", "features", "crops")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trackloom")
    sub = p.add_subparsers(dest="command", required=True)
    of = {name: sub.add_parser(name) for name in (*ON_FRAMES, "ingest", "persist", "events", "labels")}
    for name in ON_FRAMES:
        s = of[name]
        s.add_argument("source")
        s.add_argument("out")
        s.add_argument("--gap-minutes", type=float, default=60.0)
        s.add_argument("--method", choices=("median", "prev_diff"), default=MotionConfig.method)
        s.add_argument("--min-track-frames", type=int, default=TracksConfig.min_track_frames)
        s.add_argument("--crop-size", type=int, default=Config.crop_size)
    of["sequences"].add_argument("--check-only", action="store_true")
    of["stage"].add_argument("--name", choices=STAGES, required=True)
    of["stage"].add_argument("--sequence-id", type=int)
    of["stage"].add_argument("--evaluate", action="store_true", help="plant shifts (registered) or moving sources (detected) and count what is found again")
    of["train"].add_argument("--labels", required=True, help="labels with the splits train and val, and test for --test")
    of["train"].add_argument("--epochs", type=int, default=training.TrainConfig.epochs)
    of["train"].add_argument("--batch-size", type=int, default=training.TrainConfig.batch_size)
    of["train"].add_argument("--seed", type=int, default=training.TrainConfig.seed)
    of["train"].add_argument("--test", action="store_true", help="report on the test split with the checkpoint of an earlier run")
    of["score"].add_argument("--weights", help="folder of .npz checkpoints, one a run")
    of["score"].add_argument("--no-status", action="store_true")
    of["validation"].add_argument("--labels", required=True)
    of["validation"].add_argument("--markdown", action="store_true", help="the summary as text")
    of["shortlist"].add_argument("--min-frames", type=int, default=8)
    of["shortlist"].add_argument("--top", type=int, default=10)
    for name in ("evidence", "report", "similar"):
        of[name].add_argument("--track-id", required=True)
    of["similar"].add_argument("--limit", type=int, default=20)
    for name in ("ingest", "persist"):
        of[name].add_argument("--data-root", required=True, help="folder that Spark and all executors reach")
    of["ingest"].add_argument("--date", type=date.fromisoformat, required=True)
    of["ingest"].add_argument("--camera", choices=archive.CAMERAS, default="c3")
    of["ingest"].add_argument("--limit", type=int)
    of["ingest"].add_argument("--base", nargs="+", default=list(ingestion.BASES), help="archives, the first that lists the day is taken")
    of["persist"].add_argument("--out", help="folder of the tables; DATA_ROOT/index without")
    s = of["events"]
    s.add_argument("file")
    s.add_argument("--camera")
    s.add_argument("--group")
    s.add_argument("--min-days", type=int, default=1)
    s = of["labels"]
    s.add_argument("file")
    edits = s.add_subparsers(dest="edit")
    edit = {name: edits.add_parser(name) for name in ("validate", "init", "add-event", "add-negative-day", "set-day", "set-splits")}
    edit["add-event"].add_argument("--list", required=True, help="confirmation list")
    for name in ("add-event", "set-day"):
        edit[name].add_argument("--number", type=int, required=True)
    for name in ("add-negative-day", "set-day"):
        edit[name].add_argument("--day", required=True)
        edit[name].add_argument("--sequence-id", type=int, required=name != "set-day")
    edit["add-negative-day"].add_argument("--camera", required=True)
    edit["add-negative-day"].add_argument("--verified-against", nargs="+", default=[])
    edit["set-day"].add_argument("--track-ids", nargs="+")
    edit["set-splits"].add_argument("splits", nargs="+", metavar="NAME=DAY,DAY")
    return p


def lines(df: DataFrame) -> None:
    """Rows as JSON, one a line, as they come."""
    for r in df.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
        print(r.line)


def events(spark: SparkSession, a: argparse.Namespace) -> int:
    found, failed = documents.confirmation_list(spark, a.file)
    if a.camera:
        found = found.where(F.array_contains("cameras", a.camera.upper()))
    if a.group:
        found = found.where(F.lower("group") == a.group.lower())
    lines(found.where(F.datediff("obs_end", "obs_start") + 1 >= a.min_days))
    print(f"{failed.count()} other lines", file=sys.stderr)
    return 0


def ingest(spark: SparkSession, a: argparse.Namespace) -> int:
    """1 where frames failed and none came down or was there."""
    said = ingestion.ingest_day(spark, a.date, a.camera, f"{a.data_root.rstrip('/')}/{ingestion.FOLDER}", tuple(a.base), a.limit)
    print(json.dumps(said))
    return int(said["failed"] > 0 and said["downloaded"] + said["skipped"] == 0)


def persist(spark: SparkSession, a: argparse.Namespace) -> int:
    """1 where nothing was ever fetched below the root."""
    root = a.data_root.rstrip("/")
    if not exists(spark, f"{root}/{ingestion.FOLDER}"):
        print(f"{root}/{ingestion.FOLDER} is missing", file=sys.stderr)
        return 1
    print(json.dumps(ingestion.persist(spark, f"{root}/{ingestion.FOLDER}", a.out or f"{root}/index")))
    return 0


def edited(spark: SparkSession, a: argparse.Namespace) -> labels.Tables:
    if a.edit == "init":
        if exists(spark, a.file):
            raise ValueError(f"{a.file} is there already")
        return labels.no_labels(spark)
    t = labels.flat(documents.labels(spark, a.file))
    if a.edit == "add-event":
        return labels.with_listed_event(t, spark.read.text(a.list).withColumnRenamed("value", "line"), a.number, a.list)
    if a.edit == "add-negative-day":
        return labels.with_negative_day(t, a.day, a.camera, a.sequence_id, a.verified_against)
    if a.edit == "set-day":
        return labels.with_day(t, a.number, a.day, a.sequence_id, a.track_ids)
    return labels.with_splits(t, {name: days.split(",") for name, _, days in (x.partition("=") for x in a.splits)})


def edit_labels(spark: SparkSession, a: argparse.Namespace) -> int:
    """Saves an edit first and then checks the whole document: 1 if it has problems, 2 if the edit is none."""
    if a.edit not in (None, "validate"):
        try:
            write_document(labels.document(edited(spark, a)), a.file)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
    document = documents.labels(spark, a.file)
    problems = labels.format_problems(document).unionByName(labels.validate(*labels.flat(document))).collect()
    for r in problems:
        print(f"{r.subject}: {r.problem} {r.detail}")
    return int(bool(problems))


def invalid(features: DataFrame) -> int:
    return features.where(F.size(tracks.problems()) > 0).count()


def summary(run: Run) -> int:
    n = run.candidates().groupBy("status").count().collect()
    bad, good, failed = invalid(run.features()), run.images().count(), run.failures().count()
    print(json.dumps({"frames": good, "failed": failed, "sequences": run.sequences().count(), "candidates": {r.status: r["count"] for r in n}, "invalid_features": bad}))
    return int(bool(bad) or (failed > 0 and good == 0))


def sequences(run: Run, check_only: bool) -> int:
    built = run.sequences()
    if not check_only:
        lines(built.orderBy("instrument", "start_time"))
    seen = run.images().select(F.col("frame").alias("id"), "sequence_id", "instrument", F.col("ts").alias("observation_time"))
    problems = sequencing.check(seen, built.withColumnRenamed("sequence_id", "id"), run.config.gap_minutes).collect()
    for r in problems:
        print(f"{r.sequence_id}: {r.problem} {r.detail}")
    return int(bool(problems))


def stage(run: Run, name: str, sequence_id: int | None) -> int:
    """Rows of a stage by sequence; for features 1 if any is invalid."""
    x = getattr(run, name)()
    if "sequence_id" not in x.columns:
        x = x.withColumn("sequence_id", sequence_of(F.col("track_id")))
    if sequence_id is not None:
        x = x.where(F.col("sequence_id") == sequence_id)
    lines(x.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n")).orderBy("sequence_id"))
    return int(name == "features" and invalid(x) > 0)


def evaluate(run: Run, name: str, sequence_id: int | None) -> int:
    """Planting experiments on the frames of a stage, one line a sequence and cell; 2 for a stage that has none."""
    if name not in ("registered", "detected"):
        print(f"nothing can be planted into {name}", file=sys.stderr)
        return 2
    only = F.lit(True) if sequence_id is None else F.col("sequence_id") == sequence_id
    if name == "registered":
        found = planting.shift_recovery(frames.preprocess(run.images().where(only), **run.config.preprocess))
        lines(found.orderBy("sequence_id", "dx"))
    else:
        found = planting.recovery(stored(planting.planted(run.registered().where(only)), "planted"), config=run.config.motion, span=frames.SPAN)
        lines(found.orderBy("sequence_id", F.desc("strength"), "method"))
    return 0


def train(run: Run, a: argparse.Namespace) -> int:
    """The history of a training run and its checkpoint under ``models``; with --test the report on the test split and the rank of each positive."""
    t, stacks = labels.flat(documents.labels(run.spark, a.labels)), run.crops()
    there = stacks.select(sequence_of(F.col("track_id")).alias("sequence_id"), "track_id")
    config = training.TrainConfig(epochs=a.epochs, batch_size=a.batch_size, seed=a.seed)
    name = config_hash(asdict(config) | {"labels": sorted(r.value for r in run.spark.read.text(a.labels).collect())})
    path = f"{run.root}/models/run_{name}_seed{a.seed}.npz"
    if a.test:
        if not exists(run.spark, path):
            print(f"{path} is missing: train first", file=sys.stderr)
            return 2
        (weights,) = scoring.weights_of(arrays.read(run.spark, path)).values()
        known = labels.resolve_split(t, "test", there)
        scored = scoring.score(stacks, weights, "trained", max_frames=config.max_frames)
        lines(ranking.report(scored.join(known, "track_id"), [], "label", "score", "track_id"))
        lines(training.positive_ranks(scored, known).orderBy("rank"))
        return 0
    weights, history = training.train(stacks, labels.resolve_split(t, "train", there), labels.resolve_split(t, "val", there), config)
    for epoch in history:
        print(json.dumps(epoch))
    training.save(run.spark, weights, path)
    print(path, file=sys.stderr)
    return 0


def score(run: Run, weights: str | None, with_status: bool) -> None:
    """Scores of all runs, or the candidates with the priority that the ranking run gives them."""
    runs = scoring.weights_of(arrays.read(run.spark, weights)) if weights else {f"seeded_{run.config.model_seed}": net.seeded_weights(run.config.model_seed)}
    every, first = scoring.score_runs(run.crops(), runs)
    print(f"ranked by {first}", file=sys.stderr)
    if not with_status:
        return lines(every.orderBy("run_id", F.desc("score"), "track_id"))
    x = run.candidates().drop("score").withColumn("status", F.lit("UNRESOLVED"))
    x = x.join(every.where(F.col("run_id") == first).select("track_id", "score"), "track_id", "left")
    return lines(upserts.bands(x, "track_id", "score", "label", "status").select("track_id", "score", "status").orderBy(F.desc("score"), "track_id"))


def validation(run: Run, path: str, as_text: bool) -> None:
    """Recovery of every labelled event, then the ranking quality of every split: a line each, or the summary as text."""
    t = labels.flat(documents.labels(run.spark, path))
    scored, there = run.predictions(), run.points().select("sequence_id", "track_id").distinct()
    found = ranking.event_summary(t.events, t.days, t.splits, scored)
    splits = ranking.split_summary(labels.resolve(t.days, t.negatives, t.splits, there), scored)
    if as_text:
        print(evidence.markdown(found, splits, scored.count(), "seeded_v1"))
        return
    lines(found.orderBy("soho_number"))
    lines(splits.orderBy("split"))


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "ingest" and a.date > datetime.now(UTC).date():
        p.error("the date lies in the future")
    spark = get_session()
    if a.command in ("ingest", "persist", "events", "labels"):
        return {"ingest": ingest, "persist": persist, "events": events, "labels": edit_labels}[a.command](spark, a)
    if a.gap_minutes <= 0:
        p.error("the gap must be positive")
    config = Config(gap_minutes=a.gap_minutes, motion=MotionConfig(method=a.method), tracks=TracksConfig(min_track_frames=a.min_track_frames), crop_size=a.crop_size)
    run = Run(spark, a.source, a.out, config)
    if a.command == "run":
        return summary(run)
    if a.command == "sequences":
        return sequences(run, a.check_only)
    if a.command == "train":
        return train(run, a)
    if a.command == "stage" and a.evaluate:
        return evaluate(run, a.name, a.sequence_id)
    if a.command == "stage":
        return stage(run, a.name, a.sequence_id)
    if a.command == "score":
        score(run, a.weights, not a.no_status)
    elif a.command == "validation":
        validation(run, a.labels, a.markdown)
    elif a.command == "shortlist":
        lines(run.shortlist(a.min_frames, a.top))
    elif a.command == "similar":
        lines(similarity.nearest(similarity.vector_of(run.features(), "track_id", list(FEATURES)), "track_id", a.track_id, a.limit))
    else:
        one = index.detail(run.packages(), "track_id", a.track_id)
        lines(one) if a.command == "evidence" else print(evidence.reports(one).first().report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
