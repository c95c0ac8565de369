"""From a folder of frames to ranked candidates with evidence: every stage a table, so a run goes on where it stopped."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import config_hash, sequence_of
from .kernels import net
from .kernels.frames import MotionConfig, RegisterConfig
from .operators import evidence, frames, scoring, sequencing, tracking, tracks, upserts
from .session import new_path, written
from .sinks import files
from .sources import fits


@dataclass(frozen=True)
class Config:
    gap_minutes: float = 60.0
    preprocess: dict = field(default_factory=dict)
    register: RegisterConfig = RegisterConfig()
    motion: MotionConfig = MotionConfig()
    tracks: tracking.TracksConfig = tracking.TracksConfig()
    crop_size: int = 32
    model_seed: int = 0

    def hash(self) -> str:
        return config_hash(asdict(self))


class Run:
    """Stages of one configuration under ``out``; a stage that is there is read, not made again.

    Tables are named by the hash of the configuration, so another configuration makes tables of its own. What is made of
    tracks (crops, features, scores, candidates) follows them where the table of track points changes.
    """

    def __init__(self, spark: SparkSession, source: str, out: str, config: Config = Config()):  # noqa: B008
        self.spark, self.source, self.config = spark, source, config
        self.root = f"{out.rstrip('/')}/{config.hash()}"

    def stage(self, name: str, make, **partition) -> DataFrame:
        path = f"{self.root}/{name}"
        made = make()  # a plan, for its schema: an empty table has none in its files
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            writer = made.write.mode("overwrite")
            (writer.partitionBy(partition["by"]) if partition else writer).parquet(path)
        return self.spark.read.schema(made.schema).parquet(path)

    def raw(self) -> DataFrame:
        return self.stage("raw", lambda: fits.read(self.spark, self.source))

    def failures(self) -> DataFrame:
        return self.raw().where("error is not null").select("path", "error")

    def images(self) -> DataFrame:
        """Good frames with their sequence: ids are numbered by instrument and start."""

        def make() -> DataFrame:
            x = self.raw().where("error is null").withColumn("frame", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
            x = sequencing.sessionise(x, "instrument", "ts", "frame", self.config.gap_minutes)
            key = F.concat_ws("|", "instrument", F.col("day").cast("string"), F.lpad(F.col("seq").cast("string"), 5, "0"))
            return x.withColumn("sequence_id", F.xxhash64(key).bitwiseAND(F.lit((1 << 53) - 1)))

        return self.stage("images", make)

    def sequences(self) -> DataFrame:
        return sequencing.fold(self.images(), ["sequence_id", "instrument", "day"], "ts")

    def registered(self) -> DataFrame:
        return self.stage("registered", lambda: frames.register(frames.preprocess(self.images(), **self.config.preprocess), self.config.register), by="sequence_id")

    def detected(self) -> DataFrame:
        return self.stage("detected", lambda: frames.detect(self.registered(), self.config.motion, residuals=True, span=frames.SPAN), by="sequence_id")

    def points(self) -> DataFrame:
        return self.stage("points", lambda: tracking.build(frames.exploded(self.detected()), self.detected().select("sequence_id", "frame", "ts"), self.config.hash()[:8], self.config.tracks))

    def features(self) -> DataFrame:
        """Features by the reference frame's sun centre, counted from 0; epochs are the sequence's detected frames."""

        def make() -> DataFrame:
            center = frames.reference_frames(frames.preprocess(self.images(), **self.config.preprocess)).select("sequence_id", (F.col("sun_x") - 1).alias("cx"), (F.col("sun_y") - 1).alias("cy"))
            p = self.points().join(tracks.epochs(self.detected(), "sequence_id", "ts"), ["sequence_id", "ts"]).join(center, "sequence_id", "left")
            return tracks.features(p, "track_id", "ts", "x", "y", "flux", "area", (F.col("cx"), F.col("cy")), "epoch")

        return self.stage_of_tracks("features", make)

    def tracks_of(self) -> DataFrame:
        """sequence_id and ``tracks``, a fingerprint of the sequence's track points that no order of rows changes."""
        p = self.points()
        of = F.concat_ws(":", F.count(F.lit(1)), F.hex(F.bit_xor(F.xxhash64(*p.columns))))
        return p.groupBy("sequence_id").agg(of.alias("tracks"))

    def crops(self) -> DataFrame:
        """Crop stacks of the tracks as they are now.

        A ledger says of which tracks a sequence's crops were cut. Sequences whose tracks changed since, or that are new, are
        cut anew, the others stay as they are; crops of sequences that have no tracks any more are not read. Crops are written
        before their entry, so a run that stops between the two cuts them again.
        """
        path, log, now = f"{self.root}/crops", f"{self.root}/crops_ledger", self.tracks_of()
        made = lambda p: frames.crops(p, self.detected(), self.config.crop_size).withColumn("sequence_id", sequence_of(F.col("track_id")))
        entries = "sequence_id long, tracks string, config_hash string, status string, recorded_at timestamp"
        known = files.read_ledger(self.spark, log, ["sequence_id"], entries) if files.exists(self.spark, log) else self.spark.createDataFrame([], entries)
        todo = written(files.pending(now, known, ["sequence_id", "tracks"], self.config.hash()), new_path(self.spark, "todo"))
        if not todo.isEmpty():
            files.write_frames(made(self.points().join(todo.select("sequence_id"), "sequence_id", "left_semi")), path)
            files.append_ledger(todo.select("sequence_id", "tracks", F.lit(self.config.hash()).alias("config_hash"), F.lit("complete").alias("status")).coalesce(1), log)
        schema = made(self.points()).schema
        there = self.spark.read.schema(schema).parquet(path) if files.exists(self.spark, path) else self.spark.createDataFrame([], schema)
        return there.join(now.select("sequence_id"), "sequence_id", "left_semi").select(*schema.names)

    def stage_of_tracks(self, name: str, make) -> DataFrame:
        """A stage whose table is named by a fingerprint of all tracks: tracks that changed give a table of their own."""
        of = self.tracks_of().agg(F.concat_ws(":", F.count(F.lit(1)), F.hex(F.bit_xor(F.xxhash64("sequence_id", "tracks")))).alias("h")).first().h
        return self.stage(f"{name}-{config_hash(of)}", make)

    def predictions(self) -> DataFrame:
        return self.stage_of_tracks("predictions", lambda: scoring.score(self.crops(), net.seeded_weights(self.config.model_seed), "seeded_v1"))

    def candidates(self) -> DataFrame:
        """Tracks with score and priority."""

        def make() -> DataFrame:
            g = self.points().groupBy("track_id", "sequence_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("n_frames"))
            x = g.join(self.predictions().select("track_id", "score"), "track_id", "left").join(self.sequences().select("sequence_id", "instrument"), "sequence_id")
            x = x.withColumns({"label": F.lit(None).cast("string"), "status": F.lit("UNRESOLVED")})
            return upserts.bands(x, "track_id", "score", "label", "status")

        return self.stage_of_tracks("candidates", make)

    def packages(self) -> DataFrame:
        runs = self.predictions().withColumn("model_version", F.lit("seeded"))
        events = self.candidates().select("track_id", F.lit(None).cast("struct<soho_number:int,relation:string,day:string>").alias("event"))
        return evidence.packages(self.candidates(), self.points(), self.features(), runs, events, {"config_hash": F.lit(self.config.hash())})

    def shortlist(self, least: int = 8, top: int = 10) -> DataFrame:
        return tracks.shortlist(self.features(), "track_id", least, top)
