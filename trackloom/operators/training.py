"""Training of the temporal ranking model: gradients on the executors, one small model on the driver.

Stacks are normalised once and stored in slices by a hash of their id; a step reads one slice, its partitions sum their
gradients, groups of partitions sum theirs, and the driver adds at most ``GROUPS`` of them, each the size of the model.
An epoch draws every stack a seeded Poisson number of times, which is sampling with replacement without passing the
sampler's state around: as many draws as stacks in the mean, of which positives have the configured share. Partial sums are added in the order of
their partitions, so a run repeats exactly while the stored files are split alike.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import learn, net
from ..session import discard, new_path, stored
from ..sinks.files import located
from . import ranking, scoring

#: Sums of gradients that reach the driver in a step, at most.
GROUPS = 32


@dataclass(frozen=True)
class TrainConfig:
    epochs: int = 20
    batch_size: int = 32
    learning_rate: float = 1e-3
    weight_decay: float = 0.0
    positive_share: float = 0.1
    max_frames: int = 16
    seed: int = 0


def sums(rows: DataFrame, weights: dict[str, np.ndarray], epoch: int, config: TrainConfig, rates: tuple[float, float]) -> tuple[dict, float, int]:
    """Gradient and loss summed over what the epoch draws from the rows (track_id, length, stack, size, vector, label), and the number of draws."""
    shapes = {k: w.shape for k, w in weights.items()}
    names = list(shapes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, drawn = None, 0.0, 0
        for part in (p.iloc[at : at + scoring.AT_ONCE] for p in parts for at in range(0, len(p), scoring.AT_ONCE)):
            counts = np.array([np.random.default_rng([config.seed, epoch, h & (2**64 - 1)]).poisson(rates[int(y)]) for h, y in zip(part.hash, part.label, strict=True)])
            stacks = [np.frombuffer(s, "<f4").reshape(-1, n, n) for s, n in zip(part["stack"], part["size"], strict=True)]
            extra = None if part.vector.isna().all() else np.stack([np.asarray(v, np.float32) for v in part.vector])
            g, more = learn.gradient(stacks, part.length.tolist(), part.label.to_numpy(), counts, weights, extra)
            flat = np.concatenate([g[k].ravel() for k in names]).astype(np.float64)
            total, loss, drawn = flat if total is None else total + flat, loss + more, drawn + int(counts.sum())
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "g": [total.tobytes()], "loss": [loss], "drawn": [drawn]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("part")
        total = np.sum([np.frombuffer(g) for g in part.g], axis=0)
        return pd.DataFrame({"part": part.part[:1], "g": [total.tobytes()], "loss": [part.loss.sum()], "drawn": [part.drawn.sum()]})

    schema = "part int, g binary, loss double, drawn long"
    each = rows.withColumn("hash", F.xxhash64("track_id")).mapInPandas(run, schema)
    found = sorted(each.groupBy((F.col("part") % GROUPS).alias("of")).applyInPandas(add, schema).collect(), key=lambda r: r.part)
    total = np.sum([np.frombuffer(r.g) for r in found], axis=0) if found else np.zeros(net.parameters(weights))
    cuts = np.cumsum([math.prod(s) for s in shapes.values()])[:-1]
    return {k: g.reshape(shapes[k]) for k, g in zip(names, np.split(total, cuts), strict=True)}, sum(r.loss for r in found), sum(r.drawn for r in found)


def train(stacks: DataFrame, labels: DataFrame, validation: DataFrame, config: TrainConfig = TrainConfig(), vector: str | None = None, features: int = 0) -> tuple[dict[str, np.ndarray], list[dict]]:  # noqa: B008
    """Weights of the epoch with the best average precision on ``validation`` (the first of equals), and the history of epochs.

    ``stacks`` are track_id, crops, crop_size (and ``vector`` of so many ``features``), ``labels`` and ``validation`` are
    (track_id, label) of theirs. Tracks without a stack, stacks without a label and labels other than 0 and 1 take no part;
    training without positives or without negatives, and validation without positives, are errors.
    """
    known = lambda x: x.where("label in (0, 1)").select("track_id", F.col("label").cast("int").alias("label"))
    extra = F.col(vector) if vector else F.lit(None).cast("array<double>")
    x = stacks.select("track_id", "crops", "crop_size", extra.alias("vector"))
    made = scoring.normalised(x, config.max_frames).join(x.select("track_id", F.col("crop_size").alias("size"), "vector").join(known(labels), "track_id"), "track_id")
    spark = stacks.sparkSession
    n, p = known(labels).join(x.select("track_id"), "track_id").agg(F.count(F.lit(1)), F.sum("label")).first()
    if not p or p == n:
        raise ValueError("training needs positives and negatives")
    slices, path = math.ceil(n / config.batch_size), new_path(spark, "training")
    made = made.withColumn("slice", F.pmod(F.xxhash64("track_id", F.lit(config.seed)), F.lit(slices)).cast("int"))
    made.repartition("slice").sortWithinPartitions("slice", "track_id").write.partitionBy("slice").parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    held = stored(x.join(known(validation), "track_id"), "validation")
    if not held.where("label = 1").count():
        raise ValueError("validation needs positives")
    rates = (1 - config.positive_share) * n / (n - p), config.positive_share * n / p
    weights, adam = net.seeded_weights(config.seed, features), learn.Adam(config.learning_rate, config.weight_decay)
    best, history = None, []
    for epoch in range(1, config.epochs + 1):
        loss = drawn = 0
        for i in np.random.default_rng([config.seed, epoch]).permutation(slices):
            g, more, count = sums(rows.where(F.col("slice") == int(i)).drop("slice"), weights, epoch, config, rates)
            if count:
                weights = adam.step(weights, {k: (v / count).astype(np.float32) for k, v in g.items()})
            loss, drawn = loss + more, drawn + count
        found = quality(held, weights, config, vector)
        history.append({"epoch": epoch, "train_loss": loss / max(1, drawn), "drawn": drawn, "validation": found})
        if best is None or found["average_precision"] > best[0]:
            best = found["average_precision"], weights
    discard(spark, path)
    return best[1], history


def quality(labelled: DataFrame, weights: dict, config: TrainConfig, vector: str | None = None) -> dict:
    """The ranking report of labelled stacks under these weights."""
    s = scoring.score(labelled, weights, "trained", "vector" if vector else None, config.max_frames)
    (row,) = ranking.report(s.join(labelled.select("track_id", "label"), "track_id"), [], "label", "score", "track_id").collect()
    return row.asDict()


def positive_ranks(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """track_id, score, rank, n_total of every positive among all scored rows of ``labels``: the test report's ranks. Ties rank by track_id; labels without a score are left out."""
    x = scores.select("track_id", "score").join(labels.where("label in (0, 1)").select("track_id", "label"), "track_id")
    x = ranking.ranked(x, [], "label", "score", "track_id")
    return x.crossJoin(F.broadcast(x.agg(F.count(F.lit(1)).alias("n_total")))).where("label = 1").select("track_id", "score", F.col("rank").cast("long").alias("rank"), "n_total")


def save(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """A checkpoint that ``scoring.weights_of`` reads, written under a temporary name and renamed."""
    buffer = io.BytesIO()
    np.savez(buffer, **weights)
    fs, at = located(spark, path)
    _, part = located(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"{path} could not be written")
