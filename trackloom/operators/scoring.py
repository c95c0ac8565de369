"""Scoring of crop stacks, and a linear substitute for training the network."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import frames as k
from ..kernels import net
from ..session import stored
from ..sources.arrays import array_of
from .ranking import FUSION, fuse


#: Stacks that are scored together.
AT_ONCE = 256


def stack_of(crops: bytes, size: int) -> np.ndarray:
    return np.frombuffer(crops, "<f4").reshape(-1, int(size), int(size))


def score(stacks: DataFrame, weights: dict[str, np.ndarray], run_id: str, vector: str | None = None, max_frames: int = 16) -> DataFrame:
    """track_id, run_id, score of each stack; ``vector`` names the column of features for a model that takes them. The weights are a fixed number of parameters."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p.iloc[at : at + AT_ONCE] for p in parts for at in range(0, len(p), AT_ONCE)):
            made = [k.normalise_stack(stack_of(c, s), max_frames) for c, s in zip(part.crops, part.crop_size, strict=True)]
            extra = None if vector is None else np.stack([np.asarray(v, np.float32) for v in part.vector])
            yield pd.DataFrame({"track_id": part.track_id, "run_id": run_id, "score": net.score_many([x for x, _ in made], [n for _, n in made], weights, extra)})

    x = stacks.select("track_id", "crops", "crop_size", *([F.col(vector).alias("vector")] if vector else []))
    return x.mapInPandas(run, "track_id string, run_id string, score double")


def weights_of(arrays_: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """Weights by run, of checkpoint files as ``sources.arrays`` reads them (a file a run); their number is the model's."""
    runs: dict[str, dict[str, np.ndarray]] = {}
    for r in arrays_.where(F.col("name").isin(*net.seeded_weights())).collect():
        runs.setdefault(r.path.rsplit("/", 1)[-1].removesuffix(".npz"), {})[r.name] = array_of(r)
    return {run: net.known(found) for run, found in sorted(runs.items())}


def score_runs(stacks: DataFrame, runs: dict[str, dict[str, np.ndarray]], vector: str | None = None, max_frames: int = 16) -> tuple[DataFrame, str]:
    """Scores of every run, from two runs on with their mean as a run of its own; and the run that ranks: the mean if there is one, else the only run."""
    if not runs:
        raise ValueError("a run is needed")
    parts = [score(stacks, weights, run_id, vector, max_frames) for run_id, weights in runs.items()]
    every = reduce(DataFrame.unionByName, parts)
    if len(parts) == 1:
        return every, next(iter(runs))
    # one model after the other on the same stacks: the mean needs no second pass over them
    every = stored(every, "scores")
    return every.unionByName(fuse(every, "track_id", "run_id", "score").select(*every.columns)), FUSION


def normalised(stacks: DataFrame, max_frames: int = 16) -> DataFrame:
    """track_id, length, stack (binary, padded)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [k.normalise_stack(stack_of(c, s), max_frames) for c, s in zip(part.crops, part.crop_size, strict=True)]
            yield pd.DataFrame({"track_id": part.track_id, "length": [n for _, n in made], "stack": [s.tobytes() for s, _ in made]})

    return stacks.select("track_id", "crops", "crop_size").mapInPandas(run, "track_id string, length int, stack binary")


def train_linear(rows: DataFrame, vector: str, label: str, positive_share: float = 0.1, rounds: int = 100):
    """Logistic regression on the model vector, classes weighed so that positives make up ``positive_share``.

    A substitute for training the network, and another model: it does not see the crops.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n, p = rows.agg(F.count(F.lit(1)), F.sum(F.col(label).cast("double"))).first()
    if not p or p == n:
        raise ValueError("both classes are needed")
    weight = F.when(F.col(label) == 1, positive_share / (p / n)).otherwise((1 - positive_share) / (1 - p / n))
    x = rows.select(array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("weight"))
    return LogisticRegression(maxIter=rounds, weightCol="weight", regParam=1e-4).fit(x)


def predict_linear(model, rows: DataFrame, key: str, vector: str, run_id: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = model.transform(rows.select(key, array_to_vector(vector).alias("features")))
    return x.select(key, F.lit(run_id).alias("run_id"), F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
