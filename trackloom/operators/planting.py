"""Experiments on frames of one's own: sources and shifts are planted and looked for again.

A cell of the grid is a sequence of its own while it is worked on, so all cells of all sequences run at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import frames as k
from . import frames as fr

STRENGTHS, METHODS, REACH = (10.0, 5.0, 3.0), ("median", "prev_diff"), 3.0
#: Where a planted source starts, as shares of width and height, and its pixels a frame.
START, VELOCITY = (0.30, 0.70), (4.0, -3.0)
SHIFTS = ((0.0, 0.0), (0.5, -0.3), (2.3, 1.7), (5.1, -4.2))


def place(i: Column, start: tuple[float, float], velocity: tuple[float, float]) -> tuple[Column, Column]:
    """x and y of the source in a sequence's frame number ``i``, counted from 0."""
    return F.col("width") * F.lit(float(start[0])) + i * F.lit(float(velocity[0])), F.col("height") * F.lit(float(start[1])) + i * F.lit(float(velocity[1]))


def planted(registered: DataFrame, strengths: tuple = STRENGTHS, start: tuple[float, float] = START, velocity: tuple[float, float] = VELOCITY) -> DataFrame:
    """Registered frames (those that failed left out) with a faint moving source, once a strength in sigmas of the frame: as ``registered``, with ``cell``, x, y and the sequence's ``source_id``; sequence_id is one of its own a cell."""
    n = len(strengths)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.to_dict("records"):
                data = fr.pixels(r["data"], r["height"], r["width"])
                for cell, strength in enumerate(strengths):
                    (image,), _ = k.inject([data], (r["x"], r["y"]), (0.0, 0.0), strength)
                    yield pd.DataFrame([r | {"cell": cell, "source_id": r["sequence_id"], "sequence_id": r["sequence_id"] * n + cell, "data": image.tobytes(), "status": "ok"}])

    kept = ["sequence_id", "frame", "ts", "height", "width", "data", "mask"]
    x = registered.where("status in ('ok', 'reference')").select(*kept).withColumn("i", F.row_number().over(Window.partitionBy("sequence_id").orderBy("frame")) - 1)
    x = x.withColumns(dict(zip("xy", place(F.col("i"), start, velocity), strict=True))).drop("i")
    kinds = "sequence_id long, frame string, ts timestamp, height int, width int, data binary, mask binary, status string, x double, y double, cell int, source_id long"
    return x.mapInPandas(run, kinds)


def recovery(frames: DataFrame, strengths: tuple = STRENGTHS, methods: tuple = METHODS, config: k.MotionConfig = k.MotionConfig(), reach: float = REACH, span: int | None = None) -> DataFrame:  # noqa: B008
    """Of a table of planted frames: sequence_id, method, strength, n_frames, recovered (frames with a detection within ``reach`` pixels of the source) and n_detections.

    The table is read once a method and once more without pixels. Frames where the source has left the image count as frames and can't be recovered.
    """
    where = frames.select("sequence_id", "source_id", "cell", "frame", "x", "y")
    found = None
    for method in methods:
        d = fr.detect(frames, replace(config, method=method), span=span).select("sequence_id", "frame", "detections").withColumn("method", F.lit(method))
        found = d if found is None else found.unionByName(d)
    near = F.exists("detections", lambda d: F.hypot(d["x"] - F.col("x"), d["y"] - F.col("y")) <= reach)
    g = found.join(where, ["sequence_id", "frame"]).groupBy("source_id", "method", "cell").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(near).alias("recovered"), F.sum(F.size("detections")).cast("long").alias("n_detections"))
    strength = F.get(F.array(*(F.lit(float(s)) for s in strengths)), F.col("cell"))
    return g.select(F.col("source_id").alias("sequence_id"), "method", strength.alias("strength"), "n_frames", "recovered", "n_detections")


def shift_recovery(normalised: DataFrame, shifts: tuple = SHIFTS) -> DataFrame:
    """sequence_id, dx, dy, error (pixels), response: shifts planted into each sequence's reference frame and estimated again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.to_dict("records"):
                found = k.recovered_shifts(fr.pixels(r["data"], r["height"], r["width"]), list(shifts))
                yield pd.DataFrame([(r["sequence_id"], dx, dy, float(((a - dx) ** 2 + (b - dy) ** 2) ** 0.5), q) for (dx, dy), (a, b, q) in zip(shifts, found, strict=True)])

    x = fr.reference_frames(normalised).select("sequence_id", "height", "width", "data")
    return x.mapInPandas(run, "sequence_id long, dx double, dy double, error double, response double")
