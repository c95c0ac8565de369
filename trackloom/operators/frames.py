"""Frames as rows: normalise, register, subtract, detect, crop. Pixels travel as binary and never beyond the detection step.

A frame row holds one frame; what a frame needs of others is brought to it by a join (the sequence's reference) or
by streaming its sequence past a window of a few frames, so no task holds a whole day of frames. Python takes and gives
rows in slices of some megabytes.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import frames as k
from ..schemas import DETECTION
from ..slices import map_rows

#: What a frame keeps as its pixels change.
SAME = ("sequence_id", "frame", "ts", "height", "width")


def pixels(data: bytes, height: int, width: int, kind: str = "<f4") -> np.ndarray:
    return np.frombuffer(data, kind).reshape(int(height), int(width))


NORMALISED = "sequence_id long, frame string, ts timestamp, height int, width int, data binary, mask binary, sun_x double, sun_y double, exposure_ok boolean, sun_center_missing boolean, invalid_fraction double, field_pixels int, usable boolean"


def preprocess(raw: DataFrame, **own) -> DataFrame:
    """Raw frames (sequence_id, frame, ts, height, width, dtype, data, detector, exposure_seconds, sun_x, sun_y, plate_scale_arcsec) to normalised ones with quality."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            some = lambda v: None if v is None or math.isnan(v) else float(v)
            center = None if some(r["sun_x"]) is None or some(r["sun_y"]) is None else (r["sun_x"], r["sun_y"])
            data, mask, qa = k.preprocess(pixels(r["data"], r["height"], r["width"], r["dtype"]), some(r["exposure_seconds"]), center, some(r["plate_scale_arcsec"]), k.PreprocessConfig.for_detector(r["detector"] or "", **own))
            yield {c: r[c] for c in (*SAME, "sun_x", "sun_y")} | {"data": data.tobytes(), "mask": np.packbits(mask).tobytes(), **qa}

    columns = ["sequence_id", "frame", "ts", "height", "width", "dtype", "data", "detector", "exposure_seconds", "sun_x", "sun_y", "plate_scale_arcsec"]
    return map_rows(raw.withColumn("ts", F.col("ts").cast("timestamp")).select(*columns), run, NORMALISED)


def mask_of(data: bytes, height: int, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=int(height) * int(width)).reshape(int(height), int(width)).astype(bool)


def reference_frames(normalised: DataFrame) -> DataFrame:
    """The first usable frame by name of each sequence that has two or more."""
    w = Window.partitionBy("sequence_id")
    x = normalised.where("usable").withColumns({"_nth": F.row_number().over(w.orderBy("frame")), "_n": F.count(F.lit(1)).over(w)})
    return x.where("_nth = 1 and _n >= 2").drop("_nth", "_n")


REGISTERED = "sequence_id long, frame string, ts timestamp, height int, width int, data binary, mask binary, dx double, dy double, response double, status string"


def register(normalised: DataFrame, config: k.RegisterConfig = k.RegisterConfig()) -> DataFrame:  # noqa: B008
    """Usable frames moved onto their sequence's reference. Status: reference, ok, or failed (as it was, left out downstream)."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            data, mask = pixels(r["data"], r["height"], r["width"]), mask_of(r["mask"], r["height"], r["width"])
            if r["frame"] == r["reference"]:
                found = {"dx": 0.0, "dy": 0.0, "response": 1.0, "status": "reference"}
            elif (r["height"], r["width"]) != (r["reference_height"], r["reference_width"]):
                found = {"dx": 0.0, "dy": 0.0, "response": 0.0, "status": "failed"}
            else:
                data, mask, found = k.register(pixels(r["reference_data"], r["height"], r["width"]), data, mask, config)
            yield {c: r[c] for c in SAME} | {"data": data.tobytes(), "mask": np.packbits(mask).tobytes(), **{c: found[c] for c in ("dx", "dy", "response", "status")}}

    ref = reference_frames(normalised).select("sequence_id", F.col("frame").alias("reference"), F.col("data").alias("reference_data"), F.col("height").alias("reference_height"), F.col("width").alias("reference_width"))
    x = normalised.where("usable").select("sequence_id", "frame", "ts", "height", "width", "data", "mask").join(ref, "sequence_id")
    return map_rows(x, run, REGISTERED)


MOVED = "sequence_id long, frame string, ts timestamp, height int, width int, data binary, mask binary, dx double, dy double"


def moved(normalised: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """Usable frames moved by shifts that are known (pixels to the right and down, also parts of one), as ``register`` moves by those it estimates.

    Between pixels values are bilinear, validity is the nearest pixel's; what comes in from outside is 0 and invalid. Frames
    whose shift is null or NaN are left out.
    """

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            data, mask = k.apply_shift(pixels(r["data"], r["height"], r["width"]), mask_of(r["mask"], r["height"], r["width"]), r["dx"], r["dy"])
            yield {c: r[c] for c in (*SAME, "dx", "dy")} | {"data": data.tobytes(), "mask": np.packbits(mask).tobytes()}

    x = normalised.where("usable").select("sequence_id", "frame", "ts", "height", "width", "data", "mask", dx.cast("double").alias("dx"), dy.cast("double").alias("dy"))
    return map_rows(x.where("dx is not null and dy is not null and not isnan(dx) and not isnan(dy)"), run, MOVED)


DETECTED = f"sequence_id long, frame string, ts timestamp, sigma double, detections array<{DETECTION}>"
#: Frames that one task takes of a sequence that is split.
SPAN = 64


def spans(names: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """A sequence's frames (sequence_id, frame) in spans of ``size``: sequence_id, n, span, its first and last frame, and ``low`` and ``high``, the ends with the neighbours that its frames need."""
    every = Window.partitionBy("sequence_id")
    w = every.orderBy("frame")
    x = names.select(
        "sequence_id", "frame", F.count(F.lit(1)).over(every).alias("n"), ((F.row_number().over(w) - 1) / size).cast("long").alias("span"),
        F.coalesce(F.lag("frame", before).over(w), F.min("frame").over(every)).alias("low"), F.coalesce(F.lead("frame", after).over(w), F.max("frame").over(every)).alias("high"),
    )
    return x.groupBy("sequence_id", "span").agg(F.first("n").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"))


def windows(rows: Iterable[dict], before: int, after: int) -> Iterator[tuple[dict, list[dict]]]:
    """Each row with up to ``before`` rows ahead of it and ``after`` behind it, in order; no more than these are held."""
    held, at = deque(), 0

    def given() -> tuple[dict, list[dict]]:
        nonlocal at
        found = held[at], [r for j, r in enumerate(held) if j != at]
        at += 1
        if at > before:
            held.popleft()
            at -= 1
        return found

    for r in rows:
        held.append(r)
        if len(held) > at + after:
            yield given()
    while at < len(held):
        yield given()


def detect(registered: DataFrame, config: k.MotionConfig = k.MotionConfig(), residuals: bool = False, span: int | None = None) -> DataFrame:  # noqa: B008
    """Detections of each frame against the median of its neighbours (or the frame before); ``residuals`` adds height, width, residual and mask.

    A sequence streams past a window of frames, so each frame is sent once and a task holds a window. ``span`` splits
    sequences into spans of so many frames, each with the neighbours that its ends need; this reads the names of all
    frames first, so it is for tables, not for long plans. Frame names are unique in a sequence; a sequence of fewer
    than three frames is an error for the median.
    """
    if config.method not in ("median", "prev_diff"):
        raise ValueError(f"unknown method {config.method!r}")
    median = config.method == "median"
    before, after = (config.window // 2, config.window // 2) if median else (1, 0)
    schema = DETECTED + (", height int, width int, residual binary, mask binary" if residuals else "")

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for (sequence, _), members in groupby(rows, key=lambda r: (r["sequence_id"], r["span"])):
            seen = n = 0
            for r, near in windows(members, before, after):
                seen, n = seen + 1, r["n"]
                if not r["own"]:
                    continue
                data, mask = pixels(r["data"], r["height"], r["width"]), mask_of(r["mask"], r["height"], r["width"])
                found, sigma, res = [], 0.0, np.zeros_like(data)
                if near:
                    res = k.less_background(data, [pixels(b["data"], b["height"], b["width"]) for b in near])
                    valid = mask if median else mask & mask_of(near[0]["mask"], r["height"], r["width"])
                    found, sigma = k.detect(res, valid, config)
                row = {"sequence_id": r["sequence_id"], "frame": r["frame"], "ts": r["ts"], "sigma": round(sigma, 5), "detections": found}
                yield row | ({"height": r["height"], "width": r["width"], "residual": res.astype("<f4").tobytes(), "mask": r["mask"]} if residuals else {})
            if median and max(n, seen) < 3:
                raise ValueError(f"sequence {sequence}: three frames or more are needed")

    x = registered.where("status in ('ok', 'reference')").select("sequence_id", "frame", "ts", "height", "width", "data", "mask")
    if span is None:
        x = x.withColumns({"span": F.lit(0).cast("long"), "n": F.lit(0).cast("long"), "own": F.lit(True)}).repartition("sequence_id")
    else:
        near = spans(x.select("sequence_id", "frame"), span, before, after)
        x = x.join(near, "sequence_id").where("frame between low and high").withColumn("own", F.expr("frame between first and last"))
        x = x.drop("first", "last", "low", "high").repartition("sequence_id", "span")
    return map_rows(x.sortWithinPartitions("sequence_id", "span", "frame"), run, schema)


def exploded(detected: DataFrame) -> DataFrame:
    """One row a detection, with its order in the frame."""
    return detected.select("sequence_id", "frame", F.posexplode("detections").alias("pos", "d")).select("sequence_id", "frame", "pos", "d.*")


def crops(points: DataFrame, residual_frames: DataFrame, size: int = 32) -> DataFrame:
    """A track's crops in order: track_id, n_frames, crop_size, crops (binary), valid_fractions, frames, positions.

    Points meet their frame's residual once; frames that were not registered drop out, tracks without any frame as well.
    """

    def cut(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            res, mask = pixels(r["residual"], r["height"], r["width"]), mask_of(r["mask"], r["height"], r["width"])
            for p in r["points"]:
                image, share = k.crop(res, mask, p["x"], p["y"], size)
                yield {"track_id": p["track_id"], "seq": p["seq"], "frame": r["frame"], "x": p["x"], "y": p["y"], "crop": image.tobytes(), "valid_fraction": share}

    by_frame = points.groupBy("sequence_id", "frame").agg(F.collect_list(F.struct("track_id", "seq", "x", "y")).alias("points"))
    x = residual_frames.select("sequence_id", "frame", "height", "width", "residual", "mask").join(by_frame, ["sequence_id", "frame"])
    c = map_rows(x, cut, "track_id string, seq int, frame string, x double, y double, crop binary, valid_fraction double")
    g = c.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seq", "frame", "x", "y", "crop", "valid_fraction"))).alias("a"))
    joined = F.unhex(F.array_join(F.transform("a", lambda p: F.hex(p["crop"])), ""))  # one buffer, not one a crop
    return g.select("track_id", F.size("a").alias("n_frames"), F.lit(size).alias("crop_size"), joined.alias("crops"), F.col("a.valid_fraction").alias("valid_fractions"), F.col("a.frame").alias("frames"), F.transform("a", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("positions"))


def totals(frames: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of each frame (height, width, dtype, data) with the sum and the largest of its pixels."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            image = pixels(r["data"], r["height"], r["width"], r["dtype"]).astype(np.float64)
            yield {c: r[c] for c in keys} | {"total": image.sum(), "largest": image.max(initial=-np.inf)}

    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(frames.select(*keys, "height", "width", "dtype", "data"), run, f"{kinds}, total double, largest double")


def stack_totals(stacks: DataFrame) -> DataFrame:
    """track_id with the sums of all its crops, of the first and of the last one."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            x = np.frombuffer(r["crops"], "<f4").reshape(-1, r["crop_size"] ** 2).sum(axis=1, dtype=np.float64)
            yield {"track_id": r["track_id"], "total": x.sum(), "first_total": x[0], "last_total": x[-1]}

    return map_rows(stacks.select("track_id", "crops", "crop_size"), run, "track_id string, total double, first_total double, last_total double")
