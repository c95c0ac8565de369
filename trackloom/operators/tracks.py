"""Tracks and their features, from one row a point. All expressions are native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rounded, seconds, wrapped
from ..schemas import FEATURES
from .selection import exact_median

STAR_DRIFT_PX_S = 0.0009


def first_of_time(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One point of each time: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return points.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def persistent(points: DataFrame, track: str, least: int = 5) -> DataFrame:
    """Tracks of at least so many points, with their number."""
    return points.groupBy(track).agg(F.count(F.lit(1)).alias("n_frames")).where(F.col("n_frames") >= least)


def numbered(tracks: DataFrame, sequence: str, order: list[str]) -> DataFrame:
    """Adds ``index`` from 0 by start time and place within the sequence."""
    return tracks.withColumn("index", F.row_number().over(Window.partitionBy(sequence).orderBy(*order)) - 1)


def summary(points: DataFrame, track: str, ts: str, x: str, y: str, residual: str) -> DataFrame:
    """n_points, duration_s, displacement_px, speed_px_s (0 without duration), residual_mean_px over all points but the first."""
    nth = F.row_number().over(Window.partitionBy(track).orderBy(ts))
    p = points.select(track, F.col(x).alias("x"), F.col(y).alias("y"), F.col(residual).alias("res"), seconds(F.col(ts)).alias("t"), nth.alias("i"))
    a = p.groupBy(track).agg(
        F.count(F.lit(1)).alias("n_points"),
        (F.max("t") - F.min("t")).alias("duration"),
        F.hypot(F.max_by("x", "i") - F.min_by("x", "i"), F.max_by("y", "i") - F.min_by("y", "i")).alias("displacement"),
        F.coalesce(F.avg(F.when(F.col("i") > 1, F.col("res"))), F.lit(0.0)).alias("mean"),
    )
    speed = F.coalesce(F.try_divide("displacement", "duration"), F.lit(0.0))
    return a.select(track, "n_points", rounded(F.col("duration"), 3).alias("duration_s"), rounded(F.col("displacement"), 2).alias("displacement_px"), rounded(speed, 6).alias("speed_px_s"), rounded(F.col("mean"), 3).alias("residual_mean_px"))


def epochs(points: DataFrame, sequence: str, ts: str) -> DataFrame:
    """Distinct times of a sequence with their number from 0."""
    return points.select(sequence, ts).distinct().withColumn("epoch", F.row_number().over(Window.partitionBy(sequence).orderBy(ts)) - 1)


def coverage(points: DataFrame, sequence: str, track: list[str], ts: str) -> DataFrame:
    """Share of the sequence's epochs between a track's first and last that have a point of it."""
    x = points.join(epochs(points, sequence, ts), [sequence, ts])
    return x.groupBy(*track).agg(F.count(F.lit(1)).alias("n_frames"), rounded(F.count(F.lit(1)) / (F.max("epoch") - F.min("epoch") + 1), 4).alias("frame_coverage"))


def features(points: DataFrame, track: str, ts: str, x: str, y: str, flux: str, area: str, center: tuple[Column, Column] | None = None, epoch: str | None = None) -> DataFrame:
    """All features of each track, null where undefined.

    One window over the track gives step, velocity change and turn of each point; one aggregation follows in
    the same partitioning, so the points are shuffled once. ``center`` is the sun's place; ``epoch`` numbers
    the sequence's times (without it every time of the track counts as consecutive).
    """
    w = Window.partitionBy(track).orderBy("t")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = lambda c: F.col(c) - F.lag(c).over(w)
    p = points.select(track, seconds(F.col(ts)).alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(flux).cast("double").alias("f"), F.col(area).cast("double").alias("a"), *([F.col(epoch).alias("e")] if epoch else []), *([center[0].alias("cx"), center[1].alias("cy")] if center else []))
    p = p.withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy(track)))
    p = p.withColumns({"dx": d("x"), "dy": d("y"), "dt": d("t"), "i": F.row_number().over(w)})
    p = p.withColumns({"len": F.hypot("dx", "dy"), "vx": F.try_divide("dx", "dt"), "vy": F.try_divide("dy", "dt")})
    p = p.withColumn("heading", F.when(F.col("len") > 0, F.atan2("dy", "dx")))
    p = p.withColumns({
        "acc": F.try_divide(F.hypot(d("vx"), d("vy")), (F.col("dt") + F.lag("dt").over(w)) / 2),
        "turn": F.when(F.col("len") > 0, F.abs(wrapped(F.col("heading") - F.last("heading", ignorenulls=True).over(before)))),
        "r": F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) if center else F.lit(None).cast("double"),
    })
    moved = F.col("len") > 0
    unit = lambda c: F.avg(F.when(moved, F.try_divide(c, "len")))
    left = lambda c: F.regr_syy(c, "t") - F.try_divide(F.pow(F.regr_sxy(c, "t"), F.lit(2)), F.regr_sxx(c, "t"))
    g = p.groupBy(track).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) / (F.max("e") - F.min("e") + 1) if epoch else F.lit(1.0)).alias("coverage"),
        F.max("t").alias("duration"),
        F.coalesce(F.sum("len"), F.lit(0.0)).alias("path"),
        (F.max_by("x", "i") - F.min_by("x", "i")).alias("dx"),
        (F.max_by("y", "i") - F.min_by("y", "i")).alias("dy"),
        F.avg(F.try_divide("len", "dt")).alias("speed"),
        F.stddev_pop(F.try_divide("len", "dt")).alias("speed_std"),
        F.hypot(unit("dx"), unit("dy")).alias("consistency"),
        F.avg("acc").alias("acc"),
        F.sum("turn").alias("turns"),
        F.count("turn").alias("n_turns"),
        F.sqrt(F.greatest(left("x") + left("y"), F.lit(0.0)) / (2 * F.count(F.lit(1)))).alias("rms"),
        F.avg("f").alias("flux"),
        F.stddev_pop("f").alias("flux_std"),
        F.regr_slope("f", "t").alias("flux_slope"),
        F.avg("a").alias("area"),
        F.regr_slope("a", "t").alias("area_slope"),
        F.min("r").alias("r_min"),
        F.avg("r").alias("r_mean"),
        F.max("r").alias("r_max"),
        (F.max_by("r", "i") - F.min_by("r", "i")).alias("dr"),
    )
    three, lasts, way = F.col("n") >= 3, F.col("duration") > 0, F.hypot("dx", "dy")
    rate = lambda slope, mean: F.when(lasts & (F.col(mean) > 0), F.try_divide(F.col(slope) * 3600, F.col(mean)))
    out = {
        "n_frames": F.col("n"),
        "frame_coverage": rounded(F.col("coverage"), 4),
        "duration_s": rounded(F.col("duration"), 3),
        "path_length_px": rounded(F.col("path"), 2),
        "displacement_px": rounded(way, 2),
        "speed_mean_px_s": rounded(F.col("speed"), 6),
        "speed_std_px_s": rounded(F.col("speed_std"), 6),
        "direction_deg": F.when(way > 0, rounded(F.degrees(F.atan2("dy", "dx")), 2)),
        "direction_consistency": rounded(F.col("consistency"), 4),
        "accel_mean_px_s2": F.when(three, rounded(F.col("acc"), 8)),
        "curvature_rad_px": F.when(three & (F.col("n_turns") >= 1), rounded(F.try_divide("turns", "path"), 6)),
        "linear_rms_px": F.when(three, rounded(F.col("rms"), 4)),
        "flux_mean": rounded(F.col("flux"), 4),
        "flux_cv": F.when(F.col("flux") > 0, rounded(F.try_divide("flux_std", "flux"), 4)),
        "flux_slope_frac_h": rounded(rate("flux_slope", "flux"), 5),
        "area_mean_px": rounded(F.col("area"), 2),
        "area_slope_frac_h": rounded(rate("area_slope", "area"), 5),
        "r_min_px": rounded(F.col("r_min"), 2),
        "r_mean_px": rounded(F.col("r_mean"), 2),
        "r_max_px": rounded(F.col("r_max"), 2),
        "radial_speed_px_s": F.when(lasts, rounded(F.try_divide("dr", "duration"), 6)),
    }
    return g.select(track, *(out[name].alias(name) for name in FEATURES))


#: Upper bounds of features that are not negative; others in BETWEEN. Fixed values.
NOT_NEGATIVE = ("duration_s", "path_length_px", "displacement_px", "speed_mean_px_s", "speed_std_px_s", "accel_mean_px_s2", "curvature_rad_px", "linear_rms_px", "flux_cv", "area_mean_px", "r_min_px")
BETWEEN = {"frame_coverage": (0.0, 1.0), "direction_consistency": (0.0, 1.0), "direction_deg": (-180.0, 180.0)}


def problems() -> Column:
    """Array of what is wrong with a feature row: not finite, out of range, displacement beyond the path."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    found = [F.when(F.col(f).isNotNull() & ~finite(F.col(f)), F.lit(f"{f} not finite")) for f in FEATURES if f != "n_frames"]
    ranges = {f: (0.0, float("inf")) for f in NOT_NEGATIVE} | BETWEEN
    found += [F.when(F.col(f).isNotNull() & ~((F.col(f) >= lo) & (F.col(f) <= hi) & ~F.isnan(f)), F.lit(f"{f} out of range")) for f, (lo, hi) in ranges.items()]
    found.append(F.when(F.col("displacement_px") > F.col("path_length_px") + 1e-6, F.lit("displacement exceeds path")))
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def signature_score() -> Column:
    """How comet-like a track moves, null unless it moves sunward: consistency, smoothness, speed against star drift, sunward share."""
    speed, radial = F.coalesce("speed_mean_px_s", F.lit(0.0)), F.col("radial_speed_px_s")
    smooth = F.when(F.col("linear_rms_px").isNotNull(), 1 / (1 + F.col("linear_rms_px"))).otherwise(0.0)
    total = F.coalesce("direction_consistency", F.lit(0.0)) + smooth + F.least(speed / (3 * STAR_DRIFT_PX_S), F.lit(1.0)) + F.least(F.try_divide(F.abs(radial), speed), F.lit(1.0))
    return F.when((radial < 0) & (speed > 0), total)


def shortlist(dna: DataFrame, track: str, least: int = 8, top: int = 10) -> DataFrame:
    """The most comet-like tracks: highest score, then highest id."""
    x = dna.where(F.col("n_frames") >= least).withColumn("score", signature_score()).where("score is not null")
    return x.orderBy(F.desc("score"), F.desc(track)).limit(top)


def model_vector() -> Column:
    """Nine inputs of the ranking model on fixed scales; null features are 0."""
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return F.array(v("radial_speed_px_s") * 360, F.asinh(v("speed_mean_px_s") * 720), v("direction_consistency"), F.asinh(v("linear_rms_px")), F.asinh(v("flux_slope_frac_h") * 10), F.asinh(v("flux_cv")), v("frame_coverage"), F.log1p(v("n_frames")) / 5, v("r_min_px") / 500)


def robust_sigma(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1.4826 times the median distance from the median, exact, per group, whatever a group's size. Null values do not count; rows with a null key have no sigma."""
    m = exact_median(df, keys, value).withColumnRenamed("median", "_m")
    x = df.join(m, keys).select(*keys, F.abs(F.col(value) - F.col("_m")).alias("_d"))
    return exact_median(x, keys, "_d").select(*keys, (F.col("median") * 1.4826).alias("sigma"))


def neighbour_median(df: DataFrame, keys: list[str], order: list[str], value: str, window: int = 5) -> DataFrame:
    """Adds ``background``: the median of up to window - 1 neighbours in order, without the row itself, cut at the ends."""
    half = window // 2
    w = Window.partitionBy(*keys).orderBy(*order)
    near = F.array_sort(F.concat(F.collect_list(value).over(w.rowsBetween(-half, -1)), F.collect_list(value).over(w.rowsBetween(1, half))))
    n = F.size("_near")
    mid = lambda i: F.get("_near", i.cast("int"))
    median = (mid(F.floor((n - 1) / 2)) + mid(F.floor(n / 2))) / 2
    return df.withColumn("_near", near).withColumn("background", median).drop("_near")


def previous(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``background``: the row before, null for the first."""
    return df.withColumn("background", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def strongest(df: DataFrame, frame: list[str], strength: str, tie: str, most: int = 500) -> DataFrame:
    """At most ``most`` detections a frame, the strongest."""
    w = Window.partitionBy(*frame).orderBy(F.desc(strength), tie)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most).drop("_nth")


def stride(n: Column, most: int) -> Column:
    """Indices of at most ``most`` of n items, evenly spread from the first to the last; halves go to even."""
    return F.when(n <= most, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * (n - 1) / (most - 1)).cast("int")))
