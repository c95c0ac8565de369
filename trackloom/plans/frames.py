"""Frame queries. Frames are made from all events: a type is a sequence, a day a frame, an event two bright pixels in it.

Pixels are whole numbers and the exposure is a power of two, so all values up to the residuals are exact and SQL can
work them out as well.
"""

from __future__ import annotations

from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..kernels import fits, net
from ..operators import frames as fr
from ..operators import planting, scoring, tracking, tracks
from ..session import stored, table
from ..sinks import files
from ..sources.fits import decode

SIZE, EXPOSURE, MIDDLE, SCALE, CROP = 48, 16.0, 24.0, 700.0, 8
TYPES = ("click", "view", "purchase", "error", "signup")
FIELD = {"border_px": 4, "occulter_rsun": 3.0, "fov_rsun": 14.0}
DAY0 = date(2024, 1, 1)


def _sequence(event_type):
    return F.array_position(F.array(*map(F.lit, TYPES)), event_type).cast("long")


def fits_files(spark, sf_dir, shifted=False):
    """A FITS file for each sequence and day: a fixed texture, noise, invalid pixels, the day's events, and a source that moves; or the texture and noise alone, moved by the day's shift."""

    def make(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        s, day = int(key[0]), key[1]
        n = (day - DAY0).days
        y, x = np.mgrid[0:SIZE, 0:SIZE]
        sx, sy = (14 if n % 11 == 5 else (n * 3 + s) % 7 - 3, (n * 5 + s) % 7 - 3) if shifted else (0, 0)
        u, v = x - sx + 64, y - sy + 64
        image = 200 + (u * u * v * 7 + v * v * u * 13 + u * 73 + v * 151 + s * 17) % 257 + (x * 5 + y * 11 + n * 7 + s * 3 + x * y * n) % 7
        if not shifted:
            lit = np.zeros((SIZE, SIZE + 1), np.int64)
            for right in (0, 1):
                np.add.at(lit, (part.ey, part.ex + right), part.amount)
            m = n % 20
            lit[6 + m : 8 + m, 4 + 2 * m : 6 + 2 * m] += 1440
            image = np.where((x * y + n) % 97 == 0, 0, image + np.minimum(lit[:, :SIZE], 8000))
        header = {"DATE-OBS": f"{day:%Y/%m/%d}", "TIME-OBS": f"{s:02d}:00:00.000", "TELESCOP": "SOHO", "INSTRUME": "LASCO", "DETECTOR": "C3", "FILTER": "Clear", "EXPTIME": EXPOSURE, "CRPIX1": MIDDLE, "CRPIX2": MIDDLE, "CDELT1": SCALE}
        return pd.DataFrame({"path": [f"seq_{s}/{day:%Y%m%d}.fts"], "content": [fits.write_image(image.astype(np.int16), header)]})

    e = table(spark, sf_dir, "events")
    # events are summed by pixel first, so a frame's group is as large as its field at most, however many events it has
    pixel = lambda factor: F.lit(4) + F.pmod(F.pmod("event_id", F.lit(40)) * factor, F.lit(40))
    x = e.groupBy(_sequence(F.col("event_type")).alias("sequence_id"), F.to_date("ts").alias("day"), pixel(7919).alias("ex"), pixel(104729).alias("ey"))
    x = x.agg(F.sum(F.lit(160) + F.pmod("event_id", F.lit(5)) * 16).alias("amount"))
    return x.groupBy("sequence_id", "day").applyInPandas(make, "path string, content binary")


def _raw(spark, sf_dir, shifted=False):
    x = decode(fits_files(spark, sf_dir, shifted))
    return x.where("error is null").withColumns({"sequence_id": F.regexp_extract("path", r"seq_(\d+)/", 1).cast("long"), "frame": F.regexp_extract("path", r"/(\d+)\.fts", 1)})


def _normalised(spark, sf_dir):
    return fr.preprocess(_raw(spark, sf_dir), **FIELD)


def _detected(spark, sf_dir, residuals=False):
    """Detections of frames that need no registration: they lie on their reference as they are."""
    return fr.detect(_normalised(spark, sf_dir).where("usable").withColumn("status", F.lit("ok")), residuals=residuals)


def fits_roundtrip(spark, sf_dir):
    x = decode(fits_files(spark, sf_dir))
    total = fr.totals(x.where("error is null"), ["path"])
    return x.join(total, "path").select("path", "height", "width", "dtype", F.col("ts").cast("timestamp_ntz").alias("ts"), "detector", "instrument", "exposure_seconds", "sun_x", F.octet_length("data").cast("long").alias("n_bytes"), "error", "total", "largest")


def preprocess_frames(spark, sf_dir):
    x = _normalised(spark, sf_dir)
    total = fr.totals(x.withColumn("dtype", F.lit("<f4")), ["sequence_id", "frame"])
    return x.join(total, ["sequence_id", "frame"]).select("sequence_id", "frame", "exposure_ok", "sun_center_missing", "invalid_fraction", F.col("field_pixels").cast("long").alias("field_pixels"), "usable", "total", "largest")


def register_shift(spark, sf_dir):
    """Shifts of frames against their sequence's first, to the whole pixel; those that are too large fail."""
    x = fr.register(fr.preprocess(_raw(spark, sf_dir, True), border_px=0, occulter_rsun=0.0, fov_rsun=99.0))
    return x.select("sequence_id", "frame", "status", F.rint("dx").cast("long").alias("dx"), F.rint("dy").cast("long").alias("dy"))


def moved_pixels(spark, sf_dir):
    """Frames moved by known shifts in halves of a pixel: sums of values, of values by place and of valid pixels by place, and the largest value."""

    def measured(parts):
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                image, valid = fr.pixels(r.data, r.height, r.width).astype(np.float64), fr.mask_of(r.mask, r.height, r.width)
                place = 1 + np.arange(r.width) + r.width * np.arange(r.height)[:, None]
                rows.append((r.sequence_id, r.frame, r.dx, r.dy, image.sum(), (image * place).sum(), image.max(), int((valid * place).sum())))
            yield pd.DataFrame(rows, columns=["sequence_id", "frame", "dx", "dy", "total", "by_place", "largest", "valid_by_place"])

    x = _normalised(spark, sf_dir).withColumn("n", F.datediff(F.to_date("frame", "yyyyMMdd"), F.lit(DAY0)))
    x = fr.moved(x, (F.col("n") % 9 - 4) / 2, ((F.col("n") + F.col("sequence_id")) % 7 - 3) / 2)
    return x.mapInPandas(measured, "sequence_id long, frame string, dx double, dy double, total double, by_place double, largest double, valid_by_place long")


def detect_components(spark, sf_dir):
    x = fr.exploded(_detected(spark, sf_dir))
    return x.select("sequence_id", "frame", F.col("pos").cast("long").alias("pos"), "x", "y", F.array_join("bbox", ",").alias("bbox"), F.col("area").cast("long").alias("area"), "peak", "flux", "snr")


VELOCITY = (1.0, -1.0)


def planted_recovery(spark, sf_dir):
    """How many frames give a planted mover back, by sequence, method and strength."""
    x = planting.planted(_normalised(spark, sf_dir).where("usable").withColumn("status", F.lit("ok")), velocity=VELOCITY)
    return planting.recovery(stored(x, "planted"))


def _track_points(spark, sf_dir, detected):
    config = tracking.TracksConfig(max_link_px=6.0)
    return tracking.build(fr.exploded(detected), detected.select("sequence_id", "frame", "ts"), "demo", config)


def tracker_greedy(spark, sf_dir):
    return _track_points(spark, sf_dir, _detected(spark, sf_dir)).select("track_id", "seq", "frame", "x", "y", F.round("residual", 4).alias("residual"))


def event_detections(spark, sf_dir):
    """All events as detections: a type's day is a sequence, an hour a frame."""
    e = table(spark, sf_dir, "events")
    e = e.select((_sequence(F.col("event_type")) * 100_000 + F.datediff("ts", F.lit(DAY0))).alias("sequence_id"), F.date_trunc("hour", "ts").alias("ts"), F.col("event_id").alias("pos"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    return e.withColumn("frame", F.date_format("ts", "yyyyMMddHH"))


def tracker_events(spark, sf_dir):
    """The tracker over all events as detections."""
    e = event_detections(spark, sf_dir)
    d = e.select("sequence_id", "frame", "pos", "x", "y", F.lit(1.0).alias("area"), F.lit(1.0).alias("peak"), F.col("x").alias("flux"), F.lit(5.0).alias("snr"))
    return tracking.build(d, e.select("sequence_id", "frame", "ts").distinct(), "events", EVENT_TRACKS).select("track_id", "seq", "frame", "x", "y")


EVENT_TRACKS = tracking.TracksConfig(max_link_px=40.0, min_track_frames=3)


def _stacks(spark, sf_dir):
    """Crops about detections: those with the same number in their frames are a stack."""
    detected = _detected(spark, sf_dir, residuals=True)
    x = fr.exploded(detected.select("sequence_id", "frame", "detections"))
    points = x.select(F.format_string("seq%d_pos_%05d", "sequence_id", "pos").alias("track_id"), F.row_number().over(Window.partitionBy("sequence_id", "pos").orderBy("frame")).alias("seq"), "sequence_id", "frame", "x", "y")
    return fr.crops(points, detected, CROP)


def crop_cut(spark, sf_dir):
    x = _stacks(spark, sf_dir)
    least = x.select("track_id", "n_frames", "crop_size", F.round(F.array_min("valid_fractions"), 6).alias("least_valid"))
    return least.join(fr.stack_totals(x), "track_id").select("track_id", F.col("n_frames").cast("long").alias("n_frames"), F.col("crop_size").cast("long").alias("crop_size"), "least_valid", "total", "first_total", "last_total")


def stack_normalise(spark, sf_dir):
    """Lengths and sums of normalised stacks."""
    x = scoring.normalised(_stacks(spark, sf_dir)).select("track_id", "length", F.col("stack").alias("crops"), F.lit(CROP).alias("crop_size"))
    return x.select("track_id", F.col("length").cast("long").alias("length")).join(fr.stack_totals(x), "track_id").select("track_id", "length", F.round("total", 1).alias("total"))


def cnn_gru_score(spark, sf_dir):
    return scoring.score(_stacks(spark, sf_dir), net.seeded_weights(1), "seeded_v1").select("track_id", "run_id", F.round("score", 5).alias("score"))


def scoring_runs(spark, sf_dir):
    """Two models and their mean, with the run that ranks."""
    x, primary = scoring.score_runs(_stacks(spark, sf_dir), {"a": net.seeded_weights(1), "b": net.seeded_weights(2)})
    return x.select("track_id", "run_id", F.round("score", 5).alias("score"), F.lit(primary).alias("primary"))


def filmstrip_png(spark, sf_dir):
    return files.filmstrips(_stacks(spark, sf_dir), 2).select("track_id", F.octet_length("png").cast("long").alias("n_bytes"))


def pipeline_features(spark, sf_dir):
    """From files to features of tracks: decode, normalise, detect, link, describe."""
    p = _track_points(spark, sf_dir, _detected(spark, sf_dir))
    return tracks.features(p, "track_id", "ts", "x", "y", "flux", "area", (F.lit(MIDDLE - 1), F.lit(MIDDLE - 1)))


def linear_ranker(spark, sf_dir):
    """Scores of the linear substitute, trained on users whose flux rises."""
    from . import features

    d = features.dna(spark, sf_dir).withColumns({"vector": tracks.model_vector(), "label": (F.col("flux_slope_frac_h") > 0).cast("int")})
    model = scoring.train_linear(d, "vector", "label", 0.5)
    return scoring.predict_linear(model, d, "user_id", "vector", "linear_v1").select("user_id", "run_id", F.round("score", 4).alias("score"))


QUERIES = {q.__name__: q for q in (fits_roundtrip, preprocess_frames, register_shift, moved_pixels, detect_components, planted_recovery, tracker_greedy, tracker_events, crop_cut, stack_normalise, cnn_gru_score, scoring_runs, filmstrip_png, pipeline_features, linear_ranker)}

_TYPES = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_E = f"e AS (SELECT CAST(list_position({_TYPES}, event_type) AS BIGINT) AS s, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) - DATE '{DAY0}' AS BIGINT) AS n, event_id FROM events), f AS (SELECT DISTINCT s, day, n FROM e)"
_PX = f"""{_E}, g AS (SELECT unnest(range({SIZE})) AS i), grid AS (SELECT a.i AS x, b.i AS y FROM g a CROSS JOIN g b),
hit AS (SELECT s, n, x, y, sum(amp) AS amp FROM (SELECT s, n, 4 + event_id * 7919 % 40 + r AS x, 4 + event_id * 104729 % 40 AS y, 160 + 16 * (event_id % 5) AS amp FROM e, (SELECT unnest([0, 1]) AS r)
  UNION ALL SELECT s, n, 4 + 2 * (n % 20) + r, 6 + n % 20 + q, 1440 FROM f, (SELECT unnest([0, 1]) AS r), (SELECT unnest([0, 1]) AS q)) GROUP BY ALL),
px AS (SELECT s, day, n, x, y, CASE WHEN (x * y + n) % 97 = 0 THEN 0 ELSE 200 + ((x + 64) * (x + 64) * (y + 64) * 7 + (y + 64) * (y + 64) * (x + 64) * 13 + (x + 64) * 73 + (y + 64) * 151 + s * 17) % 257 + (x * 5 + y * 11 + n * 7 + s * 3 + x * y * n) % 7 + least(coalesce(amp, 0), 8000) END::DOUBLE AS raw
  FROM f CROSS JOIN grid LEFT JOIN hit USING (s, n, x, y)),
fld AS (SELECT *, x BETWEEN 4 AND {SIZE - 5} AND y BETWEEN 4 AND {SIZE - 5} AND sqrt((x - {MIDDLE - 1}) * (x - {MIDDLE - 1}) + (y - {MIDDLE - 1}) * (y - {MIDDLE - 1})) / (965.0::DOUBLE / {SCALE}) BETWEEN 3 AND 14 AS field FROM px),
nrm AS (SELECT s, day, n, x, y, field, field AND raw > 0 AS ok, CASE WHEN field AND raw > 0 THEN raw / {EXPOSURE} ELSE 0 END::DOUBLE AS v FROM fld)"""
_DET = f"""mid AS (SELECT s, n, quantile_cont(r, 0.5) AS md FROM res WHERE ok GROUP BY ALL), sig AS (SELECT s, n, (1.4826::FLOAT * quantile_cont(abs(r - md), 0.5)::FLOAT)::DOUBLE AS sigma FROM res JOIN mid USING (s, n) WHERE ok GROUP BY ALL),
hot AS (SELECT s, day, n, x, y, r, sigma, y * {SIZE} + x AS i FROM res JOIN sig USING (s, n) WHERE ok AND sigma > 0 AND r::FLOAT > (5 * sigma)::FLOAT),
reach(s, n, i, j) AS (SELECT s, n, i, i FROM hot UNION SELECT t.s, t.n, t.i, h.i FROM reach t JOIN hot h ON h.s = t.s AND h.n = t.n AND abs(h.x - t.j % {SIZE}) <= 1 AND abs(h.y - t.j // {SIZE}) <= 1),
lab AS (SELECT s, n, i, min(j) AS first FROM reach GROUP BY ALL),
cmp AS (SELECT s, day, n, first, sum(x) / count(*)::DOUBLE AS cx, sum(y) / count(*)::DOUBLE AS cy, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, max(r) AS peak, sum(r) AS flux, any_value(sigma) AS sigma FROM lab JOIN hot USING (s, n, i) GROUP BY ALL),
det AS (SELECT s, day, n, row_number() OVER (PARTITION BY s, n ORDER BY first) - 1 AS pos, round_even(cx * 100, 0) / 100 AS x, round_even(cy * 100, 0) / 100 AS y, x0 || ',' || y0 || ',' || w || ',' || h AS bbox, area, round_even(peak * 1e4, 0) / 1e4 AS peak, round_even(flux * 1e4, 0) / 1e4 AS flux, round_even(peak / sigma * 100, 0) / 100 AS snr FROM cmp WHERE area BETWEEN 2 AND 2000)"""
_RES = f"""{_PX}, near AS (SELECT *, list_concat(coalesce(list(v) OVER (PARTITION BY s, x, y ORDER BY n ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []), coalesce(list(v) OVER (PARTITION BY s, x, y ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), [])) AS w FROM nrm),
res AS (SELECT s, day, n, x, y, ok, v - list_median(w) AS r FROM near),
{_DET}"""
_CUT = f"""{_RES}, pts AS (SELECT *, 'seq' || s || '_pos_' || lpad(CAST(pos AS VARCHAR), 5, '0') AS track_id, row_number() OVER (PARTITION BY s, pos ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY s, pos) AS m, CAST(round_even(x, 0) AS BIGINT) - {CROP // 2} AS left_, CAST(round_even(y, 0) AS BIGINT) - {CROP // 2} AS top FROM det),
sq AS (SELECT a.i AS cx, b.i AS cy FROM (SELECT unnest(range({CROP})) AS i) a CROSS JOIN (SELECT unnest(range({CROP})) AS i) b),
cut AS (SELECT track_id, k, m, cx, cy, coalesce(ok, false) AS ok, CASE WHEN ok THEN r ELSE 0 END::DOUBLE AS r FROM pts p CROSS JOIN sq LEFT JOIN res ON res.s = p.s AND res.n = p.n AND res.x = left_ + cx AND res.y = top + cy)"""
_FRAME = "s AS sequence_id, strftime(day, '%Y%m%d') AS frame"
_PLANTED = f"""{_PX}, lit AS (SELECT s, n, median(v) AS md FROM nrm WHERE v <> 0 GROUP BY ALL), dev AS (SELECT s, n, (1.4826::FLOAT * quantile_cont(abs(v - md), 0.5)::FLOAT)::DOUBLE AS sg FROM nrm JOIN lit USING (s, n) WHERE v <> 0 GROUP BY ALL),
ord AS (SELECT s, n, row_number() OVER (PARTITION BY s ORDER BY n) - 1 AS i FROM f), spot AS (SELECT *, {SIZE} * 0.3::DOUBLE + i * {VELOCITY[0]}::DOUBLE AS px, {SIZE} * 0.7::DOUBLE + i * {VELOCITY[1]}::DOUBLE AS py FROM ord),
cell AS (SELECT unnest([0, 1, 2]) AS c, unnest([10.0, 5.0, 3.0]::DOUBLE[]) AS a),
grown AS (SELECT s * 3 + c AS s, day, n, x, y, ok, CAST(v + a * sg * exp(-((x - px) * (x - px) + (y - py) * (y - py)) / 4.5::DOUBLE) AS FLOAT)::DOUBLE AS v FROM nrm JOIN dev USING (s, n) JOIN spot USING (s, n) CROSS JOIN cell),
near AS (SELECT *, list_concat(coalesce(list(v) OVER (PARTITION BY s, x, y ORDER BY n ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []), coalesce(list(v) OVER (PARTITION BY s, x, y ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), [])) AS w, lag(v) OVER q AS v1, lag(ok) OVER q AS ok1 FROM grown WINDOW q AS (PARTITION BY s, x, y ORDER BY n)),
res AS (SELECT s * 2 AS s, day, n, x, y, ok, CAST(v - list_median(w)::FLOAT AS FLOAT)::DOUBLE AS r FROM near UNION ALL SELECT s * 2 + 1, day, n, x, y, ok AND ok1, CAST(v - v1 AS FLOAT)::DOUBLE FROM near WHERE v1 IS NOT NULL),
{_DET}"""
SQL = {
    "planted_recovery": f"""WITH RECURSIVE {_PLANTED}, hit2 AS (SELECT d.s, d.n, bool_or(sqrt((d.x - px) * (d.x - px) + (d.y - py) * (d.y - py)) <= 3) AS found, count(*) AS k FROM det d JOIN spot ON spot.s = d.s // 6 AND spot.n = d.n GROUP BY ALL)
SELECT spot.s AS sequence_id, CASE m WHEN 0 THEN 'median' ELSE 'prev_diff' END AS method, a AS strength, count(*) AS n_frames, count(*) FILTER (WHERE found) AS recovered, coalesce(sum(k), 0)::BIGINT AS n_detections
FROM spot CROSS JOIN cell CROSS JOIN (SELECT unnest([0, 1]) AS m) LEFT JOIN hit2 ON hit2.s = spot.s * 6 + c * 2 + m AND hit2.n = spot.n GROUP BY ALL""",
    "fits_roundtrip": f"""WITH {_PX} SELECT 'seq_' || s || '/' || strftime(day, '%Y%m%d') || '.fts' AS path, {SIZE} AS height, {SIZE} AS width, '<i2' AS dtype, day + s::INT * INTERVAL 1 HOUR AS ts, 'C3' AS detector, 'LASCO/C3' AS instrument,
  {EXPOSURE}::DOUBLE AS exposure_seconds, {MIDDLE}::DOUBLE AS sun_x, count(*) * 2 AS n_bytes, NULL::VARCHAR AS error, sum(raw) AS total, max(raw) AS largest FROM px GROUP BY s, day""",
    "preprocess_frames": f"""WITH {_PX}, q AS (SELECT s, day, count(*) FILTER (WHERE field) AS field_pixels, count(*) FILTER (WHERE field AND NOT ok) AS bad, sum(v) AS total, max(v) AS largest FROM nrm GROUP BY s, day)
SELECT {_FRAME}, true AS exposure_ok, false AS sun_center_missing, round_even(bad / field_pixels::DOUBLE * 1e6, 0) / 1e6 AS invalid_fraction, field_pixels, bad / field_pixels::DOUBLE <= 0.5 AS usable, total, largest FROM q""",
    "register_shift": f"""WITH {_E}, p AS (SELECT *, CASE WHEN n % 11 = 5 THEN 14 ELSE (n * 3 + s) % 7 - 3 END AS sx, (n * 5 + s) % 7 - 3 AS sy FROM f),
d AS (SELECT s, day, n, first_value(sx) OVER w - sx AS dx, first_value(sy) OVER w - sy AS dy, n = first_value(n) OVER w AS first FROM p WINDOW w AS (PARTITION BY s ORDER BY n))
SELECT {_FRAME}, CASE WHEN first THEN 'reference' WHEN dx * dx + dy * dy > 100 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN dx * dx + dy * dy > 100 THEN 0 ELSE dx END AS dx, CASE WHEN dx * dx + dy * dy > 100 THEN 0 ELSE dy END AS dy FROM d""",
    "moved_pixels": f"""WITH {_PX}, h AS (SELECT s, day, n, (n % 9 - 4) / 2.0::DOUBLE AS dx, ((n + s) % 7 - 3) / 2.0::DOUBLE AS dy FROM f),
usable AS (SELECT s, n FROM nrm GROUP BY s, n HAVING count(*) FILTER (WHERE field AND NOT ok) / (count(*) FILTER (WHERE field))::DOUBLE <= 0.5), w AS (SELECT * FROM h SEMI JOIN usable USING (s, n)),
part AS (SELECT s, n, CAST(x + floor(dx) AS BIGINT) + a AS x, CAST(y + floor(dy) AS BIGINT) + b AS y, v * abs(1 - a - (dx - floor(dx))) * abs(1 - b - (dy - floor(dy))) AS v FROM nrm JOIN w USING (s, n), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
pixel AS (SELECT s, n, x, y, sum(v) AS v FROM part WHERE x BETWEEN 0 AND {SIZE - 1} AND y BETWEEN 0 AND {SIZE - 1} GROUP BY ALL),
valid AS (SELECT s, n, CAST(ceil(x + dx - 0.5) AS BIGINT) AS x, CAST(ceil(y + dy - 0.5) AS BIGINT) AS y FROM nrm JOIN w USING (s, n) WHERE ok),
vs AS (SELECT s, n, sum(1 + x + {SIZE} * y)::BIGINT AS valid_by_place FROM valid WHERE x BETWEEN 0 AND {SIZE - 1} AND y BETWEEN 0 AND {SIZE - 1} GROUP BY ALL),
ps AS (SELECT s, n, sum(v) AS total, sum(v * (1 + x + {SIZE} * y)) AS by_place, max(v) AS largest FROM pixel GROUP BY ALL)
SELECT {_FRAME}, dx, dy, total, by_place, largest, coalesce(valid_by_place, 0) AS valid_by_place FROM w JOIN ps USING (s, n) LEFT JOIN vs USING (s, n)""",
    "detect_components": f"WITH RECURSIVE {_RES} SELECT {_FRAME}, pos, x, y, bbox, area, peak, flux, snr FROM det",
    "crop_cut": f"""WITH RECURSIVE {_CUT}, c AS (SELECT track_id, k, any_value(m) AS m, count(*) FILTER (WHERE ok) / {CROP * CROP}::DOUBLE AS share, sum(r) AS total FROM cut GROUP BY track_id, k)
SELECT track_id, count(*) AS n_frames, {CROP}::BIGINT AS crop_size, round_even(min(share) * 1e6, 0) / 1e6 AS least_valid, sum(total) AS total, arg_min(total, k) AS first_total, arg_max(total, k) AS last_total FROM c GROUP BY track_id""",
    "stack_normalise": f"""WITH RECURSIVE {_CUT}, md AS (SELECT track_id, quantile_cont(r, 0.5) AS md FROM cut GROUP BY 1), sg AS (SELECT track_id, greatest((1.4826::FLOAT * quantile_cont(abs(r - md), 0.5)::FLOAT)::DOUBLE, 1e-6) AS sg FROM cut JOIN md USING (track_id) GROUP BY 1),
pick AS (SELECT DISTINCT track_id, k FROM cut WHERE m <= 16 UNION SELECT DISTINCT track_id, CAST(round_even(i * (m - 1) / 15.0::DOUBLE, 0) AS BIGINT) FROM cut, (SELECT unnest(range(16)) AS i) WHERE m > 16)
SELECT track_id, least(any_value(m), 16) AS length, floor(sum(asinh(r / sg)) * 10 + 0.5) / 10 AS total FROM cut JOIN sg USING (track_id) JOIN pick USING (track_id, k) GROUP BY 1""",
}
