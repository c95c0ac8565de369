"""Track queries: a user is a track, value its x and flux, props.k its y and area; an event type's day is a sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import tracks as t
from ..session import table

CENTER = (250.0, 50.0)
SEQUENCE = ["event_type", "day"]


def points(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), "ts", F.col("value").alias("x"), k.alias("y"))


def dna(spark, sf_dir):
    return t.features(points(spark, sf_dir), "user_id", "ts", "x", "y", "x", "y", (F.lit(CENTER[0]), F.lit(CENTER[1])))


def dedupe_ts(spark, sf_dir):
    x = points(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    return t.first_of_time(x, ["user_id", "hour"], ["ts", "event_id"]).select("user_id", "hour", "event_id")


def persistence_filter(spark, sf_dir):
    return t.persistent(points(spark, sf_dir).withColumn("track", F.concat_ws("/", "user_id", F.to_date("ts").cast("string"))), "track")


def track_index(spark, sf_dir):
    """Deterministic ids: place within the sequence by start time and position."""
    x = points(spark, sf_dir).groupBy("event_type", "user_id").agg(F.min("ts").alias("t0"), F.min_by("x", "ts").alias("x0"), F.min_by("y", "ts").alias("y0"))
    x = t.numbered(x, "event_type", ["t0", "x0", "y0"])
    return x.select("event_type", "user_id", F.format_string("seq%d_%s_%05d", F.length("event_type"), F.substring(F.sha2("event_type", 256), 1, 8), "index").alias("track_id"))


def track_summary(spark, sf_dir):
    return t.summary(points(spark, sf_dir), "user_id", "ts", "x", "y", "y")


def motion_dna(spark, sf_dir):
    return dna(spark, sf_dir)


def dna_validate(spark, sf_dir):
    """Ranges as the features have them, and with a displaced path that must be reported."""
    d = dna(spark, sf_dir)
    bad = d.withColumns({"path_length_px": F.when(F.col("user_id") > 75, F.col("displacement_px") - 1).otherwise(F.col("path_length_px")), "frame_coverage": F.when(F.col("user_id") <= 20, 1.5).otherwise(F.col("frame_coverage"))})
    return bad.select("user_id", F.array_join(t.problems(), "; ").alias("problems")).where("problems != ''")


def comet_shortlist(spark, sf_dir):
    return t.shortlist(dna(spark, sf_dir), "user_id").select("user_id", rounded(F.col("score"), 6).alias("score"))


def dna_vector(spark, sf_dir):
    return dna(spark, sf_dir).select("user_id", F.transform(t.model_vector(), lambda v: rounded(v, 5) + 0.0).alias("vector"))


def robust_sigma(spark, sf_dir):
    x = t.robust_sigma(points(spark, sf_dir), SEQUENCE, "x")
    return x.select("event_type", "day", rounded(F.col("sigma"), 6).alias("sigma"))


def temporal_median_1d(spark, sf_dir):
    x = t.neighbour_median(points(spark, sf_dir), SEQUENCE, ["ts", "event_id"], "x")
    return x.select("event_id", rounded(F.col("x") - F.col("background"), 6).alias("residual"))


def previous_difference(spark, sf_dir):
    x = t.previous(points(spark, sf_dir), SEQUENCE, ["ts", "event_id"], "x")
    return x.select("event_id", rounded(F.col("x") - F.col("background"), 6).alias("residual"))


def detect_threshold(spark, sf_dir):
    """Rows whose residual exceeds five robust sigmas of their sequence, with their ratio to sigma."""
    x = t.neighbour_median(points(spark, sf_dir), SEQUENCE, ["ts", "event_id"], "x").select("event_id", *SEQUENCE, (F.col("x") - F.col("background")).alias("residual"))
    s = t.robust_sigma(x, SEQUENCE, "residual").where("sigma > 0")
    return x.join(s, SEQUENCE).where("residual > 5 * sigma").select("event_id", rounded(F.col("residual"), 4).alias("peak"), rounded(F.col("residual") / F.col("sigma"), 2).alias("snr"))


def area_band(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_size").between(2, 30)).select("p_partkey", "p_size")


def topk_per_frame(spark, sf_dir):
    x = t.strongest(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_linenumber", 3)
    return x.select("l_orderkey", "l_linenumber", "l_extendedprice")


def stride_subsample(spark, sf_dir):
    """At most sixteen points of each track, evenly spread in time."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    x = points(spark, sf_dir).withColumns({"i": F.row_number().over(w.orderBy("ts", "event_id")) - 1, "n": F.count(F.lit(1)).over(w).cast("int")})
    return x.where(F.array_contains(t.stride(F.col("n"), 16), F.col("i"))).select("user_id", "event_id")


QUERIES = {f.__name__: f for f in (dedupe_ts, persistence_filter, track_index, track_summary, motion_dna, dna_validate, comet_shortlist, dna_vector, robust_sigma, temporal_median_1d, previous_difference, detect_threshold, area_band, topk_per_frame, stride_subsample)}

_P = "p AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, ts, value AS x, CAST(props->>'$.k' AS DOUBLE) AS y FROM events)"
R = lambda c, n: f"round_even(({c}) * 1e{n}, 0) / 1e{n}"
_DNA = f"""{_P},
a AS (SELECT *, epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id) AS t FROM p),
b AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS dt, row_number() OVER w AS i FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t)),
c AS (SELECT *, sqrt(dx * dx + dy * dy) AS len, dx / nullif(dt, 0) AS vx, dy / nullif(dt, 0) AS vy FROM b),
d AS (SELECT *, CASE WHEN len > 0 THEN atan2(dy, dx) END AS heading FROM c),
e AS (SELECT *, sqrt(pow(vx - lag(vx) OVER w, 2) + pow(vy - lag(vy) OVER w, 2)) / nullif((dt + lag(dt) OVER w) / 2, 0) AS acc,
  heading - last_value(heading IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dh,
  sqrt(pow(x - {CENTER[0]}, 2) + pow(y - {CENTER[1]}, 2)) AS r FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT user_id, count(*) AS n, max(t) AS duration, coalesce(sum(len), 0) AS path, arg_max(x, i) - arg_min(x, i) AS dx, arg_max(y, i) - arg_min(y, i) AS dy,
  avg(len / nullif(dt, 0)) AS speed, stddev_pop(len / nullif(dt, 0)) AS speed_std, sqrt(pow(avg(CASE WHEN len > 0 THEN dx / len END), 2) + pow(avg(CASE WHEN len > 0 THEN dy / len END), 2)) AS consistency,
  avg(acc) AS acc, sum(CASE WHEN len > 0 THEN abs(atan2(sin(dh), cos(dh))) END) AS turns, count(CASE WHEN len > 0 THEN dh END) AS n_turns,
  sqrt(greatest(regr_syy(x, t) - pow(regr_sxy(x, t), 2) / regr_sxx(x, t) + regr_syy(y, t) - pow(regr_sxy(y, t), 2) / regr_sxx(y, t), 0) / (2 * count(*))) AS rms,
  avg(x) AS flux, stddev_pop(x) AS flux_std, regr_slope(x, t) AS flux_slope, avg(y) AS area, regr_slope(y, t) AS area_slope, min(r) AS r_min, avg(r) AS r_mean, max(r) AS r_max, arg_max(r, i) - arg_min(r, i) AS dr FROM e GROUP BY user_id),
dna AS (SELECT user_id, n AS n_frames, 1.0::DOUBLE AS frame_coverage, {R("duration", 3)} AS duration_s, {R("path", 2)} AS path_length_px, {R("sqrt(dx * dx + dy * dy)", 2)} AS displacement_px,
  {R("speed", 6)} AS speed_mean_px_s, {R("speed_std", 6)} AS speed_std_px_s, CASE WHEN sqrt(dx * dx + dy * dy) > 0 THEN {R("degrees(atan2(dy, dx))", 2)} END AS direction_deg, {R("consistency", 4)} AS direction_consistency,
  CASE WHEN n >= 3 THEN {R("acc", 8)} END AS accel_mean_px_s2, CASE WHEN n >= 3 AND n_turns >= 1 THEN {R("turns / nullif(path, 0)", 6)} END AS curvature_rad_px, CASE WHEN n >= 3 THEN {R("rms", 4)} END AS linear_rms_px,
  {R("flux", 4)} AS flux_mean, CASE WHEN flux > 0 THEN {R("flux_std / flux", 4)} END AS flux_cv, CASE WHEN duration > 0 AND flux > 0 THEN {R("flux_slope * 3600 / flux", 5)} END AS flux_slope_frac_h,
  {R("area", 2)} AS area_mean_px, CASE WHEN duration > 0 AND area > 0 THEN {R("area_slope * 3600 / area", 5)} END AS area_slope_frac_h, {R("r_min", 2)} AS r_min_px, {R("r_mean", 2)} AS r_mean_px, {R("r_max", 2)} AS r_max_px,
  CASE WHEN duration > 0 THEN {R("dr / duration", 6)} END AS radial_speed_px_s FROM g)"""
_MED = f"""{_P}, m AS (SELECT *, list_concat(coalesce(list(x) OVER (PARTITION BY event_type, day ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []), coalesce(list(x) OVER (PARTITION BY event_type, day ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), [])) AS near FROM p),
q AS (SELECT *, x - list_median(near) AS residual FROM m)"""
SQL = {
    "dedupe_ts": f"WITH {_P} SELECT user_id, date_trunc('hour', ts) AS hour, event_id FROM p QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) = 1",
    "persistence_filter": "SELECT user_id || '/' || CAST(ts AS DATE) AS track, count(*) AS n_frames FROM events GROUP BY 1 HAVING count(*) >= 5",
    "track_index": f"""WITH {_P}, f AS (SELECT event_type, user_id, min(ts) AS t0, arg_min(x, ts) AS x0, arg_min(y, ts) AS y0 FROM p GROUP BY 1, 2)
SELECT event_type, user_id, 'seq' || length(event_type) || '_' || substr(sha256(event_type), 1, 8) || '_' || lpad(CAST(row_number() OVER (PARTITION BY event_type ORDER BY t0, x0, y0) - 1 AS VARCHAR), 5, '0') AS track_id FROM f""",
    "track_summary": f"""WITH {_P}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, epoch_us(ts) / 1e6 AS t FROM p),
g AS (SELECT user_id, count(*) AS n_points, max(t) - min(t) AS duration, sqrt(pow(arg_max(x, i) - arg_min(x, i), 2) + pow(arg_max(y, i) - arg_min(y, i), 2)) AS displacement, coalesce(avg(y) FILTER (WHERE i > 1), 0) AS mean FROM n GROUP BY 1)
SELECT user_id, n_points, {R("duration", 3)} AS duration_s, {R("displacement", 2)} AS displacement_px, {R("coalesce(displacement / nullif(duration, 0), 0)", 6)} AS speed_px_s, {R("mean", 3)} AS residual_mean_px FROM g""",
    "motion_dna": f"WITH {_DNA} SELECT * FROM dna",
    "dna_validate": f"""WITH {_DNA}, z AS (SELECT user_id, CASE WHEN user_id <= 20 THEN 1.5 ELSE frame_coverage END AS fc, CASE WHEN user_id > 75 THEN displacement_px - 1 ELSE path_length_px END AS pl, displacement_px AS dp FROM dna)
SELECT user_id, concat_ws('; ', CASE WHEN pl < 0 THEN 'path_length_px out of range' END, CASE WHEN fc > 1 THEN 'frame_coverage out of range' END, CASE WHEN dp > pl + 1e-6 THEN 'displacement exceeds path' END) AS problems FROM z WHERE pl < 0 OR fc > 1 OR dp > pl + 1e-6""",
    "comet_shortlist": f"""WITH {_DNA}, s AS (SELECT user_id, coalesce(direction_consistency, 0) + CASE WHEN linear_rms_px IS NOT NULL THEN 1 / (1 + linear_rms_px) ELSE 0 END + least(speed_mean_px_s / (3 * 0.0009::DOUBLE), 1) + least(abs(radial_speed_px_s) / speed_mean_px_s, 1) AS score
  FROM dna WHERE n_frames >= 8 AND radial_speed_px_s < 0 AND speed_mean_px_s > 0)
SELECT user_id, {R("score", 6)} AS score FROM s ORDER BY s.score DESC, user_id DESC LIMIT 10""",
    "dna_vector": f"""WITH {_DNA} SELECT user_id, list_transform([coalesce(radial_speed_px_s, 0) * 360, asinh(coalesce(speed_mean_px_s, 0) * 720), coalesce(direction_consistency, 0), asinh(coalesce(linear_rms_px, 0)), asinh(coalesce(flux_slope_frac_h, 0) * 10), asinh(coalesce(flux_cv, 0)), frame_coverage, ln(1 + n_frames) / 5, coalesce(r_min_px, 0) / 500], lambda v: round_even(v * 1e5, 0) / 1e5 + 0::DOUBLE) AS vector FROM dna""",
    "robust_sigma": f"WITH {_P}, m AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY event_type, day) AS md FROM p) SELECT event_type, day, {R('1.4826::DOUBLE * quantile_cont(abs(x - md), 0.5)', 6)} AS sigma FROM m GROUP BY 1, 2",
    "temporal_median_1d": f"WITH {_MED} SELECT event_id, {R('residual', 6)} AS residual FROM q",
    "previous_difference": f"WITH {_P} SELECT event_id, {R('x - lag(x) OVER (PARTITION BY event_type, day ORDER BY ts, event_id)', 6)} AS residual FROM p",
    "detect_threshold": f"""WITH {_MED}, md AS (SELECT event_type, day, quantile_cont(residual, 0.5) AS md FROM q GROUP BY 1, 2), s AS (SELECT event_type, day, 1.4826::DOUBLE * quantile_cont(abs(residual - md), 0.5) AS sigma FROM q JOIN md USING (event_type, day) GROUP BY 1, 2)
SELECT event_id, {R('residual', 4)} AS peak, {R('residual / sigma', 2)} AS snr FROM q JOIN s USING (event_type, day) WHERE sigma > 0 AND residual > 5 * sigma""",
    "area_band": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 2 AND 30",
    "topk_per_frame": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 3",
    "stride_subsample": f"""WITH {_P}, n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM p)
SELECT user_id, event_id FROM n WHERE n <= 16 OR i IN (SELECT CAST(round_even(k * (n.n - 1) / 15::DOUBLE, 0) AS BIGINT) FROM range(16) r(k))""",
}
