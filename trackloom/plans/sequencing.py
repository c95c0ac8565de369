"""Sequencing queries: event_type stands for the instrument, ts for the observation time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequencing as s
from ..session import table

_BUILT = """f AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type, day ORDER BY ts, event_id)) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM f),
h AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY event_type, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq FROM g),
b AS (SELECT event_type, day, seq, min(ts) AS start_time, max(ts) AS end_time, count(*) AS frame_count FROM h GROUP BY ALL)"""


def seq_build(spark, sf_dir):
    return s.sequences(table(spark, sf_dir, "events"), "event_type", "ts", "event_id")


def seq_session_window(spark, sf_dir):
    return s.sequences_by_session_window(table(spark, sf_dir, "events"), "event_type", "ts")


def seq_window_fold(spark, sf_dir):
    return s.fold(table(spark, sf_dir, "events"), ["user_id"], "ts")


def seq_integrity_gap(spark, sf_dir):
    x = s.sessionise(table(spark, sf_dir, "events"), "event_type", "ts", "event_id")
    x = s.internal_gaps(x, ["event_type", "day", "seq"], "ts", "event_id", 30.0)
    return x.select("event_type", "day", "seq", "event_id", "previous_time", F.floor(F.col("gap_s") + 0.5).alias("gap_s"))


def seq_attach_interval(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    late = e.select("event_id", "event_type", (F.col("ts") + F.expr("interval 45 minutes")).alias("late_ts"))
    return s.attach(late, s.sequences(e, "event_type", "ts", "event_id"), ["event_id"], "event_type", "late_ts").select("event_id", "late_ts", "start_time", "end_time")


def seq_extend(spark, sf_dir):
    """Later frames join the sequences that the purchases of the day built: incremental assignment."""
    e = table(spark, sf_dir, "events")
    old = s.sequences(e.withColumn("instrument", F.lit("all")).where("event_type = 'purchase'"), "instrument", "ts", "event_id")
    old = old.select((F.datediff("day", F.lit("2024-01-01").cast("date")) * 1000 + F.col("seq")).alias("sequence_id"), "instrument", "start_time", "end_time")
    return s.extend(e.select(F.col("event_id").alias("image_id"), F.lit("all").alias("instrument"), "ts"), old)


def seq_check(spark, sf_dir):
    """All seven integrity checks on rebuilt sequences with planted faults."""
    e = s.sessionise(table(spark, sf_dir, "events"), "event_type", "ts", "event_id")
    key = F.concat_ws("|", "event_type", F.col("day").cast("string"), F.col("seq").cast("string"))
    i = F.col("event_id")
    when = F.when(i % 500 == 3, None).when(i % 300 == 7, F.col("ts") + F.expr("interval 1 day")).otherwise(F.col("ts"))
    images = e.select(i.alias("id"), key.alias("sequence_id"), F.when(i % 400 == 5, "other").otherwise(F.col("event_type")).alias("instrument"), when.alias("observation_time"))
    built = s.fold(e.withColumn("id", key).withColumnRenamed("event_type", "instrument"), ["id", "instrument", "seq"], "ts")
    late = lambda c, k: F.when(F.col("seq") % k == 0, F.col(c) + F.expr("interval 1 second")).otherwise(F.col(c))
    built = built.select("id", "instrument", late("start_time", 5).alias("start_time"), late("end_time", 7).alias("end_time"), (F.col("frame_count") + F.when(F.col("seq") % 4 == 0, 1).otherwise(0)).alias("frame_count"))
    return s.check(images, built, 55.0)


def epoch_coverage(spark, sf_dir):
    from ..operators.tracks import coverage

    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.date_trunc("hour", "ts").alias("epoch_time")).distinct()
    return coverage(e, "event_type", ["event_type", "user_id"], "epoch_time")


QUERIES = {f.__name__: f for f in (seq_build, seq_session_window, seq_window_fold, seq_integrity_gap, seq_attach_interval, seq_extend, seq_check, epoch_coverage)}
SQL = {
    "seq_build": f"WITH {_BUILT} SELECT * FROM b",
    "seq_session_window": f"WITH {_BUILT} SELECT event_type, day, start_time, end_time, frame_count FROM b",
    "seq_window_fold": "SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS frame_count FROM events GROUP BY user_id",
    "seq_integrity_gap": f"""WITH {_BUILT}, p AS (SELECT *, lag(ts) OVER (PARTITION BY event_type, day, seq ORDER BY ts, event_id) AS previous_time FROM h)
SELECT event_type, day, seq, event_id, previous_time, CAST(floor((epoch_us(ts) - epoch_us(previous_time)) / 1e6 + 0.5) AS BIGINT) AS gap_s FROM p WHERE epoch_us(ts) - epoch_us(previous_time) > 1800000000""",
    "seq_attach_interval": f"""WITH {_BUILT}, l AS (SELECT event_id, event_type, ts + INTERVAL 45 MINUTE AS late_ts FROM events),
j AS (SELECT l.event_id, l.late_ts, b.start_time, b.end_time, row_number() OVER (PARTITION BY l.event_id ORDER BY b.start_time NULLS LAST) AS nth
  FROM l LEFT JOIN b ON l.event_type = b.event_type AND CAST(l.late_ts AS DATE) = CAST(b.start_time AS DATE) AND l.late_ts BETWEEN b.start_time - INTERVAL 60 MINUTE AND b.end_time + INTERVAL 60 MINUTE)
SELECT event_id, late_ts, start_time, end_time FROM j WHERE nth = 1""",
    "seq_check": f"""WITH {_BUILT}, k AS (SELECT *, event_type || '|' || day || '|' || seq AS key FROM h),
i AS (SELECT event_id AS id, key, CASE WHEN event_id % 400 = 5 THEN 'other' ELSE event_type END AS inst, CASE WHEN event_id % 500 = 3 THEN NULL WHEN event_id % 300 = 7 THEN ts + INTERVAL 1 DAY ELSE ts END AS t FROM k),
c0 AS (SELECT key, event_type, seq, min(ts) AS a, max(ts) AS z, count(*) AS fc FROM k GROUP BY key, event_type, seq),
c AS (SELECT key, event_type, CASE WHEN seq % 5 = 0 THEN a + INTERVAL 1 SECOND ELSE a END AS a, CASE WHEN seq % 7 = 0 THEN z + INTERVAL 1 SECOND ELSE z END AS z, fc + CASE WHEN seq % 4 = 0 THEN 1 ELSE 0 END AS fc FROM c0),
s AS (SELECT key, count(*) AS n, min(t) AS f, max(t) AS l FROM i GROUP BY 1), x AS (SELECT * FROM c JOIN s USING (key)),
p AS (SELECT *, lag(t) OVER (PARTITION BY key ORDER BY t, id) AS prev FROM i WHERE t IS NOT NULL)
SELECT key AS sequence_id, 'frame_count' AS problem, fc || '/' || n AS detail FROM x WHERE fc <> n
UNION ALL SELECT key, 'start_time', CAST(f AS VARCHAR) FROM x WHERE f IS DISTINCT FROM a UNION ALL SELECT key, 'end_time', CAST(l AS VARCHAR) FROM x WHERE l IS DISTINCT FROM z
UNION ALL SELECT i.key, 'instrument', CAST(id AS VARCHAR) FROM i JOIN c USING (key) WHERE inst <> event_type UNION ALL SELECT key, 'no observation_time', CAST(id AS VARCHAR) FROM i WHERE t IS NULL
UNION ALL SELECT key, 'several days', CAST(l AS VARCHAR) FROM x WHERE CAST(f AS DATE) <> CAST(l AS DATE)
UNION ALL SELECT key, 'internal gap', CAST(id AS VARCHAR) FROM p WHERE epoch_us(t) - epoch_us(prev) > 3300000000""",
    "seq_extend": """WITH RECURSIVE f AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, event_type FROM events),
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 3600000000 THEN 0 ELSE 1 END AS fresh FROM f WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY day ORDER BY ts, event_id)),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seq FROM g),
o AS (SELECT day, CAST((day - DATE '2024-01-01') * 1000 + seq AS BIGINT) AS id, min(ts) AS a, max(ts) AS z FROM h GROUP BY day, seq),
n AS (SELECT event_id, ts, day, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS i FROM f),
m AS (SELECT n.*, t.id, t.z FROM n LEFT JOIN (SELECT event_id, arg_min(o.id, o.a) AS id, arg_min(o.z, o.a) AS z FROM n JOIN o ON o.day = n.day AND n.ts BETWEEN o.a - INTERVAL 60 MINUTE AND o.z + INTERVAL 60 MINUTE GROUP BY 1) t USING (event_id)),
r AS (SELECT day, i, event_id, id, CASE WHEN id IS NULL THEN 1 ELSE 0 END AS own, CASE WHEN id IS NULL THEN 1 ELSE 0 END AS n, greatest(coalesce(z, ts), ts) AS e FROM m WHERE i = 1
  UNION ALL SELECT m.day, m.i, m.event_id, CASE WHEN m.ts - r.e <= INTERVAL 60 MINUTE THEN r.id ELSE m.id END, CASE WHEN m.ts - r.e <= INTERVAL 60 MINUTE THEN r.own WHEN m.id IS NULL THEN r.n + 1 ELSE 0 END,
    CASE WHEN m.ts - r.e > INTERVAL 60 MINUTE AND m.id IS NULL THEN r.n + 1 ELSE r.n END, CASE WHEN m.ts - r.e <= INTERVAL 60 MINUTE THEN greatest(r.e, m.ts) ELSE greatest(coalesce(m.z, m.ts), m.ts) END FROM r JOIN m ON m.day = r.day AND m.i = r.i + 1)
SELECT event_id AS image_id, id AS sequence_id, own AS opened FROM r""",
    "epoch_coverage": """WITH e AS (SELECT DISTINCT event_type, user_id, date_trunc('hour', ts) AS h FROM events),
n AS (SELECT event_type, h, row_number() OVER (PARTITION BY event_type ORDER BY h) AS i FROM (SELECT DISTINCT event_type, h FROM e))
SELECT event_type, user_id, count(*) AS n_frames, round_even(count(*)::DOUBLE / (max(i) - min(i) + 1) * 1e4, 0) / 1e4 AS frame_coverage FROM e JOIN n USING (event_type, h) GROUP BY ALL""",
}
