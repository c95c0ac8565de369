"""Text, date and document queries: pages are listings, orders make confirmation-list lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from .. import functions as f
from ..operators import evidence as ev
from ..schemas import FEATURES
from ..session import table
from ..sources import archive, documents
from . import features


def listing_parse(spark, sf_dir):
    """Frame names in directory listings, made of the pages' ids, with repeats and other links."""
    name = lambda i: F.lpad(F.pmod(F.col("page_id") * 37 + i, F.lit(99999999)).cast("string"), 8, "0")
    html = F.concat(F.lit('<a HREF="'), name(5), F.lit('.fts">x</a><a href="'), name(1), F.lit('.FTS">'), F.lit('<a href="'), name(5), F.lit('.fts">'), F.lit('<a href="index.jpg">'), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(f.listed_frames(html)).alias("name"))


def link_parse(spark, sf_dir):
    """Sorted distinct links of real pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))))).alias("link"))


def _lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    month, short = F.element_at(F.array(*map(F.lit, f.MONTHS)), F.month(day)), F.date_format(day, "yy")
    last = F.date_add(day.cast("date"), 3)
    span = F.when(F.col("o_orderstatus") == "F", F.concat(month, F.date_format(day, "dd"), F.lit("-"), F.element_at(F.array(*map(F.lit, f.MONTHS)), F.month(last)), F.date_format(last, "dd"), F.lit(","), short))
    span = span.otherwise(F.concat(month, F.date_format(day, "dd"), F.lit(","), short))
    camera = F.when(F.col("o_orderpriority") == "1-URGENT", "C3,C2").when(F.col("o_orderpriority") == "5-LOW", "none").otherwise("C2A")
    line = F.concat(F.lit("  "), F.col("o_orderkey").cast("string"), F.when(F.col("o_totalprice") > 400000, "*").otherwise(""), F.lit(" x y A. Name and B. Other "), camera, F.lit(" Kreutz "), span, F.lit("  "))
    return o.select("o_orderkey", line.alias("line"))


def list_parse(spark, sf_dir):
    x = f.with_event(_lines(spark, sf_dir), "line").where("e is not null")
    return x.select("o_orderkey", "e.soho_number", "e.flagged", "e.discoverers", F.array_join("e.cameras", ",").alias("cameras"), "e.group", "e.obs_start", "e.obs_end")


def list_failures(spark, sf_dir):
    return f.with_event(_lines(spark, sf_dir), "line").where("e is null").select("o_orderkey", F.rtrim("line").alias("line"))


def list_filter(spark, sf_dir):
    """Events by camera, group and span."""
    e = f.with_event(_lines(spark, sf_dir), "line").where("e is not null").select("e.*")
    return e.where(F.array_contains("cameras", "C3") & (F.lower("group") == "kreutz") & (F.datediff("obs_end", "obs_start") + 1 >= 4)).select("soho_number", "obs_start")


def obs_days(spark, sf_dir):
    """Days of the observation ranges and how many events each has."""
    e = f.with_event(_lines(spark, sf_dir), "line").where("e is not null").select("e.*")
    return e.select(F.explode(F.sequence("obs_start", "obs_end")).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def date_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "click", F.date_format("ts", "yyyy/MM/dd'T'HH:mm:ss.SSS")).when(F.col("event_type") == "view", F.date_format("ts", "yyyy/MM/dd'T'HH:mm:ss")).when(F.col("event_type") == "error", F.date_format("ts", "yyyy/MM/dd")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", f.observation_time(text).cast("timestamp_ntz").alias("observation_time"))


def track_id_format(spark, sf_dir):
    made = f.track_id(F.col("o_custkey"), f.hash_column(F.col("o_orderpriority"), 8), F.pmod("o_orderkey", F.lit(100000)))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("track_id"), f.sequence_of(made).alias("sequence_id"))


def config_hash(spark, sf_dir):
    """Hashes of configurations given as sorted JSON text."""
    text = F.format_string('{"max_link_px": %d.0, "version": "%s"}', F.col("p_size"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", f.hash_column(text).alias("config_hash"))


def day_urls(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    return d.select("day", f.day_url("https://archive.example/lasco/", F.col("day"), F.lit("C3")).alias("url"))


def archive_availability(spark, sf_dir):
    """Frames of each of the fourteen days up to the fifth of February, 0 where there are none."""
    return archive.availability(table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")), date(2024, 2, 5))


def provenance_times(spark, sf_dir):
    """Frame times by way of two manifests: line items name their order, orders hold the time; a missing one is an error."""
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"), F.col("l_orderkey").cast("string").alias("source")).distinct()
    stamp = f.observation_time(F.date_format("o_orderdate", "yyyy/MM/dd'T'HH:mm:ss"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), stamp.alias("observation_time"))
    return documents.frame_times(li.select("name"), li, o).select("name", "source", F.col("observation_time").cast("timestamp_ntz").alias("observation_time"))


def _packages(spark, sf_dir):
    p = features.points(spark, sf_dir)
    name = F.format_string("seq%d_x_%05d", F.col("user_id"), F.col("user_id"))
    from pyspark.sql import Window

    points = p.select(name.alias("track_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).alias("seq"), F.col("event_type").alias("frame"), "ts", "x", "y", F.col("y").alias("area"), F.col("x").alias("flux"), F.lit(0.0).alias("residual"))
    dna = features.dna(spark, sf_dir).withColumn("track_id", name)
    g = p.groupBy("user_id").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("n_frames"), F.max("x").alias("top"))
    c = g.select(name.alias("track_id"), F.col("user_id").alias("sequence_id"), F.lit("LASCO/C3").alias("instrument"), "start_time", "end_time", "n_frames", F.lit(None).cast("string").alias("label"), F.when(F.col("top") > 300, "HIGH_PRIORITY").otherwise("LOW_PRIORITY").alias("status"), "top")
    runs = c.select("track_id", F.explode(F.array(F.struct(F.lit("fusion_mean_v1").alias("run_id"), F.lit("m1").alias("model_version"), (F.col("top") / 1000).alias("score")), F.struct(F.lit("base").alias("run_id"), F.lit("m1").alias("model_version"), (F.col("top") / 2000).alias("score")))).alias("r")).select("track_id", "r.*")
    event = F.struct(F.lit(4000).alias("soho_number"), F.lit("confirmed_positive").alias("relation"), F.lit("2024-01-05").alias("day"))
    events = c.where("top > 400").select("track_id", event.alias("event"))
    return ev.packages(c.drop("top"), points, dna, runs, events, {"label_format": F.lit("labels_v1")})


def evidence_json(spark, sf_dir):
    """Whole packages as JSON documents, and facts read back from these."""
    x = _packages(spark, sf_dir)
    j = x.select("track_id", F.to_json(F.struct(*[c for c in x.columns if c != "track_id"])).alias("j"))
    at = lambda path, kind: F.get_json_object("j", f"$.{path}").cast(kind)
    return j.select("track_id", at("candidate.sequence_id", "long").alias("sequence_id"), at("candidate.status", "string").alias("status"), at("candidate.n_frames", "long").alias("n_frames"), at("track[0].x", "double").alias("first_x"), at("motion_dna.flux_mean", "double").alias("flux_mean"),
        at("predictions[1].run_id", "string").alias("run_id"), at("predictions[1].score", "double").alias("score"), at("event.soho_number", "long").alias("soho_number"), at("provenance.label_format", "string").alias("label_format"), F.json_array_length(at("track", "string")).cast("long").alias("n_points"), F.json_array_length(at("caveats", "string")).cast("long").alias("n_caveats"))


def evidence_compact(spark, sf_dir):
    x = ev.compact(_packages(spark, sf_dir))
    return x.select("track_id", "track_summary.n_points", F.col("track_summary.first_position.x").alias("first_x"), F.col("track_summary.last_position.x").alias("last_x"), F.col("candidate.status").alias("status"), F.size("predictions").alias("n_runs"), "event.soho_number")


def report_fallback(spark, sf_dir):
    return ev.reports(_packages(spark, sf_dir))


QUERIES = {q.__name__: q for q in (listing_parse, link_parse, list_parse, list_failures, list_filter, obs_days, date_parse, track_id_format, config_hash, day_urls, archive_availability, provenance_times, evidence_json, evidence_compact, report_fallback)}

_LINES = """l AS (SELECT o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, o_totalprice, CASE WHEN o_orderpriority = '1-URGENT' THEN 'C3,C2' WHEN o_orderpriority = '5-LOW' THEN 'none' ELSE 'C2A' END AS camera,
  CAST(o_orderdate AS DATE) AS d1, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 3 ELSE CAST(o_orderdate AS DATE) END AS d2, '19' AS cent FROM orders),
e AS (SELECT *, CAST(o_orderkey AS INTEGER) AS soho_number, CAST(d1 + INTERVAL 100 YEAR AS DATE) AS x1 FROM l WHERE camera <> 'none')"""
_DAYS = f"""{_LINES}, r AS (SELECT *, make_date(2000 + year(d1) % 100, month(d1), day(d1)) AS obs_start,
  make_date(2000 + year(d1) % 100 + CASE WHEN month(d2) < month(d1) THEN 1 ELSE 0 END, month(d2), day(d2)) AS obs_end FROM e)"""
_ORDER_LINE = """'  ' || o_orderkey || CASE WHEN o_totalprice > 400000 THEN '*' ELSE '' END || ' x y A. Name and B. Other ' || camera || ' Kreutz ' || strftime(o_orderdate, '%b%d') || CASE WHEN o_orderstatus = 'F' THEN '-' || strftime(d2, '%b%d') ELSE '' END || ',' || strftime(o_orderdate, '%y')"""
SQL = {
    "listing_parse": """WITH p AS (SELECT page_id, lpad(CAST((page_id * 37 + 5) % 99999999 AS VARCHAR), 8, '0') AS a, lpad(CAST((page_id * 37 + 1) % 99999999 AS VARCHAR), 8, '0') AS b FROM pages)
SELECT page_id, a || '.fts' AS name FROM p UNION ALL SELECT page_id, b || '.FTS' FROM p""",
    "link_parse": """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS link FROM pages""",
    "list_parse": f"""WITH {_DAYS} SELECT o_orderkey, soho_number, o_totalprice > 400000 AS flagged, 'A. Name and B. Other' AS discoverers, camera AS cameras, 'Kreutz' AS "group", obs_start, obs_end FROM r""",
    "list_failures": f"WITH {_LINES} SELECT o_orderkey, {_ORDER_LINE} AS line FROM l WHERE camera = 'none'",
    "list_filter": f"WITH {_DAYS} SELECT soho_number, obs_start FROM r WHERE camera = 'C3,C2' AND obs_end - obs_start + 1 >= 4",
    "obs_days": f"WITH {_DAYS}, u AS (SELECT unnest(generate_series(obs_start, obs_end, INTERVAL 1 DAY)) AS t FROM r) SELECT CAST(t AS DATE) AS day, count(*) AS n FROM u GROUP BY 1",
    "date_parse": "SELECT event_id, CASE event_type WHEN 'click' THEN date_trunc('millisecond', ts) WHEN 'view' THEN date_trunc('second', ts) WHEN 'error' THEN date_trunc('day', ts)::TIMESTAMP END AS observation_time FROM events",
    "track_id_format": "SELECT o_orderkey, 'seq' || o_custkey || '_' || substr(sha256(o_orderpriority), 1, 8) || '_' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS track_id, o_custkey AS sequence_id FROM orders",
    "config_hash": """SELECT p_partkey, substr(sha256('{"max_link_px": ' || p_size || '.0, "version": "' || p_brand || '"}'), 1, 16) AS config_hash FROM part""",
    "day_urls": "SELECT DISTINCT CAST(ts AS DATE) AS day, 'https://archive.example/lasco/' || strftime(ts, '%y%m%d') || '/c3/' AS url FROM events",
    "archive_availability": """WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-23', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day), e AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT day, coalesce(n, 0) AS n_frames FROM d LEFT JOIN e USING (day)""",
    "provenance_times": "SELECT DISTINCT l_orderkey || '-' || l_linenumber AS name, CAST(l_orderkey AS VARCHAR) AS source, o_orderdate AS observation_time FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "evidence_json": f"""WITH {features._DNA}, v AS (SELECT user_id, count(*) AS n, arg_min(value, ts) AS a, max(value) AS top FROM events GROUP BY 1)
SELECT 'seq' || user_id || '_x_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS track_id, user_id AS sequence_id, CASE WHEN top > 300 THEN 'HIGH_PRIORITY' ELSE 'LOW_PRIORITY' END AS status, n AS n_frames, a AS first_x, flux_mean, 'fusion_mean_v1' AS run_id, top / 1000 AS score, CASE WHEN top > 400 THEN 4000 END::BIGINT AS soho_number, 'labels_v1' AS label_format, n AS n_points, 2 AS n_caveats FROM v JOIN dna USING (user_id)""",
    "report_fallback": f"""WITH {features._DNA}, v AS (SELECT user_id, count(*) AS n, max(value) AS top, 'seq' || user_id || '_x_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS track_id FROM events GROUP BY 1)
SELECT track_id, 'fallback' AS generated_by, array_to_string(list_filter(['## Assessment', 'Automated summary for `' || track_id || '` (status ' || CASE WHEN top > 300 THEN 'HIGH_PRIORITY' ELSE 'LOW_PRIORITY' END || ', ' || n || ' frames, LASCO/C3). LLM narration unavailable; facts below are quoted directly from the evidence package.', '', '## Key evidence',
  '- Fusion score (fusion_mean_v1): ' || format('{{:.4f}}', top / 1000), '- base: ' || format('{{:.4f}}', top / 2000), {", ".join(f"'- Motion DNA {x}: ' || format('{{:.4g}}', CASE WHEN {x} = 0 THEN 0 ELSE {x} END::DOUBLE)" for x in sorted(FEATURES))},
  CASE WHEN top > 400 THEN '- Attribution: SOHO-4000 (confirmed_positive, 2024-01-05)' ELSE '- No known-event attribution.' END, '', '## Caveats', {", ".join(f"'- {c}'" for c in ev.CAVEATS)}], lambda x: x IS NOT NULL), chr(10)) AS report FROM v JOIN dna USING (user_id)""",
    "evidence_compact": """WITH g AS (SELECT user_id, count(*) AS n, arg_min(value, ts) AS a, arg_max(value, ts) AS b, max(value) AS top FROM events GROUP BY 1)
SELECT 'seq' || user_id || '_x_' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS track_id, CAST(n AS INTEGER) AS n_points, a AS first_x, b AS last_x, CASE WHEN top > 300 THEN 'HIGH_PRIORITY' ELSE 'LOW_PRIORITY' END AS status, 2 AS n_runs, CASE WHEN top > 400 THEN 4000 END AS soho_number FROM g""",
}
