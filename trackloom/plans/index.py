"""Queries of the relational index: customers and orders stand for sequences, candidates and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import index as i
from ..operators import ranking, sequencing, upserts
from ..session import new_path, table
from ..sinks.merged import merge, read_merged


def seq_counts_left(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return i.with_counts(c.select("c_custkey", "c_name"), o, "c_custkey", "o_custkey", "n_orders")


def _scored(spark, sf_dir):
    """Customers with their largest order of one status: candidates with their score in one run."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("price"))
    return i.with_score(table(spark, sf_dir, "customer"), o, F.col("o_orderstatus") == "P", "c_custkey", "o_custkey", "price")


def cand_rank_page(spark, sf_dir):
    return i.page(_scored(spark, sf_dir), "c_custkey", 50, 20).select("c_custkey", "c_name", "score")


def cand_rank_last_page(spark, sf_dir):
    """Unscored candidates come last, by id."""
    x = i.with_score(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("price")).where("price > 400000"), F.lit(True), "c_custkey", "o_custkey", "price")
    return i.page(x, "c_custkey", 100, 60).select("c_custkey", "score")


def cand_filter_ilike(spark, sf_dir):
    return i.filtered(table(spark, sf_dir, "part"), "p_name", "R%d", p_type="ECONOMY", p_size=None).select("p_partkey", "p_name", "p_type")


def cand_total(spark, sf_dir):
    return i.filtered(table(spark, sf_dir, "part"), "p_name", "widget").agg(F.count(F.lit(1)).alias("total"))


def cand_detail(spark, sf_dir):
    return i.detail(table(spark, sf_dir, "part"), "p_partkey", 7)


def cand_in_list(spark, sf_dir):
    """IN-list as a semi-join: customers with an urgent order."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


def cand_day_filter(spark, sf_dir):
    """Events of one day and instrument."""
    day, after = (F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp_ntz") for d in (5, 6))  # a range on the column itself, which files can be skipped by
    return table(spark, sf_dir, "events").where((F.col("ts") >= day) & (F.col("ts") < after) & (F.col("event_type") == "click")).select("event_id", "ts")


def cand_inner_scores(spark, sf_dir):
    """Scores of the unlabelled: inner join with a filter on both sides."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return c.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_custkey").select("o_orderkey", "c_name", "o_totalprice")


def stats_status(spark, sf_dir):
    return i.counts_by(table(spark, sf_dir, "orders"), "o_orderstatus")


def stats_label(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("label", F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")))
    return i.counts_by(o, "label", known_only=True)


def stats_run(spark, sf_dir):
    return i.counts_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").orderBy("l_returnflag", "l_linestatus")


def stats_global(spark, sf_dir):
    return i.statistics(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


def orphan_check(spark, sf_dir):
    """Line items whose order is not among the finished ones."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return i.orphans(table(spark, sf_dir, "lineitem"), done, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


def constraint_check(spark, sf_dir):
    return i.violations(table(spark, sf_dir, "orders"), [["o_orderkey"], ["o_custkey", "o_orderdate"]], {"o_orderstatus": ("F", "O"), "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM")}, ("o_custkey",))


def _old_and_new(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderstatus != 'F'").withColumn("o_totalprice", F.when(F.col("o_totalprice") > 250000, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return o.where("o_orderstatus != 'O'"), new


def upsert_classify(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    return upserts.classify(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


def upsert_counts(spark, sf_dir):
    return upsert_classify(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def upsert_merged(spark, sf_dir):
    """The merge written back: the old rows as a table, the new ones merged into it, read again with each key's partition untouched or written anew."""
    old, new = _old_and_new(spark, sf_dir)
    path, columns = new_path(spark, "merged"), ["o_orderstatus", "o_totalprice"]
    merge(path, old, "o_orderkey", columns, 16)
    merge(path, new, "o_orderkey", columns)
    return read_merged(spark, path, new.select("o_orderkey", *columns).schema)


def upsert_latest(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    log = old.withColumn("version", F.lit(1)).unionByName(new.withColumn("version", F.lit(2)))
    return upserts.latest(log, ["o_orderkey"], "version")


def upsert_predictions(spark, sf_dir):
    """A second scoring run over an earlier one: ids and creation times survive."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("candidate_id"), F.col("l_returnflag").alias("run_id"))
    a = li.agg(F.max("l_quantity").alias("score"), F.min("l_orderkey").alias("id"), F.min("l_shipdate").alias("created_at"))
    old = a.where("run_id != 'R'").withColumn("model_version", F.lit("v1"))
    new = a.where("run_id != 'A'").select("candidate_id", "run_id", (F.col("score") + 1).alias("score"), F.lit("v2").alias("model_version"))
    return upserts.upsert_predictions(old, new, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def upsert_candidates(spark, sf_dir):
    """Labels and status are replaced, a reviewer's columns stay."""
    o = table(spark, sf_dir, "orders").withColumn("track_id", F.format_string("t%07d", "o_orderkey"))
    old = o.where("o_orderstatus != 'O'").select("track_id", F.col("o_totalprice").alias("score"), F.lit("LOW_PRIORITY").alias("status"), F.col("o_orderpriority").alias("review"))
    new = o.where("o_orderstatus != 'F'").select("track_id", (F.col("o_totalprice") * 2).alias("score"), F.lit("UNRESOLVED").alias("status"))
    return upserts.upsert_candidates(old, new, ["score", "status"], ["review"])


def dimension_create(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return upserts.missing_dimensions(o, o.where("o_totalprice > 499000"), ["o_orderstatus", "o_orderpriority"])


def review_log(spark, sf_dir):
    """Events as a log of partial updates: errors set notes, views clear the verdict, others set a verdict."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    log = e.select("user_id", "ts", F.when(kind == "view", F.lit(None).cast("string")).otherwise(kind).alias("review"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("notes"), F.when(kind == "error", F.array(F.lit("notes"))).otherwise(F.array(F.lit("review"))).alias("sets"))
    return upserts.reviewed(log, "user_id", "ts")


def status_bands(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "P", "comet").alias("label"), F.lit("UNRESOLVED").alias("status"))
    return upserts.bands(o, "o_orderkey", "o_totalprice", "label", "status").select("o_orderkey", "label", "status")


def fusion_mean(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.max("l_discount").alias("score"))
    x = ranking.fuse(runs, "l_partkey", "l_returnflag", "score")
    return x.withColumn("score", rounded(F.col("score"), 6))


def image_rows(spark, sf_dir):
    """Manifest entries to image rows: derived path, upper-cased instrument, a default status."""
    camera = F.regexp_extract("url", r"/(\w\w)/", 1)
    status = F.when(F.col("url").startswith("https"), "complete")
    p = table(spark, sf_dir, "pages").select("page_id", F.format_string("%08d.fts", "page_id").alias("name"), camera.alias("camera"), status.alias("status"), F.col("html").cast("binary").alias("content"))
    return i.manifest_images(p, "raw").select("page_id", "local_path", "instrument", "ingestion_status", "checksum", "size_bytes")


def sequence_images(spark, sf_dir):
    """Complete images of one sequence in order: a user's events."""
    e = table(spark, sf_dir, "events")
    return i.image_rows(e, F.col("user_id"), 5, "ts", "event_id").select("event_id", "ts")


def cand_iso(spark, sf_dir):
    """Rows as the interface gives them, times as ISO text."""
    return i.api_rows(table(spark, sf_dir, "events").select("event_id", "ts", F.date_trunc("second", "ts").alias("second")))


def log_tail(spark, sf_dir):
    """The last forty entries of each log."""
    return i.log_tail(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_type", ["ts", "event_id"])


def ungrouped_counts(spark, sf_dir):
    """Images that await a sequence, and those skipped."""
    o = table(spark, sf_dir, "orders")
    x = o.select(F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")).alias("sequence_id"), F.when(F.col("o_orderpriority") != "5-LOW", "complete").otherwise("failed").alias("ingestion_status"), F.when(F.col("o_totalprice") < 400000, F.col("o_orderdate")).alias("observation_time"))
    return sequencing.grouping_counts(x)


QUERIES = {f.__name__: f for f in (seq_counts_left, cand_rank_page, cand_rank_last_page, cand_filter_ilike, cand_total, cand_detail, cand_in_list, cand_day_filter, cand_inner_scores, stats_status, stats_label, stats_run, stats_global, orphan_check, constraint_check, upsert_classify, upsert_counts, upsert_merged, upsert_latest, upsert_predictions, upsert_candidates, dimension_create, review_log, status_bands, fusion_mean, image_rows, sequence_images, cand_iso, log_tail, ungrouped_counts)}
_UP = """o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders), old AS (SELECT * FROM o WHERE o_orderstatus <> 'O'),
new AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 250000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM o WHERE o_orderstatus <> 'F')"""
_CLASSIFY = f"""WITH {_UP}, c AS (SELECT coalesce(n.o_orderkey, old.o_orderkey) AS o_orderkey,
  CASE WHEN old.o_orderkey IS NULL THEN 'created' WHEN n.o_orderkey IS NULL THEN 'kept' WHEN old.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus AND old.o_totalprice IS NOT DISTINCT FROM n.o_totalprice THEN 'unchanged' ELSE 'updated' END AS change,
  CASE WHEN n.o_orderkey IS NULL THEN old.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus, CASE WHEN n.o_orderkey IS NULL THEN old.o_totalprice ELSE n.o_totalprice END AS o_totalprice
  FROM old FULL JOIN new n ON old.o_orderkey = n.o_orderkey)"""
SQL = {
    "seq_counts_left": "SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "cand_rank_page": "SELECT c_custkey, c_name, score FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS score FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey ORDER BY score DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 20",
    "cand_rank_last_page": "SELECT c_custkey, score FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS score FROM orders GROUP BY 1 HAVING max(o_totalprice) > 400000) ON c_custkey = o_custkey ORDER BY score DESC NULLS LAST, c_custkey LIMIT 100 OFFSET 60",
    "cand_filter_ilike": "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%R%d%' AND p_type = 'ECONOMY'",
    "cand_total": "SELECT count(*) AS total FROM part WHERE p_name ILIKE '%widget%'",
    "cand_detail": "SELECT * FROM part WHERE p_partkey = 7",
    "cand_in_list": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "cand_day_filter": "SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05' AND event_type = 'click'",
    "cand_inner_scores": "SELECT o_orderkey, c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' AND o_orderstatus = 'F'",
    "stats_status": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "stats_label": "SELECT o_orderpriority AS label, count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1",
    "stats_run": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "stats_global": "SELECT 'total' AS what, NULL::VARCHAR AS value, count(*) AS n FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2",
    "orphan_check": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "constraint_check": """SELECT 'unique o_orderkey' AS rule, count(*) AS n FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'unique o_custkey,o_orderdate', count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)
UNION ALL SELECT 'allowed o_orderstatus', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'allowed o_orderpriority', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
UNION ALL SELECT 'required o_custkey', count(*) FROM orders WHERE o_custkey IS NULL""",
    "upsert_classify": f"{_CLASSIFY} SELECT * FROM c",
    "upsert_counts": f"{_CLASSIFY} SELECT change, count(*) AS n FROM c GROUP BY 1",
    "upsert_merged": f"{_CLASSIFY} SELECT o_orderkey, o_orderstatus, o_totalprice FROM c",
    "upsert_latest": f"WITH {_UP}, v AS (SELECT *, 1 AS version FROM old UNION ALL SELECT *, 2 FROM new) SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) = 1",
    "upsert_predictions": """WITH a AS (SELECT l_partkey AS candidate_id, l_returnflag AS run_id, max(l_quantity) AS score, min(l_orderkey) AS id, min(l_shipdate) AS created_at FROM lineitem GROUP BY 1, 2),
o AS (SELECT * FROM a WHERE run_id <> 'R'), n AS (SELECT candidate_id, run_id, score + 1 AS score FROM a WHERE run_id <> 'A')
SELECT o.id, coalesce(o.candidate_id, n.candidate_id) AS candidate_id, coalesce(o.run_id, n.run_id) AS run_id, CASE WHEN n.score IS NOT NULL THEN 'v2' ELSE 'v1' END AS model_version, coalesce(n.score, o.score) AS score, coalesce(o.created_at, TIMESTAMP '2024-01-01 00:00:00') AS created_at
FROM o FULL JOIN n ON o.candidate_id = n.candidate_id AND o.run_id = n.run_id""",
    "upsert_candidates": """WITH o AS (SELECT *, 't' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS track_id FROM orders)
SELECT track_id, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS score, CASE WHEN o_orderstatus <> 'F' THEN 'UNRESOLVED' ELSE 'LOW_PRIORITY' END AS status, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS review FROM o""",
    "dimension_create": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders EXCEPT SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 499000",
    "review_log": """WITH l AS (SELECT user_id, ts, CASE WHEN event_type <> 'view' THEN event_type END AS review, 'note ' || event_id AS notes, event_type = 'error' AS sets_notes FROM events),
a AS (SELECT user_id, max(ts) AS last_ts FROM l GROUP BY 1), r AS (SELECT user_id, review FROM l WHERE NOT sets_notes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1),
n AS (SELECT user_id, notes FROM l WHERE sets_notes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1)
SELECT user_id, review, notes AS reviewer_notes, CASE WHEN review IS NOT NULL OR notes IS NOT NULL THEN last_ts END AS reviewed_at FROM a LEFT JOIN r USING (user_id) LEFT JOIN n USING (user_id)""",
    "status_bands": """WITH o AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'comet' END AS label FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM o WHERE label IS NULL)
SELECT o_orderkey, label, CASE WHEN label IS NOT NULL THEN 'UNRESOLVED' WHEN rk <= 50 THEN 'HIGH_PRIORITY' WHEN rk <= 250 THEN 'MEDIUM_PRIORITY' ELSE 'LOW_PRIORITY' END AS status FROM o LEFT JOIN r USING (o_orderkey)""",
    "fusion_mean": "WITH r AS (SELECT l_partkey, l_returnflag, max(l_discount) AS score FROM lineitem GROUP BY 1, 2) SELECT l_partkey, round_even(avg(score) * 1e6, 0) / 1e6 AS score, 'fusion_mean_v1' AS run_id FROM r GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 2",
    "sequence_images": "SELECT event_id, ts FROM events WHERE user_id = 5",
    "cand_iso": "SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS second FROM events",
    "log_tail": "SELECT event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 40",
    "ungrouped_counts": "SELECT count(*) FILTER (WHERE w) AS waiting, count(*) FILTER (WHERE NOT w) AS skipped FROM (SELECT o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND o_totalprice < 400000 AS w FROM orders)",
    "image_rows": r"""SELECT page_id, concat_ws('/', 'raw', regexp_extract(url, '/(\w\w)/', 1), lpad(CAST(page_id AS VARCHAR), 8, '0') || '.fts') AS local_path, 'LASCO/' || upper(regexp_extract(url, '/(\w\w)/', 1)) AS instrument,
CASE WHEN starts_with(url, 'https') THEN 'complete' ELSE 'failed' END AS ingestion_status, sha256(html) AS checksum, strlen(html)::BIGINT AS size_bytes FROM pages""",
}
