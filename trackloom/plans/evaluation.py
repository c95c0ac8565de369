"""Evaluation queries: documents and labels are ranked tracks, days of events are label days, orders are scored tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import labels, ranking, similarity
from ..session import table


def _scored(spark, sf_dir):
    """Labelled documents with a deterministic score between 0 and 1."""
    score = F.pmod(F.col("doc_id") * 7919 + F.col("n_chars"), F.lit(1000)) / 1000.0
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality", "toxic", score.alias("score"))


def ranking_prf(spark, sf_dir):
    x = ranking.prf(_scored(spark, sf_dir), ["source"], "quality", "score")
    return x.select("source", "tp", "fp", "fn", *(rounded(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")))


def ranking_ap(spark, sf_dir):
    return ranking.report(_scored(spark, sf_dir), ["source"], "toxic", "score", "doc_id").select("source", "average_precision")


def ranking_at_k(spark, sf_dir):
    return ranking.report(_scored(spark, sf_dir), ["source"], "quality", "score", "doc_id", (10, 50)).select("source", "precision_at_10", "recall_at_10", "precision_at_50", "recall_at_50")


def ranking_report(spark, sf_dir):
    return ranking.report(_scored(spark, sf_dir), [], "toxic", "score", "doc_id").withColumn("run", F.lit("fusion"))


def ranking_global(spark, sf_dir):
    """Rank of every order by price, without one sorting task."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("score"))
    return ranking.global_rank(o, "o_orderkey").select("o_orderkey", F.col("global_rank").cast("long").alias("global_rank"))


def event_recovery(spark, sf_dir):
    """Nations are events, customers sequences, orders tracks; a nation's positives are its urgent finished orders."""
    c, o, n = (table(spark, sf_dir, x) for x in ("customer", "orders", "nation"))
    scored = o.select(F.col("o_orderkey").alias("track"), F.col("o_custkey").alias("sequence"), F.col("o_totalprice").alias("score"))
    urgent = o.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F' and o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("track"))
    own = c.join(urgent, "c_custkey").select(F.col("c_nationkey").alias("n_nationkey"), "track")
    positives = n.select("n_nationkey").join(own, "n_nationkey", "left")
    x = ranking.recovery(scored, positives, "track", "n_nationkey", "sequence")
    return x.select("n_nationkey", "recovered", "n_positive_tracks", "best_track", "best_fusion", F.col("global_rank").cast("long").alias("global_rank"), F.col("sequence_rank").cast("long").alias("sequence_rank"), "sequence_pool")


def recovery_totals(spark, sf_dir):
    return event_recovery(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_events"), F.count_if("recovered").alias("n_recovered"), F.count_if(F.col("sequence_rank") <= 10).alias("n_top10_in_sequence"))


def _label_days(spark, sf_dir):
    """Users are events; their days with purchases are ingested days, each with the day's sequence; large purchases are positive tracks."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    d = e.where("event_type = 'purchase'").groupBy(F.col("user_id").cast("int").alias("soho_number"), "day").agg(F.collect_list(F.when(F.col("value") > 120, F.format_string("seq%d_x_%05d", F.dayofmonth("ts"), "event_id"))).alias("positive_track_ids"))
    d = d.withColumn("sequence_id", F.dayofmonth(F.col("day").cast("date")).cast("long"))
    return d.withColumns({"ord": F.col("soho_number"), "day_ord": F.dayofmonth(F.col("day").cast("date")), "group": F.lit("Kreutz"), "source_line": F.lit(""), "notes": F.lit("")})


def _splits(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d")).distinct()
    split = F.when(F.dayofmonth("d") <= 15, "train").when(F.dayofmonth("d") <= 22, "val").otherwise("test")
    return d.select(split.alias("split"), F.col("d").cast("string").alias("day"))


def _tracks(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.dayofmonth("ts").cast("long").alias("sequence_id"), F.format_string("seq%d_x_%05d", F.dayofmonth("ts"), "event_id").alias("track_id"))


def _negatives(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error' and value < 1")
    return e.select(F.to_date("ts").cast("string").alias("day"), F.lit("C3").alias("camera"), F.dayofmonth("ts").cast("long").alias("sequence_id"), F.array(F.lit("list")).alias("verified_against")).distinct()


def split_resolve(spark, sf_dir):
    return labels.resolve(_label_days(spark, sf_dir), _negatives(spark, sf_dir), _splits(spark, sf_dir), _tracks(spark, sf_dir))


def _events(spark, sf_dir):
    return _label_days(spark, sf_dir).select("ord", "soho_number", "group").distinct()


def _track_scores(spark, sf_dir):
    """Scores of all tracks but each tenth."""
    x = table(spark, sf_dir, "events").where("event_id % 10 != 0")
    return x.select(F.format_string("seq%d_x_%05d", F.dayofmonth("ts"), "event_id").alias("track_id"), (F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 1000.0).alias("score"))


def validation_events(spark, sf_dir):
    """Recovery of every labelled event."""
    x = ranking.event_summary(_events(spark, sf_dir), _label_days(spark, sf_dir), _splits(spark, sf_dir), _track_scores(spark, sf_dir))
    longs = ("days", "global_rank", "sequence_rank", "sequence_pool", "global_pool")
    return x.select("soho_number", "group", F.array_join("splits", "/").alias("splits"), "recovered", "n_positive_tracks", "best_track", "best_fusion", *(F.col(c).cast("long").alias(c) for c in longs))


def validation_splits(spark, sf_dir):
    """Ranking quality of every split, tracks without a score last."""
    return ranking.split_summary(split_resolve(spark, sf_dir), _track_scores(spark, sf_dir))


def split_leakage(spark, sf_dir):
    d = labels.data_days(_label_days(spark, sf_dir), _negatives(spark, sf_dir))
    out = None
    for problem, x in labels.split_problems(d, _splits(spark, sf_dir)).items():
        x = x.select(F.lit(problem).alias("problem"), "day", "detail")
        out = x if out is None else out.unionByName(x)
    return out


def negative_overlap(spark, sf_dir):
    """Negative days on which their camera saw an event: users of odd numbers are seen by C3, the others by C2."""
    seen = _label_days(spark, sf_dir).select("day", F.array(F.when(F.col("soho_number") % 2 == 1, "c3a").otherwise("C2")).alias("cameras"))
    return labels.overlapping(_negatives(spark, sf_dir), seen).select("day", "camera")


def label_status(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    x = labels.candidate_labels(d, l.where("toxic = 1").select("doc_id"), d.join(l.where("quality = 0"), "doc_id").select("source").where("source > 'src5'"), "doc_id", "source")
    return x.select("doc_id", "label", "status")


def event_attribution(spark, sf_dir):
    x = labels.attributed(_tracks(spark, sf_dir), _label_days(spark, sf_dir))
    return x.select("track_id", "sequence_id", F.col("event.soho_number").alias("soho_number"), F.col("event.relation").alias("relation"), F.col("event.day").alias("day"))


def knn_zscore(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return similarity.nearest(v, "vec_id", 7)


def knn_features(spark, sf_dir):
    """Dynamic keys: users as maps from event type to their mean value."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("features"))
    return similarity.nearest(similarity.vector_of_map(e, "user_id", "features"), "user_id", 5, 10)


QUERIES = {f.__name__: f for f in (ranking_prf, ranking_ap, ranking_at_k, ranking_report, ranking_global, event_recovery, recovery_totals, validation_events, validation_splits, split_resolve, split_leakage, negative_overlap, label_status, event_attribution, knn_zscore, knn_features)}

R = lambda c, n: f"round_even(({c}) * 1e{n}, 0) / 1e{n}"
_S = "s AS (SELECT doc_id, source, quality, toxic, ((doc_id * 7919 + n_chars) % 1000) / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"


def _report(label: str, key: str) -> str:
    return f"""r AS (SELECT *, row_number() OVER w AS rk, sum(({label} = 1)::INT) OVER (PARTITION BY {key} ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS hits FROM s WINDOW w AS (PARTITION BY {key} ORDER BY score DESC, doc_id)),
g AS (SELECT {key}, count(*) AS n_total, count(*) FILTER (WHERE {label} = 1) AS n_pos, count(*) FILTER (WHERE {label} = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE {label} = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE {label} = 1 AND score < 0.5) AS fn,
  sum(hits / rk::DOUBLE) FILTER (WHERE {label} = 1) AS ap, count(*) FILTER (WHERE {label} = 1 AND rk <= 10) AS t10, count(*) FILTER (WHERE {label} = 1 AND rk <= 50) AS t50 FROM r GROUP BY 1),
q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS rc FROM g)"""


_COLS = f"""{R("p", 6)} AS precision, {R("rc", 6)} AS recall, {R("coalesce(2 * p * rc / nullif(p + rc, 0), 0)", 6)} AS f1"""
_AP = f"""{R("coalesce(ap / nullif(n_pos, 0), 0)", 6)} AS average_precision"""
_AT = ", ".join(f"{R(f'coalesce(t{k} / nullif(least({k}, n_total), 0)::DOUBLE, 0)', 6)} AS precision_at_{k}, {R(f'coalesce(t{k} / nullif(n_pos, 0)::DOUBLE, 0)', 6)} AS recall_at_{k}" for k in (10, 50))
_REC = """o AS (SELECT o_orderkey AS track, o_custkey AS seq, o_totalprice AS score, o_orderpriority, o_orderstatus FROM orders),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, track) AS global_rank, row_number() OVER (PARTITION BY seq ORDER BY score DESC, track) AS sequence_rank, count(*) OVER (PARTITION BY seq) AS sequence_pool FROM o),
u AS (SELECT c_nationkey, k.* FROM k JOIN customer ON c_custkey = seq WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND score > 490000),
best AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS np, row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, global_rank) AS nth FROM u),
e AS (SELECT n_nationkey, np IS NOT NULL AS recovered, coalesce(np, 0) AS n_positive_tracks, track AS best_track, score AS best_fusion, global_rank, sequence_rank, sequence_pool FROM nation LEFT JOIN best ON n_nationkey = c_nationkey AND nth = 1)"""
_LAB = """ev AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, day(ts) AS dm, 'seq' || day(ts) || '_x_' || lpad(CAST(event_id AS VARCHAR), 5, '0') AS track_id FROM events),
pos AS (SELECT user_id, day, dm, track_id FROM ev WHERE event_type = 'purchase' AND value > 120),
days AS (SELECT user_id, day, dm, count(*) FILTER (WHERE value > 120) AS npos FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2, 3),
neg AS (SELECT DISTINCT day, dm FROM ev WHERE event_type = 'error' AND value < 1),
spl AS (SELECT DISTINCT day, CASE WHEN dm <= 15 THEN 'train' WHEN dm <= 22 THEN 'val' ELSE 'test' END AS split FROM ev)"""
# with track ids as ``format_string`` makes them: at least five digits, none cut off
_IDS = _LAB.replace("lpad(CAST(event_id AS VARCHAR), 5, '0')", "printf('%05d', event_id)")
_RESOLVED = """ds AS (SELECT * FROM days JOIN spl USING (day)), exc AS (SELECT DISTINCT split, dm FROM ds WHERE npos = 0), p AS (SELECT split, track_id FROM pos JOIN spl USING (day)),
used AS (SELECT split, dm FROM ds UNION SELECT split, dm FROM neg JOIN spl USING (day)),
n AS (SELECT u.split, ev.track_id FROM used u JOIN ev ON ev.dm = u.dm WHERE NOT EXISTS (SELECT 1 FROM exc WHERE exc.split = u.split AND exc.dm = u.dm) AND NOT EXISTS (SELECT 1 FROM p WHERE p.split = u.split AND p.track_id = ev.track_id))"""
_SCORES = "SELECT track_id, dm, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS score FROM ev WHERE event_id % 10 <> 0"
SQL = {
    "ranking_prf": f"WITH {_S}, {_report('quality', 'source')} SELECT source, tp, fp, fn, {_COLS} FROM q",
    "ranking_ap": f"WITH {_S}, {_report('toxic', 'source')} SELECT source, {_AP} FROM q",
    "ranking_at_k": f"WITH {_S}, {_report('quality', 'source')} SELECT source, {_AT} FROM q",
    "ranking_report": f"WITH s1 AS (SELECT *, 'fusion' AS run FROM (WITH {_S} SELECT * FROM s)), {_report('toxic', 'run').replace('FROM s WINDOW', 'FROM s1 WINDOW')} SELECT run, n_total, n_pos, tp, fp, fn, {_COLS}, {_AP}, {_AT} FROM q",
    "ranking_global": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS global_rank FROM orders",
    "event_recovery": f"WITH {_REC} SELECT * FROM e",
    "recovery_totals": f"WITH {_REC} SELECT count(*) AS n_events, count(*) FILTER (WHERE recovered) AS n_recovered, count(*) FILTER (WHERE sequence_rank <= 10) AS n_top10_in_sequence FROM e",
    "split_resolve": f"""WITH {_IDS}, {_RESOLVED}
SELECT split, track_id, 1 AS label FROM p UNION ALL SELECT split, track_id, 0 FROM n""",
    "validation_events": f"""WITH {_IDS}, sc AS ({_SCORES}), rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, track_id) AS g, row_number() OVER (PARTITION BY dm ORDER BY score DESC, track_id) AS sr, count(*) OVER (PARTITION BY dm) AS sp FROM sc),
x AS (SELECT user_id, track_id, score, g, sr, sp, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(score, '-infinity'::DOUBLE) DESC, coalesce(g, 0), track_id) AS nth, count(*) OVER (PARTITION BY user_id) AS np FROM pos LEFT JOIN rk USING (track_id)),
d AS (SELECT user_id, count(*) AS days, string_agg(DISTINCT split, '/' ORDER BY split) AS splits FROM days LEFT JOIN spl USING (day) GROUP BY 1)
SELECT CAST(d.user_id AS INTEGER) AS soho_number, 'Kreutz' AS "group", coalesce(splits, 'unsplit') AS splits, days, np IS NOT NULL AS recovered, coalesce(np, 0) AS n_positive_tracks, track_id AS best_track, {R("score", 4)} AS best_fusion, g AS global_rank, sr AS sequence_rank, sp AS sequence_pool, (SELECT count(*) FROM sc) AS global_pool
FROM d LEFT JOIN x ON x.user_id = d.user_id AND nth = 1""",
    "validation_splits": f"""WITH {_IDS}, sc AS ({_SCORES}), {_RESOLVED}, u2 AS (SELECT split, track_id, 1 AS label FROM p UNION ALL SELECT split, track_id, 0 FROM n), r AS (SELECT split, label, score, row_number() OVER w AS k, sum(label) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM u2 LEFT JOIN sc USING (track_id) WINDOW w AS (PARTITION BY split ORDER BY score DESC NULLS LAST, track_id)),
q AS (SELECT split, sum(label) AS np, count(*) AS nt, count(*) FILTER (WHERE score IS NULL) AS miss, sum(hits / k::DOUBLE) FILTER (WHERE label = 1) AS ap, count(*) FILTER (WHERE label = 1 AND k <= 10) AS t10, count(*) FILTER (WHERE label = 1 AND k <= 50) AS t50, count(*) FILTER (WHERE label = 1 AND k <= 250) AS t250 FROM r GROUP BY 1)
SELECT split, np::BIGINT AS n_positives, (nt - np)::BIGINT AS n_negatives, miss AS n_missing_scores, {R("coalesce(ap / nullif(np, 0), 0)", 4)} AS ap, {R("t10 / least(10, nt)::DOUBLE", 4)} AS p_at_10, {R("coalesce(t50 / nullif(np, 0)::DOUBLE, 0)", 4)} AS r_at_50, {R("coalesce(t250 / nullif(np, 0)::DOUBLE, 0)", 4)} AS r_at_250 FROM q""",
    "split_leakage": f"""WITH {_LAB}, dd AS (SELECT day FROM days UNION SELECT day FROM neg)
SELECT 'split day without data' AS problem, day, split AS detail FROM spl WHERE day NOT IN (SELECT day FROM dd)
UNION ALL SELECT 'day without split', day, '' FROM dd WHERE day NOT IN (SELECT day FROM spl)
UNION ALL SELECT 'neighbouring days in different splits', a.day, a.split || '/' || b.split FROM spl a JOIN spl b ON CAST(b.day AS DATE) = CAST(a.day AS DATE) + 1 WHERE a.split <> b.split""",
    "negative_overlap": f"WITH {_LAB} SELECT day, 'C3' AS camera FROM neg WHERE day IN (SELECT day FROM days WHERE user_id % 2 = 1)",
    "label_status": """WITH x AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND source > 'src5')
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'comet' WHEN d.source IN (SELECT source FROM x) THEN 'excluded' END AS label, CASE WHEN l.toxic = 1 THEN 'KNOWN_COMET' ELSE 'UNRESOLVED' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "event_attribution": f"""WITH {_IDS}, f AS (SELECT dm, user_id, day, row_number() OVER (PARTITION BY dm ORDER BY user_id, day) AS nth FROM days WHERE npos = 0)
SELECT ev.track_id, ev.dm AS sequence_id, CAST(coalesce(pos.user_id, f.user_id) AS INTEGER) AS soho_number, CASE WHEN pos.user_id IS NOT NULL THEN 'confirmed_positive' WHEN f.user_id IS NOT NULL THEN 'unrecovered_event_day' END AS relation, coalesce(pos.day, f.day) AS day
FROM ev LEFT JOIN pos USING (track_id) LEFT JOIN f ON f.dm = ev.dm AND nth = 1""",
    "knn_zscore": f"""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM v GROUP BY 1),
z AS (SELECT vec_id, i, (x - m) / s AS z FROM v JOIN m USING (i)), d AS (SELECT a.vec_id, sqrt(sum(pow(a.z - b.z, 2))) AS d FROM z a JOIN z b ON a.i = b.i AND b.vec_id = 7 AND a.vec_id <> 7 GROUP BY 1)
SELECT vec_id, {R("d", 4)} AS distance FROM d ORDER BY d, vec_id LIMIT 20""",
    "knn_features": f"""WITH a AS (SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY ALL), k AS (SELECT DISTINCT event_type FROM a), u AS (SELECT DISTINCT user_id FROM a),
v AS (SELECT u.user_id, k.event_type AS i, coalesce(x, 0) AS x FROM u CROSS JOIN k LEFT JOIN a ON a.user_id = u.user_id AND a.event_type = k.event_type), m AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM v GROUP BY 1),
z AS (SELECT user_id, i, (x - m) / s AS z FROM v JOIN m USING (i)), d AS (SELECT a.user_id, sqrt(sum(pow(a.z - b.z, 2))) AS d FROM z a JOIN z b ON a.i = b.i AND b.user_id = 5 AND a.user_id <> 5 GROUP BY 1)
SELECT user_id, {R("d", 4)} AS distance FROM d ORDER BY d, user_id LIMIT 10""",
}
