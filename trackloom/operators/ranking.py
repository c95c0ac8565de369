"""Ranking metrics over labels and scores, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rounded, sequence_of
from ..session import stored

FUSION = "fusion_mean_v1"


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(df: DataFrame, keys: list[str], label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of score >= threshold, with tp, fp, fn; 0 where undefined."""
    hit, is_one = F.col(score) >= threshold, F.col(label) == 1
    x = df.groupBy(*keys).agg(F.count_if(hit & is_one).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"), F.count_if(~hit & is_one).alias("fn"))
    x = x.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return x.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def ranked(df: DataFrame, keys: list[str], label: str, score: str, tie: str) -> DataFrame:
    """Adds ``rank`` by score, highest first, ties by ``tie``, NaN and null last; and ``hits``, positives up to there. Without keys all rows are one ranking; null keys are a group."""
    known, one = F.when(~F.isnan(score), F.col(score)), F.when(F.col(label) == 1, 1).otherwise(0)
    return ranked_together(df, known, one, tie, keys)


def ranked_together(df: DataFrame, score: Column, one: Column, tie: str, keys: list[str] = [], parts: int | None = None) -> DataFrame:  # noqa: B006
    """A ranking of each group (without keys: of all rows) without one task that sorts a whole group.

    Rows are dealt into ranges of (keys, score, tie), so a large group and equal scores part as well, and are written once
    with their place. A row's rank and hits are those among its group's rows in its range plus the sums of the group's
    ranges before. Sums are a row a range and group that meet: at most ranges plus groups, so they are broadcast by hint
    only where there are no keys.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.withColumns({"_s": score, "_one": one})
    order = [*map(F.asc, keys), F.desc_nulls_last("_s"), F.asc(tie)]
    # the id counts the rows of a partition in order below bit 33, and the partitions above
    x = stored(x.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    own = Window.partitionBy(*keys, "_b").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_b", F.shiftright("_at", 33))
    sums = x.groupBy(*keys, "_b").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.sum("_one").alias("_p"))
    sums = sums.select("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_above"), F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_hits"))
    x = x.withColumns({"_own": F.sum("_one").over(own), "_first": F.min("_at").over(own)})
    x = x.join(sums if keys else F.broadcast(sums), "_first")
    x = x.withColumns({"rank": F.col("_above") + F.col("_at") - F.col("_first") + 1, "hits": F.col("_hits") + F.col("_own")})
    return x.select(*df.columns, "rank", "hits")


def report(df: DataFrame, keys: list[str], label: str, score: str, tie: str, ks: tuple = (10, 50), threshold: float = 0.5, places: int = 6) -> DataFrame:
    """All metrics of each group in one aggregation over one ranking: AP, P@k, R@k, P/R/F1 and counts."""
    one, hit = F.col(label) == 1, F.col(score) >= threshold
    r = ranked(df, keys, label, score, tie)
    at = [F.count_if(one & (F.col("rank") <= k)).alias(f"_top{k}") for k in ks]
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(one).alias("n_pos"), F.sum(F.when(one, F.col("hits").cast("double") / F.col("rank"))).alias("_ap"), F.count_if(hit & one).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"), F.count_if(~hit & one).alias("fn"), *at)
    p, q = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    out = [F.col(k) for k in keys] + ["n_total", "n_pos", "tp", "fp", "fn"]
    out += [rounded(c, places).alias(n) for n, c in (("precision", p), ("recall", q), ("f1", share(2 * p * q, p + q)), ("average_precision", share(F.col("_ap"), F.col("n_pos"))))]
    for k in ks:
        out += [rounded(share(F.col(f"_top{k}"), F.least(F.lit(k), F.col("n_total"))), places).alias(f"precision_at_{k}"), rounded(share(F.col(f"_top{k}"), F.col("n_pos")), places).alias(f"recall_at_{k}")]
    return g.select(*out)


def fuse(predictions: DataFrame, item: str, run: str, score: str, least: int = 2) -> DataFrame:
    """Mean score of each item over its runs, as a run of its own; items of fewer than ``least`` runs have none."""
    x = predictions.groupBy(item).agg(F.avg(score).alias("score"), F.count_distinct(run).alias("n_runs"))
    return x.where(F.col("n_runs") >= least).drop("n_runs").withColumn("run_id", F.lit(FUSION))


def recovery(scored: DataFrame, positives: DataFrame, item: str, event: str, sequence: str) -> DataFrame:
    """For each event its positives' number and its best item with global and in-sequence ranks.

    scored: item, sequence, score; positives: event and item (null item: an event without any). An item without
    a score is worse than any other; ranks are by score, ties by item.
    """
    top = lambda *k: Window.partitionBy(*k).orderBy(F.desc("score"), item)
    s = scored.withColumns({"sequence_rank": F.row_number().over(top(sequence)), "sequence_pool": F.count(F.lit(1)).over(Window.partitionBy(sequence))})
    s = global_rank(s, item)
    x = positives.join(s, item, "left")
    order = F.struct(-F.coalesce("score", F.lit(float("-inf"))), F.coalesce("global_rank", F.lit(0)), F.col(item))
    best = F.min_by(F.struct(item, "score", "global_rank", "sequence_rank", "sequence_pool"), F.when(F.col(item).isNotNull(), order))
    g = x.groupBy(event).agg(F.count(item).alias("n_positive_tracks"), best.alias("b"))
    return g.select(event, (F.col("n_positive_tracks") > 0).alias("recovered"), "n_positive_tracks", F.col(f"b.{item}").alias("best_track"), F.col("b.score").alias("best_fusion"), "b.global_rank", "b.sequence_rank", "b.sequence_pool")


def global_rank(df: DataFrame, item: str) -> DataFrame:
    """Adds ``global_rank`` over all rows by score, ties by item."""
    return ranked_together(df, F.col("score"), F.lit(0), item).withColumnRenamed("rank", "global_rank").drop("hits")


def event_summary(events: DataFrame, days: DataFrame, splits: DataFrame, scored: DataFrame) -> DataFrame:
    """Recovery of each labelled event: soho_number, group, splits (``unsplit`` without any), days, and what ``recovery`` says, with the pool of all scored.

    scored: track_id, score. An event of several days counts its positives over all of them; a best track without a score has no ranks.
    """
    s = scored.select("track_id", "score", sequence_of(F.col("track_id")).alias("sequence_id"))
    of = days.join(splits.select("day", "split"), "day", "left").groupBy("ord").agg(F.count_distinct("day").alias("days"), F.array_sort(F.collect_set("split")).alias("splits"))
    facts = events.select("ord", "soho_number", "group").join(of, "ord", "left")
    none = F.coalesce(F.size("splits"), F.lit(0)) <= 0
    facts = facts.select("soho_number", "group", F.when(none, F.array(F.lit("unsplit"))).otherwise(F.col("splits")).alias("splits"), F.coalesce("days", F.lit(0)).alias("days"))
    positives = events.select("ord", "soho_number").join(days.select("ord", F.explode("positive_track_ids").alias("track_id")), "ord", "left").select("soho_number", "track_id")
    found = recovery(s, positives, "track_id", "soho_number", "sequence_id").withColumn("best_fusion", rounded(F.col("best_fusion"), 4))
    pool = scored.agg(F.count(F.lit(1)).alias("global_pool"))
    return facts.join(found, "soho_number").crossJoin(F.broadcast(pool))


def split_summary(resolved: DataFrame, scored: DataFrame) -> DataFrame:
    """Ranking quality of each split: n_positives, n_negatives, n_missing_scores, ap, p_at_10, r_at_50, r_at_250. A track without a score ranks last."""
    x = resolved.join(scored.select("track_id", "score"), "track_id", "left")
    missing = x.groupBy("split").agg(F.count_if(F.col("score").isNull()).alias("n_missing_scores"))
    r = report(x, ["split"], "label", "score", "track_id", (10, 50, 250), places=4).join(missing, "split")
    names = {"average_precision": "ap", "precision_at_10": "p_at_10", "recall_at_50": "r_at_50", "recall_at_250": "r_at_250"}
    return r.select("split", F.col("n_pos").alias("n_positives"), (F.col("n_total") - F.col("n_pos")).alias("n_negatives"), "n_missing_scores", *(F.col(a).alias(b) for a, b in names.items()))
