"""Upserts on plain tables: Parquet has no MERGE, so old and new rows are joined and the result rewritten."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every key with its ``change``: created, updated, unchanged or kept (old alone), and the values to store."""
    o = old.select(F.col(key).alias("_old_key"), *(F.col(c).alias(f"_old_{c}") for c in columns))
    n = new.select(F.col(key).alias("_new_key"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    x = o.join(n, F.col("_old_key") == F.col("_new_key"), "full")
    same = reduce(lambda a, b: a & b, (F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")) for c in columns))
    change = F.when(F.col("_old_key").isNull(), "created").when(F.col("_new_key").isNull(), "kept").when(same, "unchanged").otherwise("updated")
    stored = lambda c: F.when(F.col("_new_key").isNull(), F.col(f"_old_{c}")).otherwise(F.col(f"_new_{c}")).alias(c)
    return x.select(F.coalesce("_new_key", "_old_key").alias(key), change.alias("change"), *map(stored, columns))


def latest(versions: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key of an append log; of several with the same version, the one with the largest hash of all its columns, the same in every run."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc(F.xxhash64(*(c for c, kind in versions.dtypes if "map<" not in kind))))
    return versions.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def upsert_predictions(old: DataFrame, new: DataFrame, created: Column) -> DataFrame:
    """(candidate_id, run_id) decides; of a known pair id and created_at survive and the rest is replaced."""
    keys = ["candidate_id", "run_id"]
    n = new.select(*keys, F.col("model_version").alias("_version"), F.col("score").alias("_score"))
    x = old.join(n, keys, "full")
    fresh = F.col("_score").isNotNull()
    return x.select("id", *keys, F.when(fresh, F.col("_version")).otherwise(F.col("model_version")).alias("model_version"), F.when(fresh, F.col("_score")).otherwise(F.col("score")).alias("score"), F.coalesce("created_at", created).alias("created_at"))


def upsert_candidates(old: DataFrame, new: DataFrame, replaced: list[str], kept: list[str], key: str = "track_id") -> DataFrame:
    """Old and new candidates by key: ``replaced`` columns come from the new row where there is one, label and status among them; ``kept`` (a reviewer's) stay."""
    n = new.select(F.col(key).alias("_key"), F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in replaced))
    x = old.join(n, F.col(key) == F.col("_key"), "full")
    pick = [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in replaced]
    return x.select(F.coalesce("_key", key).alias(key), *pick, *kept)


def missing_dimensions(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct wanted rows that are not known yet."""
    return wanted.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")


def bands(candidates: DataFrame, key: str, score: str, label: str, status: str, high: int = 50, medium: int = 250) -> DataFrame:
    """Priority by rank over all unlabelled, scored candidates: the first ``high`` HIGH, up to ``medium`` MEDIUM, the rest LOW; others keep their status.

    Only the top ``medium`` rows, a fixed number, are ever ranked together: they come from a bounded top-k.
    """
    own = lambda c: F.col(f"_all.`{c}`")
    candidates, open_ = candidates.alias("_all"), own(label).isNull() & own(score).isNotNull()
    top = candidates.where(open_).select(F.col(key).alias("key"), F.col(score).alias("score")).orderBy(F.desc("score"), "key").limit(medium)
    top = top.select("key", F.row_number().over(Window.orderBy(F.desc("score"), "key")).alias("rank")).alias("_top")
    place = F.col("_top.rank")
    band = F.when(~open_, own(status)).when(place <= high, "HIGH_PRIORITY").when(place.isNotNull(), "MEDIUM_PRIORITY").otherwise("LOW_PRIORITY")
    x = candidates.join(F.broadcast(top), own(key) == F.col("_top.key"), "left")
    return x.select(*(band.alias(c) if c == status else own(c) for c in candidates.columns))


def reviewed(log: DataFrame, key: str, version: str) -> DataFrame:
    """State after a log of partial updates (review, notes, sets: the names of the fields set).

    A field keeps its last set value, a null that was set clears it, and ``reviewed_at`` is the last update's
    time if a verdict or notes are left then, else null.
    """
    last = lambda c: F.max_by(c, F.when(F.array_contains("sets", c), F.col(version)))
    x = log.groupBy(key).agg(last("review").alias("review"), last("notes").alias("reviewer_notes"), F.max(version).alias("_at"))
    some = (F.coalesce("review", F.lit("")) != "") | (F.coalesce("reviewer_notes", F.lit("")) != "")
    return x.select(key, "review", "reviewer_notes", F.when(some, F.col("_at")).alias("reviewed_at"))


def check_review(review: str | None, notes: str | None, sets: list[str]) -> None:
    """Refuses an update that sets nothing, an unknown verdict, or notes of over 10,000 characters."""
    from ..schemas import REVIEW_VERDICTS

    if not sets:
        raise ValueError("nothing to update")
    if review is not None and review not in REVIEW_VERDICTS:
        raise ValueError(f"unknown verdict {review!r}")
    if notes is not None and len(notes) > 10_000:
        raise ValueError("notes are too long")
