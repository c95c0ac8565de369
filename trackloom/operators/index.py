"""Queries of the relational index: joins with counts and scores, filters, pages, statistics, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "n") -> DataFrame:
    """Every row of ``left`` with its number of rows in ``right``; counted before the join, 0 where there are none."""
    counts = right.groupBy(F.col(right_key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return left.join(counts, F.col(left_key) == F.col("_key"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_n", "_key")


def with_score(candidates: DataFrame, predictions: DataFrame, run: Column, key: str, foreign: str, score: str) -> DataFrame:
    """Every candidate with its score in one run, null if it has none. The run is chosen on the predictions' side, before the join."""
    p = predictions.where(run).select(F.col(foreign).alias("_key"), F.col(score).alias("score"))
    return candidates.join(p, F.col(key) == F.col("_key"), "left").drop("_key")


def filtered(candidates: DataFrame, search_column: str = "track_id", q: str | None = None, **equal: object) -> DataFrame:
    """Equality filters (None: no filter) and a case-blind search; % and _ in ``q`` are wildcards, an empty ``q`` is no filter."""
    conditions = [F.col(k) == v for k, v in equal.items() if v is not None]
    if q:
        conditions.append(F.col(search_column).ilike(f"%{q}%"))
    return candidates.where(reduce(lambda a, b: a & b, conditions)) if conditions else candidates


def page(scored: DataFrame, key: str, limit: int = 50, offset: int = 0, score: str = "score") -> DataFrame:
    """A page by score, highest first and missing ones last, then by key. Limit and offset run as one bounded top-k."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be from 1 to 500, offset at least 0")
    return scored.orderBy(F.desc_nulls_last(score), F.asc(key)).offset(offset).limit(limit)


def detail(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a unique key; reading it is an error when the key is absent. Nothing runs before."""
    one = df.sparkSession.range(1).select(F.lit(1).alias("_one"))
    row = df.where(F.col(key) == value).withColumn("_there", F.lit(True))
    there = lambda c: F.when(F.col("_there"), F.col(c)).otherwise(F.raise_error(F.lit(f"{key} {value!r} not found")))
    return one.join(row, F.lit(True), "left").select(*(there(c).alias(c) for c in df.columns))


def iso(c: Column) -> Column:
    """A time as ISO-8601 text without a zone, to seconds, or to microseconds where it has a part of a second."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def api_rows(candidates: DataFrame) -> DataFrame:
    """Rows as the interface gives them: times as ISO text, all else as it is."""
    times = {f.name for f in candidates.schema if f.dataType.typeName().startswith("timestamp")}
    return candidates.select(*(iso(F.col(c)).alias(c) if c in times else F.col(c) for c in candidates.columns))


def manifest_images(entries: DataFrame, root: str) -> DataFrame:
    """Manifest entries (name, camera, status, content, any others) as image rows: local_path, instrument, ingestion_status (failed where the entry has none), checksum, size_bytes."""
    others = [c for c in entries.columns if c not in ("name", "camera", "status", "content")]
    made = {
        "local_path": F.concat_ws("/", F.lit(root), "camera", "name"),
        "instrument": F.concat(F.lit("LASCO/"), F.upper("camera")),
        "ingestion_status": F.coalesce("status", F.lit("failed")),
        "checksum": F.sha2("content", 256),
        "size_bytes": F.octet_length("content").cast("long"),
    }
    return entries.select(*others, *(v.alias(k) for k, v in made.items()))


def image_rows(images: DataFrame, sequence: Column, sequence_id: object, time: str, name: str) -> DataFrame:
    """Complete images of one sequence in order of time, then name."""
    return images.where((sequence == F.lit(sequence_id)) & F.col(time).isNotNull()).orderBy(time, name)


def log_tail(entries: DataFrame, job: str, order: list[str], most: int = 40) -> DataFrame:
    """The last entries of each job's log; each task cuts its own before they meet."""
    w = Window.partitionBy(job).orderBy(*(F.desc(c) for c in order))
    return entries.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most).drop("_nth")


def counts_by(df: DataFrame, *keys: str, known_only: bool = False) -> DataFrame:
    x = df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))) if known_only else df
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def statistics(df: DataFrame, *keys: str) -> DataFrame:
    """The total and the counts of each key's values in one pass: what, value, n."""
    sets = [F.struct(F.lit("total").alias("what"), F.lit(None).cast("string").alias("value"))]
    sets += [F.struct(F.lit(k).alias("what"), F.col(k).cast("string").alias("value")) for k in keys]
    return df.select(F.explode(F.array(*sets)).alias("x")).groupBy("x.what", "x.value").agg(F.count(F.lit(1)).alias("n"))


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent does not exist."""
    p = parents.select(F.col(parent_key).alias("_key")).distinct()
    return rows.join(p, F.col(key) == F.col("_key"), "left_anti")


def violations(df: DataFrame, unique: list[list[str]], allowed: dict[str, tuple] | None = None, required: tuple = ()) -> DataFrame:
    """What a database's constraints would refuse: rule, n (rows or key values at fault). Each rule has one row."""
    one = lambda rule, n: n.select(F.lit(rule).alias("rule"), "n")
    parts = [one("unique " + ",".join(k), df.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("n"))) for k in unique]
    rules = [("allowed " + c, F.col(c).isNotNull() & ~F.col(c).isin(*v)) for c, v in (allowed or {}).items()] + [("required " + c, F.col(c).isNull()) for c in required]
    if rules:  # all row rules in one pass
        counts = df.agg(*(F.count_if(when).alias(str(i)) for i, (_, when) in enumerate(rules)))
        parts.append(counts.select(F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(str(i)).alias("n")) for i, (rule, _) in enumerate(rules)))).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)
