"""Nearest rows by z-scored distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rounded


def vector_of(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """key, v: the features as an array, nulls as 0."""
    return df.select(key, F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)).alias("v"))


def vector_of_map(df: DataFrame, key: str, features: str) -> DataFrame:
    """key, v from a map column, over the sorted union of all rows' keys; a missing or null value is 0."""
    names = df.select(F.explode(F.map_keys(features)).alias("k")).agg(F.array_sort(F.collect_set("k")).alias("names"))
    x = df.where(F.col(features).isNotNull()).crossJoin(F.broadcast(names))
    return x.select(key, F.transform("names", lambda k: F.coalesce(F.element_at(F.col(features), k).cast("double"), F.lit(0.0))).alias("v"))


def moments(vectors: DataFrame, key: str) -> DataFrame:
    """One row: arrays ``mean`` and ``std`` (population; 0 becomes 1) by position. Sums are combined before the shuffle."""
    p = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    p = p.agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s")))).alias("a"))
    return p.select(F.col("a.m").alias("mean"), F.col("a.s").alias("std"))


def standardised(vectors: DataFrame, key: str) -> DataFrame:
    """key, z. The moments are one row, bounded by the number of features."""
    x = vectors.crossJoin(F.broadcast(moments(vectors, key)))
    return x.select(key, F.transform(F.arrays_zip("v", "mean", "std"), lambda t: (t["v"] - t["mean"]) / t["std"]).alias("z"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, key: str, query: object, limit: int = 20, places: int = 4) -> DataFrame:
    """The ``limit`` rows nearest to the query's, without itself, ties by key. One row is broadcast and a bounded top-k taken."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    z = standardised(vectors, key)
    own = z.where(F.col(key) == query).select(F.col("z").alias("_q")).limit(1)
    x = z.where(F.col(key) != query).crossJoin(F.broadcast(own)).select(key, distance(F.col("z"), F.col("_q")).alias("_d"))
    return x.orderBy("_d", key).limit(limit).select(key, rounded(F.col("_d"), places).alias("distance"))
