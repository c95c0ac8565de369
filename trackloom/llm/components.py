"""Connected components of an edge table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard
from .common import new_path, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) longs to (node, root) for every node that has an edge; root: the component's smallest node.

    Each round replaces a node's links by links to the smallest of its neighbours; the number of edges never
    grows, minima are combined before the shuffle, and every round is a table in the shared folder, which goes when the next one is there. Rounds
    grow with the logarithm of a component's length. Self-links and repeated links are allowed.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    e = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    was, now = None, _state(e)
    while was != now and now[0]:
        old, between, path = path, new_path(spark, "large"), new_path(spark, "small")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), between)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = written(small.where("u != v").distinct(), path)
        discard(spark, old)
        discard(spark, between)
        was, now = now, _state(e)
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
