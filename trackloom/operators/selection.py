"""Exact medians of groups of any size, without a group's values in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Values of a group up to which they are aggregated as they are, and bins of a round. A buffer holds so many values at most.
LIMIT, BINS, ACCURACY = 1 << 20, 64, 2000


def exact_median(df: DataFrame, keys: list[str], value: str, limit: int = LIMIT) -> DataFrame:
    """keys and ``median`` of the values that are not null, null where there are none; NaN is larger than any number. Two middle values are averaged.

    Groups of up to ``limit`` values are one aggregation. Of larger ones a round takes rough quantiles as the edges of a
    histogram, counts its bins and goes on with the one that holds the middle ranks, until that has one value or no more
    than ``limit``. An edge is a bin of its own, so each round narrows. Where the two middle ranks part, they are the
    largest of one bin and the smallest of the next. What moves are a task's sums, never a group's values. Null keys are a
    group; no rows give none; columns besides keys and value are not read.
    """
    x = df.select(*keys, F.col(value).cast("double").alias("_v"))
    large = x.groupBy(*keys).agg(F.count("_v").alias("left")).where(F.col("left") > limit)
    if large.isEmpty():
        return x.groupBy(*keys).agg(F.percentile("_v", F.lit(0.5)).alias("median"))
    k = [f"_k{i}" for i in range(len(keys))]
    names = dict(zip(k, keys, strict=True))
    match = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(i)) for i, n in names.items()), F.lit(True))
    large = stored(large.withColumnsRenamed({n: i for i, n in names.items()}), "large-groups")
    median = x.join(large, match, "left_anti").groupBy(*keys).agg(F.percentile("_v", F.lit(0.5)).alias("median"))
    # ranks a and b, from 0, among the group's values from lo to hi
    open_ = large.select(*k, F.floor((F.col("left") - 1) / 2).alias("a"), F.floor(F.col("left") / 2).alias("b"), F.lit(float("-inf")).alias("lo"), F.lit(float("nan")).alias("hi"), "left")
    within = lambda groups: x.join(groups, match).where(F.col("_v").between(F.col("lo"), F.col("hi"))).drop(*keys)
    while True:
        near = open_.where(F.col("left") <= limit)
        values = within(near).groupBy(*k, "a", "b").agg(F.array_sort(F.collect_list("_v")).alias("_v"))
        found = values.select(*k, middle(F.get("_v", F.col("a").cast("int")), F.get("_v", F.col("b").cast("int"))))
        median = median.unionByName(found.withColumnsRenamed(names))
        open_ = open_.where(F.col("left") > limit)
        if open_.isEmpty():
            return median
        live = within(open_)
        edges = live.groupBy(*k).agg(F.percentile_approx("_v", [i / BINS for i in range(1, BINS)], ACCURACY).alias("edges"))
        edges = stored(edges.withColumnsRenamed({i: f"{i}e" for i in k}), "edges")
        at = reduce(lambda a, b: a & b, (F.col(i).eqNullSafe(F.col(f"{i}e")) for i in k), F.lit(True))
        place = F.size(F.filter("edges", lambda e: e < F.col("_v"))) + F.size(F.filter("edges", lambda e: e <= F.col("_v")))
        bins = live.join(edges, at).withColumn("bin", place).groupBy(*k, "a", "b", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        below = F.sum("c").over(Window.partitionBy(*k).orderBy("bin")) - F.col("c")  # at most 2 BINS rows a group
        bins = bins.withColumn("below", below)
        holds = lambda r: F.max(F.when((F.col("below") <= F.col(r)) & (F.col(r) < F.col("below") + F.col("c")), F.struct("bin", "below", "c", "least", "most"))).alias(f"_{r}")
        hit = stored(bins.groupBy(*k, "a", "b").agg(holds("a"), holds("b")), "bins")
        done = (F.col("_a.bin") != F.col("_b.bin")) | (F.col("_a.least") == F.col("_a.most"))
        median = median.unionByName(hit.where(done).select(*k, middle(F.col("_a.most"), F.col("_b.least"))).withColumnsRenamed(names))
        open_ = hit.where(~done).select(*k, (F.col("a") - F.col("_a.below")).alias("a"), (F.col("b") - F.col("_a.below")).alias("b"), F.col("_a.least").alias("lo"), F.col("_a.most").alias("hi"), F.col("_a.c").alias("left"))


def middle(a: Column, b: Column) -> Column:
    return F.when(a == b, a).otherwise(0.5 * a + 0.5 * b).alias("median")
