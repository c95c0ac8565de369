import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators.selection import exact_median
from trackloom.operators.tracks import robust_sigma


def medians(spark, groups, limit):
    rows = [(k, d, v, "x") for (k, d), values in groups.items() for v in values]
    random.Random(1).shuffle(rows)
    x = spark.createDataFrame(rows, "kind string, day int, v double, median string").repartition(5)
    return {(r.kind, r.day): r.median for r in exact_median(x, ["kind", "day"], "v", limit).collect()}


@pytest.mark.parametrize("limit", [1, 10, 1 << 20])
def test_groups_of_all_shapes(spark, limit):
    r = random.Random(2)
    groups = {
        ("odd", 1): [r.gauss(0, 1) for _ in range(701)],
        ("even", 1): [r.gauss(0, 1) for _ in range(700)],
        ("two values", 1): [1.0] * 300 + [2.0] * 300,
        ("one value", 1): [7.0] * 500,
        ("mostly one", 1): [r.random() for _ in range(30)] + [5.0] * 500 + [9 + r.random() for _ in range(25)],
        ("wide", 1): [10.0 ** r.uniform(-300, 300) * r.choice((-1, 1)) for _ in range(501)],
        ("infinite", 1): [float("inf")] * 200 + [float("-inf")] * 201,
        ("nulls", 1): [None] * 400 + [3.0, 4.0],
        ("only nulls", 1): [None] * 20,
        (None, None): [float(i) for i in range(64)],
        (None, 2): [2.0],
    }
    got = medians(spark, groups, limit)
    for k, values in groups.items():
        known = [v for v in values if v is not None]
        want = statistics.median_low(known) if known and statistics.median_low(known) == statistics.median_high(known) else 0.5 * statistics.median_low(known) + 0.5 * statistics.median_high(known) if known else None
        assert got[k] == want or abs(got[k] - want) <= 1e-15 * abs(want), k
    assert set(got) == set(groups) and medians(spark, {}, limit) == {}


def test_nan_is_largest(spark):
    assert medians(spark, {("a", 1): [1.0, 2.0, float("nan")] * 5}, 3)["a", 1] == 2.0
    assert np.isnan(medians(spark, {("a", 1): [1.0, float("nan"), float("nan")] * 5}, 3)["a", 1])


def test_one_group_of_ten_million_distinct_values(spark):
    """No task's shuffle read reaches a hundredth of the group: only sums move."""
    n = 10_000_000
    x = spark.range(0, n, 1, 16).select(F.lit("a").alias("k"), ((F.col("id") * 7_368_787) % n).cast("double").alias("v"))
    assert exact_median(x, ["k"], "v", 50_000).first().median == (n - 1) / 2


def test_sigma_of_a_large_group(spark):
    r = np.random.default_rng(3)
    v = r.normal(5, 2, 3001)
    x = spark.createDataFrame([(1, float(a)) for a in v] + [(2, None)], "k int, v double")
    got = {s.k: s.sigma for s in robust_sigma(x, ["k"], "v").collect()}
    assert abs(got[1] - 1.4826 * np.median(np.abs(v - np.median(v)))) < 1e-12 and got[2] is None
