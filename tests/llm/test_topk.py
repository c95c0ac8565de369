import math
import random

import pytest
from trackloom.llm import topk
from pyspark.sql import functions as F


def by_hand(rows, every, k=10):
    v = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, x in {(i, tuple(e)) for i, e in v if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in v if i != q and len(y) == len(x))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, every, block):
    x = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<double>, score int").select("vec_id", topk.whole_numbers(F.col("embedding")).alias("v"))
    got = topk.exact_top_k(x, x.where(f"vec_id % {every} = 0").withColumnRenamed("vec_id", "query_id"), block=block)
    return sorted(tuple(r) for r in got.collect())


def test_random_vectors_ties_and_copies(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, 0.25, 0.0, 0.125]) for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, -0.5, 0.1]) for i in range(150)]
    r.shuffle(rows)
    for block in (64, 100_000):
        assert run(spark, rows, 20, block) == by_hand(rows, 20)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [3.0]), (None, [9.0, 9.0]), (7, [-1.0, 0.5]), (8, [0.0, 0.0]), (10, [0.0, 0.0])]
    assert run(spark, rows, 10, 4) == by_hand(rows, 10)
    assert run(spark, [], 10, 4) == []


def test_few_lists_are_walked_where_one_dimension_rules():
    import numpy as np

    v = np.zeros((5000, 8), np.int64)
    v[:, 0] = np.random.default_rng(1).permutation(5000) * 10
    v[:, 1:] = np.random.default_rng(2).integers(-3, 3, (5000, 7))
    ids, scores, scored = topk.Lists(np.arange(5000), v).top(-1, np.array([5, 1, 0, 0, 0, 0, 0, 0]), 10)
    s = v @ np.array([5, 1, 0, 0, 0, 0, 0, 0])
    assert scores.tolist() == sorted(s.tolist(), reverse=True)[:10] and scored < 500 and len(ids) == 10


def test_own_rows_take_no_places(spark):
    rows = [(0, [0.5, 0.25])] * 2 + [(i, [0.5, 0.25]) for i in range(1, 16)] + [(i, [0.25, 0.0]) for i in range(16, 30)]
    for block in (8, 100_000):
        assert run(spark, rows, 100, block) == by_hand(rows, 100)
    assert [r[2] for r in by_hand(rows, 100)] == list(range(1, 11))


def test_own_rows_of_several_vectors_take_no_places():
    import numpy as np

    v = np.array([[100 - i, 1] for i in range(40)])
    for ids in (np.array([7] * 5 + list(range(50, 85))), np.array([7, 50, 7, 51] * 10)):
        got, scores, _ = topk.Lists(ids, v).top(7, np.array([3, 1]), 10)
        want = sorted((-int(s), int(i)) for i, s in zip(ids, v @ np.array([3, 1]), strict=True) if i != 7)[:10]
        assert list(zip((-scores).tolist(), got.tolist(), strict=True)) == want


def test_large_components_take_part_or_are_an_error(spark):
    rows = [(0, [0.0, 0.0]), (1, [1e15, 2.0]), (2, [-2e15, 1.0]), (3, [float("-inf"), 1.0])]
    x = spark.createDataFrame(rows, "vec_id long, v array<double>").select(topk.whole_numbers(F.col("v")).alias("v"))
    assert [r.v for r in x.collect()] == [[0, 0], [1024 * 10**15, 2048], [-2048 * 10**15, 1024], None]
    with pytest.raises(Exception, match="do not fit 64 bits"):
        run(spark, [(0, [1.0, 2.0]), (1, [1e300, 2.0])], 10, 4)
    with pytest.raises(Exception, match="do not fit 64 bits"):
        run(spark, [(0, [8.0, 2.0]), (1, [1e15, 2.0])], 10, 4)
