import hashlib
import random

import numpy as np
import pytest

from trackloom.llm import kmeans as m


def by_hand(rows, k, rounds, seed=1):
    """(vec_id, v) to (vec_id, cluster, distance, cluster_inertia, inertia, digest): every vector against every centroid."""
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    centroids = [list(v) for _, v in start]
    for r in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids)) for _, v in rows]
        if r < rounds:
            for i in range(len(centroids)):
                own = [v for (_, v), (_, j) in zip(rows, best, strict=True) if j == i]
                if own:
                    centroids[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = [sum(d for d, j in best if j == i) for i in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(map(repr, ((i, j, d, inertia[j], sum(inertia), digest[j]) for (i, _), (d, j) in zip(rows, best, strict=True))))


def got(spark, rows, *how):
    d = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, v array<long>, cluster int").repartition(3)
    return sorted(map(repr, (tuple(r) for r in m.cluster_table(d, *how).collect())))


def blobs(seed, n, dims, spread, centres):
    r = random.Random(seed)
    at = [[r.randint(-200, 200) for _ in range(dims)] for _ in range(centres)]
    return [(i, [x + r.randint(-spread, spread) for x in at[r.randrange(centres)]]) for i in range(n)]


@pytest.mark.parametrize("rows", [blobs(1, 300, 8, 30, 5), blobs(2, 300, 2, 2, 3), blobs(3, 200, 1, 0, 4), [(i, [i % 3, -(i % 2)]) for i in range(90)]], ids=["blobs", "ties", "one dimension", "few values"])
def test_against_all_centroids(spark, rows):
    """Few distinct values give many ties and equal centroids."""
    assert got(spark, rows, 7, 3) == by_hand(rows, 7, 3)


def test_odd_rows(spark):
    rows = [*blobs(4, 40, 3, 9, 2), (7, [1, 2, 3]), (7, [0, 2, 3]), (None, [500, 0, 0]), (None, [500, 0, 0]), (3, blobs(4, 40, 3, 9, 2)[3][1])]
    assert got(spark, rows, 5, 2) == by_hand(rows, 5, 2)
    assert got(spark, rows[:3], 16, 3) == by_hand(rows[:3], 16, 3)
    assert got(spark, rows, 1, 0) == by_hand(rows, 1, 0)
    assert got(spark, []) == [] and got(spark, [(None, [1, 2])]) == []


def test_components_beyond_64_bit_squares(spark):
    rows = [(i, [r, 0]) for i, r in enumerate([2**30, -(2**30), 5, 2**30 + 9, 0])]
    assert got(spark, rows, 3, 2) == by_hand(rows, 3, 2)
    with pytest.raises(Exception, match="too large|too big|Overflow"):
        got(spark, [(i, [r, 0]) for i, r in enumerate([2**40, -(2**40), 5])], 1, 1)


def test_vectors_that_take_no_part(spark, tmp_path):
    fine = [[(i * j) % 7 / 7 for j in range(m.DIMS)] for i in range(30)]
    odd = [None, [], fine[0][:-1], [*fine[0], 0.5], [None, *fine[0][1:]], [float("nan"), *fine[0][1:]], [float("inf"), *fine[0][1:]]]
    rows = [(i, v, 1) for i, v in enumerate([*fine, *odd])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int").write.parquet(f"{tmp_path}/embeddings.parquet")
    have = sorted(map(repr, (tuple(r) for r in m.op12_ball_kmeans(spark, str(tmp_path)).collect())))
    assert have == by_hand([(i, [int(np.floor(64 * x)) for x in v]) for i, v in enumerate(fine)], 16, 3)


def test_members_meet_only_the_neighbours_of_their_ball():
    rows = blobs(5, 2000, 6, 8, 10)
    v = np.array([x for _, x in rows])
    centroids = [v[i].tolist() for i in range(0, 2000, 125)]
    first, distance, all_tests = m.Balls(centroids, [1 << 200] + [0] * 15).assign(v, np.zeros(2000, np.int64))
    radii = [int(distance[first == i].max(initial=0)) for i in range(16)]
    again, same, tests = m.Balls(centroids, radii).assign(v, first)
    assert (again == first).all() and (same == distance).all()
    assert tests < all_tests <= 2000 * 15 and tests < 2000 * 15 / 3
