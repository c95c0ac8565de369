"""Centroid clustering by ball k-means, in whole numbers and so exact.

A cluster is a ball around its centroid. When centroids move, a ball's radius is bounded by its farthest member
before and how far its centroid went. Only centroids within twice the radius of a ball's own can be nearer to a
member: its neighbours. A member lies in the stable core where not even the nearest neighbour can take it, or
in the annulus of as many nearest neighbours as can, and is compared with these alone. All tests are made on
squared distances in whole numbers, so ties go to the smaller number exactly as in a comparison with all.

A round reads the table of vectors and their clusters twice: once for the sums, which every task adds up before
they are exchanged, and once to assign. Centroids (k times the dimensions) are all that the driver sees.

Defined cases: vectors that are null, of another length, or have null or non-finite components take no part;
rows without an id are clustered, but start no centroid; repeated rows count each, and of those that share an
id the smallest vector stands first as a start; with fewer vectors than k there are fewer centroids, and none
give no rows; components whose squared distances do not fit 64 bits are an error; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard
from .common import new_path, recut, table, written
from .topk import whole_numbers

SCALE, DIMS, K, ROUNDS, SEED = 64, 64, 16, 3, 1
ROWS = 4096
STATE = "vec_id long, v array<long>, cluster int, distance long"


class Balls:
    """Centroids, and of each ball the others that can be nearer to a member, nearest first, with their squared distances."""

    def __init__(self, centroids: list[list[int]], radii: list[int]):
        """radii: bounds of the members' squared distances."""
        self.centroids = centroids
        between = [[sum((a - b) ** 2 for a, b in zip(c, d, strict=True)) for d in centroids] for c in centroids]
        # nearer or as near needs 2 d(x, own) >= d(own, other)
        self.near = [sorted((between[i][j], j) for j in range(len(centroids)) if j != i and 4 * r >= between[i][j]) for i, r in enumerate(radii)]

    def assign(self, v: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each vector's nearest centroid and squared distance, from its cluster so far; and how many comparisons were made beyond its own."""
        best, distance, tests = cluster.copy(), np.empty(len(v), np.int64), 0
        for i in np.unique(cluster).tolist():
            own = np.flatnonzero(cluster == i)
            x = v[own]
            low = squared(x, self.centroids[i])
            # annulus: how many neighbours may be as near; the core has none
            edges = [d for d, _ in self.near[i]]
            ring = np.array([bisect(edges, 4 * d) for d in low.tolist()]) if x.dtype == object else np.searchsorted(np.minimum(edges, 1 << 62).astype(np.int64), np.minimum(low, 1 << 60) * 4, "right")
            number = np.full(len(own), i, best.dtype)
            for k, (_, j) in enumerate(self.near[i]):
                at = np.flatnonzero(ring > k)
                if not len(at):
                    break
                tests += len(at)
                d = squared(x[at], self.centroids[j])
                nearer = (d < low[at]) | (d == low[at]) & (j < number[at])
                low[at[nearer]], number[at[nearer]] = d[nearer], j
            best[own], distance[own] = number, low
        return best, distance, tests


def bisect(edges: list[int], value: int) -> int:
    return sum(e <= value for e in edges)


def squared(x: np.ndarray, c: list[int]) -> np.ndarray:
    d = x - np.array(c, x.dtype)
    return (d * d).sum(axis=1)


def whole_vectors(column: pa.ListArray, n: int, most: int) -> np.ndarray:
    """Rows of a column of lists; of Python's integers where squared distances to components up to ``most`` may not fit 64 bits."""
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    top = max(most, int(np.abs(v).max(initial=0)))
    return v if v.shape[1] * (2 * top) ** 2 < 1 << 60 else v.astype(object)


def start(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest sha256 of ``seed:id``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [list(r.v) for r in rows]


def assigned(state: DataFrame, balls: Balls, path: str) -> DataFrame:
    most = max(abs(x) for c in balls.centroids for x in c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in recut(batches, ROWS):
            v = whole_vectors(b.column(1), b.num_rows, most)
            cluster, distance, _ = balls.assign(v, b.column(2).to_numpy(zero_copy_only=False))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return written(state.mapInArrow(run, STATE), path)


def summed(state: DataFrame, k: int) -> list:
    """cluster, n, far (largest squared distance), sums by component; added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, sums = [0] * k, [0] * k, [0] * k
        for b in recut(batches, ROWS):
            v = whole_vectors(b.column(1), b.num_rows, 0)
            cluster, distance = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            for i in np.unique(cluster).tolist():
                own = cluster == i
                n[i] += int(own.sum())
                far[i] = max(far[i], int(distance[own].max()))
                sums[i] = sums[i] + v[own].sum(axis=0).astype(object)
        for i in range(k):
            if n[i]:
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([n[i]], pa.int64()), pa.array([far[i]], pa.int64()), pa.array([[str(x) for x in sums[i]]])], ["cluster", "n", "far", "sums"])

    parts = state.mapInArrow(run, "cluster int, n long, far long, sums array<string>")
    x = parts.select("cluster", "n", "far", F.posexplode("sums").alias("pos", "x"))
    g = x.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    return g.groupBy("cluster").agg(F.max("n").alias("n"), F.max("far").alias("far"), F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("sums")).collect()


def root_above(x: int) -> int:
    return math.isqrt(x) + 1


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v array of long, all of one length) to vec_id, v, cluster, distance, and the final centroids."""
    spark = vectors.sparkSession
    centroids = start(vectors, k, seed)
    if not centroids:
        return vectors.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), []
    # at first all vectors are in the first ball, however wide
    state, radii = vectors.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [1 << 200] + [0] * (len(centroids) - 1)
    old = None
    for r in range(rounds + 1):
        path = new_path(spark, "clusters")
        state = assigned(state, Balls(centroids, radii), path)
        if old:
            discard(spark, old)
        old = path
        if r < rounds:
            radii = [0] * len(centroids)
            for row in summed(state, len(centroids)):
                was, centroids[row.cluster] = centroids[row.cluster], [int(x.x) // row.n for x in row.sums]
                moved = sum((a - b) ** 2 for a, b in zip(was, centroids[row.cluster], strict=True))
                radii[row.cluster] = (root_above(row.far) + root_above(moved)) ** 2
    return state, centroids


def cluster_table(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector of (vec_id, v)."""
    state, centroids = clustered(vectors, k, rounds, seed)
    spark = vectors.sparkSession
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    g = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = g.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = g.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster").crossJoin(total)  # k rows and one
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").where(F.size("embedding") == DIMS)
    x = x.select("vec_id", whole_numbers(F.col("embedding"), SCALE).alias("v")).where("v is not null")
    return cluster_table(x)


def _sql() -> str:
    far = "CAST(list_sum(list_transform(list_zip(x.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    parts = [f"""x AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda y: CAST(floor({SCALE} * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS i, v AS c FROM x WHERE vec_id IS NOT NULL ORDER BY i LIMIT {K})"]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS (SELECT x.r, arg_min(c.i, ({far}, c.i)) AS i, min({far}) AS d FROM x, c{r} c GROUP BY x.r)")
        parts.append(f"u{r} AS (SELECT a.i, k.k, CAST(floor(sum(x.v[k.k])::DECIMAL(38, 0) / count(*)) AS BIGINT) AS m FROM a{r} a JOIN x ON a.r = x.r, range(1, {DIMS + 1}) k(k) GROUP BY ALL)")
        parts.append(f"c{r + 1} AS (SELECT c.i, coalesce(any_value(m.m), any_value(c.c)) AS c FROM c{r} c LEFT JOIN (SELECT i, list(m ORDER BY k) AS m FROM u{r} GROUP BY i) m ON c.i = m.i GROUP BY c.i)")
    return f"""WITH {", ".join(f"{p.replace(' AS (', ' AS MATERIALIZED (', 1)}" for p in parts)}
SELECT x.vec_id, CAST(a.i AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.i) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM x JOIN a{ROUNDS} a ON x.r = a.r JOIN c{ROUNDS} c ON a.i = c.i"""


QUERIES = {"op12_ball_kmeans": op12_ball_kmeans}
SQL = {"op12_ball_kmeans": _sql()}
