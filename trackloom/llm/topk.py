"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt into blocks by a hash of their id. Within a block every dimension has a list of the
block's distinct vectors sorted by that component. A query walks all lists from the end that its component's
sign favours, in rounds of doubling depth; vectors met for the first time are scored in full, and the walk
stops when the sum of the products at the present depth, the bound for all unseen vectors, is below the kth
score so far. At equal scores the walk goes on, as an unseen smaller id would win. The k best of each block
meet in one ranking a query. Queries stream past a block one batch at a time, so neither side is held whole.

Copies of a vector are one entry of the lists with all their ids; a vector that a third of the rows share
costs no more than another.

Defined cases: vectors that are null, empty or have null or non-finite components, and rows without an id,
take no part; a query meets candidates of its own length only; all rows with the query's id are its own;
repeated rows are candidates each, but a repeated query counts once; with fewer than k candidates all are
returned; components beyond what 64-bit sums hold exactly are an error; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SCALE, K, EVERY = 1024, 10, 100
#: Candidates of a block, least and most (a block is held in memory, and each meets every query); blocks up to which they stay at the least; queries of a packet.
BLOCK, LARGEST, BLOCKS, PACKET, FIRST = 16_384, 65_536, 512, 256, 16


def whole_numbers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, null where the vector takes no part."""
    def whole(v: Column) -> Column:
        x = v.cast("double") * scale
        return F.when(F.abs(x) < float(1 << 62), F.floor(x)).otherwise(F.raise_error(F.lit("components do not fit 64 bits")).cast("long"))

    fine = (F.size(embedding) > 0) & F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(embedding, whole))


class Lists:
    """A block's distinct vectors, their ids, and a sorted list for every dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows = ids[order]
        self.vectors, group = np.unique(vectors[order], axis=0, return_inverse=True)
        by = np.argsort(group.ravel(), kind="stable")
        self.ids = ids[order][by]  # of each vector, ascending
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(group.ravel(), minlength=len(self.vectors)))))
        self.order = np.argsort(-self.vectors, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.exact = self.vectors.astype(np.float64)
        self.largest = int(np.abs(self.vectors).max(initial=0))

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (ids, scores), and how many distinct vectors were scored."""
        n, dims = self.vectors.shape
        bound = self.largest * int(np.abs(query).max(initial=0)) * dims
        if bound >= 1 << 63:
            raise ValueError("scores do not fit 64 bits")
        used = np.flatnonzero(query)
        weights, up = query[used], query[used] > 0
        own_rows = int(np.searchsorted(self.rows, own, "right") - np.searchsorted(self.rows, own))
        # row i of walk lists block positions from the favoured end of dimension used[i]
        seen, scored = np.zeros(n, bool), np.zeros(n, bool)
        ids, scores, depth, step, count = np.empty(0, np.int64), np.empty(0, np.int64), 0, FIRST, 0
        while depth < n:
            stop = min(n, depth + step)
            if len(used):
                seen[self.order[used[up], depth:stop]] = True
                seen[self.order[used[~up], n - stop : n - depth]] = True
            else:
                seen[:] = True
                stop = n
            new = np.flatnonzero(seen & ~scored)
            scored[new] = True
            count += len(new)
            if bound < 1 << 53:
                s = (self.exact[new] @ query.astype(np.float64)).astype(np.int64)
            else:
                s = self.vectors[new] @ query
            ids, scores = self.merge(own, own_rows, ids, scores, new, s, k)
            depth, step = stop if count < n else n, step * 2
            if depth < n and len(scores) == k:
                edge = np.where(up, self.sorted[used, min(depth, n - 1)], self.sorted[used, n - 1 - min(depth, n - 1)])
                if int(edge @ weights) < int(scores[-1]):
                    break
        return ids, scores, count

    def merge(self, own: int, own_rows: int, ids: np.ndarray, scores: np.ndarray, new: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(scores) == k:
            keep = s >= scores[-1]
            new, s = new[keep], s[keep]
        enough = k + own_rows  # of vectors, and of a vector's smallest ids: so many may be the query's own
        if len(s) > enough:
            keep = s >= np.partition(s, len(s) - enough)[len(s) - enough]
            new, s = new[keep], s[keep]
        if not len(s):
            return ids, scores
        size = np.minimum(self.begin[new + 1] - self.begin[new], enough)
        at = np.repeat(self.begin[new] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ids, scores = np.concatenate((ids, self.ids[at])), np.concatenate((scores, np.repeat(s, size)))
        keep = ids != own
        ids, scores = ids[keep], scores[keep]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int | None = None) -> DataFrame:
    """(vec_id, v array of long) and (query_id, v) to query_id, rank, vec_id, score: each query's k best by inner product, ties to smaller ids.

    Every query meets every block, so what moves is queries times blocks; ``block`` candidates make one, by default so
    many that blocks are few, and queries travel in packets.
    """
    rows = vectors.count()
    n = max(1, -(-rows // (block or min(LARGEST, max(BLOCK, rows // BLOCKS)))))
    c = vectors.where("vec_id is not null and v is not null").select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"), F.size("v").alias("dims"), F.lit(0).alias("kind"), F.array("vec_id").alias("ids"), "v")
    q = stored(queries.where("query_id is not null and v is not null").select("query_id", F.size("v").alias("dims"), "v").distinct(), "queries")
    packets = max(1, -(-q.count() // PACKET))
    q = q.groupBy("dims", F.pmod(F.xxhash64("query_id", "v"), F.lit(packets)).alias("packet")).agg(F.collect_list(F.struct("query_id", "v")).alias("x"))
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), "dims", F.lit(1).alias("kind"), F.col("x.query_id").alias("ids"), F.flatten("x.v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, lists = None, [], None
        for b in batches:
            block_of, dims, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = 0
            while at < b.num_rows:
                same = (block_of == block_of[at]) & (dims == dims[at]) & (kind == kind[at])
                stop = at + (len(same) - at if same[at:].all() else int(np.argmin(same[at:])))
                ids, part = (b.column(i).slice(at, stop - at).flatten().to_numpy(zero_copy_only=False) for i in (3, 4))
                part = part.reshape(len(ids), dims[at])
                if key != (block_of[at], dims[at]):
                    key, held, lists = (block_of[at], dims[at]), [], None
                if kind[at] == 0:
                    held.append((ids, part))
                elif held or lists:
                    if lists is None:
                        lists, held = Lists(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])), []
                    own, found, score = [], [], []
                    for i, v in zip(ids.tolist(), part, strict=True):
                        x, s, _ = lists.top(i, v, k)
                        own.append(np.full(len(x), i))
                        found.append(x)
                        score.append(s)
                    yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in (own, found, score)], ["query_id", "vec_id", "score"])
                at = stop

    rows = c.unionByName(q).repartition(n, "block").sortWithinPartitions("block", "dims", "kind")
    found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = stored(table(spark, sf_dir, "embeddings").select("vec_id", whole_numbers(F.col("embedding")).alias("v")), "vectors")
    return exact_top_k(x, x.where(f"vec_id % {EVERY} = 0").withColumnRenamed("vec_id", "query_id"))


SQL = {
    "op3_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
QUERIES = {"op3_top_k": op3_top_k}
