"""MinHash near-duplicates by an LSH forest.

A document's set are its distinct shingles. Equal sets are one class. Every class has a signature in several
orders (trees): an order's entry is the tree's number and the minima of its hash functions, most significant
first, so entries that share a longer prefix are nearer in the sorted order. Neighbours whose longest common
prefix reaches the region's depth are candidates. The depth adapts: regions of up to FEW classes stay at the
first depth; classes of denser regions are sorted again at the double depth, in as many more orders as keep
the chance that a pair at the threshold shares no prefix below one in a million (``FOREST``). Regions that are
dense at the last depth stay candidates as a whole.

Within a region a sketch of 128 bytes rules out what is far below the threshold, and only a spanning forest of
the rest leaves it. Its components are families: a class meets its family once with its whole text. Families
are cut into blocks of bounded size, each pair of blocks is a task's unit of work, and there links are confirmed
on the full sets; pairs that are connected already need no test, so copies are never expanded into pairs.
Sets are held as 64-bit hashes of their shingles.

Work within a family grows with the square of its distinct sets, over its blocks; that is the exact way for
groups in which many near copies are just not near enough to each other.

Defined cases: null or blank text has the empty set, is linked with nothing and its own component; a text of
one or two words is one shingle; rows without doc_id get their component's smallest doc_id, null where it has
none (and count as kept then); repeated rows are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import recut, runs, stored, table, text_bytes
from .components import components
from .ngram import pairs
from .simhash import text_hash

WORDS, SHARE = 3, 85
#: Depth of an order and number of orders: (1 - 0.85 ** depth) ** orders is below one in a million.
FOREST = ((4, 20), (8, 45), (16, 180))
#: Bytes of a sketch, and how many of them agree at the threshold but for a chance of one in ten million.
SKETCH, AGREE = 128, 86
#: Classes of a region that are compared at once; classes and shingles of a block; rows of a task on average.
FEW, BLOCK, BLOCK_SHINGLES, TASK_ROWS = 1024, 512, 1 << 19, 1 << 18
#: Shingles whose hash values are taken at once.
CHUNK = 512


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending."""
    words = text_bytes(text).lower().split()  # bytes: A-Z alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = h[: max(1, len(h) - WORDS + 1)]
    for k in range(1, min(WORDS, len(h))):
        out = pairs(out, h[k : k + len(out)])
    return np.unique(out)


@functools.cache
def functions(depth: int, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and masks of ``orders`` times ``depth`` hash functions; an order keeps its functions at every depth."""
    draw = lambda kind: np.array([xxhash.xxh32_intdigest(f"{kind}:{t}:{j}") for t in range(orders) for j in range(depth)], np.uint32)[:, None]
    return draw("factor") | np.uint32(1), draw("mask")


def minima(hashes: np.ndarray, depth: int, orders: int) -> np.ndarray:
    """orders x depth minima of a set that is not empty."""
    factor, mask = functions(depth, orders)
    x, low = (hashes >> np.uint64(32)).astype(np.uint32), np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), CHUNK):
        np.minimum(low, ((x[None, at : at + CHUNK] ^ mask) * factor).min(axis=1), out=low)
    return low.reshape(orders, depth)


def entries(low: np.ndarray) -> list[bytes]:
    """Each order's entry: its number and minima, big-endian, so bytes sort as the numbers do."""
    return [t.to_bytes(2, "big") + row.tobytes() for t, row in enumerate(low.astype(">u4"))]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n, d1 and d2 (digest of the set), entries and sketch for every row of ``docs`` (doc_id, text)."""
    depth, orders = FOREST[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in recut(batches):
            n, digests, keys, sketches = [], [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                low = minima(s, depth, SKETCH // depth) if len(s) else None
                keys.append(entries(low[:orders]) if len(s) else [])
                sketches.append((low & 255).astype(np.uint8).tobytes() if len(s) else b"")
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(1), pa.array(n, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(keys, pa.list_(pa.binary())), pa.array(sketches, pa.binary())], ["doc_id", "th", "n", "d1", "d2", "entries", "sketch"])

    return docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text").mapInArrow(run, "doc_id long, th long, n long, d1 long, d2 long, entries array<binary>, sketch binary")


def deeper(texts: DataFrame, depth: int, orders: int) -> DataFrame:
    """(cid, text) to cid and entries of another depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in recut(batches):
            keys = [entries(minima(shingles(t), depth, orders)) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(keys, pa.list_(pa.binary()))], ["cid", "entries"])

    return texts.select("cid", "text").mapInArrow(run, "cid long, entries array<binary>")


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of ``near``, which tells a thing's neighbours among later ones; connected pairs are not asked for."""
    root, out = np.arange(n), []
    for i in range(n - 1):
        others = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        hit = others[near(i, others)] if len(others) else others
        if len(hit):
            joined, at = np.unique(root[hit], return_index=True)
            out += [(i, int(hit[k])) for k in at]
            root[np.isin(root, joined)] = root[i]
    return out


def sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= SHARE * np.maximum(a, b)


def edges_of(u: list, v: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def parts_for(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def candidates(regions: DataFrame) -> DataFrame:
    """(entry, cid, n, sketch), regions of FEW classes at most, to links (u, v) that span what the sketches leave of each region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in runs(batches, 1):
            us, vs = [], []
            cid, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            sketch = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
            for at, to in zip(starts, [*starts[1:], b.num_rows], strict=True):
                s, size = sketch[at:to], n[at:to]
                for i, j in spanning(to - at, lambda i, o, s=s, size=size: ((s[o] == s[i]).sum(axis=1) >= AGREE) & sizes_fit(size[o], size[i])):
                    us.append(cid[at + i])
                    vs.append(cid[at + j])
            yield edges_of(us, vs)

    n = parts_for(regions, regions.count())
    return regions.select("entry", "cid", "n", "sketch").repartition(n, "entry").sortWithinPartitions("entry", "cid").mapInArrow(run, "u long, v long")


def with_company(orders: DataFrame) -> DataFrame:
    """(cid, entries) to entry, cid, size: the entries that more than one class has, with their number."""
    x = orders.select(F.explode("entries").alias("entry"), "cid")
    many = x.groupBy("entry").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return x.join(many, "entry")


def forest(classes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Candidate links (u, v) between classes (cid, n, entries, sketch), and (cid, text) of all classes that have any neighbour."""
    found, orders, texts = None, classes.select("cid", "entries"), None
    for depth, _ in FOREST:
        if texts is not None:
            orders = deeper(texts.join(dense.select("cid").distinct(), "cid"), depth, dict(FOREST)[depth])
        near = stored(with_company(orders), "regions")
        if texts is None:
            texts = stored(texts_of(near.select("cid").distinct()), "texts")
        small = near.where(F.col("size") <= few).join(classes.select("cid", "n", "sketch"), "cid")
        links = candidates(small)
        dense = near.where(F.col("size") > few)
        if depth == FOREST[-1][0]:  # as a whole: every class with the region's smallest
            least = dense.groupBy("entry").agg(F.min("cid").alias("u"))
            links = links.unionByName(dense.join(least, "entry").select("u", F.col("cid").alias("v")))
        links = stored(links.where("u != v").distinct(), "candidates")
        found = links if found is None else found.unionByName(links)
        if dense.isEmpty():
            break
    return found, texts


def confirmed(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(family, cid, n, text) to links (u, v) that span the components within families, on the full sets."""
    sizes = members.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    x = members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in runs((s for b in batches for s in recut([b], 4 * BLOCK, 16 << 20)), 3):
            us, vs = [], []
            for at, to in zip(starts, [*starts[1:], b.num_rows], strict=True):
                part = b.slice(at, to - at)
                cid = part.column(4).to_pylist()
                within = part.column(1)[0] == part.column(2)[0]
                side = part.column(3).to_numpy(zero_copy_only=False)
                for i, j in exact([shingles(t) for t in part.column(5).to_pylist()], None if within else side):
                    us.append(cid[i])
                    vs.append(cid[j])
            yield edges_of(us, vs)

    n = parts_for(members, 64 * members.count())
    keys = ["family", "low", "high"]
    return x.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def exact(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of sets whose intersection is at least SHARE percent of their union; with ``side``, of those on different sides."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    _, place, times = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = times > 1  # others add nothing to any intersection
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, place = owner[keep], column[place[keep]]
    bits = np.zeros((len(sets), -(-int(shared.sum()) // 64) * 8), np.uint8)
    np.bitwise_or.at(bits, (owner, place // 8), (1 << (place % 8)).astype(np.uint8))
    bits = bits.view(np.uint64)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        fits = sizes_fit(size[others], size[i])
        if side is not None:
            fits &= side[others] != side[i]
        fits = np.flatnonzero(fits)
        o, hit = others[fits], np.zeros(len(others), bool)
        both = np.bitwise_count(bits[o] & bits[i]).sum(axis=1, dtype=np.int64)
        hit[fits] = 100 * both >= SHARE * (size[o] + size[i] - both)
        return hit

    return spanning(len(sets), near)


def near_duplicates(docs: DataFrame, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    rows = stored(described(docs), "sets")
    first = ["n", "entries", "sketch"]
    c = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("rep"), *(F.first(x).alias(x) for x in first))
    classes = stored(c.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def texts_of(cids: DataFrame) -> DataFrame:
        need = classes.join(cids, "cid").select("cid", "n", F.col("rep.doc_id").alias("_id"), F.col("rep.th").alias("_th"))
        d = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text")
        x = d.join(need, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
        return x.groupBy("cid", "n").agg(F.first("text").alias("text"))  # repeated rows are one

    links, texts = forest(classes, texts_of, few)
    family = stored(components(links), "families")
    members = family.select(F.col("node").alias("cid"), F.col("root").alias("family")).join(texts, "cid")
    roots = stored(components(stored(confirmed(members, block).distinct(), "links")), "roots")
    x = classes.join(roots, F.col("cid") == F.col("node"), "left").select("d1", "d2", "least", F.coalesce("root", "cid").alias("root"))
    least = x.groupBy("root").agg(F.min("least").alias("component_id"))
    of = x.join(least, "root").select("d1", "d2", "component_id")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.select("doc_id", "n", "d1", "d2").join(of, ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op13_minhash": op13_minhash}
SQL = {
    "op13_minhash": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
p AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS n, b.n AS m, count(*) AS k FROM p a JOIN p b ON a.x = b.x AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT u, v FROM i WHERE 100 * k >= 85 * (n + m - k)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, s.doc_id = c AS kept FROM s JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) ON s.doc_id = u""",
}
