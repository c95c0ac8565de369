"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at two or fewer differing bits. Of the two halves of such a pair, one differs in
one bit at most. The anchors of a half are the 2^26 words of the [31,26] Hamming code on its first 31 bits:
every point has an anchor within the covering radius 1, and a partner within threshold 1 of the point lies
within 1 + 1 = 2 of that anchor. So each distinct fingerprint goes to all anchors within 2 of either half
(16, or 1 for a point that is an anchor itself), and only fingerprints that meet at an anchor are compared.

At an anchor, few fingerprints are compared with each other; more of them are linked through the 65 values
that each of them reaches by changing no or one bit: two differ in at most two bits exactly if they share
such a value. Either way only a spanning forest of links leaves the anchor, so copies and near copies are
never expanded into pairs, and one anchor's cost is in proportion to its fingerprints.

Defined cases: null or blank text has fingerprint zero, linked like any other; a text of one or two words
is one shingle; rows without doc_id get a fingerprint and their group's smallest doc_id, null if it has none;
repeated rows are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard
from .common import new_path, recut, row_hash, stored, table, text_bytes, written
from .components import components

SEED, WORDS = 42, 3
#: Shingles whose bits are counted at once; fingerprints at an anchor up to which all pairs are compared.
CHUNK, FEW = 1 << 16, 48
#: Fingerprints of a stage's task at the anchors, on average.
ANCHOR_ROWS = 1 << 20


def fingerprint(text: str | None) -> int:
    words = text_bytes(text).lower().split()  # bytes: A-Z alone
    if not words:
        return 0
    n, line, h = max(1, len(words) - WORDS + 1), b" ".join(words), xxhash.xxh64_intdigest
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], stop[:-1] + 1))[:n].tolist()
    stop = stop[min(WORDS, len(words)) - 1 :].tolist()
    over = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([h(line[a:b], SEED) for a, b in zip(start[at : at + CHUNK], stop[at : at + CHUNK], strict=True)], "<u8")
        over += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > n, bitorder="little").view("<u8")[0])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), fp (long: the fingerprint's 64 bits) for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in recut(batches):
            fp = np.fromiter(map(fingerprint, b.column(2).to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    return docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")


def anchors(half: Column) -> Column:
    """All words of the [31,26] Hamming code within 2 of a 31-bit point. Bit p - 1 is position p; the syndrome is the XOR of the positions of set bits."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    syndrome = sum((F.pmod(F.bit_count(half.bitwiseAND(F.lit(m))), F.lit(2)) * (1 << k) for k, m in enumerate(masks)), F.lit(0)).cast("int")
    bit = lambda p: F.element_at(F.array(F.lit(0), *(F.lit(1 << k) for k in range(31))).cast("array<bigint>"), p + 1)
    # flip the syndrome's own position, or two positions whose XOR it is; position 0 stands for none
    partner = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda p: F.struct(p.alias("p"), p.bitwiseXOR(syndrome).alias("q")))
    kept = F.filter(partner, lambda x: x["p"] < x["q"])
    near = F.transform(kept, lambda x: half.bitwiseXOR(bit(x["p"])).bitwiseXOR(bit(x["q"])))
    return F.when(syndrome == 0, F.array(half)).otherwise(near)


def linked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints to links (from, to) that span each group connected through at most two differing bits."""
    n = len(values)
    if n <= FEW:
        i, j = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2, 1))
    else:
        near = np.concatenate([values, *(values ^ np.uint64(1 << k) for k in range(64))])
        owner = np.tile(np.arange(n), 65)
        order = np.argsort(near, kind="stable")
        near, owner = near[order], owner[order]
        same = np.flatnonzero(near[1:] == near[:-1])
        i, j = owner[same], owner[same + 1]
    root = np.arange(n)
    while len(i):  # hook larger roots under smaller ones, then shorten the paths
        a, b = root[i], root[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, b, a)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        left = root[i] != root[j]
        i, j = i[left], j[left]
    to = np.flatnonzero(root != np.arange(n))
    return values[to], values[root[to]]


def links(distinct: DataFrame) -> DataFrame:
    """(fp) distinct to links (u, v) whose components are those of all pairs at two or fewer bits."""
    n = max(8, -(-distinct.count() * 32 // ANCHOR_ROWS), int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = distinct.select("fp").repartition(n, "fp")  # the table may be one small file, but each row becomes up to 32
    low, high = F.col("fp").bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(0x7FFFFFFF))
    keyed = x.select("fp", F.explode(F.concat(anchors(low), F.transform(anchors(high), lambda a: a.bitwiseOR(F.lit(1 << 31))))).alias("anchor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.diff(key)) + 1
            start, stop = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
            size = stop - start
            us, vs = [], []
            two = start[size == 2]  # most anchors that have any company
            near = two[np.bitwise_count(values[two] ^ values[two + 1]) <= 2]
            us.append(values[near])
            vs.append(values[near + 1])
            for a, b in zip(start[size > 2].tolist(), stop[size > 2].tolist(), strict=True):
                u, v = linked(values[a:b])
                us.append(u)
                vs.append(v)
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        keys, held = [], []  # of the last anchor, which may go on in the next batch
        for b in batches:
            key, values = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            keys.append(key)
            held.append(values)
            if key[-1] == keys[0][0]:
                continue
            key, values = np.concatenate(keys), np.concatenate(held)
            whole = np.searchsorted(key, key[-1])
            yield from flush(key[:whole], values[:whole])
            keys, held = [key[whole:]], [values[whole:]]
        if keys:
            yield from flush(np.concatenate(keys), np.concatenate(held))

    dealt = keyed.select("anchor", "fp").repartition(n, "anchor").sortWithinPartitions("anchor")
    found = dealt.mapInArrow(run, "u long, v long")
    return found.distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), fp, root (a fingerprint of the group), component_id for every row of ``docs``."""
    d = stored(fingerprints(docs), "fingerprints")
    classes = stored(d.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    pairs = new_path(docs.sparkSession, "links")
    roots = stored(components(written(links(classes), pairs)), "roots")
    discard(docs.sparkSession, pairs)
    c = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = c.groupBy("root").agg(F.min("first").alias("component_id"))
    return d.join(c.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs`` (doc_id, text)."""
    return grouped(docs).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, one of its smallest doc_id's; all columns as they are."""
    keep = grouped(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id").agg(F.min("th").alias("_th"))
    keep = keep.select(F.col("doc_id").alias("_id"), "_th")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_key"), text_hash(F.col("text")).alias("_hash"), row_hash(docs).alias("_order"))
    x = rows.join(keep, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")))
    x = x.withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_hash").orderBy("_order")))
    return x.where("_nth = 1").select("_row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = near_duplicates(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
