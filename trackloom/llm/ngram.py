"""Language-model scores by deleted interpolation.

P(w | u v) = a c(u v w)/c(u v) + b c(v w)/c(v) + c c(w)/N + d / (V + 1), the weights (a, b, c, d) adding up to 1 in each
bucket of the context's frequency: that of c(u v), or of c(v) where the pair u v is unseen. A document begins in the
context of two ends. Counts come from the training documents; the weights are learned by expectation-maximisation on
the counts of a deleted part of these (remainder 1), against estimates from the rest.

Counts travel packed. Documents are cut into chunks of some megabytes, kept as arrays of chunk-local word numbers.
A chunk asks for each distinct word, pair and triple once: keys are hashes, sorted, cut into key ranges and
delta-coded, with the chunk's own training counts. A range's task adds up the counts of all chunks and answers
every chunk in the order of its keys. No word is a shuffle key of its own, so frequent ones make no hot task; what
moves grows with the distinct triples of each chunk, and nothing of that size reaches the driver. Packets are as many
as chunks times ranges, at most one a key; ranges widen with the cube root of the corpus beyond WIDEN tokens, and
chunks may be set larger. EM sees the deleted events as a histogram over the bucket and the logs of the three
estimates, whose size is bounded.

Words are told apart by 64-bit hashes, pairs and triples by hashes of SPARE bits more than the number of tokens needs:
one in 2^SPARE of them at most is taken for another.

Defined cases: null and blank text is the one token end; null doc_id counts as the text "" (held out); repeated
rows count and score each; without training documents every score rests on 1 / (V + 1); an empty table gives
no rows; other columns are not read. Reruns over another partitioning add in another order, so scores may differ in
their last bits.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import recut, stored, table, text_bytes

FOLDS, HELD, DELETED, KEPT = 10, 0, 1, 2
#: Text bytes of a chunk, tokens of a key range on average (up to WIDEN tokens in all), rows worked on at once (a row holds a packed chunk), spare bits of a hash.
CHUNK_BYTES, RANGE_TOKENS, WIDEN, ROWS, SPARE = 8 << 20, 1 << 20, 1 << 31, 8, 20
#: Context buckets by powers of 2, of single words and of pairs; histogram steps a power of e, EM rounds, weights where nothing is deleted.
BUCKETS, PAIR_BUCKETS, STEPS, ROUNDS, DEFAULT = 32, 32, 2, 60, (0.3, 0.3, 0.3, 0.1)
CHUNKS = "part int, seq long, role int, ids array<long>, lengths binary, tokens binary, vocab binary, n long"
ANSWERS = "chunk long, role int, kind int, range long, n long, total binary, deleted binary, tokens long, words long"


def pairs(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """64-bit keys of word pairs from the words' hashes."""
    x = before * np.uint64(0x9E3779B97F4A7C15) + after
    for shift, by in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(32))


def squeeze(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes: high bytes are mostly zero and cost next to nothing."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1) if len(x) else b""


def stretch(data: bytes, n: int, kind: str) -> np.ndarray:
    """``n`` integers of a kind (u or i), of the size they were squeezed from."""
    if not n:
        return np.empty(0, f"<{kind}8")
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(f"<{kind}{len(planes)}").ravel()


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and the differences."""
    return keys[:1].astype("<u8").tobytes() + squeeze(counted(np.diff(keys)))


def unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(data, "<u8", 1), stretch(data[8:], n - 1, "u"))), dtype=np.uint64)


def counted(x: np.ndarray) -> np.ndarray:
    return x.astype("<u4" if x.max(initial=0) < 1 << 32 else "<u8")


def counts_bytes(x: np.ndarray) -> bytes:
    return squeeze(counted(x))


def counts_of(data: bytes, n: int) -> np.ndarray:
    return stretch(data, n, "u").astype(np.int64)


def cut(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks of documents of one role: held out, deleted or kept; numbered within the partition that cut them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty() -> tuple:
            words = defaultdict()
            words.default_factory = words.__len__
            words[b""]  # the end is number 0
            return [0, [], [], [], words]

        def emit(role: int, held: list) -> pa.RecordBatch:
            _, ids, lengths, tokens, words = held
            vocab = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            row = [part, next(numbers), role, ids, np.array(lengths, "<i4").tobytes(), squeeze(np.concatenate(tokens).astype("<i4")), vocab.astype("<u8").tobytes(), sum(lengths)]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in CHUNKS.split(", ")])

        open_chunks, part, numbers = {}, TaskContext.get().partitionId(), count()
        for b in recut(batches):
            for doc_id, text, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
                role, data = min(fold, KEPT), text_bytes(text)
                held = open_chunks.get(role) or open_chunks.setdefault(role, empty())
                words = data.lower().split()
                words.append(b"")
                held[0] += len(data) + 16
                held[1].append(doc_id)
                held[2].append(len(words))
                held[3].append(np.fromiter(map(held[4].__getitem__, words), np.int32, len(words)))
                if held[0] >= chunk_bytes:
                    yield emit(role, open_chunks.pop(role))
        for role, held in sorted(open_chunks.items()):
            yield emit(role, held)

    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")
    return docs.select("doc_id", "text", fold.alias("fold")).mapInArrow(run, CHUNKS)


def dealt_evenly(chunks: DataFrame) -> tuple[DataFrame, int]:
    """Chunks with a number ``chunk`` each, and how many partitions take about two of them each by the number's remainder.

    The first chunks of all partitions come first, so remainders are used evenly; should one partition have cut many more than the
    others, its numbers are a stride apart that shares no factor with the number of partitions.
    """
    stride, n = chunks.agg(F.coalesce(F.max("part") + 1, F.lit(1)), F.count(F.lit(1))).first()
    parts = max(8, -(-n // 2))
    while math.gcd(stride, parts) > 1:
        parts += 1
    return chunks.withColumn("chunk", F.col("seq") * stride + F.col("part")), parts


def keyed(tokens: bytes, lengths: bytes, n: int, vocab: bytes, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per kind (words, pairs, triples) the distinct keys, ascending, and for every token its place among them."""
    tokens, hashes = stretch(tokens, n, "i"), np.frombuffer(vocab, "<u8").astype(np.uint64)
    words, place = np.unique(hashes, return_inverse=True)
    yield words, place[tokens]
    ends, hashes = hashes[:1], hashes[tokens]
    both = pairs(np.concatenate((ends, hashes[:-1])), hashes)  # the end precedes each document
    yield np.unique(both >> np.uint64(64 - bits), return_inverse=True)
    context = np.concatenate((both[:1], both[:-1]))
    context[starts(np.frombuffer(lengths, "<i4"))] = pairs(ends, ends)
    yield np.unique(pairs(context, hashes) >> np.uint64(64 - bits), return_inverse=True)


def starts(lengths: np.ndarray) -> np.ndarray:
    """Places of the documents' first tokens."""
    return np.cumsum(lengths) - lengths


def ask(chunks: DataFrame, ranges: int, bits: int) -> DataFrame:
    """A row for each chunk, kind and key range: packed keys and the chunk's counts of them."""
    names = ["range", "chunk", "role", "kind", "n", "keys", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = {width: np.array([-(-(i << width) // ranges) for i in range(ranges)], np.uint64) for width in (64, bits)}
        for b in recut(batches, 1):
            for chunk, role, tokens, lengths, n, vocab in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for kind, (keys, place) in enumerate(keyed(tokens, lengths, n, vocab, bits)):
                    counts = np.bincount(place, minlength=len(keys))
                    edge = [*np.searchsorted(keys, edges[bits if kind else 64]).tolist(), len(keys)]
                    rows = [(i, chunk, role, kind, z - a, pack(keys[a:z]), counts_bytes(counts[a:z]) if role != HELD else b"") for i, (a, z) in enumerate(zip(edge, edge[1:])) if z > a]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "range long, chunk long, role int, kind int, n long, keys binary, counts binary"
    return chunks.select("chunk", "role", "tokens", "lengths", "n", "vocab").mapInArrow(run, schema)


def answer(asked: DataFrame, ranges: int) -> DataFrame:
    """Sums of the training counts, for every chunk in the order of its keys; and a row with chunk null that has the range's training tokens and words."""
    names = ["chunk", "role", "kind", "range", "n", "total", "deleted", "tokens", "words"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def add(rng: int, kind: int, rows: list) -> pa.RecordBatch:
        keys, place = np.unique(np.concatenate([unpack(k, n) for _, _, n, k, _ in rows]), return_inverse=True)
        edge = np.cumsum([0, *(n for _, _, n, _, _ in rows)])
        total, deleted = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for (_, role, n, _, c), a in zip(rows, edge, strict=False):
            if role != HELD:
                at, c = place[a : a + n], counts_of(c, n)
                total[at] += c  # a chunk has a key once
                if role == DELETED:
                    deleted[at] += c
        out = [(chunk, role, kind, rng, n, counts_bytes(total[place[a : a + n]]), counts_bytes(deleted[place[a : a + n]]) if role == DELETED else b"", None, None) for (chunk, role, n, _, _), a in zip(rows, edge, strict=False)]
        if kind == 0:
            out.append((None, None, kind, rng, None, None, None, int(total.sum()), int(np.count_nonzero(total))))
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in recut(batches):
            for rng, kind, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (rng, kind):
                    if rows:
                        yield add(*key, rows)
                    key, rows = (rng, kind), []
                rows.append(row)
        if rows:
            yield add(*key, rows)

    dealt = asked.repartitionById(ranges, F.col("range").cast("int")).sortWithinPartitions("range", "kind")
    return dealt.select("range", "kind", "chunk", "role", "n", "keys", "counts").mapInArrow(run, ANSWERS)


def with_answers(chunks: DataFrame, answers: DataFrame, work, schema: str, parts: int, bits: int) -> DataFrame:
    """``work`` on every chunk with its counts: role, ids, lengths, per kind each token's training count and the deleted part of it."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = chunks.select("chunk", "role", F.lit(-1).alias("kind"), F.lit(-1).cast("long").alias("range"), "n", F.col("lengths").alias("a"), F.col("tokens").alias("b"), F.col("vocab").alias("c"), "ids")
    rows = rows.unionByName(answers.where("chunk is not null").select("chunk", "role", "kind", "range", "n", F.col("total").alias("a"), F.col("deleted").alias("b"), none("binary").alias("c"), none("array<long>").alias("ids")))

    def finish(base: tuple, parts: list) -> pa.RecordBatch:
        role, n, lengths, tokens, vocab, ids = base
        found = []
        for kind, (keys, place) in enumerate(keyed(tokens, lengths, n, vocab, bits)):
            total = np.concatenate([counts_of(a, m) for k, m, a, _ in parts if k == kind])
            deleted = np.concatenate([counts_of(b, m) for k, m, _, b in parts if k == kind]) if role == DELETED else None
            if len(total) != len(keys):
                raise ValueError("a chunk has not got all its answers")
            found.append((total[place], None if deleted is None else deleted[place]))
        return work(role, ids, np.frombuffer(lengths, "<i4"), *found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, parts = None, None, []
        for b in recut(batches, ROWS):
            for chunk, role, kind, _, n, a, bb, c, ids in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if kind < 0:
                    if key is not None:
                        yield finish(base, parts)
                    key, base, parts = chunk, (role, n, a, bb, c, ids), []
                else:
                    parts.append((kind, n, a, bb))
        if key is not None:
            yield finish(base, parts)

    dealt = rows.repartitionById(parts, F.pmod("chunk", F.lit(parts)).cast("int")).sortWithinPartitions("chunk", "kind", "range")
    return dealt.mapInArrow(run, schema)


def bucket(c: np.ndarray, most: int = BUCKETS) -> np.ndarray:
    """0 for unseen contexts, else 1 + the power of 2 at or below the count."""
    return np.minimum(np.frexp(c.astype(np.float64))[1], most - 1)


def estimates(lengths: np.ndarray, words: np.ndarray, both: np.ndarray, triples: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's bucket and its estimates from triples, pairs and words, by the counts of these at every token."""
    first = starts(lengths)
    word_before, pair_before = np.concatenate((words[:1], words[:-1])), np.concatenate((both[:1], both[:-1]))
    word_before[first] = pair_before[first] = words[lengths[0] - 1]  # ends, which are as many as documents
    share = lambda c, of: np.minimum(np.divide(c, of, out=np.zeros(len(c)), where=of > 0), 1.0)  # more only where hashes met
    where = np.where(pair_before > 0, BUCKETS - 1 + bucket(pair_before, PAIR_BUCKETS), bucket(word_before))
    return where, np.stack([share(triples, pair_before), share(both, word_before), words / max(n, 1)])


def learn(rows: list[tuple], words: int) -> np.ndarray:
    """Weights (triple, pair, word, uniform) of each bucket by EM over the histogram (bucket, n, mean estimates of triples, pairs and words)."""
    size = BUCKETS + PAIR_BUCKETS - 1
    out = np.tile(np.array(DEFAULT), (size, 1))
    if rows:
        x = np.array(rows, np.float64)
        b, n = x[:, 0].astype(int), x[:, 1]
        p = np.concatenate([x[:, 2:], np.full((len(x), 1), 1 / (words + 1))], axis=1)
        for _ in range(ROUNDS):
            share = out[b] * p
            share *= (n / share.sum(axis=1))[:, None]
            got = np.stack([np.bincount(b, share[:, i], size) for i in range(p.shape[1])], axis=1)
            every = got.sum(axis=0) / max(got.sum(), 1e-300)
            got += every  # a bucket without events has the weights of all
            out = got / got.sum(axis=1, keepdims=True)
        out = (out + 1e-6) / (1 + 1e-6 * out.shape[1])
    out[:BUCKETS, 0] = 0  # an unseen pair has no triples
    out[0, 1] = 0  # an unseen word has no pairs
    return out / out.sum(axis=1, keepdims=True)


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    ``weights`` (bucket, then triple, pair, word, uniform) replaces learning them. A chunk takes some ten times its
    bytes of a worker's memory.
    """
    chunks, parts = dealt_evenly(stored(cut(docs, chunk_bytes), "chunks"))
    tokens, deleted = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("role") == DELETED, F.col("n"))), F.lit(0))).first()
    ranges = max(8, round(tokens / (RANGE_TOKENS * max(1.0, tokens / WIDEN) ** (1 / 3))))
    bits = min(64, tokens.bit_length() + SPARE)
    answers = stored(answer(ask(chunks, ranges, bits), ranges), "answers")
    n, v = answers.where("chunk is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    left = n - deleted

    def histogram(role, ids, lengths, *counts) -> pa.RecordBatch:
        where, p = estimates(lengths, *(total - gone for total, gone in counts), left)
        bins = np.where(p > 0, np.floor(-np.log(np.where(p > 0, p, 1)) * STEPS) + 1, 0).astype(np.int64)
        code = (where.astype(np.int64) << 48) | (bins[0] << 32) | (bins[1] << 16) | bins[2]
        found, at = np.unique(code, return_inverse=True)
        return pa.record_batch([pa.array(found), pa.array(np.bincount(at)), *(pa.array(np.bincount(at, x)) for x in p)], ["code", "n", "p3", "p2", "p1"])

    if weights is None:
        of = F.col("role") == DELETED
        small = with_answers(chunks.where(of), answers.where(of), histogram, "code long, n long, p3 double, p2 double, p1 double", parts, bits)
        rows = small.groupBy("code").agg(*(F.sum(c).alias(c) for c in ("n", "p3", "p2", "p1"))).orderBy("code").collect()
        weights = learn([(r.code >> 48, r.n, r.p3 / r.n, r.p2 / r.n, r.p1 / r.n) for r in rows], v)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scores(role, ids, lengths, *counts) -> pa.RecordBatch:
        words, both, triples = (total for total, _ in counts)
        first = starts(lengths)
        base = np.log10((words + 0.1) / (n + 0.1 * (v + 1)))
        where, p = estimates(lengths, words, both, triples, n)
        w = weights[where]
        p = np.log10(w[:, 0] * p[0] + w[:, 1] * p[1] + w[:, 2] * p[2] + w[:, 3] / (v + 1))
        cols = [pa.array(ids, pa.int64()), pa.array(np.full(len(ids), role == HELD)), pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat((words > 0).astype(np.int64), first)), pa.array(np.full(len(ids), n)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(p, first))]
        return pa.record_batch(cols, names)

    return with_answers(chunks, answers, scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", parts, bits)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op9_lm_scores": op9_lm_scores}
