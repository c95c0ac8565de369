"""Quality classifier from weak labels.

Overlapping heuristic labellers vote junk, fine or nothing on every document. The counts of all vote
patterns, at most 3 to the number of labellers, are what expectation-maximisation needs to estimate each
labeller's rates of the votes for either class, and with them a posterior for every pattern. The posteriors
label a bounded sample on which a logistic scorer over hashed features is trained; the scorer then judges every
document. The sample is of at most SAMPLE distinct feature vectors, those with the smallest seeded hashes, so
copies of a text count once in training, and neither missing nor repeated ids matter.

Defined cases: null and blank text gets no votes and no features and is judged by the scorer's bias; repeated
rows count and are judged each; null doc_id is a document like any other; with an empty table nothing is
fitted and no rows come; ``keep_good`` passes all columns on as they are, whatever their names.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import recut, stored, table, text_bytes

JUNK, NONE, FINE = 0, 1, 2
#: Hashed dimensions, rows of the training sample, EM and training rounds, seed of the sample, bound of a worker's cache of word shapes.
DIMS, SAMPLE, EM_ROUNDS, ROUNDS, SEED, CACHE = 1 << 12, 20_000, 200, 300, 11, 100_000
#: Edges of the bins into which shares are cut as features.
EDGES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
#: Common words of four languages, written without accents' case. Fixed values.
STOPWORDS = frozenset("the of and to in a is that it for on was with as be by der die und das den von zu mit ist im des ein eine nicht de la le les et en un une du que est pour dans qui sur par el los las y por con se del una es no".encode().split())
SHAPES = bytes(97 if 97 <= b < 123 or b >= 128 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256))
RUN = re.compile(rb"(.)\1+", re.DOTALL)
SYMBOLS = bytes(b for b in range(33, 127) if chr(b) in "#$%&*+/<=>@[\\]^_`{|}~")


def measures(text: str | None) -> tuple[dict[str, float], Counter] | None:
    """Shares that describe the whole text, and the counts of its words' shapes; None without words."""
    raw = text_bytes(text)
    words = raw.lower().split()
    n = len(words)
    if not n:
        return None
    shaped = raw.translate(SHAPES)
    shapes, counts = Counter(shaped.split()), Counter(words)
    letters = shaped.count(b"a") + shaped.count(b"A")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {
        "same": sum(map(operator.eq, words, words[1:])) / n,
        "top": max(counts.values()) / n,
        "distinct": len(counts) / n,
        "stop": sum(counts[w] for w in STOPWORDS if w in counts) / n,
        "symbols": (len(raw) - len(raw.translate(None, SYMBOLS))) / len(raw),
        "upper": shaped.count(b"A") / max(letters, 1),
        "bangs": raw.count(b"!") / n,
        "bare": sum(c for s, c in shapes.items() if b"a" not in s and b"A" not in s and b"0" not in s) / n,
        "lines": 1 - len(set(lines)) / len(lines),
        "length": float(n),
    }, shapes


#: Name, measure, junk if above (or, negative, below), fine if at most (at least) that; words needed to vote.
LABELLERS = (
    ("repeats itself", "same", 0.15, 0.03, 8),
    ("one word rules", "top", 0.3, 0.15, 20),
    ("few distinct words", "distinct", -0.15, 0.3, 40),
    ("no common words", "stop", -0.01, 0.05, 30),
    ("symbols", "symbols", 0.06, 0.02, 4),
    ("shouts", "upper", 0.5, 0.15, 8),
    ("exclaims", "bangs", 0.3, 0.05, 8),
    ("bare marks", "bare", 0.2, 0.03, 8),
    ("repeats lines", "lines", 0.5, 0.1, 40),
)


def votes(m: dict[str, float]) -> int:
    """The labellers' votes as the digits of a number of base 3."""
    code = 0
    for _, name, junk, fine, needed in LABELLERS:
        x = m[name]
        vote = NONE if m["length"] < needed else JUNK if (x > junk if junk > 0 else x < -junk) else FINE if (x <= fine if junk > 0 else x >= fine) else NONE
        code = code * 3 + vote
    return code


def unvoted() -> int:
    return sum(NONE * 3**i for i in range(len(LABELLERS)))


class Shapes(dict):
    """A word's shape to its hashed dimension; runs of one class count as one."""

    def __missing__(self, shape: bytes) -> int:
        at = zlib.crc32(b"shape " + RUN.sub(rb"\1", shape)) % DIMS
        if len(shape) <= 64:  # long ones rarely come again
            if len(self) >= CACHE:
                self.clear()
            self[shape] = at
        return at


_shapes = Shapes()


def features(found: tuple[dict[str, float], Counter] | None) -> tuple[list[int], list[float]]:
    """Dimensions and values: square roots of the shapes' shares, and one-hot bins of the measures."""
    if found is None:
        return [], []
    m, shapes = found
    n, sums = m["length"], {}
    for shape, c in shapes.items():
        at = _shapes[shape]
        sums[at] = sums.get(at, 0) + c
    values = {at: (c / n) ** 0.5 for at, c in sums.items()}
    for name in m:
        size = np.log2(m[name]) / 16 if name == "length" else m[name]
        at = zlib.crc32(f"{name} {sum(size > e for e in EDGES)}".encode()) % DIMS
        values[at] = values.get(at, 0.0) + 1.0
    return list(values), list(values.values())


def described(docs: DataFrame) -> DataFrame:
    """doc_id, votes, dims, vals of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in recut(batches):
            codes, dims, vals = [], [], []
            for text in b.column(1).to_pylist():
                found = measures(text)
                codes.append(votes(found[0]) if found else unvoted())
                x, y = features(found)
                dims.append(x)
                vals.append(y)
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(codes, pa.int32()), pa.array(dims, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))], ["doc_id", "votes", "dims", "vals"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, votes int, dims array<int>, vals array<float>")


def posteriors(patterns: dict[int, int]) -> dict[int, float]:
    """P(junk) of each vote pattern, by EM over the patterns' counts; votes are independent given the class."""
    codes = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[c] for c in codes], np.float64)
    v = np.stack([codes // 3**i % 3 for i in range(len(LABELLERS))], axis=1)
    hot = np.eye(3)[v][:, :, [JUNK, FINE]]  # pattern, labeller, vote; not voting tells nothing
    junk = np.where((v == JUNK).any(axis=1), 0.9, 0.02)  # to begin with, any junk vote counts
    for _ in range(EM_ROUNDS):
        rates = []
        for share in (junk, 1 - junk):
            w = np.einsum("p,plv->lv", n * share, hot) + 0.5
            rates.append(np.log(w / w.sum(axis=1, keepdims=True)))
        prior = (n @ junk + 1) / (n.sum() + 2)
        a = np.log(prior) + np.einsum("plv,lv->p", hot, rates[0])
        z = np.log(1 - prior) + np.einsum("plv,lv->p", hot, rates[1])
        junk = 1 / (1 + np.exp(np.clip(z - a, -50, 50)))
    return dict(zip(codes.tolist(), junk.tolist(), strict=True))


def train(rows: list[tuple[list[int], list[float], float]]) -> tuple[np.ndarray, float]:
    """Weights and bias of P(junk) by full-batch Adam with decay on soft labels."""
    w, bias = np.zeros(DIMS), 0.0
    if not rows:
        return w, bias
    at = np.concatenate([np.asarray(d, np.int64) for d, _, _ in rows])
    x = np.concatenate([np.asarray(v, np.float64) for _, v, _ in rows])
    size = np.array([len(d) for d, _, _ in rows])
    row, y = np.repeat(np.arange(len(rows)), size), np.array([p for _, _, p in rows])
    m, s, mb, sb = np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], len(rows)) + bias, -50, 50)))
        g = np.bincount(at, x * (p - y)[row], DIMS) / len(rows) + 1e-5 * w
        gb = float((p - y).mean())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.1 * (m / fix) / (np.sqrt(s / fix2) + 1e-8)
        bias -= 0.1 * (mb / fix) / (sb / fix2) ** 0.5 if sb else 0.0
    return w, bias


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray, float]:
    """From ``described`` rows: the patterns' posteriors (all rows counted), and the scorer's weights and bias (at most ``sample`` rows)."""
    patterns = {r[0]: r[1] for r in rows.groupBy("votes").count().collect()}
    junk = posteriors(patterns) if patterns else {}
    total = sum(patterns.values())
    part = rows.select("dims", "vals", "votes", F.pmod(F.xxhash64(F.lit(SEED), "dims", "vals"), F.lit(1 << 60)).alias("h"))
    if total > sample:
        kinds = part.agg(F.approx_count_distinct("h", 0.01)).first()[0]
        part = part.where(F.col("h") < int(min(1.0, 0.95 * sample / max(kinds, 1)) * (1 << 60)))
    part = part.groupBy("h").agg(F.first("dims").alias("dims"), F.first("vals").alias("vals"), F.first("votes").alias("votes"))
    return junk, *train([(r.dims, r.vals, junk[r.votes]) for r in part.orderBy("h").limit(sample).collect()])


def judge(rows: DataFrame, junk: dict[int, float], weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, junk_votes, posterior (weak label's P(junk)), score (scorer's P(junk)), keep."""
    names = ["doc_id", "junk_votes", "posterior", "score", "keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in recut(batches, 4096):
            code = b.column(1).to_numpy(zero_copy_only=False)
            against = sum((code // 3**i % 3 == JUNK).astype(np.int64) for i in range(len(LABELLERS)))
            score = scores(b.column(2), b.column(3), weights, bias)
            yield pa.record_batch([b.column(0), pa.array(against, pa.int64()), pa.array([junk[c] for c in code.tolist()], pa.float64()), pa.array(score), pa.array(score <= 0.5)], names)

    return rows.mapInArrow(run, "doc_id long, junk_votes long, posterior double, score double, keep boolean")


def scores(dims: pa.ListArray, vals: pa.ListArray, weights: np.ndarray, bias: float) -> np.ndarray:
    size = np.diff(dims.offsets.to_numpy())
    x = weights[dims.flatten().to_numpy()] * vals.flatten().to_numpy()
    return 1 / (1 + np.exp(-np.clip(np.bincount(np.repeat(np.arange(len(size)), size), x, len(size)) + bias, -50, 50)))


def keep_good(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that a classifier fitted on them rejects; columns as they are."""
    _, weights, bias = fit(stored(described(docs), "described"), sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in recut(batches):
            found = [features(measures(x)) for x in b.column(at).to_pylist()]
            dims, vals = (pa.array([x[i] for x in found], pa.list_(k)) for i, k in ((0, pa.int32()), (1, pa.float32())))
            yield b.filter(pa.array(scores(dims, vals, weights, bias) <= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(described(table(spark, sf_dir, "documents")), "described")
    return judge(rows, *fit(rows))


QUERIES = {"op1_quality": op1_quality}
