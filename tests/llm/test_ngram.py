import collections
import math
import random
import zlib

import numpy as np
import pytest

from trackloom.llm import ngram


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def by_hand(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in rows]


def some_rows():
    r = random.Random(3)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))) for i in range(300)]
    return [*rows, (1, "repeated Row"), (1, "repeated Row"), (None, "a b"), (7, None), (8, "  É"), (9, "long " * 20_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")


@pytest.mark.parametrize("chunk", [200, 8 << 20])
def test_counts_and_base_scores(spark, chunk):
    rows = some_rows()
    got = sorted((tuple(x) for x in ngram.score(frame(spark, rows), chunk).collect()), key=repr)
    want = sorted(by_hand(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def counted(rows):
    """Counts of words, pairs and triples; a document begins with two ends, which are no tokens of it."""
    c = collections.Counter(), collections.Counter(), collections.Counter()
    for _, text in rows:
        t = [b"", b"", *tokens(text)]
        for i in range(2, len(t)):
            for k in range(3):
                c[k][tuple(t[i - k : i + 1])] += 1
    contexts = collections.Counter(x[:2] for x in c[2].elements())
    return c, contexts


def model_score(text, counts, contexts, weights):
    """The score of one text, term by term."""
    c, n, v = counts, sum(counts[0].values()), len(counts[0])
    before = collections.Counter()
    for (a, _), m in c[1].items():
        before[a] += m
    total, t = 0.0, [b"", b"", *tokens(text)]
    for u, w, x in zip(t, t[1:], t[2:], strict=False):
        level = lambda m: min(m.bit_length(), 31)
        a, b, cc, d = weights[31 + level(contexts[u, w]) if contexts[u, w] else level(before[(w)])]
        p = a * c[2][u, w, x] / contexts[u, w] if contexts[u, w] else 0.0
        p += b * c[1][w, x] / before[w] if before[w] else 0.0
        total += math.log10(p + cc * c[0][(x,)] / n + d / (v + 1))
    return total


@pytest.mark.parametrize("chunk", [300, 8 << 20])
def test_scores_by_given_weights(spark, chunk):
    rows = some_rows()
    w = np.random.default_rng(4).dirichlet(np.ones(4), 63)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts, contexts = counted([x for x in rows if not held(x[0])])
    got = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in ngram.score(frame(spark, rows), chunk, w).collect())
    assert got == sorted((str(i), len(tokens(t)), round(model_score(t, counts, contexts, w), 6)) for i, t in rows)


def test_weights_are_learned_on_the_deleted_part(spark, monkeypatch):
    rows, fold = some_rows(), lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    counts, contexts = counted([x for x in rows if fold(x[0]) > 1])
    n, before = sum(counts[0].values()), collections.Counter()
    for (a, _), m in counts[1].items():
        before[a] += m
    bins = collections.defaultdict(lambda: np.zeros(4))
    for _, text in (x for x in rows if fold(x[0]) == 1):
        t = [b"", b"", *tokens(text)]
        for u, w, x in zip(t, t[1:], t[2:], strict=False):
            m = contexts[u, w]
            p = (counts[2][u, w, x] / m if m else 0.0, counts[1][w, x] / before[w] if before[w] else 0.0, counts[0][(x,)] / n)
            at = (31 + m.bit_length() if m else before[w].bit_length(), *(math.floor(-math.log(q) * ngram.STEPS + 1e-12) + 1 if q else 0 for q in p))
            bins[at] += (1, *p)
    v = len(counted([x for x in rows if fold(x[0])])[0][0])
    want = ngram.learn([(at[0], c[0], *(c[1:] / c[0])) for at, c in sorted(bins.items())], v)
    seen, learn = [], ngram.learn
    monkeypatch.setattr(ngram, "learn", lambda *a: seen.append(learn(*a)) or seen[0])
    ngram.score(frame(spark, rows))
    assert np.allclose(seen[0], want, atol=1e-6)


def test_numbers_are_dealt_evenly(spark):
    for sizes in ([5] * 20, [1] * 30 + [200], [3]):
        x = spark.createDataFrame([(p, i) for p, n in enumerate(sizes) for i in range(n)], "part int, seq long")
        chunks, parts = ngram.dealt_evenly(x)
        load = collections.Counter(r.chunk % parts for r in chunks.collect())
        assert max(load.values()) <= 5 and len({r.chunk for r in chunks.collect()}) == sum(sizes)


def test_empty_and_untrained(spark):
    d = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    got = ngram.score(d).collect()
    assert len(got) == d.count() and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert ngram.score(d.limit(0)).count() == 0


def test_model_beats_its_base_on_held_out_text(spark, sf_dir):
    rows = [r for r in ngram.score(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and rows


def test_em_finds_the_weights_that_made_the_data():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(50) * 0.2), rng.dirichlet(np.ones(50) * 0.2)
    events = np.where(rng.random(60_000) < 0.7, rng.choice(50, 60_000, p=p[0]), rng.choice(50, 60_000, p=p[1]))
    n = np.bincount(events, minlength=50)
    w = ngram.learn([(5, int(c), 0.0, float(a), float(b)) for c, a, b in zip(n, *p, strict=True) if c], 10**9)
    assert abs(w[5, 1] - 0.7) < 0.03 and np.allclose(w.sum(axis=1), 1) and w[0, 1] == w[5, 0] == 0


def test_packing_is_lossless():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        assert (ngram.unpack(ngram.pack(keys), len(keys)) == keys).all()
        counts = rng.integers(0, 1 << (20 if n < 1000 else 40), n)
        assert (ngram.counts_of(ngram.counts_bytes(counts), n) == counts).all()


def test_hashes_that_meet_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(ngram, "SPARE", -4)
    rows = some_rows()
    got = ngram.score(frame(spark, rows), 300).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
