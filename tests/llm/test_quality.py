import itertools
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from trackloom.llm import quality as q


def test_held_out_accuracy_against_labels(spark, sf_dir):
    """Labels take no part in the fit, so all of them are held out."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = q.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n, right, lost = got.agg(F.count(F.lit(1)), F.count_if((F.col("quality") == 1) == F.col("keep")), F.count_if((F.col("quality") == 1) & ~F.col("keep"))).first()
    assert right / n > 0.97 and lost / n < 0.005


def test_em_recovers_labellers():
    rng = np.random.default_rng(1)
    junk = rng.random(20_000) < 0.2
    code = np.zeros(20_000, int)
    for _ in q.LABELLERS:
        against = np.where(junk, rng.random(20_000) < 0.6, rng.random(20_000) < 0.03)
        code = code * 3 + np.where(rng.random(20_000) < 0.2, q.NONE, np.where(against, q.JUNK, q.FINE))
    kinds, n = np.unique(code, return_counts=True)
    p = q.posteriors(dict(zip(kinds.tolist(), n.tolist(), strict=True)))
    said = np.array([p[c] for c in code.tolist()])
    assert ((said > 0.5) == junk).mean() > 0.97


def test_not_voting_tells_nothing():
    p = q.posteriors({q.unvoted(): 5, 0: 10, 3 ** len(q.LABELLERS) - 1: 90})
    assert 0.05 < p[q.unvoted()] < 0.2


def test_nulls_repeats_and_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.select("doc_id", "text", F.lit("x").alias("votes"), F.lit(1).alias("keep"))
    odd = spark.createDataFrame([(None, None, "a", 1), (1, "", "b", 2), (1, "", "b", 2), (2, "buy!! " * 100_000, "c", 3)], "doc_id long, text string, votes string, keep int")
    kept = q.keep_good(own.unionByName(odd))
    assert kept.columns == own.columns and kept.where("text = ''").count() == 2 and kept.where("doc_id is null").count() == 1 and kept.where("text like 'buy%'").count() == 0
    assert q.keep_good(odd.limit(0)).count() == 0


def test_sample_is_bounded_and_runs_agree(spark, sf_dir):
    rows = q.described(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    a, b = q.fit(rows, 50), q.fit(rows.repartition(3), 50)
    assert np.allclose(a[1], b[1]) and a[0] == b[0]


def test_a_long_word_counts_to_its_end():
    word = b"aA" * 40
    at = {q._shapes[word + x] for x in (b"", b"0", b"-", b"0-0")}
    assert len(at) == 4 and q._shapes[b"aaAA" * 90 + b"00"] == q._shapes[b"aA" * 90 + b"0"]
    assert not any(len(x) > 64 for x in q._shapes)


def plain_measures(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return None, []
    n, size = len(words), len(text.encode())
    ascii_letters, high = re.findall("[A-Za-z]", text), sum(b >= 128 for b in text.encode())
    lines = [x for x in text.split("\n") if x.strip(" \t\r\v\f")]
    return {
        "same": sum(words[i] == words[i - 1] for i in range(1, n)) / n,
        "top": max(words.count(w) for w in set(words)) / n,
        "distinct": len(set(words)) / n,
        "stop": sum(w.encode() in q.STOPWORDS for w in words) / n,
        "symbols": sum(text.count(c) for c in "#$%&*+/<=>@[\\]^_`{|}~") / size,
        "upper": len(re.findall("[A-Z]", text)) / max(len(ascii_letters) + high, 1),
        "bangs": text.count("!") / n,
        "bare": sum(all(ord(c) < 128 and not c.isalnum() for c in w) for w in words) / n,
        "lines": 1 - len(set(lines)) / len(lines),
        "length": float(n),
    }, re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_votes(m):
    said = []
    for _, name, junk, fine, least in q.LABELLERS:
        low = junk < 0
        if m is None or m["length"] < least:
            said.append(None)
        elif (m[name] < -junk) if low else (m[name] > junk):
            said.append("junk")
        elif (m[name] >= fine) if low else (m[name] <= fine):
            said.append("fine")
        else:
            said.append(None)
    return said


def plain_posteriors(said):
    """EM over documents one by one."""
    p = [0.9 if "junk" in v else 0.02 for v in said]
    for _ in range(q.EM_ROUNDS):
        rate = {}
        for kind in (0, 1):
            for i in range(len(q.LABELLERS)):
                n = {vote: 0.5 + sum((x, 1 - x)[kind] for x, v in zip(p, said, strict=True) if v[i] == vote) for vote in ("junk", "fine")}
                rate[kind, i] = {vote: c / (n["junk"] + n["fine"]) for vote, c in n.items()}
        prior = (sum(p) + 1) / (len(p) + 2)
        for d, v in enumerate(said):
            a, z = prior, 1 - prior
            for i, vote in enumerate(v):
                if vote:
                    a, z = a * rate[0, i][vote], z * rate[1, i][vote]
            p[d] = a / (a + z)
    return p


def plain_features(m, words):
    x = np.zeros(q.DIMS, np.float64)
    for w in words:
        shape = b"".join(b"a" if 97 <= b < 123 or b >= 128 else b"A" if 65 <= b < 91 else b"0" if 48 <= b < 58 else bytes([b]) for b in w.encode())
        x[zlib.crc32(b"shape " + b"".join(bytes([k]) for k, _ in itertools.groupby(shape))) % q.DIMS] += 1 / len(words)
    x = np.sqrt(x)
    for name, value in (m or {}).items():
        value = math.log2(value) / 16 if name == "length" else value
        x[zlib.crc32(f"{name} {len([e for e in q.EDGES if value > e])}".encode()) % q.DIMS] += 1
    return x.astype(np.float32)


def test_against_a_plain_version(spark, sf_dir):
    """Measures from characters, EM document by document, Adam on a dense matrix: nothing of the operator's own but its fixed values."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = [plain_measures(r.text) for r in docs]
    said = [plain_votes(m) for m, _ in found]
    junk = plain_posteriors(said)
    x = np.stack([plain_features(m, words) for m, words in found]).astype(np.float64)
    _, first = np.unique(x, axis=0, return_index=True)
    a, y = x[first], np.array(junk)[first]
    w, moments = np.zeros(q.DIMS + 1), np.zeros((2, q.DIMS + 1))
    a = np.hstack([a, np.ones((len(a), 1))])
    for t in range(1, q.ROUNDS + 1):
        g = a.T @ (1 / (1 + np.exp(-(a @ w))) - y) / len(a)
        g[:-1] += 1e-5 * w[:-1]
        moments = np.stack([0.9 * moments[0] + 0.1 * g, 0.999 * moments[1] + 0.001 * g * g])
        w -= 0.1 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
    score = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    got = {r.doc_id: r for r in q.op1_quality(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r, v, p, s in zip(docs, said, junk, score, strict=True):
        mine = got[r.doc_id]
        assert mine.junk_votes == v.count("junk") and abs(mine.posterior - p) < 1e-6, (r.doc_id, mine, p)
        assert abs(mine.score - s) < 1e-3 and (mine.keep == (s <= 0.5) or abs(s - 0.5) < 1e-3), (r.doc_id, mine, s)
