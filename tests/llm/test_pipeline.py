import collections

import corpus_pipeline
from test_bpe import LIBRARY

from trackloom.llm import mixing, quality, simhash


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    (_, keep), (_, dedup), (_, mix), (_, encode) = corpus_pipeline.STAGES
    good = keep(spark, docs, sf_dir).cache()
    # the classifier in plain Python
    rows = docs.collect()
    found = [quality.measures(r.text) for r in rows]
    patterns = collections.Counter(quality.votes(f[0]) if f else quality.unvoted() for f in found)
    junk = quality.posteriors(patterns)
    order = sorted(range(len(rows)), key=lambda i: rows[i].doc_id)
    weights, bias = quality.train([(*quality.features(found[i]), junk[quality.votes(found[i][0])]) for i in order])
    stays = set()
    for r, f in zip(rows, found, strict=True):
        d, v = quality.features(f)
        if sum(weights[a] * b for a, b in zip(d, v, strict=True)) + bias <= 0:
            stays.add(r.doc_id)
    assert good.columns == docs.columns and len({r.doc_id for r in good.collect()} ^ stays) <= 1
    # one of each group of fingerprints
    from test_simhash import groups

    fp = {r.doc_id: simhash.fingerprint(r.text) for r in good.collect()}
    g, first = groups(set(fp.values())), {}
    for i in sorted(fp):
        first.setdefault(g[fp[i]], i)
    one = dedup(spark, good, sf_dir).cache()
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(first.values())
    # copies as the mix says, of texts as they were
    text = {r.doc_id: r.text for r in rows}
    taken = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.mix(one).collect() if r.size}
    mixed = mix(spark, one, sf_dir).cache()
    assert mixed.columns == docs.columns and collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({i: n for i, n in taken.items() if n})
    out = encode(spark, mixed, sf_dir).collect()
    assert len(out) == mixed.count()
    for r in out[:50]:
        assert r.n_tokens == len(LIBRARY.encode(text[r.doc_id], add_special_tokens=False).ids)
    assert sorted(map(repr, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(repr, out))
