import collections
import random
import re

import numpy as np
import xxhash

from trackloom.llm import components, simhash


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(values, near=2):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    array = np.array(sorted(values), np.uint64)
    for v in values:
        for w in array[np.bitwise_count(array ^ np.uint64(v)) <= near]:
            a, b = root(v), root(int(w))
            parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in values}


def test_fingerprints():
    r = random.Random(2)
    for text in [None, "", " \t", "One", "one TWO", "a b c", "É é Ǳ a b c", "x " * 70_000, *(" ".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(50))]:
        assert simhash.fingerprint(text) == by_hand(text)


def test_anchors_cover(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    points = [0, (1 << 31) - 1, *(r.getrandbits(31) for _ in range(60))]
    pairs = [(p, p ^ (1 << r.randrange(31)) if r.random() < 0.8 else p) for p in points]
    d = spark.createDataFrame(pairs, "a long, b long").select(F.size(F.array_intersect(simhash.anchors(F.col("a")), simhash.anchors(F.col("b")))).alias("n"), F.size(simhash.anchors(F.col("a"))).alias("m"))
    assert all(x.n >= 1 and x.m in (1, 16) for x in d.collect())


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_links_of_dense_and_chained_groups(spark):
    r = random.Random(3)
    values = {0, (1 << 64) - 1, 1 << 63}
    for size in (3, 40, 400):  # few, and many at an anchor
        center = r.getrandbits(64)
        for _ in range(size):
            v = center
            for _ in range(r.randint(0, 4)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    chain = r.getrandbits(64)
    for k in range(0, 60, 2):
        values.add(chain)
        chain ^= 3 << k
    found = components.components(simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long")))
    root = {x.node & (1 << 64) - 1: x.root for x in found.collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for v, g in groups(values).items():
        want[g].add(v)
        got[root.get(v, signed(v))].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_groups_with_nulls_repeats_and_clashing_names(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (3, base), (3, base), (None, base), (9, base + " more"), (7, None), (8, "  "), (None, "lone words here"), (None, "lone words here"), (1, "other text altogether")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    fps = {simhash.fingerprint(t) for _, t in rows}
    g = groups(fps)
    least = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            least[g[simhash.fingerprint(t)]].append(i)
    want = sorted(map(repr, ((i, signed(simhash.fingerprint(t)), min(least[g[simhash.fingerprint(t)]], default=None)) for i, t in rows)))
    assert sorted(map(repr, (tuple(r) for r in simhash.near_duplicates(docs).collect()))) == want
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len(set(g.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}
