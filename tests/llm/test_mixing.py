import collections
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trackloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, taken int, h string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "y") for i, t, s in rows], SCHEMA)


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, full = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        level = (want - sum(full.values())) / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > 2 * sizes[s]]
        if not over:
            return {s: full.get(s, level * w[s]) for s in order}
        full |= {s: Fraction(2 * sizes[s]) for s in over}


def check(spark, rows):
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    by = targets_by_hand(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source_size) for r in got) == sorted((i is None, i or 0, size(t), sizes[s]) for i, t, s in rows)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and abs(r.target - by[r.source]) < 1e-6 * (1 + r.target)
        taken[r.source] += r.taken
    block = min(64, max(1, float(sum(by.values())) // 4096))
    for s in sizes:
        assert abs(taken[s] - by[s]) <= 2 * block
    assert sorted(map(repr, mixing.mix(docs.repartition(3)).collect())) == sorted(map(repr, got))


def test_sources_come_near_targets_one_holds_most(spark):
    r = random.Random(1)
    check(spark, [(i, " ".join("w" * r.randint(1, 60) for _ in range(r.randint(0, 300))), r.choice(["hot", "hot", "hot", "b", "a", "é", None, "z"])) for i in range(800)])


def test_nulls_ties_and_repeats(spark):
    check(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (1, "x", "s"), (None, "a b", None), (2, None, "t"), (3, "", "t"), (4, "   one", "u"), (5, "w " * 50_000, "u")])


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    r = mixing.mix(documents(spark, [(1, "", "a"), (2, None, "b")])).collect()
    assert [(x.size, x.target, x.taken) for x in r] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1003])
def test_apportionment_is_sainte_lague(spark, seats):
    votes = {i: float(v) for i, v in enumerate([500, 33, 33, 0, 1, 250, 7, 999])}
    got = {r.i: r.won for r in mixing.apportion(spark.createDataFrame([(i, v, seats) for i, v in votes.items()], "i int, v double, seats long"), [], ["i"], "v", "seats").collect()}
    want = dict.fromkeys(votes, 0)
    for _ in range(seats):
        want[min(votes, key=lambda i: (-votes[i] / (2 * want[i] + 1), i))] += 1
    assert got == want


def test_mixed_documents_keep_columns_and_copies(spark):
    rows = [(i, "w " * (i % 9), "abc"[i % 3]) for i in range(60)] + [(3, "w w w", "a"), (3, "w w w", "a")]
    docs = documents(spark, rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    want = mixing.mix(docs).select(F.floor(F.coalesce(F.try_divide("taken", "size"), F.lit(0.0)) + 0.5).alias("n")).agg(F.sum("n")).first()[0]
    assert out.count() == want


@pytest.fixture
def small_shards(monkeypatch):
    for name, value in (("SHARD_DOCS", 20), ("GROUP", 3), ("SPREAD", 4)):
        monkeypatch.setattr(mixing, name, value)


def hot_rows():
    r = random.Random(5)
    rows = [(None, f"w{i} " * r.randint(1, 40), "a") for i in range(300)]  # rows without id, of different texts
    rows += [(7, "the same row again", "a")] * 150 + [(7, f"other {i} " * 3, "b") for i in range(100)] + [(None, None, "b")] * 60
    return rows + [(i, "x y z " * r.randint(1, 30), r.choice("abc")) for i in range(100, 300)]


def test_rows_without_id_and_repeats_in_many_shards(spark, small_shards):
    check(spark, hot_rows())


def test_hot_ids_spread(spark):
    docs = documents(spark, [(None, f"w{i}", "a") for i in range(2000)])
    assert docs.select(mixing.dealt_by(1)).distinct().count() == 2000


def test_repeats_and_missing_ids_match_the_sql(spark):
    import duckdb

    docs = documents(spark, hot_rows()).select("doc_id", "text", "source")
    con = duckdb.connect()
    con.register("given", docs.toPandas().astype({"doc_id": "Int64"}))
    con.execute("create table documents as select * from given")
    want = con.execute(mixing.SQL["op4_mix_sources"]).fetchall()
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    same = lambda rows: sorted(repr((i, n, m, round(t, 6), k)) for i, n, m, t, k in rows)
    assert same(got) == same(want)


def test_whole_documents_of_hot_rows(spark, small_shards):
    docs = documents(spark, hot_rows())
    x = mixing.mixed_documents(docs)
    assert x.columns == docs.columns
    given, took = (collections.Counter((r.doc_id, r.text, r.source) for r in d.collect()) for d in (docs, x))
    assert all(n <= 2 * given[k] for k, n in took.items())
    whole = collections.Counter()
    for r in mixing.mix(docs).collect():
        whole[r.source] += int(r.taken / r.size + 0.5) if r.size else 0
    assert collections.Counter(s for (_, _, s), n in took.items() for _ in range(n)) == whole
