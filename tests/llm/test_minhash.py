import random
import re

import numpy as np
import pytest

from trackloom.llm import minhash as m


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def set_of(text):
    w = words_of(text)
    return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def by_hand(rows):
    """(doc_id, text) to (doc_id, n, component, kept): all pairs of full sets."""
    sets = [set_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    of = [least[g] if s else r[0] for r, s, g in zip(rows, sets, group, strict=True)]
    return sorted(repr((r[0], len(s), c, r[0] == c)) for r, s, c in zip(rows, sets, of, strict=True))


def got(spark, rows, **how):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, entries string").repartition(3)
    return sorted(map(repr, (tuple(r) for r in m.near_duplicates(d, **how).collect())))


def families(seed, count, size, length, edits):
    """Texts in families of near copies, each of so many random edits at most."""
    r = random.Random(seed)
    for f in range(count):
        base = [f"w{r.randrange(5000)}" for _ in range(length)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, edits)):
                t[r.randrange(length)] = f"e{r.randrange(10**6)}"
            yield " ".join(t)


def test_shingles_are_those_of_the_words():
    for text in (None, "", " \t\n", "One", "one TWO", "a b c", "a b c a b c a b c", "É é Ǳ a b", "x\x0by\x0cz q", "w " * 40_000):
        assert len(m.shingles(text)) == len(set_of(text))
    assert list(m.shingles("A b C d")) == list(m.shingles("a  B\tc D"))


def test_minima_agree_as_often_as_sets_do():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = np.concatenate((a[:1700], r.integers(0, 1 << 63, 300).astype(np.uint64)))
    low, other = m.minima(a, 4, 180), m.minima(b, 4, 180)
    assert abs((low == other).mean() - 1700 / 2300) < 0.06
    assert (m.minima(a, 4, 20) == low[:20]).all()
    assert (m.minima(np.flip(a), 4, 20) == low[:20]).all()


def test_the_forest_misses_one_in_a_million():
    assert all((1 - (m.SHARE / 100) ** depth) ** orders < 1e-6 for depth, orders in m.FOREST)


@pytest.mark.parametrize("sides", [False, True])
def test_exact_links_span_what_all_pairs_link(sides):
    r = random.Random(4)
    sets = [m.shingles(t) for t in families(5, 6, 9, 60, 5)]
    side = np.array([r.randrange(2) for _ in sets]) if sides else None
    want = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 85 * (len(a) + len(sets[j]) - both) and (not sides or side[i] != side[j]):
                want = [want[j] if x == want[i] else x for x in want]
    have = list(range(len(sets)))
    for i, j in m.exact(sets, side):
        have = [have[j] if x == have[i] else x for x in have]
    assert [[x == y for y in want] for x in want] == [[x == y for y in have] for x in have]
    assert len(m.exact(sets, side)) == len(sets) - len(set(want))
    assert m.exact([]) == [] and m.exact(sets[:1]) == []


@pytest.mark.parametrize("how", [{}, {"few": 3, "block": 4}])
def test_against_all_pairs(spark, how):
    """With few = 3 regions are dense at every depth, and families of up to 30 lie in several blocks."""
    texts = [*families(1, 4, 30, 80, 6), *families(2, 20, 2, 50, 3), *families(3, 5, 1, 400, 0)]
    rows = list(enumerate(texts))
    random.Random(6).shuffle(rows)
    assert got(spark, rows, **how) == by_hand(rows)


def test_threshold_is_met_exactly(spark):
    base = [f"b{i}" for i in range(37)]  # 35 shingles
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x", "y"])), (3, " ".join(base[:30]))]  # 35 of 37; 28 of 35
    shared = [f"s{i}" for i in range(19)]  # 17 shingles
    rows += [(10, " ".join(shared)), (11, " ".join([*shared, "p", "q", "r"]))]  # 17 of 20: exactly 85 percent
    assert got(spark, rows) == by_hand(rows)
    assert sum("10, True" in x or "10, False" in x for x in got(spark, rows)) == 2


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(4, None), (5, ""), (6, " \t"), (None, None), (7, "one"), (3, "ONE"), (8, "one two"), (2, "one two"), (None, "one two"), (None, "lone words of nobody"), (9, "a b c"), (9, "a b c"), (9, "other text of the same id"), (12, long), (11, long + " tail"), (None, long)]
    assert got(spark, rows) == by_hand(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, " ")]) == [repr((1, 0, 1, True)), repr((2, 0, 2, True))]
