import hashlib
import random
import zlib

from pyspark.sql import functions as F

from trackloom.llm import merkle as m

h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
runs_of = lambda x: [x[i : i + 8] for i in range(0, len(x), 8)]


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*r) for r in runs_of(levels[-1])])
    return levels


def siblings(levels, i):
    """(those to the left, those to the right) at each level."""
    for level in levels[:-1]:
        at = i // 8 * 8
        yield level[at:i], level[i + 1 : at + 8]
        i //= 8


def by_hand(rows):
    """(doc_id, source, lang, n_chars, text) to the result's rows, tree by tree."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in of[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for t, x in enumerate(langs):
        for i, r in enumerate(of[x]):
            way = [*siblings(trees[x], i), *siblings(top, t)]
            node = leaf((*r[:4], lowered(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r)
            for left, right in way:
                node = h(*left, node, *right)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], h(*(s for left, right in way for s in (*left, *right))), node, node == top[-1][0]))
    return sorted(map(repr, out))


def got(spark, tmp_path, rows):
    d = spark.createDataFrame([(*r, b"x", 0) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf binary, t int")
    d.repartition(5).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(repr, (tuple(r) for r in m.op11_merkle(spark, str(tmp_path)).collect())))


def test_trees_of_many_sizes(spark, tmp_path):
    """Sizes around powers of 8, and a tree of more than one region."""
    r = random.Random(3)
    rows = []
    for lang, n in [("de", 1), ("en", 2), ("fr", 8), ("é", 9), ("z", 64), ("Z", 65), ("", 17), (None, 70), ("hot", 4200)]:
        rows += [(r.randrange(10**9), f"s{i % 3}", lang, i, f"Text {i}" if i % 2 else f"text é {i}") for i in range(n)]
    assert got(spark, tmp_path, rows) == by_hand(rows)


def test_many_languages(spark, tmp_path):
    rows = [(i, None, f"l{i % 100}", None, "T") for i in range(250)]
    assert got(spark, tmp_path, rows) == by_hand(rows)


def test_odd_rows(spark, tmp_path):
    long = "Ab " * 100_000
    rows = [(None, None, None, None, None), (None, "s", "en", 1, "A"), (None, "s", "en", 1, "A"), (3, "s", "en", 1, "A"), (3, "s", "en", 1, "A"), (3, "s", "en", 1, "B"), (-5, "", "", 0, ""), (12, "a:b", "en", -7, long), (0, "s", None, 2, "ÄÖ lower only Ä")]
    assert got(spark, tmp_path, rows) == by_hand(rows)
    assert got(spark, tmp_path, rows[3:4]) == by_hand(rows[3:4])
    assert got(spark, tmp_path, []) == []


def test_any_change_of_a_row_is_found(spark, tmp_path):
    rows = [(i, "s", "en", 3, f"Text {i}") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert {r.verified for r in m.manifest(d, F.lit(False)).collect()} == {True}
    assert {r.verified for r in m.manifest(d, F.lit(True)).collect()} == {False}


def test_coordinates_are_not_broadcast(spark, tmp_path):
    """They are many to a leaf, but Spark takes them for as small as the leaves' file."""
    rows = [(i, "s", "en", 3, f"Text {i}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    plan = m.manifest(d, F.lit(False))._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "Broadcast" not in plan
