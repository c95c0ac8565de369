"""Merkle dataset manifest with coordinate lookup proofs. DataFrame functions only.

Every row is a leaf; the leaves of a language, in order, are the lowest level of its tree, and the languages'
roots, in order, that of the manifest's. A level's node stands for ARITY nodes below. All nodes are one table,
keyed by tree, level and index. A proof is a lookup: from its index and its tree's size alone a leaf knows the
coordinates of all siblings up to the root, explodes them, joins the node table and folds what comes back in
order.

Leaves of a subtree of REGION levels are a region. Nodes below a region's top are asked for by its own leaves only;
those above, which all leaves of a tree need, are looked up once for every region and asked for there. So no
node is a hot key, whatever a tree's share of the rows, and what a region holds is bounded. Leaves find their
index by ranges of (tree, key) and the sums of the ranges before. Spark takes exploded coordinates for no larger than the
file they stem from and would broadcast them, so joins of what grows with the leaves ask for a merge.

Defined cases: null values are ``-``; rows without doc_id stand first in their tree and are never tampered with; rows
that share a doc_id are ordered by their leaves, and equal rows are equal leaves in a place each; an empty table
has no root and gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import table

#: Children of a node (a power of 2), its binary logarithm, and levels of a region: 8 ** 4 leaves.
ARITY, BITS, REGION = 8, 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Marks of coordinates: levels of the manifest's own tree come above those of the languages' trees; the tree's root is asked for as well.
TOP, OWN_ROOT, MANIFEST = 100, 99, -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """sha256 as 32 bytes; tables and shuffles hold these, hashes are taken of lowercase hex."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_of(**changed: Column) -> Column:
    """The digest of a row's fields, each ``-`` or its byte count, a colon and its value."""
    values = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)))


def levels(n: Column) -> Column:
    """How many levels are below the root of ``n`` leaves: least k with ARITY ** k >= n."""
    return sum((F.when(n > ARITY**k, 1).otherwise(0) for k in range(62 // BITS + 1)), F.lit(0))


def up(index: Column, by: Column) -> Column:
    """The index of a node's ancestor so many levels above."""
    return F.call_function("shiftright", index, (by * BITS).cast("int"))


def range_sorted(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A written table of ``df`` with its range ``_b`` in the order and its place ``_nth`` there, from 0."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    # the id numbers the rows of a partition in order below bit 33, and the partition above
    return x.select("*", F.shiftright("_at", 33).alias("_b"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")).drop("_at")


def placed(leaves: DataFrame) -> tuple[DataFrame, int]:
    """(tree, key, leaf, changed) with t (the tree's place among all), i (the leaf's in its tree) and n (the tree's size); and the number of trees."""
    x = range_sorted(stored(leaves, "leaves"), ["tree", "key", "leaf"], "ranked")
    parts = x.groupBy("tree", "_b").agg(F.count(F.lit(1)).alias("c"), F.min("_nth").alias("first"))
    w = Window.partitionBy("tree")
    parts = parts.withColumns({"n": F.sum("c").over(w), "before": F.coalesce(F.sum("c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    parts = stored(parts, "places")
    trees = range_sorted(parts.select("tree").distinct(), ["tree"], "trees")
    above = trees.groupBy("_b").agg(F.count(F.lit(1)).alias("c"))  # a row for each range
    above = above.select("_b", F.coalesce(F.sum("c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    trees = trees.join(F.broadcast(above), "_b").select("tree", (F.col("above") + F.col("_nth")).alias("t"))
    parts = parts.join(trees, "tree")
    x = x.join(parts, ["tree", "_b"]).select("t", (F.col("before") + F.col("_nth") - F.col("first")).alias("i"), "n", "key", "leaf", "changed")
    return stored(x, "placed"), trees.count()


def all_nodes(leaves: DataFrame) -> DataFrame:
    """(t, i, n, hash), the lowest level of each tree, to t, level, i, n, hash of all levels; n: the level's number of nodes."""
    below = leaves.select("t", F.lit(0).alias("level"), "i", "n", "hash")
    found, most = below, below.agg(F.max("n")).first()[0] or 0
    level = 0
    while most > 1:
        g = below.where("n > 1").groupBy("t", "n", up(F.col("i"), F.lit(1)).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "hash"))).alias("x"))
        level, most = level + 1, -(-most // ARITY)
        below = stored(g.select("t", F.lit(level).alias("level"), "i", (up(F.col("n") - 1, F.lit(1)) + 1).alias("n"), digest(F.concat_ws("", F.transform("x", lambda y: hexed(y["hash"])))).alias("hash")), "level")
        found = found.unionByName(below)
    return found


def sibling_coordinates(index: Column, n: Column, at: int = 0, mark: int = 0) -> Column:
    """(mark, level, j) of the siblings of a node at level ``at`` and of its ancestors, in a tree of ``n`` leaves; the mark is that given plus the level."""

    def of_level(level: Column) -> Column:
        own = up(index, level - at)
        first = up(own, F.lit(1)) * ARITY
        run = F.sequence(first, F.least(first + ARITY - 1, up(n - 1, level)))
        return F.transform(F.filter(run, lambda j: j != own), lambda j: F.struct((level + mark).alias("mark"), level.alias("level"), j.alias("j")))

    top = levels(n)
    steps = F.when(top > at, F.sequence(F.lit(at), top - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(steps, of_level))


def region_nodes(nodes: DataFrame, leaves: DataFrame, trees: int) -> DataFrame:
    """t, region, mark, j, hash: every node that the region's leaves ask for."""
    low = nodes.where((F.col("t") != MANIFEST) & (F.col("level") < REGION))
    low = low.select("t", up(F.col("i"), REGION - F.col("level")).alias("region"), F.col("level").alias("mark"), F.col("i").alias("j"), "hash")
    regions = leaves.select("t", up(F.col("i"), F.lit(REGION)).alias("region"), "n").distinct()
    own = F.transform(sibling_coordinates(F.col("region"), F.col("n"), REGION), lambda c: F.struct(F.col("t").alias("of"), c["mark"].alias("mark"), c["level"].alias("level"), c["j"].alias("j")))
    above = F.transform(sibling_coordinates(F.col("t"), F.lit(trees).cast("long"), 0, TOP), lambda c: F.struct(F.lit(MANIFEST).cast("long").alias("of"), c["mark"].alias("mark"), c["level"].alias("level"), c["j"].alias("j")))
    root = F.array(F.struct(F.lit(MANIFEST).cast("long").alias("of"), F.lit(OWN_ROOT).alias("mark"), F.lit(0).alias("level"), F.col("t").alias("j")))
    asked = regions.select("t", "region", F.explode(F.concat(own, above, root)).alias("c")).select("t", "region", "c.*")
    there = nodes.select(F.col("t").alias("of"), "level", F.col("i").alias("j"), "hash")
    return low.unionByName(asked.hint("merge").join(there, ["of", "level", "j"]).select("t", "region", "mark", "j", "hash"))


def proofs(leaves: DataFrame, nodes: DataFrame, trees: int) -> DataFrame:
    """t, i, proof: sorted (mark, j, hash) of all siblings of a leaf and its ancestors, and of its tree's root."""
    at = F.concat(sibling_coordinates(F.col("i"), F.col("n")), sibling_coordinates(F.col("t"), F.lit(trees).cast("long"), 0, TOP))
    at = F.concat(F.transform(at, lambda c: F.struct(c["mark"].alias("mark"), c["j"].alias("j"))), F.array(F.struct(F.lit(OWN_ROOT).alias("mark"), F.col("t").alias("j"))))
    asked = leaves.select("t", "i", up(F.col("i"), F.lit(REGION)).alias("region"), F.explode(at).alias("c")).select("t", "i", "region", "c.*")
    found = asked.hint("merge").join(region_nodes(nodes, leaves, trees), ["t", "region", "mark", "j"])
    return found.groupBy("t", "i").agg(F.array_sort(F.collect_list(F.struct("mark", "j", "hash"))).alias("proof"))


def folded(leaf: Column, trees: int) -> Column:
    """The root that a leaf and its siblings give, in hex."""

    def steps(index: Column, n: Column, mark: int) -> Column:
        top = levels(n)
        at = F.when(top > 0, F.sequence(F.lit(0), top - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.struct((k + mark).alias("mark"), up(index, k).alias("own")))

    def fold(node: Column, step: Column) -> Column:
        side = lambda test: F.concat_ws("", F.transform(F.filter("proof", lambda p: (p["mark"] == step["mark"]) & test(p["j"])), lambda p: hexed(p["hash"])))
        return F.sha2(F.concat(side(lambda j: j < step["own"]), node, side(lambda j: j > step["own"])).cast("binary"), 256)

    way = F.concat(steps(F.col("i"), F.col("n"), 0), steps(F.col("t"), F.lit(trees).cast("long"), TOP))
    return F.aggregate(way, hexed(leaf), fold)


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of ``docs``; a row is verified with its letters A-Z in lower case where ``tampered`` holds."""
    changed = F.when(tampered, leaf_of(text=F.translate("text", UPPER, LOWER)))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null first, bytes in order
    leaves, trees = placed(docs.select(tree.alias("tree"), F.col("doc_id").alias("key"), leaf_of().alias("leaf"), changed.alias("changed")))
    nodes = all_nodes(leaves.select("t", "i", "n", F.col("leaf").alias("hash")))
    subroots = nodes.where("n = 1").select(F.lit(MANIFEST).cast("long").alias("t"), F.col("t").alias("i"), F.lit(trees).cast("long").alias("n"), "hash")
    top = all_nodes(stored(subroots, "subroots"))
    last = top.where("n = 1").first()
    root = F.lit(last.hash.hex() if last else None).cast("string")
    x = leaves.hint("merge").join(proofs(leaves, nodes.unionByName(top), trees), ["t", "i"])
    siblings = F.filter("proof", lambda p: p["mark"] != OWN_ROOT)
    own = F.filter("proof", lambda p: p["mark"] == OWN_ROOT)[0]["hash"]
    x = x.withColumn("again", folded(F.coalesce("changed", "leaf"), trees))
    proof = F.sha2(F.concat_ws("", F.transform(siblings, lambda p: hexed(p["hash"]))).cast("binary"), 256)
    return x.select(F.col("key").alias("doc_id"), hexed(F.col("leaf")).alias("leaf"), hexed(own).alias("subroot"), root.alias("root"), proof.alias("proof_sha256"), F.col("again").alias("folded_root"), (F.col("again") == root).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return manifest(table(spark, sf_dir, "documents"), F.coalesce(crc % 3 == 0, F.lit(False)))


def _sql(lang_levels: int = 8, top_levels: int = 5) -> str:
    """Levels are written out: enough for 8 ** 8 documents a language and 8 ** 5 languages."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in FIELDS[:-1])} || {text})"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [
        "crc AS (SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k))",
        "d AS (SELECT row_number() OVER () AS r, documents.*, xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: xor(crc.t[CAST((xor(c, b) & 255) + 1 AS INTEGER)], c >> 8)), 4294967295) AS crc FROM documents, crc)",
        f"leaves AS (SELECT r, doc_id, lang, {leaf(field('text'))} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(field(lowered))} END AS changed FROM d)",
        "f0 AS (SELECT r, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, coalesce(changed, leaf) AS h, '' AS proof FROM leaves)",
        "n0 AS (SELECT f.lang, i, count(*) OVER (PARTITION BY f.lang) AS n, leaf AS h FROM f0 f JOIN leaves l ON f.r = l.r)",
    ]

    def climb(f: str, n: str, key: str, k: int) -> None:
        same = f"s.{key} IS NOT DISTINCT FROM f.{key}" if key else "true"
        own = f"f.{key}, " if key else ""
        parts.append(f"""{f}{k + 1} AS (SELECT f.r, {own}f.i // 8 AS i, CASE WHEN max(s.n) = 1 THEN f.h ELSE sha256(coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < f.i), '') || f.h
  || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > f.i), '')) END AS h, f.proof || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> f.i), '') AS proof
  FROM {f}{k} f JOIN {n}{k} s ON {same} AND s.i // 8 = f.i // 8 GROUP BY f.r, {own}f.i, f.h, f.proof)""")
        parts.append(f"{n}{k + 1} AS (SELECT {key + ', ' if key else ''}i // 8 AS i, any_value((n + 7) // 8) AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {n}{k} GROUP BY ALL)")

    for k in range(lang_levels):
        climb("f", "n", "lang", k)
    parts.append(f"m0 AS (SELECT row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h, lang FROM n{lang_levels})")
    parts.append(f"g0 AS (SELECT f.r, m.i, f.h, f.proof FROM f{lang_levels} f JOIN m0 m ON m.lang IS NOT DISTINCT FROM f.lang)")
    parts.append("t0 AS (SELECT i, n, h FROM m0)")
    for k in range(top_levels):
        climb("g", "t", "", k)
    body = ", ".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)
    return f"""WITH {body}
SELECT l.doc_id, l.leaf, m.h AS subroot, t.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = t.h AS verified
FROM leaves l JOIN g{top_levels} g ON g.r = l.r JOIN m0 m ON m.lang IS NOT DISTINCT FROM l.lang, t{top_levels} t"""


QUERIES = {"op11_merkle": op11_merkle}
SQL = {"op11_merkle": _sql()}
