"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

The words of a source's documents, in seeded order and dealt into shards, form circular lines. Blocks of
equal length on these lines are the seats of an apportionment: highest quotients ``votes / (2 k + 1)`` give
every source an integer number of blocks, and the source's blocks go in the same way to groups of its shards and
within these to shards. A shard then takes its blocks from a seeded block on, round the line and at most twice.

A document is dealt by a hash of its id and text, so neither rows without id nor those that repeat one are a hot
shard; rows that agree in both are one entry with their number, in parts of bounded size that go to shards in turn.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source without
words has target 0; equal rows (repeated doc_id) each stand for themselves; an empty table gives no rows;
other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, row_hash, seeded, stored, table

SEED = 20240229
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
#: Words of a block: a 4096th of the mix, from 1 to 64.
BLOCK_WORDS, BLOCKS = 64, 4096
#: Documents of a shard on average, shards of a group, equal rows of a part, and the parts of a source in the join that brings its target.
SHARD_DOCS, GROUP, SPREAD, SALTS = 4096, 1024, 256, 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apportion(items: DataFrame, group: list[str], order: list[str], votes: str, seats: str) -> DataFrame:
    """Adds ``won``: each item's share of the group's ``seats`` by highest quotients votes / (2 k + 1), ties to the first in ``order``.

    Only seats near the fair share are contested: with n items and S seats, every item surely has those of
    (S - n) and none beyond those of (S + n), so about three quotients an item are ranked.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    fair = lambda s: F.floor(F.coalesce(F.try_divide(F.col(votes) * F.greatest(s, F.lit(0)), F.col("_all")), F.lit(0.0)) + F.lit(0.5)).cast("long")
    x = items.withColumns({"_all": F.sum(votes).over(g), "_n": F.count(F.lit(1)).over(g)})
    x = x.withColumns({"_lo": fair(F.col(seats) - F.col("_n")), "_hi": fair(F.col(seats) + F.col("_n"))})
    x = x.withColumn("_left", F.col(seats) - F.sum("_lo").over(g))
    x = x.withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
    rank = F.row_number().over(g.orderBy(F.desc(F.col(votes) / (2 * F.col("_k") + 1)), *order, "_k"))
    x = x.withColumn("_got", (rank <= F.col("_left")) & (F.col(votes) > 0))
    keep = [c for c in items.columns]
    return x.groupBy(*keep).agg((F.first("_lo") + F.count_if("_got")).alias("won"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, n_docs) to the same with ``place`` and ``target``: shares by weight, stopped at limit times the size, the excess reshared."""
    one = Window.partitionBy(F.lit(1))
    x = sources.withColumn("place", F.row_number().over(one.orderBy(F.asc_nulls_last("source"))) - 1)
    x = x.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    x = x.withColumns({"top": F.col("source_size").cast("double") * limit, "want": F.sum("source_size").over(one) * F.lit(share)})
    full = one.orderBy(F.col("top") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("level", (F.col("want") - F.coalesce(F.sum("top").over(full), F.lit(0.0))) / (F.sum("w").over(one) - F.coalesce(F.sum("w").over(full), F.lit(0.0))))
    fits = F.when(F.col("level") <= F.col("top") / F.col("w"), F.struct(F.col("top") / F.col("w"), F.col("place"), F.col("level").alias("level")))
    x = x.withColumn("level", F.min(fits).over(one)["level"])
    return x.withColumn("target", F.coalesce(F.least("top", F.col("level") * F.col("w")), F.col("top"))).select("source", "source_size", "n_docs", "place", "target")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row of ``docs`` (doc_id, text, source)."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), dealt_by(seed))
    base = stored(rows.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    sources = targets(base.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n_docs")), weights, share, limit)
    one = Window.partitionBy(F.lit(1))
    sources = sources.withColumn("mix", F.sum("target").over(one))
    sources = sources.withColumn("block", F.least(F.lit(BLOCK_WORDS), F.greatest(F.lit(1), F.floor(F.col("mix") / BLOCKS))).cast("long"))
    sources = sources.withColumn("seats", F.floor(F.col("mix") / F.col("block") + 0.5).cast("long"))
    sources = apportion(sources, [], ["place"], "target", "seats").drop("seats", "mix").withColumnRenamed("won", "seats")
    sources = stored(sources.withColumn("shards", F.ceil(F.col("n_docs") / SHARD_DOCS).cast("long")), "sources")
    # each source meets its documents in SALTS parts, so a hot one is no single key
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "s")
    d = base.withColumn("parts", F.ceil(F.col("rows") / SPREAD).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    d = d.withColumn("rows", F.floor(F.col("rows") / F.col("parts")) + F.when(F.col("part") < F.col("rows") % F.col("parts"), 1).otherwise(0))
    d = d.withColumn("salt", F.pmod(F.xxhash64("h", "part"), F.lit(SALTS)).cast("int"))
    d = d.join(salted, F.col("source").eqNullSafe(F.col("s")) & (d["salt"] == salted["salt"])).select("doc_id", "source", "size", "h", "part", "rows", "source_size", "place", "target", "block", "seats", F.pmod(F.col("h") + F.col("part"), "shards").alias("shard"))
    shards = d.groupBy("place", "shard", "block", "seats").agg(F.sum(F.col("size") * F.col("rows")).cast("double").alias("line")).withColumn("group", F.floor(F.col("shard") / GROUP))
    groups = apportion(shards.groupBy("place", "group", "seats").agg(F.sum("line").alias("line")), ["place"], ["group"], "line", "seats")
    shards = shards.drop("seats").join(groups.select("place", "group", F.col("won").alias("seats")), ["place", "group"])
    shards = apportion(shards, ["place", "group"], ["shard"], "line", "seats").select("place", "shard", "line", "won")
    d = d.join(shards, ["place", "shard"])
    w = Window.partitionBy("place", "shard").orderBy("h", F.asc_nulls_last("doc_id"), "size", "part").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line").cast("long")
    d = d.withColumns({"end": F.sum(F.col("size") * F.col("rows")).over(w), "line": line, "quota": F.least(F.col("won") * F.col("block"), line * limit)})
    # the rows of a part stand side by side on the line
    d = d.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).withColumn("end", F.col("end") - (F.col("rows") - F.col("nth")) * F.col("size"))
    d = d.withColumns({"full": F.coalesce(F.floor(F.try_divide(F.col("quota"), F.col("line"))), F.lit(0)).cast("long"), "start": F.col("end") - F.col("size")})
    d = d.withColumn("rest", F.col("quota") - F.col("full") * F.col("line"))
    d = d.withColumn("from", F.pmod(seeded(seed, F.col("place"), F.col("shard")), F.greatest(F.lit(1), F.ceil(F.col("line") / F.col("block")))) * F.col("block"))
    part = lambda a, b: F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("start"), a))
    here = part(F.col("from"), F.least(F.col("from") + F.col("rest"), F.col("line"))) + part(F.lit(0), F.col("from") + F.col("rest") - F.col("line"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + here).cast("long").alias("taken"), "source", "h")


def dealt_by(seed: int) -> Column:
    """h: the hash of id and text by which a document is dealt."""
    return seeded(seed, F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("h")


def mixed_documents(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The mix as whole documents: each row of ``docs`` as often as its taken words hold it, halves up; other columns as they are.

    Rows that agree in id, text and source are told apart by their other columns.
    """
    numbered = lambda df, c: df.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_h", "_source").orderBy(c)))
    m = mix(docs, seed=seed, **how).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("source").alias("_source"), F.floor(F.coalesce(F.try_divide("taken", "size"), F.lit(0.0)) + 0.5).cast("int").alias("_copies"))
    m = numbered(m, F.col("_copies"))
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), dealt_by(seed).alias("_h"), F.col("source").alias("_source"), row_hash(docs).alias("_order"))
    row = numbered(row, F.col("_order"))
    same = F.col("a._id").eqNullSafe(F.col("b._id")) & F.col("a._source").eqNullSafe(F.col("b._source")) & (F.col("a._h") == F.col("b._h")) & (F.col("a._nth") == F.col("b._nth"))
    x = row.alias("a").join(m.where("_copies > 0").alias("b"), same)
    return x.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _sql_apportion(src: str, group: str, order: str, votes: str, name: str) -> str:
    over = f"PARTITION BY {group}" if group else ""
    return f"""{name}_a AS (SELECT *, sum({votes}) OVER ({over}) AS allv, count(*) OVER ({over}) AS n FROM {src}),
{name}_b AS (SELECT *, CAST(floor(coalesce({votes} * greatest(seats - n, 0) / nullif(allv, 0), 0) + 0.5) AS BIGINT) AS lo,
  CAST(floor(coalesce({votes} * greatest(seats + n, 0) / nullif(allv, 0), 0) + 0.5) AS BIGINT) AS hi FROM {name}_a),
{name}_c AS (SELECT *, seats - sum(lo) OVER ({over}) AS lft FROM {name}_b),
{name}_d AS (SELECT *, unnest(range(lo, hi + 1)) AS k FROM {name}_c),
{name}_e AS (SELECT *, row_number() OVER ({over} ORDER BY {votes} / (2 * k + 1) DESC, {order}, k) AS rk FROM {name}_d),
{name} AS (SELECT {group + "," if group else ""} {order}, any_value(lo) + count(*) FILTER (WHERE rk <= lft AND {votes} > 0) AS won FROM {name}_e GROUP BY {group + "," if group else ""} {order})"""


_H = "CAST('0x' || substr(md5('{0}:' || {1}), 1, 15) AS BIGINT)"
SQL = {
    "op4_mix_sources": f"""WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  {_H.format(SEED, "coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))")} AS h, count(*) AS many FROM documents GROUP BY ALL),
s0 AS (SELECT source, sum(size * many)::BIGINT AS source_size, sum(many)::BIGINT AS n_docs FROM base GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, ([3, 1, 2])[(place % 3 + 1)::INT]::DOUBLE AS w, source_size::DOUBLE * 2 AS top, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS want FROM s1),
s3 AS (SELECT *, (want - coalesce(sum(top) OVER q, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER q, 0)) AS level FROM s2
  WINDOW q AS (ORDER BY top / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, coalesce(least(top, w * (SELECT level FROM s3 WHERE level <= top / w ORDER BY top / w, place LIMIT 1)), top) AS target FROM s3),
s5 AS (SELECT source, source_size, n_docs, place, target, sum(target) OVER () AS mix FROM s4),
s6 AS (SELECT *, least(64, greatest(1, floor(mix / 4096)))::BIGINT AS block FROM s5),
s7 AS (SELECT *, floor(mix / block + 0.5)::BIGINT AS seats FROM s6),
{_sql_apportion("s7", "", "place", "target", "ap")},
src AS (SELECT s.source, s.source_size, s.place, s.target, s.block, ap.won AS seats, ceil(n_docs / 4096.0)::BIGINT AS shards FROM s7 s JOIN ap USING (place)),
p AS (SELECT *, ceil(many / {SPREAD}.0)::BIGINT AS parts, unnest(range(ceil(many / {SPREAD}.0)::BIGINT)) AS part FROM base),
d AS (SELECT b.doc_id, b.size, b.h, b.part, many // parts + CASE WHEN part < many % parts THEN 1 ELSE 0 END AS many, s.source_size, s.place, s.target, s.block, s.seats, (b.h + b.part) % s.shards AS shard
  FROM p b JOIN src s ON b.source IS NOT DISTINCT FROM s.source),
sh AS (SELECT place, shard, shard // {GROUP} AS grp, seats, sum(size * many)::DOUBLE AS line FROM d GROUP BY ALL),
gr AS (SELECT place, grp, seats, sum(line) AS line FROM sh GROUP BY ALL),
{_sql_apportion("gr", "place", "grp", "line", "apg")},
shg AS (SELECT sh.place, sh.shard, sh.grp, sh.line, apg.won AS seats FROM sh JOIN apg USING (place, grp)),
{_sql_apportion("shg", "place, grp", "shard", "line", "aps")},
e AS (SELECT d.*, sh.line::BIGINT AS line, least(aps.won * d.block, sh.line::BIGINT * 2)::BIGINT AS quota,
  (sum(d.size * d.many) OVER (PARTITION BY d.place, d.shard ORDER BY d.h, d.doc_id NULLS LAST, d.size, d.part ROWS UNBOUNDED PRECEDING))::BIGINT AS part_stop, unnest(range(d.many)) AS after
  FROM d JOIN sh USING (place, shard) JOIN aps USING (place, shard)),
f AS (SELECT *, coalesce(quota // nullif(line, 0), 0) AS whole, part_stop - after * size AS stop, part_stop - (after + 1) * size AS start,
  ({_H.format(SEED, "place || ':' || shard")} % greatest(1, ceil(line / block::DOUBLE)::BIGINT)) * block AS off FROM e),
g AS (SELECT *, quota - whole * line AS rest FROM f)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(stop, least(off + rest, line)) - greatest(start, off)) + greatest(0, least(stop, off + rest - line) - greatest(start, 0)))::BIGINT AS taken FROM g""",
}
QUERIES = {"op4_mix_sources": op4_mix_sources}
