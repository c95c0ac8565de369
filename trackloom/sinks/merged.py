"""A keyed table that is merged into: only the partitions that a merge changes are written again, and one commit makes them count.

Rows lie in partitions by a hash of the key. A version is a small file that names each partition's folder and number of
rows; it can be made only once, so two writers cannot both make the next one. A merge reads the partitions that its
keys fall into, writes the changed ones under a name of their own and commits. One that fails before its commit leaves
the table as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upserts import classify
from ..session import discard, written
from .files import located

CHANGES = ("created", "updated", "unchanged", "kept")


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, at = located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file; False where it is there already."""
    fs, at = located(spark, path)
    try:
        out = fs.create(at, False)
    except Exception:
        if not fs.exists(at):
            raise
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


def version(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The newest version's number and content; 0 and nothing where there is none."""
    names = names_in(spark, f"{path}/_versions")
    if not names:
        return 0, {"partitions": {}, "of": 0}
    text = spark.read.text(f"{path}/_versions/{names[-1]}", wholetext=True).first().value
    return int(names[-1].partition(".")[0]), json.loads(text)


def read_merged(spark: SparkSession, path: str, schema, only: list[int] | None = None) -> DataFrame:
    """The table's rows as of its newest version; of some partitions alone where these are named."""
    _, content = version(spark, path)
    folders = [p["folder"] for k, p in content["partitions"].items() if only is None or int(k) in only]
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.createDataFrame([], schema)


def partition_of(key: str, of: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(of)).cast("int")


def merge(path: str, new: DataFrame, key: str, columns: list[str], partitions: int = 64) -> dict[str, int]:
    """Merges (key, columns) into the table at ``path`` and returns how many keys were created, updated, unchanged and kept.

    ``partitions`` counts for a new table only. Rows without a key are an error. Of rows that share one the largest by its
    columns counts. A merge that changes nothing writes nothing. Where another merge got ahead of this one, it is an error and
    the table is the other's. The driver sees counts by partition.
    """
    spark = new.sparkSession
    number, content = version(spark, path)
    of = content["of"] or partitions
    new = new.select(key, *columns)
    if not new.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"rows without {key}")
    rows = new.groupBy(key).agg(F.max(F.struct(*columns)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in columns))
    folder = f"rows-{uuid.uuid4().hex}"
    touched = [r.p for r in rows.select(partition_of(key, of).alias("p")).distinct().collect()]
    old = read_merged(spark, path, new.schema, touched)
    x = written(classify(old, rows, key, columns).withColumn("_p", partition_of(key, of)), f"{path}/{folder}-all")
    counts: dict[int, dict[str, int]] = {}
    for r in x.groupBy("_p", "change").count().collect():
        counts.setdefault(r._p, {})[r.change] = r["count"]
    changed = [p for p, c in counts.items() if c.get("created", 0) + c.get("updated", 0)]
    total = {c: sum(n.get(c, 0) for n in counts.values()) for c in CHANGES}
    total["kept"] += sum(p["rows"] for k, p in content["partitions"].items() if int(k) not in touched)
    if changed:
        keep = x.where(F.col("_p").isin(changed)).select(key, *columns, "_p")
        keep.repartition(len(changed), "_p").write.partitionBy("_p").parquet(f"{path}/{folder}")
        own = {str(p): {"folder": f"{folder}/_p={p}", "rows": sum(counts[p].values())} for p in changed}
        text = json.dumps({"of": of, "partitions": content["partitions"] | own, "counts": total})
        if not write_once(spark, f"{path}/_versions/{number + 1:012d}.json", text):
            discard(spark, f"{path}/{folder}-all")
            discard(spark, f"{path}/{folder}")
            raise RuntimeError(f"version {number + 1} of {path} is another's")
    discard(spark, f"{path}/{folder}-all")
    return total


def clean(spark: SparkSession, path: str) -> list[str]:
    """Deletes folders of which no partition of the newest version is left, and their names: for when no reader of an older version and no merge is at work."""
    _, content = version(spark, path)
    live = {p["folder"].partition("/")[0] for p in content["partitions"].values()}
    gone = [n for n in names_in(spark, path) if n.startswith("rows-") and n not in live]
    for n in gone:
        discard(spark, f"{path}/{n}")
    return gone
