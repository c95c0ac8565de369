import os

import pytest
from pyspark.sql import functions as F

from trackloom.operators import upserts
from trackloom.sinks import merged

SCHEMA = "k long, a string, b double"


def rows_of(spark, path):
    return sorted(map(tuple, merged.read_merged(spark, path, spark.createDataFrame([], SCHEMA).schema).collect()))


def files(path):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names)


def test_merges_change_only_what_they_must(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(i, "x", float(i)) for i in range(200)], SCHEMA)
    assert merged.merge(path, old, "k", ["a", "b"], 8) == {"created": 200, "updated": 0, "unchanged": 0, "kept": 0}
    assert rows_of(spark, path) == sorted(map(tuple, old.collect()))
    before = files(path)
    assert merged.merge(path, old, "k", ["a", "b"]) == {"created": 0, "updated": 0, "unchanged": 200, "kept": 0}
    assert files(path) == before
    new = spark.createDataFrame([(7, None, 7.0), (7, "x", 7.0), (8, None, 8.0), (1000, "y", None)], SCHEMA)
    want = upserts.classify(old, new.where("a is not null or k != 7"), "k", ["a", "b"])
    counts = {r.change: r["count"] for r in want.groupBy("change").count().collect()}
    assert {k: n for k, n in merged.merge(path, new, "k", ["a", "b"]).items() if n} == counts == {"created": 1, "updated": 1, "unchanged": 1, "kept": 198}
    assert rows_of(spark, path) == sorted(map(tuple, want.select("k", "a", "b").collect()))
    first, now = (merged.json.loads(open(f"{path}/_versions/{v:012d}.json").read())["partitions"] for v in (1, 2))
    hit = {str(r.p) for r in new.where("k in (8, 1000)").select(merged.partition_of("k", 8).alias("p")).collect()}
    assert {p for p in now if now[p] != first.get(p)} == hit
    assert sum(p["rows"] for p in now.values()) == 201
    assert merged.clean(spark, path) == [] and len(rows_of(spark, path)) == 201
    merged.merge(path, old.withColumn("a", F.lit("z")), "k", ["a", "b"])
    kept = rows_of(spark, path)
    assert merged.clean(spark, path) and rows_of(spark, path) == kept


def test_a_failed_merge_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0)], SCHEMA)
    merged.merge(path, old, "k", ["a", "b"], 4)
    was = rows_of(spark, path)
    bad = old.withColumn("a", F.when(F.col("k") == 2, F.raise_error(F.lit("planted"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="planted"):
        merged.merge(path, bad, "k", ["a", "b"])
    assert rows_of(spark, path) == was

    def stop(*_):
        raise RuntimeError("before the commit")

    with monkeypatch.context() as m:
        m.setattr(merged, "write_once", stop)
        with pytest.raises(RuntimeError, match="before the commit"):
            merged.merge(path, old.withColumn("a", F.lit("new")), "k", ["a", "b"])
    assert rows_of(spark, path) == was
    with monkeypatch.context() as m:
        m.setattr(merged, "version", lambda s, p, real=merged.version: (0, real(s, p)[1]))  # as one that began before the first merge's commit
        with pytest.raises(RuntimeError, match="another's"):
            merged.merge(path, old.withColumn("a", F.lit("new")), "k", ["a", "b"])
    assert rows_of(spark, path) == was
    merged.clean(spark, path)
    assert rows_of(spark, path) == was


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="without k"):
        merged.merge(path, spark.createDataFrame([(None, "x", 1.0)], SCHEMA), "k", ["a", "b"])
    empty = spark.createDataFrame([], SCHEMA)
    assert sum(merged.merge(path, empty, "k", ["a", "b"]).values()) == 0 and rows_of(spark, path) == []
    clash = spark.createDataFrame([(1, "x", None, "other", 5)], SCHEMA + ", change string, _p int")
    assert merged.merge(path, clash, "k", ["a", "b"])["created"] == 1 and rows_of(spark, path) == [(1, "x", None)]
    assert merged.merge(path, empty, "k", ["a", "b"])["kept"] == 1
