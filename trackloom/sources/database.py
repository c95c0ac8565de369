"""Tables of a relational database, read in ranges of a whole-number key by as many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, url: str, table: str, key: str, parts: int = 8, fetch: int = 10_000, **options: str) -> DataFrame:
    """The table in ``parts`` ranges between the smallest and the largest key, which the database works out; filters and columns are pushed down to it.

    Rows without a key are read with the first range. An empty table, and one whose keys are all null, is one range.
    Table and key are names of one's own, not user input: they stand in the text of the query.
    """
    from_ = spark.read.format("jdbc").options(url=url, **options)
    low, high = from_.option("query", f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}").load().first()
    x = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch), **options)
    if low is not None and high > low and parts > 1:
        x = x.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return x.load()
