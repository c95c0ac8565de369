"""Label queries against their SQL on events whose numbers have five digits or more, in months that share days."""

from datetime import datetime, timedelta

import duckdb
import pytest
from oracle import same

from trackloom.plans import evaluation as e


@pytest.mark.parametrize("name", ["event_attribution", "split_resolve", "validation_events", "validation_splits"])
def test_long_numbers(spark, tmp_path, name):
    kinds, start = ("purchase", "view", "error"), datetime(2024, 1, 1)
    rows = [(n, start + timedelta(days=k % 45, hours=k % 24), k % 7, kinds[k % 3], float(k * 37 % 150) / (1 if k % 4 else 200)) for k in range(600) for n in (99_700 + k, 1_000_000 + k)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    same(spark, con, str(tmp_path), e.QUERIES[name], e.SQL[name])
