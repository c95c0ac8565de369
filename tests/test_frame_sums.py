"""Frames are made of sums by pixel, so what Python takes of a frame does not grow with its events."""

from datetime import datetime

import numpy as np

from trackloom.plans import frames as pf
from trackloom.sources.fits import decode


def test_a_crowded_frame_reaches_python_as_pixels(spark, tmp_path):
    n = 20_000
    rows = spark.range(n).selectExpr("id * 7 as event_id", "timestamp_ntz'2024-01-03 05:00:00' as ts", "1L as user_id", "'view' as event_type", "1.0D as value", "'{}' as props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    x = pf.fits_files(spark, str(tmp_path))
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FlatMapGroupsInPandas") < plan.index("Aggregate")
    (r,) = decode(x).collect()
    lit = np.zeros((pf.SIZE, pf.SIZE + 1), np.int64)
    for e in range(0, 7 * n, 7):
        lit[4 + e * 104729 % 40, 4 + e * 7919 % 40 : 6 + e * 7919 % 40] += 160 + 16 * (e % 5)
    lit[8:10, 8:10] += 1440
    got = np.frombuffer(r.data, r.dtype).reshape(pf.SIZE, pf.SIZE)
    y, c = np.mgrid[0 : pf.SIZE, 0 : pf.SIZE]
    dark = (c * y + 2) % 97 == 0
    base = got - np.minimum(lit[:, : pf.SIZE], 8000)
    assert (got[dark] == 0).all() and base[~dark].min() >= 200 and base[~dark].max() <= 200 + 256 + 6
