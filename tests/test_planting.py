"""Planted sources and shifts on tables of frames."""

import numpy as np

from trackloom.kernels import frames as k
from trackloom.operators import planting


def table(spark, n=8, size=32):
    rows = []
    for s in (0, 7):
        for i in range(n):
            r = np.random.default_rng(100 * s + i)
            data, mask = r.normal(50, 1, (size, size)).astype(np.float32), r.random((size, size)) > 0.02
            rows.append((s, f"f{i}", size, size, bytearray(data.tobytes()), bytearray(np.packbits(mask).tobytes()), "ok", True))
        rows.append((s, "f0x", 2, 2, None, None, "failed", False))
    return spark.createDataFrame(rows, "sequence_id long, frame string, height int, width int, data binary, mask binary, status string, usable boolean").selectExpr("*", "timestamp'2024-01-01' as ts", "1 as cell", "'mine' as x")


def test_recovery_is_that_of_the_kernels(spark):
    t, strengths, start, velocity = table(spark), (9.0, 0.5), (0.25, 0.75), (3.0, -2.0)
    x = planting.planted(t, strengths, start, velocity)
    got = {(r.sequence_id, r.method, r.strength): (r.n_frames, r.recovered, r.n_detections) for r in planting.recovery(x, strengths).collect()}
    want = {}
    for s in (0, 7):
        rows = sorted((r for r in t.where("status = 'ok'").collect() if r.sequence_id == s), key=lambda r: r.frame)
        frames = [np.frombuffer(r.data, "<f4").reshape(32, 32) for r in rows]
        masks = [np.unpackbits(np.frombuffer(r.mask, np.uint8), count=1024).reshape(32, 32).astype(bool) for r in rows]
        for strength in strengths:
            lit, places = k.inject(frames, (32 * start[0], 32 * start[1]), velocity, strength)
            for method in planting.METHODS:
                config, hits, many = k.MotionConfig(method=method), 0, 0
                for i, (px, py) in enumerate(places):
                    res = k.residual(lit, i, config)
                    found = [] if res is None else k.detect(res, masks[i] & masks[i - 1] if method == "prev_diff" else masks[i], config)[0]
                    hits, many = hits + any(np.hypot(d["x"] - px, d["y"] - py) <= 3 for d in found), many + len(found)
                want[s, method, strength] = (8, hits, many)
    assert got == want and got[0, "median", 9.0][1] >= 6


def test_nothing_planted_in_nothing(spark):
    x = planting.planted(table(spark).where("status = 'failed'"))
    assert x.count() == 0 and planting.recovery(x).count() == 0
    assert planting.shift_recovery(table(spark).where("false")).count() == 0


def test_shifts_of_the_reference_frame_are_found(spark):
    x = planting.shift_recovery(table(spark, size=64)).collect()
    assert len(x) == 8 and all(r.error < 0.6 for r in x) and all(r.error < 0.01 for r in x if r.dx == 0)
