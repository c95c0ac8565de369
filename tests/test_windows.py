"""Backgrounds from a window that a sequence streams past, whole or in spans, against the kernels on lists of frames."""

import numpy as np
import pytest

from trackloom.kernels import frames as k
from trackloom.operators import frames as fr


def sequence(number, n, shape=(20, 24)):
    r = np.random.default_rng(number)
    frames = [r.normal(100, 1, shape).astype(np.float32) for _ in range(n)]
    masks = [r.random(shape) > 0.05 for _ in range(n)]
    for i, f in enumerate(frames):
        f[5 : 7, i % 20 : i % 20 + 2] += 30
    return frames, masks


def registered(spark, sequences):
    rows = []
    for s, (frames, masks) in sequences.items():
        for i, (f, m) in enumerate(zip(frames, masks, strict=True)):
            rows.append((s, f"f{i:04d}", *f.shape, bytearray(f.tobytes()), bytearray(np.packbits(m).tobytes()), "ok" if i else "reference"))
        rows.append((s, "f0001x", 4, 4, None, None, "failed"))
    x = spark.createDataFrame(rows, "sequence_id long, frame string, height int, width int, data binary, mask binary, status string")
    return x.selectExpr("*", "timestamp'2024-01-01' as ts").repartition(5)


@pytest.mark.parametrize("config", [k.MotionConfig(), k.MotionConfig(window=3, opening_px=2), k.MotionConfig(method="prev_diff", threshold_sigma=3.0)], ids=lambda c: f"{c.method}{c.window}")
@pytest.mark.parametrize("span", [None, 1, 4, 64])
def test_streamed_and_split_sequences_give_what_lists_of_frames_give(spark, config, span):
    sequences = {1: sequence(1, 13), 2: sequence(2, 3, (9, 30)), 3: sequence(3, 8)}
    got = {(r.sequence_id, r.frame): r for r in fr.detect(registered(spark, sequences), config, residuals=True, span=span).collect()}
    assert len(got) == 24
    for s, (frames, masks) in sequences.items():
        for i, f in enumerate(frames):
            res, mask = k.residual(frames, i, config), masks[i]
            row = got[s, f"f{i:04d}"]
            if res is None:
                assert row.detections == [] and row.sigma == 0 and not np.frombuffer(row.residual, "<f4").any()
                continue
            found, sigma = k.detect(res, mask & masks[i - 1] if config.method == "prev_diff" else mask, config)
            assert row.sigma == round(sigma, 5) and (row.height, row.width) == f.shape
            assert np.array_equal(np.frombuffer(row.residual, "<f4").reshape(f.shape), res)
            assert [d.asDict() for d in row.detections] == found


def test_the_window_holds_no_more_than_it_needs():
    assert [(r["i"], [b["i"] for b in near]) for r, near in fr.windows(({"i": i} for i in range(5)), 2, 1)] == [(0, [1]), (1, [0, 2]), (2, [0, 1, 3]), (3, [1, 2, 4]), (4, [2, 3])]
    taken = []
    for r, _ in fr.windows(({"i": taken.append(i) or i} for i in range(1000)), 2, 2):
        assert len(taken) <= r["i"] + 3
    assert list(fr.windows([], 2, 2)) == []


@pytest.mark.parametrize("span", [None, 2])
def test_short_sequences_and_empty_tables(spark, span):
    assert fr.detect(registered(spark, {1: sequence(1, 3)}).where("false"), span=span).count() == 0
    with pytest.raises(Exception, match="three frames or more"):
        fr.detect(registered(spark, {1: sequence(1, 3), 2: sequence(2, 2)}), span=span).count()
    with pytest.raises(ValueError, match="unknown method"):
        fr.detect(registered(spark, {1: sequence(1, 3)}), k.MotionConfig(method="mean"))
