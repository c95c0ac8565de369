"""The network on many stacks at once against one stack at a time and against a plain one."""

import time

import numpy as np
import pytest
from test_plain_versions import plain_score

from trackloom.kernels import net
from trackloom.operators import scoring
from trackloom.plans import frames as pf


def stacks(seed, n, size, most=16):
    r = np.random.default_rng(seed)
    lengths = r.integers(0, most + 1, n)
    out = np.zeros((n, most, size, size), np.float32)
    for i, k in enumerate(lengths):
        out[i, :k] = r.normal(0, 1, (k, size, size))
    return list(out), lengths.tolist()


@pytest.mark.parametrize("extra", [0, 9])
def test_many_at_once_give_what_each_gives(extra):
    a, n = stacks(1, 40, 8)
    b, m = stacks(2, 7, 13)
    every, lengths = [*a, *b, np.zeros((16, 8, 8), np.float32)], [*n, *m, 0]
    w = net.seeded_weights(3, extra)
    features = np.random.default_rng(4).normal(0, 1, (len(every), extra)).astype(np.float32) if extra else None
    got = net.score_many(every, lengths, w, features)
    want = [net.score(s, k, w, features[i] if extra else None) if k else got[i] for i, (s, k) in enumerate(zip(every, lengths, strict=True))]
    assert np.abs(got - want).max() < 1e-5
    if extra:
        with pytest.raises(ValueError, match="features"):
            net.score_many(every, lengths, w)
    else:
        some = [i for i, k in enumerate(lengths) if k][:3]
        assert all(abs(got[i] - plain_score(every[i], lengths[i], w)) < 1e-4 for i in some)
    assert len(net.score_many([], [], w, features if features is None else features[:0])) == 0


def test_pixels_at_once_change_nothing(monkeypatch):
    every, lengths = stacks(5, 30, 8)
    w = net.seeded_weights(1)
    whole = net.score_many(every, lengths, w)
    monkeypatch.setattr(net, "PIXELS", 100)
    assert np.abs(net.score_many(every, lengths, w) - whole).max() < 1e-5


def test_many_at_once_are_faster():
    every, lengths = stacks(6, 256, 8)
    lengths = [max(1, n) for n in lengths]
    w = net.seeded_weights(1)
    took = []
    for f in (lambda: [net.score(s, n, w) for s, n in zip(every, lengths, strict=True)], lambda: net.score_many(every, lengths, w)):
        began = time.perf_counter()
        f()
        took.append(time.perf_counter() - began)
    assert took[1] < took[0] / 2, took


def test_every_stack_of_the_query(spark, sf_dir):
    made = {r.track_id: (np.frombuffer(r.stack, "<f4").reshape(16, 8, 8), r.length) for r in scoring.normalised(pf._stacks(spark, sf_dir)).collect()}
    w = net.seeded_weights(1)
    got = {r.track_id: r.score for r in scoring.score(pf._stacks(spark, sf_dir), w, "r").collect()}
    assert set(got) == set(made) and all(abs(got[k] - plain_score(*made[k], w)) < 1e-4 for k in got)
