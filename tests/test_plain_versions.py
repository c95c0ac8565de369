"""Queries without SQL, held against plain versions of what they compute."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from trackloom.kernels import net, png
from trackloom.operators import frames as fr
from trackloom.operators import scoring, tracks
from trackloom.plans import frames as pf


def plain_tracks(frames, reach, missed, least):
    """frames: [(time, [(x, y), ...])]; every pair is tried anew for each link."""
    live, done = [], []
    for now, places in frames:
        free, open_ = set(range(len(places))), set(range(len(live)))
        ahead = {}
        for i, t in enumerate(live):
            (t0, x0, y0), (t1, x1, y1) = t["p"][0], t["p"][-1]
            k = (now - t1) / (t1 - t0) if t1 > t0 else 0.0
            ahead[i] = (x1 + (x1 - x0) * k, y1 + (y1 - y0) * k)
        while True:
            pairs = [(np.hypot(ahead[i][0] - places[j][0], ahead[i][1] - places[j][1]), i, j) for i in open_ for j in free]
            pairs = [p for p in pairs if p[0] <= reach]
            if not pairs:
                break
            _, i, j = min(pairs)
            live[i]["p"].append((now, *places[j]))
            live[i]["missed"] = -1
            open_.discard(i)
            free.discard(j)
        for t in live:
            t["missed"] += 1
        done += [t for t in live if t["missed"] > missed]
        live = [t for t in live if t["missed"] <= missed] + [{"p": [(now, *places[j])], "missed": 0} for j in sorted(free)]
    return sorted([tuple(p[1:] for p in t["p"]) for t in done + live if len(t["p"]) >= least])


def test_tracker_of_all_events(spark, sf_dir):
    e = pf.event_detections(spark, sf_dir).collect()
    want = []
    for s in {r.sequence_id for r in e}:
        times = sorted({r.ts for r in e if r.sequence_id == s})
        frames = [(t.timestamp(), [(r.x, r.y) for r in sorted((r for r in e if r.sequence_id == s and r.ts == t), key=lambda r: r.pos)]) for t in times]
        want += plain_tracks(frames, 40.0, 2, 3)
    got = {}
    for r in pf.tracker_events(spark, sf_dir).orderBy("track_id", "seq").collect():
        got.setdefault(r.track_id, []).append((r.x, r.y))
    assert sorted(map(tuple, got.values())) == sorted(want) and want


def test_the_moving_source_is_followed_and_described(spark, sf_dir):
    p = pf.tracker_greedy(spark, sf_dir)
    longest = p.groupBy("track_id").count().orderBy(F.desc("count")).first()
    way = p.where(F.col("track_id") == longest.track_id).orderBy("seq").collect()
    steps = np.diff([(r.x, r.y) for r in way], axis=0)
    assert len(way) >= 6 and np.abs(np.median(steps, axis=0) - (2, 1)).max() < 0.6
    f = pf.pipeline_features(spark, sf_dir).where(F.col("track_id") == longest.track_id).first()
    assert f.n_frames == len(way) and abs(f.path_length_px - np.hypot(*steps.T).sum()) < 0.02


def plain_score(stack, n, w):
    state = np.zeros(64)
    for image in stack[:n].astype(np.float64):
        x = image[None]
        for k in range(3):
            weights, bias = w[f"conv{k}.w"].astype(np.float64), w[f"conv{k}.b"]
            high, wide = x.shape[1:]
            out = np.zeros((len(weights), high, wide))
            for i in range(high):
                for j in range(wide):
                    for a in range(3):
                        for b in range(3):
                            if 0 <= i + a - 1 < high and 0 <= j + b - 1 < wide:
                                out[:, i, j] += weights[:, :, a, b] @ x[:, i + a - 1, j + b - 1]
            x = np.maximum(out + bias[:, None, None], 0)
            if k < 2:
                x = np.array([[[c[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].max() for j in range(c.shape[1] // 2)] for i in range(c.shape[0] // 2)] for c in x])
        x = x.mean(axis=(1, 2))
        sig = lambda v: 1 / (1 + np.exp(-v))
        a, b = w["w_in"] @ x + w["b_in"], w["w_state"] @ state + w["b_state"]
        r, z = sig(a[:64] + b[:64]), sig(a[64:128] + b[64:128])
        state = (1 - z) * np.tanh(a[128:] + r * b[128:]) + z * state
    return float(1 / (1 + np.exp(-(state @ w["head.w"] + w["head.b"][0]))))


def test_network_scores(spark, sf_dir):
    stacks = pf._stacks(spark, sf_dir).orderBy("track_id").limit(4).cache()
    w = net.seeded_weights(1)
    stack = {r.track_id: (np.frombuffer(r.stack, "<f4").reshape(16, 8, 8), r.length) for r in scoring.normalised(stacks).collect()}
    got = {r.track_id: r.score for r in scoring.score(stacks, w, "r").collect()}
    assert len(got) == 4 and all(abs(got[k] - plain_score(*stack[k], w)) < 1e-4 for k in got)


def test_filmstrips_hold_the_stretched_crops(spark, sf_dir):
    from trackloom.sinks.files import filmstrips

    stacks = pf._stacks(spark, sf_dir).limit(3).cache()
    made = {r.track_id: bytes(r.png) for r in filmstrips(stacks, 2).collect()}
    for r in stacks.collect():
        crops = scoring.stack_of(r.crops, r.crop_size)
        lo, hi = np.percentile(crops, (1, 99.5))
        want = (np.clip((crops - lo) / max(hi - lo, 1e-6), 0, 1) * 255).astype(np.uint8)
        data = made[r.track_id]
        at = data.index(b"IDAT")
        size = int.from_bytes(data[at - 4 : at], "big")
        rows = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size]), np.uint8).reshape(16, 1 + 16 * len(crops))
        assert not rows[:, 0].any()
        assert (rows[::2, 1::2].reshape(8, len(crops), 8).transpose(1, 0, 2) == want).all()
    assert png.png(np.zeros((2, 3), np.uint8))[16:24] == (3).to_bytes(4, "big") + (2).to_bytes(4, "big")


def test_linear_ranker_learns_what_it_is_shown(spark, sf_dir):
    from trackloom.plans import features

    d = features.dna(spark, sf_dir).withColumns({"vector": tracks.model_vector(), "label": (F.col("flux_slope_frac_h") > 0).cast("int")}).where("flux_slope_frac_h is not null")
    train, held = d.where("user_id % 3 != 0"), d.where("user_id % 3 = 0")
    model = scoring.train_linear(train, "vector", "label", 0.5)
    x = scoring.predict_linear(model, held, "user_id", "vector", "l").join(held.select("user_id", "label"), "user_id").collect()
    assert sum((r.score > 0.5) == (r.label == 1) for r in x) / len(x) > 0.8


def test_planted_shifts_are_found_again():
    from trackloom.kernels.frames import recovered_shifts

    y, x = np.mgrid[0:128, 0:128]
    r = np.random.default_rng(3)
    sky = sum(a * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 4.5) for cx, cy, a in zip(r.uniform(10, 118, 60), r.uniform(10, 118, 60), r.uniform(20, 100, 60), strict=True)).astype(np.float32)
    planted = [(2.0, -3.0), (0.5, 0.25), (-4.0, 1.5)]
    for (dx, dy), (gx, gy, response) in zip(planted, recovered_shifts(sky, planted), strict=True):
        assert abs(gx - dx) < 0.35 and abs(gy - dy) < 0.35 and response > 0.2
    assert fr.NORMALISED.startswith("sequence_id")
