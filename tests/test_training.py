"""Back-propagation against finite differences; training on planted stacks; checkpoints; ranks of positives."""

import json
from types import SimpleNamespace

import numpy as np
import pytest

from trackloom.__main__ import parser, train
from trackloom.kernels import learn, net
from trackloom.operators import scoring, training
from trackloom.sources import arrays


def made(seed, n, size=6, most=5):
    r = np.random.default_rng(seed)
    return [r.normal(0, 1, (most, size, size)) for _ in range(n)], r.integers(0, most + 1, n)


@pytest.mark.parametrize("extra", [0, 3])
def test_gradient_is_that_of_finite_differences(extra):
    a, n = made(1, 4)
    b, m = made(2, 2, 7)
    stacks, lengths = [*a, *b], [*n, *m]
    lengths[0], lengths[1] = 0, 5
    r = np.random.default_rng(3)
    features = r.normal(0, 1, (6, extra)) if extra else None
    labels, counts = np.array([1, 0, 1, 0, 1, 0]), np.array([1, 2, 0, 1, 3, 1])
    w = {k: (v + r.normal(0, 0.05, v.shape)).astype(np.float64) for k, v in net.seeded_weights(4, extra).items()}
    got, loss = learn.gradient(stacks, lengths, labels, counts, w, features)
    score = net.score_many([s.astype(np.float32) for s in stacks], lengths, {k: v.astype(np.float32) for k, v in w.items()}, None if features is None else features.astype(np.float32))
    assert loss == pytest.approx(-(counts * (labels * np.log(score) + (1 - labels) * np.log(1 - score))).sum(), rel=1e-4)
    for name, value in w.items():
        for at in r.choice(value.size, min(6, value.size), replace=False):
            place, ends = np.unravel_index(at, value.shape), []
            for step in (1e-6, -1e-6):
                moved = w | {name: value.copy()}
                moved[name][place] += step
                ends.append(learn.gradient(stacks, lengths, labels, counts, moved, features)[1])
            assert got[name][place] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-7), (name, place)


def planted(spark, n, size=8):
    """Every fourth stack holds a source that brightens; the others are noise."""
    r, rows = np.random.default_rng(5), []
    for i in range(n):
        crops = r.normal(0, 1, (4, size, size)).astype(np.float32)
        if i % 4 == 0:
            crops[:, 3:5, 3:5] += 3 + 2 * np.arange(4)[:, None, None]
        rows.append((f"t{i:04d}", bytearray(crops.tobytes()), size, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "track_id string, crops binary, crop_size int, label int")


def test_training_learns_what_is_planted_and_its_checkpoint_is_read(spark, tmp_path):
    x = planted(spark, 96)
    first, held = x.where("track_id < 't0064'"), x.where("track_id >= 't0064'")
    config = training.TrainConfig(epochs=3, batch_size=32, learning_rate=5e-3, positive_share=0.5)
    weights, history = training.train(x, first, held, config)
    ap = [h["validation"]["average_precision"] for h in history]
    start = training.quality(held, net.seeded_weights(0), config)["average_precision"]
    assert max(ap) > max(start, 0.9) and training.quality(held, weights, config)["average_precision"] == max(ap)
    assert history[-1]["train_loss"] < history[0]["train_loss"] and all(30 < h["drawn"] < 110 for h in history)
    training.save(spark, weights, f"{tmp_path}/runs/a.npz")
    read = scoring.weights_of(arrays.read(spark, f"{tmp_path}/runs"))
    assert list(read) == ["a"] and all(np.array_equal(read["a"][k], v) for k, v in weights.items())


def test_partial_sums_are_the_sum_of_all(spark):
    x = planted(spark, 20)
    rows = scoring.normalised(x).join(x.selectExpr("track_id", "crop_size as size", "label"), "track_id").selectExpr("*", "cast(null as array<double>) as vector")
    w, config = net.seeded_weights(1), training.TrainConfig()
    many, loss, drawn = training.sums(rows.repartition(7), w, 2, config, (1.0, 2.0))
    one, same_loss, same_drawn = training.sums(rows.coalesce(1), w, 2, config, (1.0, 2.0))
    assert drawn == same_drawn and loss == pytest.approx(same_loss, rel=1e-5)
    assert all(np.allclose(many[k], one[k], rtol=1e-3, atol=1e-5) for k in w)
    none, loss, drawn = training.sums(rows.where("false"), w, 2, config, (1.0, 2.0))
    assert (loss, drawn) == (0, 0) and not any(g.any() for g in none.values())


def test_errors_and_ranks(spark):
    x = planted(spark, 8)
    with pytest.raises(ValueError, match="positives and negatives"):
        training.train(x, x.where("label = 0"), x)
    with pytest.raises(ValueError, match="validation needs"):
        training.train(x, x, x.where("label = 0"))
    s = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.1), ("d", None), ("e", 0.5)], "track_id string, score double")
    y = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("d", 1), ("e", None), ("z", 1)], "track_id string, label int")
    assert sorted(tuple(r) for r in training.positive_ranks(s, y).collect()) == [("b", 0.9, 2, 4), ("c", 0.1, 3, 4), ("d", None, 4, 4)]


def test_commands_to_train_and_to_test(spark, tmp_path, capsys):
    tracks = [(f"seq{1 + i % 3}_a_{i:05d}", i) for i in range(24)]
    x = planted(spark, 24).join(spark.createDataFrame([(f"t{i:04d}", name) for name, i in tracks], "track_id string, name string"), "track_id")
    run = SimpleNamespace(spark=spark, root=str(tmp_path), crops=lambda: x.select("name", "crops", "crop_size").withColumnRenamed("name", "track_id"))
    positives = lambda s: [name for name, i in tracks if i % 4 == 0 and i % 3 == s - 1]
    day = lambda s: {"sequence_id": s, "positive_track_ids": positives(s)}
    event = {"soho_number": 1, "group": "Kreutz", "cameras": ["C3"], "obs_start": "2024-01-01", "obs_end": "2024-01-03", "source_file": "f", "source_line": "l", "status": "labeled", "notes": "", "days": {f"2024-01-0{s}": day(s) for s in (1, 2, 3)}}
    splits = {"train": ["2024-01-01"], "val": ["2024-01-02"], "test": ["2024-01-03"]}
    (tmp_path / "labels.json").write_text(json.dumps({"label_format": "labels_v1", "events": [event], "negative_days": [], "splits": splits}))
    words = ["train", "in", "out", "--labels", str(tmp_path / "labels.json"), "--epochs", "1"]
    said = lambda *more: (train(run, parser().parse_args([*words, *more])), [json.loads(line) for line in capsys.readouterr().out.splitlines()])
    assert said("--test") == (2, [])
    code, (epoch,) = said()
    assert code == 0 and epoch["epoch"] == 1 and (epoch["validation"]["n_total"], epoch["validation"]["n_pos"]) == (8, 2)
    code, (report, *ranks) = said("--test")
    assert code == 0 and (report["n_total"], report["n_pos"]) == (8, 2) and sorted(r["track_id"] for r in ranks) == positives(3)
