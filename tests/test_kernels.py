import numpy as np
import pytest

from trackloom.kernels import fits, net, png
from trackloom.kernels import frames as k

rng = np.random.default_rng(5)


def stars(n=80, size=256, seed=3, dx=0.0, dy=0.0):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:size, 0:size]
    out = np.zeros((size, size))
    for cx, cy, a in zip(r.uniform(20, size - 20, n), r.uniform(20, size - 20, n), r.uniform(20, 100, n), strict=True):
        out += a * np.exp(-((x - cx + dx) ** 2 + (y - cy + dy) ** 2) / 4.5)
    return (out + np.random.default_rng([9, int(100 * dx) + 5000]).normal(0, 0.2, out.shape)).astype(np.float32)


def header(**own):
    return {"DATE-OBS": "2024/01/01", "TIME-OBS": "00:06:06.030", "TELESCOP": "SOHO", "INSTRUME": "LASCO", "DETECTOR": "C3", "FILTER": "Clear", "POLAR": "Clear", "EXPTIME": 18.5, "CRPIX1": 4.5, "CRPIX2": 4.0, "CDELT1": 56.0, "CROTA2": 0.5, "LEBXSUM": 1, "LEBYSUM": 2} | own


def test_fits_fields_and_native_order():
    a = np.arange(64, dtype=np.int16).reshape(8, 8)
    r = fits.read_image(fits.write_image(a, header()))
    assert (r["data"] == a).all() and r["data"].dtype.isnative
    assert (r["instrument"], r["date_obs"], r["exposure_seconds"], r["sun_x"], r["binning_y"]) == ("LASCO/C3", "2024/01/01T00:06:06.030", 18.5, 4.5, 2)


def test_fits_errors_and_missing_fields():
    a = np.zeros((8, 8), np.int16)
    bad = [b"garbage", fits.write_image(np.zeros(8, np.int16), header()), fits.write_image(a, {k: v for k, v in header().items() if k != "DATE-OBS"}), fits.write_image(a, {k: v for k, v in header().items() if k != "DETECTOR"})]
    for data in bad:
        with pytest.raises(fits.FitsError):
            fits.read_image(data)
    r = fits.read_image(fits.write_image(a, {k: v for k, v in header().items() if not k.startswith("CRPIX")}))
    assert r["sun_x"] is None and fits.dimensions(fits.write_image(np.zeros((2, 3, 4), np.int16), {})) == (4, 3) and fits.dimensions(b"x") == (None, None)


def test_field_mask_and_quality():
    c = k.PreprocessConfig(rsun_arcsec=56, occulter_rsun=10, fov_rsun=40, border_px=2)
    m = k.field_mask((100, 100), (50, 50), 56.0, c)
    assert not m[49, 49] and m[49, 49 + 20] and not m[49, 49 + 45] and not m[0, 50] and not m[49, 58] and m[49, 59]
    data = np.full((100, 100), 100, np.int16)
    data[49, 70] = 0
    out, mask, qa = k.preprocess(data, 10.0, (50, 50), 56.0, c)
    assert out[49, 75] == 10 and not mask[49, 70] and out[49, 70] == 0 and qa["usable"] and qa["exposure_ok"]
    assert not k.preprocess(data, None, (50, 50), 56.0, c)[2]["usable"]
    assert k.preprocess(data, 1.0, None, None, c)[2]["sun_center_missing"]
    with pytest.raises(ValueError):
        k.preprocess(data, 1.0, None, None, k.PreprocessConfig(stretch="cube"))
    assert k.PreprocessConfig.for_detector("c2").fov_rsun == 6.0


@pytest.mark.parametrize(("shift", "error"), [((0.5, -0.3), 0.35), ((2.25, 1.75), 0.1), ((5.0, -4.0), 0.1), ((0.0, 0.0), 0.05)])
def test_registration(shift, error):
    dx, dy, response = k.estimate_shift(stars(), stars(dx=shift[0], dy=shift[1]))
    assert abs(dx - shift[0]) < error and abs(dy - shift[1]) < error and response > 0.2


def test_registration_refuses_large_shifts():
    mask = np.ones((256, 256), bool)
    data, _, found = k.register(stars(), stars(dx=30.0), mask, k.RegisterConfig())
    assert found["status"] == "failed" and (data == stars(dx=30.0)).all()
    data, moved, found = k.register(stars(), stars(dx=3.0, dy=-2.0), mask, k.RegisterConfig())
    assert found["status"] == "ok" and not moved[:, 0].any() and np.abs(data - stars())[20:-20, 20:-20].mean() < 1.5


def test_sigma_and_background():
    assert abs(k.sigma_of(rng.normal(0, 2, 200_000)) - 2) < 0.05 and k.sigma_of(np.empty(0)) == 0
    frames = [np.full((4, 4), v, np.float32) for v in (1, 2, 100, 4, 5)]
    assert (k.residual(frames, 2, k.MotionConfig()) == 97).all() and k.residual(frames, 0, k.MotionConfig(method="prev_diff")) is None
    with pytest.raises(ValueError):
        k.residual(frames[:2], 0, k.MotionConfig())


def test_mover_found_and_star_not():
    y, x = np.mgrid[0:128, 0:128]
    blob = lambda cx, cy, a: a * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 4.5)
    frames = [(np.random.default_rng(i).normal(50, 1, (128, 128)) + blob(30, 30, 100) + blob(60 + 5 * i, 90 - 5 * i, 15)).astype(np.float32) for i in range(7)]
    for i in range(7):
        found, _ = k.detect(k.residual(frames, i, k.MotionConfig()), np.ones((128, 128), bool), k.MotionConfig())
        assert any(np.hypot(d["x"] - 60 - 5 * i, d["y"] - 90 + 5 * i) < 2.5 for d in found)
        assert not any(np.hypot(d["x"] - 30, d["y"] - 30) < 4 for d in found)


def test_labels_match_flood_fill():
    for seed in range(20):
        b = np.random.default_rng(seed).random((30, 40)) < 0.4
        got, n = k.label(b)
        want, m = np.zeros(b.shape, int), 0
        for y, x in zip(*np.nonzero(b), strict=True):
            if not want[y, x]:
                m += 1
                todo = [(y, x)]
                while todo:
                    p, q = todo.pop()
                    if 0 <= p < 30 and 0 <= q < 40 and b[p, q] and not want[p, q]:
                        want[p, q] = m
                        todo += [(p + i, q + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert n == m and (got == want).all()


def test_crop_edges_and_stack():
    res, mask = np.ones((20, 20), np.float32), np.ones((20, 20), bool)
    c, share = k.crop(res, mask, 0, 0, 8)
    assert share == 16 / 64 and c.sum() == 16 and k.crop(res, mask, 100, 100, 8)[1] == 0
    out, n = k.normalise_stack(rng.normal(0, 1, (40, 8, 8)).astype(np.float32))
    assert out.shape == (16, 8, 8) and n == 16
    out, n = k.normalise_stack(np.zeros((5, 8, 8), np.float32))
    assert n == 5 and (out == 0).all()


def test_network_ignores_padding_and_counts_parameters():
    w = net.seeded_weights(2)
    assert net.parameters(w) == 48_321
    stack, n = k.normalise_stack(rng.normal(0, 1, (5, 32, 32)).astype(np.float32))
    a = net.score(stack, n, w)
    stack[n:] = 7
    assert 0 < a < 1 and net.score(stack, n, w) == a
    with pytest.raises(ValueError):
        net.score(stack, n, net.seeded_weights(2, 9))


def test_png_dimensions():
    data = png.filmstrip(rng.normal(0, 1, (3, 32, 32)), 2)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and int.from_bytes(data[16:20], "big") == 192 and int.from_bytes(data[20:24], "big") == 64


def test_injected_source_is_recovered():
    y, x = np.mgrid[0:96, 0:96]
    base = [np.random.default_rng(i).normal(100, 1, (96, 96)).astype(np.float32) for i in range(8)]
    frames, places = k.inject(base, (20, 70), (4.0, -3.0), 10.0)
    hits = 0
    for i, (px, py) in enumerate(places):
        found, _ = k.detect(k.residual(frames, i, k.MotionConfig()), np.ones((96, 96), bool), k.MotionConfig())
        hits += any(np.hypot(d["x"] - px, d["y"] - py) <= 3 for d in found)
    assert hits == 8


def test_known_shifts_move_frames(spark):
    """A lit pixel goes where the shift says, in parts where it lies between pixels; frames without a shift or not usable are left out."""
    from pyspark.sql import functions as F

    from trackloom.operators import frames as fr

    image, mask = np.zeros((4, 5), np.float32), np.ones((4, 5), bool)
    image[1, 2] = 8
    row = lambda name, dx, usable=True: (1, name, None, 4, 5, image.tobytes(), np.packbits(mask).tobytes(), usable, dx, 0.0)
    x = spark.createDataFrame([row("a", 1.0), row("b", 0.5), row("c", -9.0), row("d", None), row("e", float("nan")), row("f", 1.0, False)], "sequence_id long, frame string, ts timestamp, height int, width int, data binary, mask binary, usable boolean, dx double, other double")
    got = {r.frame: (fr.pixels(r.data, 4, 5), fr.mask_of(r.mask, 4, 5)) for r in fr.moved(x, F.col("dx"), F.lit(0)).collect()}
    assert sorted(got) == ["a", "b", "c"]
    assert got["a"][0].tolist() == np.roll(image, 1, 1).tolist() and not got["a"][1][:, 0].any() and got["a"][1][:, 1:].all()
    assert got["b"][0][1].tolist() == [0, 0, 4, 4, 0] and not got["c"][0].any() and not got["c"][1].any()
    assert fr.moved(x.limit(0), F.col("dx"), F.lit(0)).count() == 0
