"""Stages over frames take and give rows in slices, however large the batches are that Spark hands them."""

import datetime as dt
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trackloom import slices
from trackloom.kernels import fits
from trackloom.operators import frames as fr
from trackloom.sources.fits import decode


class Captured:
    """Stands in for a table: keeps the function that its batches go through."""

    def __getattr__(self, name):
        def called(*a, **k):
            if name == "mapInArrow":
                self.run = a[0]
            return self

        return called


def through(table, operator, *args, **own):
    """Rows a batch and all rows that the operator's stage makes of one batch, and the most that it held in Python."""
    x = Captured()
    operator(x, *args, **own)
    tracemalloc.start()
    sizes, first = [], None
    for b in x.run(iter(table.combine_chunks().to_batches())):
        sizes.append(b.num_rows)
        first = first or b.slice(0, 1).to_pylist()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return sizes, first, peak


N, SIZE = 2000, 48


def test_a_batch_of_frames_is_preprocessed_in_slices(spark):
    data = [(np.arange(SIZE * SIZE) % (100 + i) + 50).astype("<i2").tobytes() for i in range(N)]
    at = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    rows = [{"sequence_id": 1, "frame": f"{i:05d}", "ts": at, "height": SIZE, "width": SIZE, "dtype": "<i2", "data": d, "detector": "C3", "exposure_seconds": 16.0, "sun_x": None, "sun_y": 24.0, "plate_scale_arcsec": 700.0} for i, d in enumerate(data)]
    sizes, first, peak = through(pa.Table.from_pylist(rows), fr.preprocess, border_px=0)
    assert sum(sizes) == N and max(sizes) <= slices.MANY
    assert peak < 8 << 20 < N * SIZE * SIZE * 4
    assert first["sun_x"] is None and first["sun_center_missing"] and first["ts"] == at and len(first["data"]) == SIZE * SIZE * 4


def test_a_batch_of_files_is_decoded_in_slices(spark):
    image = np.arange(SIZE * SIZE, dtype=np.int16).reshape(SIZE, SIZE)
    good = fits.write_image(image, {"DATE-OBS": "2024/01/02", "TIME-OBS": "01:00:00.000", "DETECTOR": "C3"})
    table = pa.table({"path": [f"{i}.fts" for i in range(N)], "content": pa.array([b"no file" if i % 100 == 99 else good for i in range(N)], pa.binary())})
    sizes, first, peak = through(table, decode)
    assert sum(sizes) == N and max(sizes) <= slices.MANY and peak < 8 << 20 < N * len(good)
    assert first["data"] == image.astype(first["dtype"]).tobytes() and dict(first["header"])["DETECTOR"] and first["roll_deg"] is None


@pytest.mark.parametrize("rows,bytes_each", [(1000, 10), (300, 1 << 16), (3, 1 << 23)])
def test_slices_are_cut_by_rows_and_bytes(rows, bytes_each):
    batch = pa.record_batch({"n": pa.array(range(rows)), "data": pa.array([b"x" * bytes_each] * rows)})
    parts = list(slices.cut(batch))
    assert [r for p in parts for r in p["n"].to_pylist()] == list(range(rows))
    assert all(p.num_rows == 1 or p.num_rows <= slices.MANY and p.num_rows * bytes_each <= slices.SIZE for p in parts)
    held = list(slices.together(batch.to_pylist()))
    assert sum(map(len, held)) == rows and all(len(h) <= slices.MANY and (len(h) - 1) * bytes_each < slices.SIZE for h in held)
    assert not list(slices.cut(batch.slice(0, 0))) and not list(slices.together([]))
