"""Fetching from a local server: chunks, retries, what is refused, what is left behind."""

import hashlib
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from trackloom.kernels import fits
from trackloom.sources import archive

HEAD = {"DATE-OBS": "2024/01/01", "TIME-OBS": "00:06:06.030", "DETECTOR": "C3"}
IMAGE = fits.write_image(np.arange(64, dtype=np.int16).reshape(8, 8), HEAD)
BIG_ROWS = 100_000_000 // 2000  # 200 MB of int16 in rows of 2000


@pytest.fixture
def server():
    tries = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            name = self.path.rsplit("/", 1)[-1]
            tries[name] = tries.get(name, 0) + 1
            bodies = {"good.fts": IMAGE, "shaky.fts": IMAGE, "cut.fts": IMAGE[:-2880], "junk.fts": b"junk" * 2000, "nodate.fts": fits.write_image(np.zeros((4, 4), np.int16), {"DETECTOR": "C3"}), "empty.fts": b""}
            if name == "big.fts":
                head = fits.write_image(np.zeros((1, 2000), np.int16), HEAD)[:2880].replace(b"NAXIS2  =                    1", f"NAXIS2  ={BIG_ROWS:>21}".encode())
                size = 2880 + -(-BIG_ROWS * 4000 // 2880) * 2880
                self.send_response(200)
                self.send_header("Content-Length", str(size))
                self.end_headers()
                self.wfile.write(head)
                left = size - 2880
                while left:
                    n = min(left, 1 << 20)
                    self.wfile.write(bytes(n))
                    left -= n
            elif name not in bodies or name == "shaky.fts" and tries[name] < 3:
                self.send_error(404 if name not in bodies else 503)
            else:
                self.send_response(200)
                self.send_header("Content-Length", str(len(bodies[name])))
                self.end_headers()
                self.wfile.write(bodies[name])

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/", tries
    s.shutdown()


def test_what_is_kept_and_what_is_refused(spark, tmp_path, server):
    url, tries = server
    folder = f"file://{tmp_path}/frames"
    names = spark.createDataFrame([(n,) for n in ("good.fts", "good.fts", "shaky.fts", "cut.fts", "junk.fts", "nodate.fts", "empty.fts", "gone.fts")], "name string")
    got = {r.name: r for r in archive.fetched(names.repartition(1), archive.opened, url, folder, 3, 0.0).collect()}
    assert sorted(os.listdir(tmp_path / "frames")) == ["good.fts", "shaky.fts"]
    assert (tmp_path / "frames" / "good.fts").read_bytes() == IMAGE
    assert (got["good.fts"].sha256, got["good.fts"].size_bytes, got["good.fts"].date_obs, got["good.fts"].path) == (hashlib.sha256(IMAGE).hexdigest(), len(IMAGE), "2024/01/01T00:06:06.030", f"{folder}/good.fts")
    assert tries["shaky.fts"] == 3 and tries["gone.fts"] == 3 and tries["cut.fts"] == 1
    assert {n: got[n].error for n in ("cut.fts", "junk.fts", "nodate.fts", "empty.fts", "gone.fts")} == {"cut.fts": "data are cut off", "junk.fts": "no end of header", "nodate.fts": "no observation time", "empty.fts": "no two-dimensional image", "gone.fts": "status 404"}
    assert archive.fetched(names.limit(0), archive.opened, url, folder).count() == 0


def test_facts_refuse_what_the_reader_refuses():
    for data in (IMAGE, IMAGE[:3000], b"", b"x" * 5760, fits.write_image(np.zeros(5, np.int16), HEAD), fits.write_image(np.zeros((2, 2), np.float32), {"DATE-OBS": "2024-01-01"})):
        outcome = []
        for f in (lambda d=data: fits.read_image(d)["date_obs"], lambda d=data: fits.facts(lambda at, n: d[at : at + n], len(d))["date_obs"]):
            try:
                outcome.append(f())
            except fits.FitsError as e:
                outcome.append(str(e))
        assert outcome[0] == outcome[1]


def test_a_body_of_200_mb_goes_through_in_chunks(spark, tmp_path, server):
    """The worker's own peak, measured in the worker before and after, grows by far less than the body."""
    url, _ = server

    def traced(address):
        import resource

        status, body = archive.opened(address)

        def chunks():
            before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
            yield from body
            if resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before > 60_000:
                raise ValueError("more than 60 MB were held")

        return status, chunks()

    row = archive.fetched(spark.createDataFrame([("big.fts",)], "name string"), traced, url, f"file://{tmp_path}/frames", 1, 0.0).first()
    assert row.status == "complete" and row.size_bytes > 200_000_000 and os.path.getsize(tmp_path / "frames" / "big.fts") == row.size_bytes


def test_leftovers_of_killed_attempts_go(tmp_path):
    folder = tmp_path / "frames"
    assert archive.leftovers(f"file://{folder}") == []
    folder.mkdir()
    for n in (".a.fts.123.part", "a.fts"):
        (folder / n).write_bytes(b"x")
    assert len(archive.leftovers(f"file://{folder}")) == 1 and os.listdir(folder) == ["a.fts"]
