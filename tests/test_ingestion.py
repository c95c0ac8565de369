"""The commands ingest and persist against a local archive: what is fetched, skipped, tried again, merged."""

import json
import os
import threading
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from trackloom import ingestion
from trackloom.__main__ import main
from trackloom.kernels import fits
from trackloom.sinks import merged

IMAGE = fits.write_image(np.arange(48, dtype=np.int16).reshape(6, 8), {"DATE-OBS": "2024/01/01", "TIME-OBS": "00:06:06.030", "DETECTOR": "C3"})


@pytest.fixture
def served():
    """Paths and bodies of an archive, and how often each was asked for."""
    bodies, asked = {}, {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked[self.path] = asked.get(self.path, 0) + 1
            if self.path not in bodies:
                return self.send_error(404)
            self.send_response(200)
            self.send_header("Content-Length", str(len(bodies[self.path])))
            self.end_headers()
            self.wfile.write(bodies[self.path])

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", bodies, asked
    s.shutdown()


def test_a_day_is_fetched_once_and_persisted(spark, tmp_path, served, capsys):
    url, bodies, asked = served
    day = "/recent/240101/c3/"
    names = [f"{i:08d}.fts" for i in range(4)]
    bodies[day] = "".join(f'<a href="{n}">{n}</a>' for n in names).encode()
    bodies |= {day + n: IMAGE for n in names[:2]} | {day + names[2]: b"junk"}
    root = f"file://{tmp_path}/data"
    call = lambda *more: (main(["ingest", "--data-root", root, "--date", "2024-01-01", "--base", f"{url}/old", f"{url}/recent", *more]), json.loads(capsys.readouterr().out.splitlines()[-1]))
    said = lambda listed, downloaded, skipped, failed: {"date": "2024-01-01", "camera": "c3", "listed": listed, "downloaded": downloaded, "skipped": skipped, "failed": failed}
    assert main(["persist", "--data-root", root]) == 1
    assert call("--camera", "c2") == (0, said(0, 0, 0, 0) | {"camera": "c2"})
    assert call("--limit", "1") == (0, said(1, 1, 0, 0))
    assert call() == (0, said(4, 1, 1, 2)) and asked[day + names[0]] == 1 and asked[day + names[3]] == 3
    folder = tmp_path / "data" / ingestion.FOLDER / "240101" / "c3"
    assert sorted(os.listdir(folder)) == names[:2]
    merge = lambda: (main(["persist", "--data-root", root]), json.loads(capsys.readouterr().out.splitlines()[-1]))
    assert merge() == (0, {"created": 4, "updated": 0, "unchanged": 0})
    index = lambda: sorted((d, n) for d, _, ns in os.walk(tmp_path / "data" / "index") for n in ns)
    was = index()
    assert merge() == (0, {"created": 0, "updated": 0, "unchanged": 4}) and index() == was
    bodies[day + names[3]] = IMAGE
    assert call() == (0, said(4, 1, 2, 1)) and call() == (0, said(4, 0, 3, 1)) and merge()[1] == {"created": 0, "updated": 1, "unchanged": 3}
    schema = ingestion.image_values(ingestion.ledger(spark, f"{root}/{ingestion.FOLDER}")).schema
    rows = {r.source_identifier: r for r in merged.read_merged(spark, f"{root}/index/images", schema).collect()}
    assert sorted(rows) == [f"240101/c3/{n}" for n in names]
    good, bad = rows[f"240101/c3/{names[3]}"], rows[f"240101/c3/{names[2]}"]
    assert (good.width, good.height, good.size_bytes, good.instrument, good.ingestion_status, good.error_message) == (8, 6, len(IMAGE), "LASCO/C3", "complete", None)
    assert good.local_path == f"raw/soho/lasco/240101/c3/{names[3]}" and good.source_url == url + day + names[3] and good.observation_time == datetime(2024, 1, 1, 0, 6, 6, 30000)
    assert (bad.ingestion_status, bad.error_message, bad.width, bad.observation_time, bad.checksum) == ("failed", "no end of header", None, None, None)
    (mission,) = merged.read_merged(spark, f"{root}/index/missions", spark.createDataFrame([], "mission string, mission_name string").schema).collect()
    assert tuple(mission) == ("SOHO/LASCO", "SOHO")


def test_nothing_that_came_down_is_a_failure(spark, tmp_path, served, capsys):
    url, bodies, _ = served
    bodies["/a/240102/c2/"] = b'<a href="00000001.fts">'
    words = ["ingest", "--data-root", f"file://{tmp_path}", "--date", "2024-01-02", "--camera", "c2", "--base", f"{url}/a"]
    assert main(words) == 1 and json.loads(capsys.readouterr().out)["failed"] == 1
    bodies["/b/240102/c2/"] = b"no frames"
    assert main([*words[:-1], f"{url}/b"]) == 0
    with pytest.raises(SystemExit):
        main([*words[:4], f"{datetime.now(UTC).year + 1}-01-01"])


def test_odd_entries(spark):
    """Entries without status, time or address; a camera in capitals."""
    x = spark.createDataFrame([("240101", "C3", "a.fts", None, None, None, None, None, None, "soon", None, None)], ingestion.LEDGER)
    r = ingestion.image_values(x).first()
    assert (r.source_identifier, r.source_url, r.observation_time, r.instrument, r.ingestion_status) == ("240101/C3/a.fts", "", None, "LASCO/C3", "failed")
    assert ingestion.image_values(x.limit(0)).count() == 0
