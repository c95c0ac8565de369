import base64
import gzip
import hashlib
import io
import random

import pytest
from pyarrow import fs

from trackloom.llm import warc
from trackloom.llm.common import new_path


def by_hand(rows, least=0):
    equal, out = {}, []
    for p, _, h in rows:
        equal.setdefault((h or "").encode(), []).append(p)
    for payload, pages in equal.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = max((p for p in pages if p is not None), default=None)
        answered = False
        for p in pages:
            response = len(payload) < least or (p == first and not answered)
            answered |= response
            out.append((p, len(payload), digest, "response" if response else "revisit", None if response else first))
    return sorted(map(repr, out))


def go(df, **how):
    folder = new_path(df.sparkSession, "test")
    manifest = warc.write_warc(df, folder, **how)
    read = warc.read_warc(manifest, folder)
    return sorted(map(repr, (tuple(r) for r in read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))), sorted((r.file, r.sha256, r.records) for r in manifest.collect()), folder, read


ROWS = [(1, "u", "a"), (2, "u", "a"), (2, "u", "a"), (2, "v", "a"), (3, None, None), (None, "x", ""), (None, "x\r\n y", "zz"), (None, "w", "zz"), (7, "q", "b" * 200_000), (8, "q", "é" * 30_000), (8, "q", "ü")]
SCHEMA = "page_id long, url string, html string, shard int, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d") for r in rows], SCHEMA)


def test_records_and_equal_bytes_in_every_run(spark):
    a, files, folder, read = go(frame(spark, ROWS), shard_bytes=20_000, roll_bytes=200)
    b, again, *_ = go(frame(spark, ROWS).repartition(5), shard_bytes=20_000, roll_bytes=200)
    assert a == b == by_hand(ROWS) and files == again and len(files) > 3
    store, path = fs.FileSystem.from_uri(folder)
    assert sorted(f.base_name for f in store.get_file_info(fs.FileSelector(path))) == [f for f, _, _ in files]
    assert {bytes(r.payload).decode() for r in read.where("payload is not null").collect()} == {h or "" for _, _, h in ROWS}


def test_least_length_and_hot_payload(spark):
    r = random.Random(1)
    rows = [(i, f"http://x/{i}", "same page" if i % 3 == 0 else "tiny" if i % 3 == 1 else f"page {r.random()}") for i in range(300)]
    assert go(frame(spark, rows), least=5)[0] == by_hand(rows, 5)


def test_empty_table(spark):
    assert go(frame(spark, []))[:2] == ([], [])


def test_members_of_any_length_are_read_apart():
    r = random.Random(3)
    bodies = [r.randbytes(n) for n in (0, 1, warc.PIECE - 30, warc.PIECE, warc.PIECE + 1, 3 << 20, *(r.randrange(300) for _ in range(500)))] + [b"a" * (5 << 20)]
    r.shuffle(bodies)
    data = b"".join(map(gzip.compress, bodies))
    assert list(warc.members(io.BytesIO(data))) == bodies and list(warc.members(io.BytesIO(b""))) == []
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(io.BytesIO(data[:-1])))
