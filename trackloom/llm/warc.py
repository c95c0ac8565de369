"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id: shard borders come from the ids with the smallest seeded hashes, so
they, the shards and all bytes are the same in every run. A task streams its shard, builds headers and
digests anew, compresses each record as a gzip member of its own and rolls to the next file when the
compressed size passes a limit. Files are written under a temporary name of the attempt; the manifest that
Spark commits names those of the attempts that won, and only these are then renamed. A repeated attempt or
rename does no harm.

Of equal payloads of at least ``least`` bytes the largest page_id is the response and the others revisit it;
a revisit keeps the HTTP header with the payload's length but not the payload.

Defined cases: null html is an empty payload; rows without page_id have shards of their own, dealt by payload and url,
and refer to the largest id of their payload; where no equal payload has an id, one row of the first url (none before
any) is the response and the rest revisit it, referring to null; of repeated rows with the response's id the first is the response and
the rest revisit it; null url leaves out the target; an empty table writes no file and gives no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, recut, seeded, stored, table

DATE, SOFTWARE, SPACE = "2024-01-01T00:00:00Z", "trackloom", uuid.UUID("6f0d2c1e-8a53-5d7b-9a55-0c6f1f2b7a10")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of a shard on average, compressed bytes after which a file is rolled, gzip level, sampled ids a shard;
#: and the most shards, beyond which they grow instead (the sample of ids on the driver is SAMPLED times that at most).
SHARD_BYTES, ROLL_BYTES, LEVEL, SAMPLED, SEED, SHARDS = 16 << 20, 8 << 20, 6, 64, 7, 1 << 16
#: Compressed bytes that the reader inflates at a time.
PIECE = 16 << 10
MANIFEST = "shard long, seq long, temporary string, file string, records long, bytes long, sha256 string"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def line(value: object) -> str:
    """A header value: one line without control characters or blanks."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in str(value))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: bool, refers_to: int | None) -> bytes:
    """One uncompressed record with all headers and digests."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, f'{digest}:{url}') if revisits else record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {line(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        *([f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"] if revisits else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *([f"X-Refers-To-Page: {refers_to}"] if revisits and refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Roller:
    """Writes members of a shard to temporary files, a new one whenever the last has grown past the limit."""

    def __init__(self, folder: str, attempt: str, roll: int):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.attempt, self.roll = attempt, roll
        self.shard, self.seq, self.out, self.done = None, 0, None, []

    def add(self, shard: int, data: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.size >= self.roll):
            self.close()
        if shard != self.shard:
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.open()
            info = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
            name = f"{self.file}.warc.gz"
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name)}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode()
            self.write(member(head + info + b"\r\n\r\n"))
        self.write(member(data))
        self.records += 1

    def open(self) -> None:
        self.file = f"part-{self.shard:07d}-{self.seq:05d}"
        self.temporary = f"_temporary-{self.file}-{self.attempt}"
        self.store.create_dir(self.folder, recursive=True)
        self.out = self.store.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        self.size, self.records, self.hash = 0, 0, hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.seq, self.temporary, f"{self.file}.warc.gz", self.records, self.size, self.hash.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def borders(ids: DataFrame, rows: int, total_bytes: int, shard_bytes: int) -> np.ndarray:
    """Ids at which shards begin, the same in every run: quantiles of the ids whose seeded hash is small enough, about SAMPLED a shard."""
    n = min(SHARDS, max(1, -(-total_bytes // shard_bytes)))
    share = min(1.0, n * SAMPLED / max(rows, 1))
    sample = ids.where("page_id is not null").select("page_id").distinct().where(seeded(SEED, F.col("page_id")) < int(share * (1 << 60)))
    found = np.sort(np.array([r[0] for r in sample.toLocalIterator()], np.int64))
    return np.unique(found[np.arange(1, n) * len(found) // n]) if len(found) else found


def write_warc(pages: DataFrame, folder: str, least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to part-*.warc.gz in ``folder``, a URI that driver and executors share; returns the manifest."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    own_url = F.when(F.col("page_id").isNull(), F.col("url"))
    small = stored(pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n"), own_url.alias("url")), "payloads")
    count, total, nameless = small.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("page_id").isNull(), F.col("n") + 1)), F.lit(0))).first()
    at = borders(small, count, total, shard_bytes)
    extra = min(SHARDS, -(-nameless // shard_bytes))
    # of a payload that no page with an id has, the first url answers
    first = F.min(F.when(F.col("page_id").isNull(), F.struct(F.col("url").isNotNull(), "url")))
    groups = small.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), first["url"].alias("first_url"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    roles = small.where(F.col("n") >= least).join(groups, "digest").select("page_id", "digest", "url", "response", "first_url").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    rows = pages.select("page_id", F.lit(1).alias("kind"), F.sha1(payload).alias("digest"), "url", "html", none("long").alias("response"), none("string").alias("first_url"))
    rows = rows.unionByName(roles.select("page_id", F.lit(0).alias("kind"), "digest", "url", none("string").alias("html"), "response", "first_url"))

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, ids.to_numpy(np.int64), side="right").astype(np.int32))

    by_id = shard_of(F.coalesce("page_id", F.lit(0)))
    shard = F.when(F.col("page_id").isNotNull(), by_id).otherwise(F.pmod(F.xxhash64("digest", "url"), F.lit(max(1, extra))).cast("int") + len(at) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, page, role, answered = Roller(folder, uuid.uuid4().hex, roll_bytes), None, None, False
        for b in recut(batches):
            for shard, page_id, kind, digest, url, html, response, first_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if page != (page_id, digest):
                    page, role, answered = (page_id, digest), None, False
                if kind == 0:
                    role = (response, first_url)
                    continue
                revisits = role is not None and (role[0] != page_id or answered or page_id is None and url != role[1])
                answered = answered or not revisits
                files.add(shard, record(page_id, url, (html or "").encode(), base32(digest), revisits, role and role[0]))
        files.close()
        cols = list(zip(*files.done, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "seq", "temporary", "file", "records", "bytes", "sha256"])

    rows = rows.select(shard.alias("shard"), "*")
    rows = rows.repartitionById(len(at) + 1 + extra, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    manifest = stored(rows.mapInArrow(run, MANIFEST), "manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for b in recut(batches):
            for temporary, name in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if store.get_file_info(f"{path}/{temporary}").type != fs.FileType.NotFound:
                    store.move(f"{path}/{temporary}", f"{path}/{name}")
                elif store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{path}/{name}")
            yield b

    committed = stored(manifest.mapInArrow(commit, MANIFEST), "committed")
    store, path = fs.FileSystem.from_uri(folder)
    for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if f.base_name.startswith("_temporary-"):  # of attempts that lost
            store.delete_file(f.path)
    return committed


def members(source: pa.NativeFile) -> Iterator[bytes]:
    """Inflated gzip members of a stream, one at a time. Bytes are fed in pieces, so what is copied behind a member's end is less than one piece."""
    inflate, parts = zlib.decompressobj(31), []
    while data := source.read(1 << 20):
        view, at = memoryview(data), 0
        while at < len(view):
            piece = view[at : at + PIECE]
            parts.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("a record is cut off")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']}: wrong length")
    return fields, block


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the manifest's files, with digests checked: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        number = lambda x: None if x is None else int(x)
        for b in recut(batches):
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as source:
                    for data in members(source):
                        f, block = parse(data)
                        if f["WARC-Type"] == "warcinfo":
                            continue
                        if f["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
                            raise ValueError(f"record {f['WARC-Record-ID']}: wrong block digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = f["WARC-Type"] == "response"
                        if response and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"record {f['WARC-Record-ID']}: wrong payload digest")
                        rows.append((number(f.get("X-Page-Id")), f.get("WARC-Target-URI"), payload if response else None, size, digest, f["WARC-Type"], number(f.get("X-Refers-To-Page"))))
                        held += len(payload)
                        if held > 4 << 20:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = manifest.select("file").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
