"""Archive days: listing, choice of archive, and what there is to fetch, whole or in chunks to a shared folder."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import fits

CAMERAS = ("c2", "c3")
PART = ".part"


def day_url(base: str, day: date, camera: str) -> str:
    if camera.lower() not in CAMERAS:
        raise ValueError(f"unknown camera {camera!r}")
    return f"{base.rstrip('/')}/{day:%y%m%d}/{camera.lower()}/"


def list_day(fetch: Callable[[str], tuple[int, bytes]], bases: list[str], day: date, camera: str) -> tuple[str | None, list[str]]:
    """Address and sorted frame names of the first archive that has any; a missing folder (404) is empty, other failures are errors."""
    import re

    for base in bases:
        url = day_url(base, day, camera)
        status, body = fetch(url)
        if status == 404:
            continue
        if status != 200:
            raise OSError(f"{url}: status {status}")
        names = sorted({m for m in re.findall(r'href="(\d{8}\.fts)"', body.decode("utf-8", "replace"), re.IGNORECASE)})
        if names:
            return url, names
    return None, []


def wanted(listed: DataFrame, manifest: DataFrame, limit: int | None = None) -> DataFrame:
    """Listed names, the first ``limit`` of them, that the manifest does not have as complete."""
    x = listed.orderBy("name").limit(limit) if limit is not None else listed
    return x.join(manifest.where("status = 'complete'").select("name"), "name", "left_anti")


def ingest(names: DataFrame, fetch: Callable[[str], tuple[int, bytes]], url: str, retries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """Fetches and validates on the executors: name, status, source_url, sha256, size_bytes, date_obs, error, content (null if failed)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name in part.name:
                row = {"name": name, "status": "failed", "source_url": url + name, "sha256": None, "size_bytes": None, "date_obs": None, "error": None, "content": None}
                for attempt in range(retries):
                    try:
                        status, body = fetch(url + name)
                        if status != 200:
                            raise OSError(f"status {status}")
                        found = fits.read_image(body)
                        row |= {"status": "complete", "sha256": hashlib.sha256(body).hexdigest(), "size_bytes": len(body), "date_obs": found["date_obs"], "error": None, "content": body}
                        break
                    except fits.FitsError as e:
                        row["error"] = str(e)
                        break
                    except OSError as e:
                        row["error"] = str(e)
                        time.sleep(wait_s * (attempt + 1) if attempt + 1 < retries else 0)
                yield pd.DataFrame([row])  # a body leaves before the next one comes

    return names.select("name").mapInPandas(run, "name string, status string, source_url string, sha256 string, size_bytes long, date_obs string, error string, content binary")


def opened(url: str, timeout_s: float = 60.0, chunk: int = 1 << 20) -> tuple[int, Iterator[bytes]]:
    """Status and body of an address, chunk by chunk."""
    import urllib.error
    import urllib.request

    try:
        answer = urllib.request.urlopen(url, timeout=timeout_s)  # noqa: S310
    except urllib.error.HTTPError as e:
        return e.code, iter(())
    return answer.status, iter(lambda: answer.read(chunk), b"")


def fetched(names: DataFrame, open_url: Callable[[str], tuple[int, Iterator[bytes]]], url: str, folder: str, retries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """Fetches to files of a shared folder: name, status, source_url, path, sha256, size_bytes, date_obs, width, height, error; no content.

    A body goes chunk by chunk to a part file while its hash is kept. The part is renamed to the frame's name once its headers
    are valid and its data whole, and deleted if they are not; failures of the network are tried again from the start. So a
    task holds one chunk, whatever a frame's size, and a frame's name never shows half a file. Every attempt has a part of
    its own; ``leftovers`` deletes those of attempts that were killed. Names that repeat are fetched each and end as one file.

    folder: a path or address that pyarrow's file systems reach from every executor.
    """
    out = "name string, status string, source_url string, path string, sha256 string, size_bytes long, date_obs string, width int, height int, error string"
    columns = [c.split()[0] for c in out.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        import pyarrow.fs as pafs

        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def attempt(name: str) -> dict:
            status, body = open_url(url + name)
            if status != 200:
                raise OSError(f"status {status}")
            part, digest, size = f"{root}/.{name}.{uuid.uuid4().hex}{PART}", hashlib.sha256(), 0
            try:
                with store.open_output_stream(part) as f:
                    for chunk in body:
                        digest.update(chunk)
                        size += len(chunk)
                        f.write(chunk)
                with store.open_input_file(part) as f:
                    found = fits.facts(lambda at, n: f.read_at(max(0, min(n, size - at)), at), size)
                store.move(part, f"{root}/{name}")
            except BaseException:
                if store.get_file_info(part).type != pafs.FileType.NotFound:
                    store.delete_file(part)
                raise
            return {"status": "complete", "path": f"{folder.rstrip('/')}/{name}", "sha256": digest.hexdigest(), "size_bytes": size, "date_obs": found["date_obs"], "width": found["width"], "height": found["height"], "error": None}

        for frame in parts:
            for name in frame.name:
                row = dict.fromkeys(columns) | {"name": name, "status": "failed", "source_url": url + name}
                for k in range(retries):
                    try:
                        row |= attempt(name)
                        break
                    except fits.FitsError as e:
                        row["error"] = str(e)
                        break
                    except OSError as e:
                        row["error"] = str(e)
                        time.sleep(wait_s * (k + 1) if k + 1 < retries else 0)
                yield pd.DataFrame([row], columns=columns).astype({"width": "Int32", "height": "Int32", "size_bytes": "Int64"})

    return names.select("name").mapInPandas(run, out)


def leftovers(folder: str) -> list[str]:
    """Deletes the part files of attempts that were killed, and names them; for when no fetch into the folder is at work."""
    import pyarrow.fs as pafs

    store, root = pafs.FileSystem.from_uri(folder)
    found = [f.path for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.path.endswith(PART)]
    for path in found:
        store.delete_file(path)
    return found


def summary(listed: DataFrame, done: DataFrame) -> DataFrame:
    """listed, downloaded, skipped, failed."""
    n = listed.agg(F.count(F.lit(1)).alias("listed"))
    d = done.agg(F.count_if(F.col("status") == "complete").alias("downloaded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("_all"))
    return n.crossJoin(d).select("listed", "downloaded", (F.col("listed") - F.col("_all")).alias("skipped"), "failed")


def availability(listed: DataFrame, last: date, days: int = 14) -> DataFrame:
    """day, n_frames of each of the last ``days`` days, 0 where nothing is listed; listed: a row a frame with its ``day``."""
    n = listed.groupBy("day").agg(F.count(F.lit(1)).alias("_n"))
    span = listed.sparkSession.range(days).select(F.date_sub(F.lit(last), F.col("id").cast("int")).alias("day"))
    return span.join(n, "day", "left").select("day", F.coalesce("_n", F.lit(0)).alias("n_frames"))
