"""A day of the archive fetched into a shared folder with a ledger, and the ledger merged into tables of missions and images.

``root`` is a folder that Spark and pyarrow both reach from every executor: name its file system (hdfs://, s3://, file://)
wherever the two have different defaults. Frames lie under root/<yymmdd>/<camera>, the ledger in root/_ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import observation_time
from .session import discard, new_path, written
from .sinks.files import append_ledger, exists, read_ledger
from .sinks.merged import merge
from .sources import archive

#: The archive of the whole mission, and that of the last two weeks. Fixed values.
BASES = ("https://lasco-www.nrl.navy.mil/lz/level_05", "https://umbra.nascom.nasa.gov/pub/lasco/lastimage/level_05")
#: The mission, and where its frames lie below the root of all data. Fixed values.
MISSION, INSTRUMENT, DESCRIPTION, FOLDER = "SOHO", "LASCO", "SOHO LASCO coronagraph, level-0.5 imagery", "raw/soho/lasco"

KEYS = ["day", "camera", "name"]
ENTRIES = ["status", "source_url", "width", "height", "sha256", "size_bytes", "date_obs", "error"]
LEDGER = "day string, camera string, name string, status string, source_url string, width int, height int, sha256 string, size_bytes long, date_obs string, error string, recorded_at timestamp"
IMAGE = ["mission", "source_url", "local_path", "observation_time", "instrument", "width", "height", "checksum", "size_bytes", "ingestion_status", "error_message"]


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The newest entry of every frame; no rows where nothing was fetched yet."""
    path = f"{root}/_ledger"
    return read_ledger(spark, path, KEYS, LEDGER) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def ingest_day(
    spark: SparkSession, day: date, camera: str, root: str, bases: tuple[str, ...] = BASES, limit: int | None = None,
    open_url: Callable[[str], tuple[int, Iterator[bytes]]] = archive.opened, workers: int = 6, retries: int = 3, wait_s: float = 1.0,
) -> dict:
    """Fetches a day of a camera, from the first archive that lists any frame, and returns date, camera, listed, downloaded, skipped, failed.

    Frames that the ledger has as complete are skipped, failed ones are tried again. ``workers`` tasks fetch at a time. The
    ledger gets this call's entries in one file once all are through; a call that is killed before leaves whole frames
    without an entry, which the next one fetches again, and part files, which ``archive.leftovers`` deletes. Two calls may
    work at different days, not at the same one.
    """

    def page(url: str) -> tuple[int, bytes]:
        status, chunks = open_url(url)
        return status, b"".join(chunks)

    url, names = archive.list_day(page, list(bases), day, camera)
    names = names if limit is None else names[:limit]
    said = {"date": str(day), "camera": camera, "listed": len(names), "downloaded": 0, "skipped": 0, "failed": 0}
    if not names:
        return said
    own, camera = f"{day:%y%m%d}", camera.lower()
    listed = spark.createDataFrame([(n,) for n in names], "name string")
    todo = archive.wanted(listed, ledger(spark, root).where((F.col("day") == own) & (F.col("camera") == camera)))
    got = archive.fetched(todo.repartition(workers), open_url, url, f"{root}/{own}/{camera}", retries, wait_s)
    path = new_path(spark, "fetched")
    got = written(got.select(F.lit(own).alias("day"), F.lit(camera).alias("camera"), "name", *ENTRIES), path)
    counts = archive.summary(listed, got).first().asDict()
    if counts["downloaded"] + counts["failed"]:
        append_ledger(got.coalesce(1), f"{root}/_ledger")
    discard(spark, path)
    return said | counts


def image_values(entries: DataFrame) -> DataFrame:
    """Ledger entries as image rows by source_identifier. A time that cannot be read is null, an entry without a status failed."""
    identifier = F.concat_ws("/", *KEYS)
    values = {
        "source_identifier": identifier,
        "mission": F.lit(f"{MISSION}/{INSTRUMENT}"),
        "source_url": F.coalesce("source_url", F.lit("")),
        "local_path": F.concat_ws("/", F.lit(FOLDER), identifier),
        "observation_time": observation_time(F.col("date_obs")),
        "instrument": F.concat(F.lit(f"{INSTRUMENT}/"), F.upper("camera")),
        "width": F.col("width"),
        "height": F.col("height"),
        "checksum": F.col("sha256"),
        "size_bytes": F.col("size_bytes"),
        "ingestion_status": F.coalesce("status", F.lit("failed")),
        "error_message": F.col("error"),
    }
    return entries.select(*(v.alias(k) for k, v in values.items()))


def persist(spark: SparkSession, root: str, out: str) -> dict[str, int]:
    """Merges the mission and every ledger entry into out/missions and out/images; how many images were created, updated and unchanged.

    Rows of frames that the ledger does not know stay. A second call changes no file.
    """
    mission = spark.createDataFrame([(f"{MISSION}/{INSTRUMENT}", MISSION, INSTRUMENT, DESCRIPTION)], "mission string, mission_name string, instrument_name string, description string")
    merge(f"{out}/missions", mission, "mission", mission.columns[1:], 1)
    n = merge(f"{out}/images", image_values(ledger(spark, root)), "source_identifier", IMAGE)
    return {k: n[k] for k in ("created", "updated", "unchanged")}
