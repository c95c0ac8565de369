"""Greedy multi-frame association of detections into tracks.

A sequence streams past its tracker frame by frame, so what a task holds are the open tracks and one frame. Pairs
of a frame's detections and expected places are found by a grid of cells: only detections of a place's own cell and
the eight around it are measured, never all of a frame. Where many lie within a link's reach of each other, pairs are
looked for in growing rings, and what an inner ring links is not measured again; detections and tracks that share a place
are measured once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TracksConfig:
    version: str = "tracks_v1"
    max_link_px: float = 10.0
    max_missed_frames: int = 2
    min_track_frames: int = 5


@dataclass(slots=True)
class Open:
    """A track that may go on: its first and last point, how often it was missed, its rows and residuals."""

    first: tuple[float, float, float]
    last: tuple[float, float, float]
    rows: list[int] = field(default_factory=list)
    residuals: list[float] = field(default_factory=list)
    missed: int = 0


def expected(tracks: list[Open], now: float) -> np.ndarray:
    """Places at ``now`` by each track's mean velocity over its whole length; without a time span, where it was last."""
    a, b = np.array([t.first for t in tracks]), np.array([t.last for t in tracks])
    span = (b[:, 0] - a[:, 0])[:, None]
    v = np.divide(b[:, 1:] - a[:, 1:], span, out=np.zeros((len(tracks), 2)), where=span > 0)
    return b[:, 1:] + v * (now - b[:, :1])


def cell_keys(cells: np.ndarray) -> np.ndarray:
    """One number a cell. Should two cells share one, their pairs are measured as well, which does no harm."""
    x = np.clip(cells, -(2.0**62), 2.0**62).astype(np.int64).view(np.uint64)
    return x[:, 0] * np.uint64(0x9E3779B97F4A7C15) + x[:, 1]


def pairs_within(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, i, j) of all places a[i], b[j] at most ``reach`` apart, nearest first, then by i and j. Places that are not finite have no pair."""
    width = reach * (1 + 1e-6) if reach > 0 else 1.0  # a little more, as quotients are rounded
    left, right = (np.flatnonzero(np.isfinite(x).all(axis=1)) for x in (a, b))
    own, other = np.floor(a[left] / width), cell_keys(np.floor(b[right] / width))
    order = np.argsort(other, kind="stable")
    other, right = other[order], right[order]
    found = []
    for step in np.ndindex(3, 3):
        key = cell_keys(own + np.array(step) - 1)
        at = np.searchsorted(other, key)
        n = np.searchsorted(other, key, "right") - at
        i = np.repeat(left, n)
        j = right[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        d = np.hypot(*(a[i] - b[j]).T)
        near = d <= reach
        found.append((d[near], i[near], j[near]))
    d, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((j, i, d))
    return d[order], i[order], j[order]


def first_come(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of the pairs that stay when each pair, in order, takes its two sides away from all later ones.

    A pair that comes first for both of its sides stays for certain; these are taken together, and the rest is looked at again.
    """
    at, kept = np.arange(len(i)), []
    while len(at) > 256:
        first = np.zeros(len(at), bool)
        first[np.unique(i[at], return_index=True)[1]] = True
        both = np.zeros(len(at), bool)
        both[np.unique(j[at], return_index=True)[1]] = True
        sure = at[first & both]
        kept.append(sure)
        at = at[~np.isin(i[at], i[sure]) & ~np.isin(j[at], j[sure])]
    linked, used, rest = set(), set(), []
    for k in at.tolist():
        if i[k] not in linked and j[k] not in used:
            linked.add(i[k])
            used.add(j[k])
            rest.append(k)
    return np.concatenate([*kept, np.array(rest, np.int64)]).astype(np.int64)


def places_of(a: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The finite places of ``a``, each once, and the rows that lie at each, in order."""
    at = np.flatnonzero(np.isfinite(a).all(axis=1))
    at = at[np.lexsort((at, a[at, 1], a[at, 0]))]
    x = a[at]
    starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(axis=1)][: len(x)])
    return x[starts], np.split(at, starts[1:]) if len(x) else []


def candidates(a: np.ndarray, b: np.ndarray, reach: float) -> int:
    """How many pairs of the places ``pairs_within`` would measure."""
    width = reach * (1 + 1e-6) if reach > 0 else 1.0
    own, other = np.floor(a / width), np.sort(cell_keys(np.floor(b / width)))
    keys = np.concatenate([cell_keys(own + np.array(step) - 1) for step in np.ndindex(3, 3)])
    return int((np.searchsorted(other, keys, "right") - np.searchsorted(other, keys)).sum())


def linked_at_once(left: dict[int, list[int]], right: dict[int, list[int]], near: dict[int, list[int]]) -> Iterator[tuple[int, int]]:
    """Pairs of rows at places that are all equally far apart: by the left row, each with the first right row that is left. Rows leave ``left`` and ``right``, last first."""
    heap = [(left[g][-1], g) for g in near if left[g]]
    heapq.heapify(heap)
    while heap:
        i, g = heapq.heappop(heap)
        there = [h for h in near[g] if right[h]]
        if there:
            left[g].pop()
            yield i, right[min(there, key=lambda h: right[h][-1])].pop()
            if left[g]:
                heapq.heappush(heap, (left[g][-1], g))


def matched(a: np.ndarray, b: np.ndarray, reach: float, many: int = 200_000, few: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, i, j) of the pairs that stay when all places a[i], b[j] at most ``reach`` apart are taken nearest first, then by i and j, and each takes its two sides away from all later ones.

    Of few places all pairs are measured at once. Else a ring's radius is halved until about ``many`` pairs are measured.
    What is left of an inner ring has no pair in it.
    """
    if len(a) * len(b) <= few:
        left, right = (np.flatnonzero(np.isfinite(x).all(axis=1)) for x in (a, b))
        x, y = a[left], b[right]
        d = np.hypot(x[:, None, 0] - y[:, 0], x[:, None, 1] - y[:, 1]).ravel()
        near = np.flatnonzero(d <= reach)
        near = near[np.argsort(d[near], kind="stable")]
        i, j = np.divmod(near, max(1, len(y)))
        kept = first_come(i, j)
        return d[near[kept]], left[i[kept]], right[j[kept]]
    (pa_, rows_a), (pb, rows_b) = places_of(a), places_of(b)
    left, right = ({g: r[::-1].tolist() for g, r in enumerate(rows)} for rows in (rows_a, rows_b))
    out, inner = [], -1.0
    while left and right and inner < reach:
        gl, gr = np.fromiter(left, np.int64), np.fromiter(right, np.int64)
        x, y, radius = pa_[gl], pb[gr], reach
        if len(gl) * len(gr) > many:
            while radius / 2 > max(inner, reach * 2.0**-30) and candidates(x, y, radius) > many:
                radius /= 2
        d, i, j = pairs_within(x, y, radius)
        i, j, inner = gl[i], gr[j], radius
        if all(len(left[g]) == 1 for g in gl.tolist()) and all(len(right[h]) == 1 for h in gr.tolist()):
            fi, fj = np.array([left[g][0] for g in gl.tolist()]), np.array([right[h][0] for h in gr.tolist()])
            ri, rj = fi[np.searchsorted(gl, i)], fj[np.searchsorted(gr, j)]
            order = np.lexsort((rj, ri, d))
            order = order[first_come(ri[order], rj[order])]
            out += zip(d[order].tolist(), ri[order].tolist(), rj[order].tolist(), strict=True)
            for g, h in zip(i[order].tolist(), j[order].tolist(), strict=True):
                left[g], right[h] = [], []
        else:
            edges = np.flatnonzero(np.r_[True, d[1:] != d[:-1], True]).tolist() if len(d) else []
            d, i, j = d.tolist(), i.tolist(), j.tolist()
            for at, end in zip(edges, edges[1:], strict=False):
                near: dict[int, list[int]] = {}
                for k in range(at, end):
                    if left[i[k]] and right[j[k]]:
                        near.setdefault(i[k], []).append(j[k])
                out += ((d[at], *p) for p in linked_at_once(left, right, near))
        left, right = {g: r for g, r in left.items() if r}, {h: r for h, r in right.items() if r}
    return tuple(np.array([p[c] for p in out], kind) for c, kind in enumerate((float, np.int64, np.int64)))


class Tracker:
    """State machine over frames in time order. Its state is what a stream has to keep."""

    def __init__(self, config: TracksConfig = TracksConfig()):  # noqa: B008
        self.config, self.open, self.done = config, [], []

    def step(self, now: float, places: np.ndarray, rows: list[int]) -> None:
        """Links the nearest pairs of expected and found places first, one to one; ages the rest; opens tracks for what is left."""
        c, linked, used = self.config, set(), set()
        if self.open and len(places):
            d, i, j = matched(expected(self.open, now), places, c.max_link_px)
            for apart, track, place in zip(d.tolist(), i.tolist(), j.tolist(), strict=True):
                linked.add(track)
                used.add(place)
                t = self.open[track]
                t.last, t.missed = (now, *places[place]), 0
                t.rows.append(rows[place])
                t.residuals.append(apart)
        kept = []
        for i, t in enumerate(self.open):
            t.missed += i not in linked
            (self.done if t.missed > c.max_missed_frames else kept).append(t)
        for j, p in enumerate(places):
            if j not in used:
                kept.append(Open((now, *p), (now, *p), [rows[j]], [0.0]))
        self.open = kept

    def finish(self) -> list[Open]:
        self.done, self.open = self.done + self.open, []
        return self.done


def link(times: np.ndarray, places: np.ndarray, config: TracksConfig = TracksConfig(), frames: np.ndarray | None = None) -> list[Open]:  # noqa: B008
    """All tracks of detections sorted by time; ``frames`` adds the times of frames without detections."""
    t, edge = Tracker(config), np.unique(times if frames is None else np.concatenate((times, frames)))
    for now in edge:
        a, b = np.searchsorted(times, now, "left"), np.searchsorted(times, now, "right")
        t.step(float(now), places[a:b], list(range(a, b)))
    return t.finish()


POINT = "struct<frame:string,ts:timestamp,x:double,y:double,area:double,peak:double,flux:double,snr:double,residual:double>"


def build(detections: DataFrame, frames: DataFrame, tag: str, config: TracksConfig = TracksConfig()) -> DataFrame:  # noqa: B008
    """Points of persistent tracks: sequence_id, track_id, seq, frame, ts, x, y, area, peak, flux, snr, residual.

    detections: sequence_id, frame, pos (order within the frame), x, y, area, peak, flux, snr; frames: sequence_id, frame, ts.
    Of frames with the same time the first by name counts. Ids number the tracks by start time and place, then by the first
    detection's pos. Detections of frames that are not listed, and sequences without frames, give nothing; a detection
    without a finite place links with none; repeated detections are one each; other columns are not read.

    A sequence's frames come to one task in order of time; a track leaves when it closes.
    """
    values = ["area", "peak", "flux", "snr"]
    # fresh aliases, as both sides may stem from one plan
    times = frames.select(F.col("sequence_id").cast("long").alias("_s"), F.col("frame").alias("_f"), F.col("ts").cast("timestamp").alias("ts"))
    times = times.groupBy("_s", "ts").agg(F.min("_f").alias("_f"))
    found = detections.select(F.col("sequence_id").cast("long").alias("_sequence"), F.col("frame").alias("_frame"), "pos", *(F.col(c).cast("double").alias(c) for c in ("x", "y", *values)))
    x = times.join(found, (F.col("_s") == F.col("_sequence")) & (F.col("_f") == F.col("_frame")), "left")  # frames without detections age the tracks
    x = x.where("ts is not null").select("_s", (F.unix_micros("ts") / 1e6).alias("t"), F.col("_f").alias("frame"), "ts", F.col("_frame").isNotNull().alias("there"), "pos", "x", "y", *values)
    order = ["_s", "t", "pos", "x", "y"]
    point = pa.struct([("frame", pa.string()), ("ts", pa.timestamp("us", "UTC")), *((c, pa.float64()) for c in ("x", "y", *values, "residual"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(sequence: int, tracker: Tracker) -> Iterator[pa.RecordBatch]:
            done = [t for t in tracker.done if len(t.rows) >= config.min_track_frames]
            tracker.done = []
            if done:
                points = [[{**p[1], "residual": r} for p, r in zip(t.rows, t.residuals, strict=True)] for t in done]
                first = [pa.array([t.first[k] for t in done], pa.float64()) for k in range(3)]
                yield pa.record_batch([pa.array([sequence] * len(done), pa.int64()), *first, pa.array([t.rows[0][0] for t in done], pa.int64()), pa.array(points, pa.list_(point))], ["sequence_id", "t", "x", "y", "nth", "points"])

        def frame_done(held: list[dict], tracker: Tracker) -> None:
            rows = [r for r in held if r["there"]]
            places = np.array([(np.nan if r["x"] is None else r["x"], np.nan if r["y"] is None else r["y"]) for r in rows], float).reshape(-1, 2)
            tracker.step(held[0]["t"], places, [(k, {c: r[c] for c in ("frame", "ts", "x", "y", *values)}) for k, r in enumerate(rows)])

        held, tracker = [], Tracker(config)
        for b in batches:
            for r in b.to_pylist():
                if held and (r["_s"], r["t"]) != (held[0]["_s"], held[0]["t"]):
                    frame_done(held, tracker)
                    if r["_s"] != held[0]["_s"]:
                        tracker.finish()
                    yield from closed(held[0]["_s"], tracker)
                    held = []
                held.append(r)
        if held:
            frame_done(held, tracker)
            tracker.finish()
            yield from closed(held[0]["_s"], tracker)

    n = int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracks = x.repartition(n, "_s").sortWithinPartitions(*order).mapInArrow(run, f"sequence_id long, t double, x double, y double, nth long, points array<{POINT}>")
    by = Window.partitionBy("sequence_id").orderBy("t", "x", "y", "nth")
    name = F.format_string(f"seq%d_{tag.replace('%', '%%')}_%05d", "sequence_id", F.row_number().over(by) - 1)
    return tracks.withColumn("track_id", name).select("sequence_id", "track_id", F.posexplode("points").alias("seq", "p")).select("sequence_id", "track_id", "seq", "p.*")
