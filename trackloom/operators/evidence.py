"""Evidence packages and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, let, whole
from ..schemas import FEATURES
from .ranking import FUSION

#: What every package states. Fixed values.
CAVEATS = (
    "Scores are ranking signals, not detection probabilities; model calibration on unseen months is weak.",
    "A candidate is not a discovery: confirmation requires human review and astrometric verification.",
)


def packages(candidates: DataFrame, points: DataFrame, dna: DataFrame, predictions: DataFrame, events: DataFrame, provenance: dict[str, Column]) -> DataFrame:
    """One row a candidate: track_id and nested candidate, track, motion_dna, predictions, event, provenance, caveats.

    candidates: track_id, sequence_id, instrument, start_time, end_time, n_frames, label, status; points: schemas.TRACK_POINTS;
    dna: track_id and the features; predictions: track_id, run_id, model_version, score; events: track_id, event. A
    candidate without points is an error, as nothing is made up.
    """
    track = points.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seq", "frame", "ts", "x", "y", "area", "flux", "residual"))).alias("track"))
    runs = predictions.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("run_id", "model_version", "score"))).alias("predictions"))
    x = candidates.join(track, "track_id", "left").join(dna.select("track_id", F.struct(*FEATURES).alias("motion_dna")), "track_id", "left")
    x = x.join(runs, "track_id", "left").join(events.select("track_id", "event"), "track_id", "left")
    known = F.when(F.col("track").isNull(), F.raise_error(F.concat(F.col("track_id"), F.lit(" has no track")))).otherwise(F.col("track"))
    return x.select(
        "track_id",
        F.struct("sequence_id", "instrument", "start_time", "end_time", "n_frames", "label", "status").alias("candidate"),
        known.alias("track"),
        "motion_dna",
        F.coalesce("predictions", F.expr("array()").cast("array<struct<run_id:string,model_version:string,score:double>>")).alias("predictions"),
        "event",
        F.struct(*(c.alias(k) for k, c in provenance.items())).alias("provenance") if provenance else F.lit(None).cast("string").alias("provenance"),
        F.array(*map(F.lit, CAVEATS)).alias("caveats"),
    )


def compact(packages_: DataFrame) -> DataFrame:
    """Packages without per-frame arrays: n_points, first and last position in their place."""
    place = lambda i: F.transform(F.slice("track", F.lit(i), F.lit(1)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    brief = F.struct(F.size("track").alias("n_points"), F.get(place(1), F.lit(0)).alias("first_position"), F.get(place(-1), F.lit(0)).alias("last_position"))
    return packages_.withColumn("track_summary", brief).drop("track", "provenance")


def reports(packages_: DataFrame) -> DataFrame:
    """track_id, generated_by, report: a deterministic text from the evidence alone. Its lines are fixed values."""
    line = lambda c: F.concat(F.lit("- "), c)
    fused = F.filter("predictions", lambda p: p["run_id"] == FUSION)
    others = F.filter("predictions", lambda p: p["run_id"] != FUSION)
    head = F.concat(F.lit("Automated summary for `"), F.col("track_id"), F.lit("` (status "), F.col("candidate.status"), F.lit(", "), F.col("candidate.n_frames").cast("string"), F.lit(" frames, "), F.coalesce("candidate.instrument", F.lit("unknown instrument")), F.lit("). LLM narration unavailable; facts below are quoted directly from the evidence package."))
    facts = F.array(*(F.struct(F.lit(f).alias("name"), F.col(f"motion_dna.{f}").cast("double").alias("value")) for f in sorted(FEATURES)))
    facts = F.transform(F.filter(facts, lambda x: x["value"].isNotNull()), lambda x: line(F.concat(F.lit("Motion DNA "), x["name"], F.lit(": "), significant(x["value"]))))
    event = F.when(F.col("event").isNotNull(), line(F.concat(F.lit("Attribution: SOHO-"), F.col("event.soho_number").cast("string"), F.lit(" ("), F.col("event.relation"), F.lit(", "), F.coalesce("event.day", F.lit("None")), F.lit(")")))).otherwise("- No known-event attribution.")
    parts = F.concat(
        F.array(F.lit("## Assessment"), head, F.lit(""), F.lit("## Key evidence")),
        F.transform(fused, lambda p: F.concat(F.lit(f"- Fusion score ({FUSION}): "), fixed(p["score"], 4))),
        F.transform(others, lambda p: F.concat(F.lit("- "), p["run_id"], F.lit(": "), fixed(p["score"], 4))),
        facts,
        F.array(event, F.lit(""), F.lit("## Caveats")),
        F.transform("caveats", line),
    )
    return packages_.select("track_id", F.lit("fallback").alias("generated_by"), F.array_join(parts, "\n").alias("report"))


def significant(c: Column, digits: int = 4) -> Column:
    """A number with so many significant digits, trailing zeros dropped; very large and small ones in exponent form."""

    def text(x: Column) -> Column:
        n, e = x["n"], x["e"]
        places = F.lit(digits - 1) - e
        trimmed = lambda t: F.when(F.instr(t, ".") > 0, F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))).otherwise(t)
        plain = let(F.lpad(n, F.greatest(F.length(n), places + 1), "0"), lambda p: trimmed(F.concat(F.substr(p, F.lit(1), F.length(p) - places), F.lit("."), F.right(p, places))))
        sign, size = F.when(e < 0, "-").otherwise("+"), F.abs(e).cast("string")
        power = F.concat(trimmed(F.concat(F.substring(n, 1, 1), F.lit("."), F.substr(n, F.lit(2)))), F.lit("e"), sign, F.lpad(size, F.greatest(F.lit(2), F.length(size)), "0"))
        return F.when((e < -4) | (e >= digits), power).otherwise(plain)

    def settled(size: Column, e: Column) -> Column:
        """The exponent after rounding: the next power of ten, or the one before."""
        return let(whole(size, F.lit(digits - 1) - e), lambda n: F.when(n >= 10**digits, e + 1).when((n > 0) & (n < 10 ** (digits - 1)), e - 1).otherwise(e))

    def of(size: Column) -> Column:
        guess = F.when(size == 0, 0).otherwise(F.floor(F.log10(size) + 1e-12)).cast("int")
        return let(let(guess, lambda e: settled(size, e)), lambda e: text(F.struct(whole(size, F.lit(digits - 1) - e).cast("string").alias("n"), e.alias("e"))))

    return F.concat(F.when(c < 0, "-").otherwise(""), let(F.abs(c), of))


#: The summary's text. Fixed values.
SUMMARY = (
    "# Scientific validation summary", "", "Primary score: `{run}` over {n:,} scored tracks.", "", "## Known-event recovery", "",
    "{found}/{events} labeled Sungrazer events recovered by the CV pipeline; of those, {top}/{found} rank in the top 10 of their own sequence under the fusion score.", "",
    "| SOHO # | Group | Split(s) | Recovered | Best fusion | Seq rank | Global rank |", "|---|---|---|---|---|---|---|", "{event_rows}", "",
    "## Ranking quality by split", "", "| Split | Positives | Negatives | AP | P@10 | R@50 | R@250 |", "|---|---|---|---|---|---|---|", "{split_rows}", "",
)
RECOVERED = "yes ({n} track{s}) | {best:.4f} | {rank}/{pool} | {global_rank}/{global_pool}"
LOST = "no | — | — | —"


def markdown(events: DataFrame, splits: DataFrame, n_scored: int, run: str = FUSION) -> str:
    """Validation summary as text, of ``ranking.event_summary`` and ``ranking.split_summary``; both are a few rows. Splits come in the order train, val, test, others after."""
    rows = events.orderBy("soho_number").collect()
    order = F.coalesce(F.array_position(F.array(*map(F.lit, ("train", "val", "test"))), F.col("split")), F.lit(0))
    found = [r for r in rows if r.recovered]
    facts = [RECOVERED.format(n=r.n_positive_tracks, s="" if r.n_positive_tracks == 1 else "s", best=r.best_fusion if r.best_fusion is not None else float("nan"), rank=r.sequence_rank, pool=r.sequence_pool, global_rank=r.global_rank, global_pool=r.global_pool) if r.recovered else LOST for r in rows]
    measures = splits.orderBy(F.when(order == 0, 9).otherwise(order), "split").collect()
    return "\n".join(SUMMARY).format(
        run=run, n=n_scored, found=len(found), events=len(rows), top=sum(r.sequence_rank is not None and r.sequence_rank <= 10 for r in found),
        event_rows="\n".join(f"| {r.soho_number} | {r.group} | {'/'.join(r.splits)} | {x} |" for r, x in zip(rows, facts, strict=True)),
        split_rows="\n".join(f"| {m.split} | {m.n_positives} | {m.n_negatives:,} | {m.ap:.4f} | {m.p_at_10:.4f} | {m.r_at_50:.4f} | {m.r_at_250:.4f} |" for m in measures),
    )
