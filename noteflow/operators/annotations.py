"""Append-only annotation log: latest values, histories, consolidation, ties."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.joins import nearest, points_in
from ..plans.timeline import CHUNK_MS, islands, max_before, nxt, scan, settle


def latest(annotations: DataFrame, value: str = "value") -> DataFrame:
    """Last written row per (note, kind): a partial-aggregating max_by, no sort."""
    return annotations.groupBy("note_id", "kind").agg(F.max_by(value, "seq").alias(value), F.max("seq").alias("seq"))


def pivot_latest(annotations: DataFrame, kinds: Sequence[str], value: str = "value") -> DataFrame:
    """One row per note with one column per kind, in a single aggregation."""
    return annotations.groupBy("note_id").agg(
        *[F.max_by(value, F.when(F.col("kind") == k, F.col("seq"))).alias(k) for k in kinds]
    )


def with_latest(notes: DataFrame, annotations: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return notes.join(pivot_latest(annotations.filter(F.col("kind").isin(*kinds)), kinds), "note_id", "left")


def history(annotations: DataFrame, kind: str | None = None) -> DataFrame:
    """Rows of a kind with their place in the note's own history."""
    rows = annotations if kind is None else annotations.filter(F.col("kind") == kind)
    w = Window.partitionBy("note_id").orderBy("seq")
    return rows.withColumn("version", F.row_number().over(w))


def attacked(notes: DataFrame, onsets: DataFrame, window_ms: float = 50.0, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Add ``attack``: an onset of the same stem lies within the window of the note's start."""
    hit = nearest(notes, onsets, ["song_id", "stem"], "start_ms", "t_ms", window_ms, {"_hit": F.col("t_ms")}, chunk_ms)
    return hit.withColumn("attack", F.col("_hit").isNotNull()).drop("_hit")


def consolidate(notes: DataFrame, onsets: DataFrame | None = None, max_gap_ms: float = 60.0,
                chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Label fragments of one sounding note: adds run_start, run_note (the primary's id).

    Within (song, stem, pitch) a note joins the running note when the gap to the
    latest end so far is small and no attack marks a re-strike.  The running
    maximum may be taken over the whole voice: a break always starts after it.
    """
    keys, order = ["song_id", "stem", "pitch"], ["start_ms", "note_id"]
    n = attacked(notes, onsets, 50.0, chunk_ms) if onsets is not None else notes.withColumn("attack", F.lit(False))
    n = settle(scan(n, keys, order, {"_reach": max_before("end_ms")}, chunk_ms))
    gap = F.col("start_ms") - F.col("_reach")
    joins = (gap <= max_gap_ms) & ((gap < 20.0) | ~F.col("attack"))
    n = n.withColumn("_new", F.col("_reach").isNull() | ~joins)
    n = islands(n, keys, order, lambda p, r: r["_new"], ["_new"], "_run", chunk_ms).drop("_new")
    return n.withColumn("run_note", F.col("_run.note_id")).drop("_reach", "_run")


def consolidation_rows(runs: DataFrame) -> DataFrame:
    """Role of every fragment that belongs to a run of two or more."""
    g = runs.groupBy("song_id", "stem", "pitch", "run_note").agg(
        F.max("end_ms").alias("run_end_ms"),
        (F.count(F.lit(1)) - 1).alias("absorbed"),
        F.max_by("note_id", F.struct("end_ms", -F.col("start_ms"), -F.col("note_id"))).alias("last_note_id"),
    ).filter("absorbed > 0")
    j = runs.select("song_id", "stem", "pitch", "run_note", "note_id").join(
        g, ["song_id", "stem", "pitch", "run_note"])
    first = F.col("note_id") == F.col("run_note")
    return j.select(
        "song_id", "note_id",
        F.when(first, "primary").otherwise("absorbed").alias("role"),
        F.when(first, F.col("run_end_ms")).alias("run_end_ms"),
        F.when(first, F.col("absorbed")).alias("absorbed"),
        F.when(first, F.col("last_note_id")).alias("last_note_id"),
        F.when(~first, F.col("run_note")).alias("into"),
    )


def merged(runs: DataFrame) -> DataFrame:
    """One row per run: the primary's pitch and start with the run's end."""
    return runs.groupBy("song_id", "stem", "pitch", F.col("run_note").alias("note_id")).agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.min_by("confidence", F.struct("start_ms", "note_id")).alias("confidence"),
        F.count(F.lit(1)).alias("fragments"),
    )


def tie_candidates(notes: DataFrame, beats: DataFrame, proximity_ms: float = 30.0, max_gap_ms: float = 40.0,
                   chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Neighbours of one pitched stem that read as one tied note across a beat.

    Reach is bounded by the gap rule, but the next note in order decides, so the
    lead runs over the whole stem.  Drums have no ties.
    """
    nx = F.struct("pitch", "start_ms", "confidence", "note_id")
    n = scan(notes.filter("stem <> 'drums'"), ["song_id", "stem"], ["start_ms", "note_id"], {"_n": nxt(nx)}, chunk_ms)
    gap = F.col("_n.start_ms") - F.col("end_ms")
    n = n.filter(
        (F.col("_n.pitch") == F.col("pitch")) & gap.between(0.0, max_gap_ms)
        & (F.col("_n.confidence") <= F.col("confidence"))
    ).select(
        "song_id", F.col("note_id").alias("first_id"), F.col("_n.note_id").alias("second_id"),
        gap.alias("gap_ms"), ((F.col("end_ms") + F.col("_n.start_ms")) / 2).alias("mid_ms"),
    )
    hit = nearest(n, beats, ["song_id"], "mid_ms", "t_ms", proximity_ms, {"beat_ms": F.col("t_ms")}, chunk_ms)
    return hit.filter("beat_ms is not null")


def tie_flags(notes: DataFrame, ties: DataFrame) -> DataFrame:
    """tie_start / tie_stop flags, set only when both notes of a tie survive."""
    alive = notes.select("note_id")
    both = ties.join(alive.withColumnRenamed("note_id", "first_id"), "first_id", "left_semi").join(
        alive.withColumnRenamed("note_id", "second_id"), "second_id", "left_semi")
    ends = both.select(F.explode(F.array(
        F.struct(F.col("first_id").alias("note_id"), F.lit(1).alias("a"), F.lit(0).alias("b")),
        F.struct(F.col("second_id").alias("note_id"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("x"))
    flags = ends.groupBy("x.note_id").agg((F.max("x.a") == 1).alias("tie_start"), (F.max("x.b") == 1).alias("tie_stop"))
    off = F.lit(False)
    return notes.join(flags, "note_id", "left").withColumns(
        {"tie_start": F.coalesce("tie_start", off), "tie_stop": F.coalesce("tie_stop", off)})


def section_lookup(notes: DataFrame, sections: DataFrame, bucket_ms: float = 4000.0) -> DataFrame:
    """Label, index and instance of the section holding each note's start.

    Sections are few per song but grow with the corpus, so they are joined on
    (song, time bucket) rather than broadcast.
    """
    by_label = Window.partitionBy("song_id", "label").orderBy("idx")
    whole = Window.partitionBy("song_id", "label")
    s = sections.select(
        "song_id", "idx", "label", F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"),
        (F.row_number().over(by_label) - 1).alias("instance"),
        (F.count(F.lit(1)).over(whole) >= 2).alias("repeats"),
    )
    return points_in(s, notes, ["song_id"], "s_start", "s_end", "start_ms", bucket_ms, closed_end=False)


def refine_onsets(notes: DataFrame, onsets: DataFrame, max_shift_ms: float = 60.0,
                  chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Each note's onset as seen by two witnesses: adds resolved_ms and disagreement."""
    keys = ["song_id", "stem"]
    a = nearest(notes, onsets.filter("witness = 'w1'"), keys, "start_ms", "t_ms", max_shift_ms,
                {"w1_ms": F.col("t_ms")}, chunk_ms)
    b = nearest(a, onsets.filter("witness = 'w2'"), keys, "start_ms", "t_ms", max_shift_ms,
                {"w2_ms": F.col("t_ms")}, chunk_ms)
    w1, w2 = F.col("w1_ms"), F.col("w2_ms")
    both = w1.isNotNull() & w2.isNotNull()
    return b.withColumn("resolved_ms", F.when(both, 0.5 * w1 + 0.5 * w2).otherwise(F.coalesce(w1, w2))).withColumn(
        "disagreement",
        F.when(both, F.least(F.lit(1.0), F.abs(w1 - w2) / max(max_shift_ms, 1.0))).otherwise(0.0))


def accepted_refinements(refined: DataFrame) -> DataFrame:
    shift = F.col("resolved_ms") - F.col("start_ms")
    return refined.filter(
        F.col("resolved_ms").isNotNull() & (F.col("disagreement") <= 0.5) & (F.abs(shift) >= 5.0)
        & (F.col("resolved_ms") < F.col("end_ms"))
    ).withColumn("shift_ms", shift).withColumn(
        "refined_confidence", F.col("confidence") * (1.0 - F.col("disagreement")))


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per check name: both values, whether they differ, and the numeric change."""
    a = left.select("name", F.col("value").alias("left_value"), F.col("status").alias("status_left"))
    b = right.select("name", F.col("value").alias("right_value"), F.col("status").alias("status_right"))
    return a.join(b, "name", "full_outer").select(
        "name", "left_value", "right_value",
        (~F.col("left_value").eqNullSafe(F.col("right_value"))).alias("changed"),
        (F.col("right_value") - F.col("left_value")).alias("numeric_delta"),
        F.coalesce("status_left", F.lit("INFO")).alias("status_left"),
        F.coalesce("status_right", F.lit("INFO")).alias("status_right"),
    )

