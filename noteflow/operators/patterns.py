"""Melodic and harmonic figures found in streams of notes.

Every detector takes notes with stream keys and returns observations
(keys, pattern, pos0, pos1, size, confidence, detail); positions count a
stream's notes in order, so all later steps cut streams into chunks of a fixed
number of notes, whatever their density in time.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import sequences as sequences_of
from ..functions.music import is_chord_mask
from ..plans.grouping import anchor_groups
from ..plans.groups import Group, map_groups
from ..plans.joins import nearest
from ..plans.walk import walk
from ..plans.timeline import CHUNK_MS, fill_after, fill_next, islands, nxt, prev, row_no, run_sum, scan, settle

NOTES_PER_CHUNK = 5000.0
KEYS = ("song_id", "stem")


def positions(notes: DataFrame, keys: Sequence[str] = KEYS, outs=None, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Number a stream's notes from 0 in time order, with any other neighbour columns of the same pass."""
    n = scan(notes, list(keys), ["start_ms", "note_id"], {"_rn": row_no(), **(outs or {})}, chunk_ms)
    return n.withColumn("pos", (F.col("_rn") - 1).cast("bigint")).drop("_rn")


def _obs(df: DataFrame, keys, pattern: str, pos0, pos1, confidence, detail) -> DataFrame:
    return df.select(*keys, F.lit(pattern).alias("pattern"), pos0.cast("bigint").alias("pos0"), pos1.cast("bigint").alias("pos1"),
                     (pos1 - pos0 + 1).cast("bigint").alias("size"), confidence.cast("double").alias("confidence"), detail.cast("string").alias("detail"))


def _seq(stream: DataFrame, keys, outs) -> DataFrame:
    return scan(stream, list(keys), ["pos"], outs, NOTES_PER_CHUNK)


def _runs(stream: DataFrame, keys, starts, cols) -> DataFrame:
    return islands(settle(stream), list(keys), ["pos"], starts, cols, "_isl", NOTES_PER_CHUNK)


def greedy(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-to-right choice of matches: one taken at ``pos`` blocks starts before pos + advance."""
    keys = list(keys)
    m = settle(matches)
    taken = walk(m, keys, "pos", "advance", NOTES_PER_CHUNK, closed=True).select(*keys, F.col("pos").cast("bigint").alias("pos")).distinct()
    return m.join(taken, [*keys, "pos"], "left_semi")


def scale_runs(notes: DataFrame, beat_ms: float, keys=KEYS) -> DataFrame:
    """Maximal runs of steps of one or two semitones in one direction, four notes or more."""
    s = positions(notes, keys, {"_p": prev("pitch")})
    iv = F.col("pitch") - F.col("_p")
    s = s.select(*keys, "pos", F.when(F.abs(iv).between(1, 2), F.signum(iv)).alias("d")).filter("d is not null")
    s = _runs(s, keys, lambda p, r: (r["pos"] != p["pos"] + 1) | (r["d"] != p["d"]), ["d"])
    g = s.groupBy(*keys, "_isl").agg(
        F.min("pos").alias("a"), F.max("pos").alias("b"), F.min("d").alias("d"))
    g = g.filter(F.col("b") - F.col("a") + 1 >= 3)
    n = F.col("b") - F.col("a") + 2
    return _obs(g, keys, "scale_run", F.col("a") - 1, F.col("b"), F.least(F.lit(0.95), 0.55 + 0.05 * n), F.when(F.col("d") > 0, "up").otherwise("down"))


def arpeggios(notes: DataFrame, beat_ms: float, keys=KEYS) -> DataFrame:
    """Runs of leaps over one chord moving mostly one way; a failing run is retried from its next note."""
    s = positions(notes, keys, {"_p": prev("pitch")})
    iv = F.col("pitch") - F.col("_p")
    s = s.filter(F.abs(iv).between(3, 12)).select(*keys, "pos", "pitch", "_p")
    s = _runs(s, keys, lambda p, r: r["pos"] != p["pos"] + 1, [])
    bit = F.pow(F.lit(2), F.pmod("pitch", F.lit(12))).cast("int").bitwiseOR(F.pow(F.lit(2), F.pmod("_p", F.lit(12))).cast("int"))
    w = Window.partitionBy(*keys, "_isl").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("mask", F.bit_or(bit).over(w)).withColumn("ups", F.sum((iv > 0).cast("int")).over(w)).withColumn(
        "edges", F.count(F.lit(1)).over(w)).withColumn("b", F.max("pos").over(w))
    share = F.greatest(F.col("ups"), F.col("edges") - F.col("ups")) / F.col("edges")
    g = s.filter((F.col("edges") >= 3) & (share >= 0.75) & is_chord_mask(F.col("mask"))).groupBy(*keys, "_isl").agg(
        F.min("pos").alias("a"), F.max("b").alias("b"))
    n = F.col("b") - F.col("a") + 2
    return _obs(g, keys, "arpeggio", F.col("a") - 1, F.col("b"), F.least(F.lit(0.9), 0.5 + 0.08 * n), F.lit(""))


def sequences(notes: DataFrame, beat_ms: float, keys=KEYS) -> DataFrame:
    """A cell of five, four or three notes repeated at once in transposition."""
    s = positions(notes, keys, {f"p{k}": nxt("pitch", k) for k in range(1, 10)}).withColumn("p0", F.col("pitch"))

    def p(k):
        return F.col(f"p{k}")

    best = F
    for cell in (5, 4, 3):
        move = p(cell) - p(0)
        ok = move.between(-12, 12) & (move != 0)
        for k in range(1, cell):
            ok = ok & (p(cell + k) - p(k) == move)
        best = best.when(ok, F.struct(F.lit(cell).alias("cell"), move.alias("move")))
    m = s.withColumn("m", best).filter("m is not null").select(*keys, "pos", (F.col("m.cell") * 2).alias("advance"), F.col("m.cell").alias("cell"), F.col("m.move").alias("move"))
    g = greedy(m, keys)
    return _obs(g, keys, "sequence", F.col("pos"), F.col("pos") + F.col("advance") - 1, F.lit(0.8), F.concat_ws(":", F.col("cell").cast("string"), F.col("move").cast("string")))


def _repeats(notes: DataFrame, keys, cells: Sequence[int], extra=()) -> DataFrame:
    """Per note and cell length, how many times in a row the cell starting there is played."""
    ks = sorted({*cells, *extra})
    s = positions(notes, keys, {f"p{k}": nxt("pitch", k) for k in ks})
    s = settle(s.select(*keys, "pos", "pitch", *[f"p{k}" for k in ks]))
    ends = {f"_e{c}": fill_next(F.when(~F.coalesce(F.col("pitch") == F.col(f"p{c}"), F.lit(False)), F.col("pos"))) for c in cells}
    s = _seq(s, keys, ends)
    for c in cells:
        s = s.withColumn(f"r{c}", F.floor((F.col(f"_e{c}") - F.col("pos")) / c) + 1)
    return s


def ostinati(notes: DataFrame, beat_ms: float, keys=KEYS) -> DataFrame:
    """A cell of two to five pitches played three times or more; longest cell first."""
    s = _repeats(notes, keys, (5, 4, 3, 2))
    best = F
    for c in (5, 4, 3, 2):
        best = best.when(F.col(f"r{c}") >= 3, F.struct(F.lit(c).alias("cell"), F.col(f"r{c}").alias("repeats")))
    m = s.withColumn("m", best).filter("m is not null").select(*keys, "pos", (F.col("m.cell") * F.col("m.repeats")).alias("advance"),
                                                              F.col("m.cell").alias("cell"), F.col("m.repeats").alias("repeats"))
    g = greedy(m, keys)
    return _obs(g, keys, "ostinato", F.col("pos"), F.col("pos") + F.col("advance") - 1, F.least(F.lit(0.92), 0.6 + 0.08 * F.col("repeats")),
                F.concat_ws("x", F.col("cell").cast("string"), F.col("repeats").cast("string")))


def _equal_runs(notes: DataFrame, keys, max_ioi: float | None) -> DataFrame:

    def other(p, r):
        differs = r["pitch"] != p["pitch"]
        return differs if max_ioi is None else differs | (r["start_ms"] - p["start_ms"] > max_ioi)

    s = positions(notes, keys).select(*keys, "pos", "pitch", "start_ms", "end_ms", "confidence")
    s = _runs(s, keys, other, ["pitch", "start_ms"])
    return s.groupBy(*keys, "_isl").agg(
        F.min("pos").alias("a"), F.max("pos").alias("b"), F.min("start_ms").alias("t0"), F.max_by("end_ms", "pos").alias("t1"),
        F.min("pitch").alias("pitch"), F.avg("confidence").alias("mean_conf")).filter(F.col("b") - F.col("a") >= 2)


def pedals(notes: DataFrame, beat_ms: float, keys=KEYS) -> DataFrame:
    """One pitch struck three times or more over at least two beats."""
    g = _equal_runs(notes, keys, None).filter((F.col("t1") - F.col("t0")) / beat_ms >= 2.0)
    return _obs(g, keys, "pedal_point", F.col("a"), F.col("b"), F.lit(0.75), F.col("pitch"))


def rearticulations(notes: DataFrame, beat_ms: float, keys=KEYS) -> DataFrame:
    """One pitch re-struck within 0.30 beat, three times or more."""
    g = _equal_runs(notes, keys, 0.30 * beat_ms)
    return _obs(g, keys, "rearticulation", F.col("a"), F.col("b"), F.lit(0.7), F.round("mean_conf", 3))


def alberti(notes: DataFrame, beat_ms: float, keys=KEYS) -> DataFrame:
    """Low-high-mid-high over a chord, the same four pitches twice or more."""
    s = _repeats(notes, keys, (4,), extra=(1, 2, 3))
    mask = F.lit(0)
    for c in ("pitch", "p1", "p2"):
        mask = mask.bitwiseOR(F.pow(F.lit(2), F.pmod(F.col(c), F.lit(12))).cast("int"))
    cyc = (F.col("pitch") < F.col("p2")) & (F.col("p2") < F.col("p1")) & (F.col("p3") == F.col("p1")) & is_chord_mask(mask)
    m = s.filter(cyc & (F.col("r4") >= 2)).select(*keys, "pos", (F.col("r4") * 4).alias("advance"), F.col("r4").alias("cycles"))
    g = greedy(m, keys)
    return _obs(g, keys, "alberti_bass", F.col("pos"), F.col("pos") + F.col("advance") - 1, F.lit(0.85), F.col("cycles"))


def neighbor_tones(notes: DataFrame, beat_ms: float, keys=KEYS) -> DataFrame:
    """A step away and back; five notes when the opposite neighbour follows."""
    s = positions(notes, keys, {f"p{k}": nxt("pitch", k) for k in range(1, 5)})
    up, down = F.col("p1") - F.col("pitch"), F.col("p3") - F.col("pitch")
    near = (F.col("p2") == F.col("pitch")) & F.abs(up).between(1, 2)
    turn = F.coalesce((F.col("p4") == F.col("pitch")) & F.abs(down).between(1, 2) & (up * down < 0), F.lit(False))
    m = s.filter(near).select(*keys, "pos", F.when(turn, 4).otherwise(2).alias("advance"), turn.alias("turn"))
    g = greedy(m, keys)
    return _obs(g, keys, "neighbor_tone", F.col("pos"), F.col("pos") + F.col("advance"), F.when(F.col("turn"), 0.85).otherwise(0.75),
                F.when(F.col("turn"), "turn").otherwise("neighbor"))


def gap_fills(notes: DataFrame, beat_ms: float, keys=KEYS) -> DataFrame:
    """A leap of 4..12 filled by two or more steps the other way."""
    s = positions(notes, keys, {"p1": nxt("pitch")})
    iv = F.col("p1") - F.col("pitch")
    s = settle(s.select(*keys, "pos", iv.alias("iv"), F.coalesce(F.when(F.abs(iv).between(1, 2), F.signum(iv)), F.lit(0.0)).alias("d")))
    # d describes the step from a note on; from the note after a leap, the fill lasts to the first other step
    s = _seq(s, keys, {"_nu": fill_after(F.when(F.col("d") != 1, F.col("pos"))), "_nw": fill_after(F.when(F.col("d") != -1, F.col("pos")))})
    filled = F.when(F.col("iv") < 0, F.col("_nu")).otherwise(F.col("_nw")) - F.col("pos") - 1
    m = s.filter(F.abs("iv").between(4, 12)).withColumn("filled", filled).filter("filled >= 2").select(
        *keys, "pos", (F.col("filled") + 1).alias("advance"), "filled", "iv")
    g = greedy(m, keys)
    return _obs(g, keys, "gap_fill", F.col("pos"), F.col("pos") + F.col("advance"), F.least(F.lit(0.9), 0.6 + 0.07 * F.col("filled")), F.col("iv"))


def chords(notes: DataFrame, beat_ms: float, keys=KEYS, window_ms: float = 45.0) -> DataFrame:
    """Three or more notes struck together that form a triad or tetrad."""
    n = positions(notes, keys)
    g = anchor_groups(n, list(keys), "start_ms", "note_id", window_ms)
    bit = F.pow(F.lit(2), F.pmod("pitch", F.lit(12))).cast("int")
    s = g.groupBy(*keys, "group_ms").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.bit_or(bit).alias("mask"))
    s = s.filter((F.col("b") - F.col("a") >= 2) & is_chord_mask(F.col("mask")))
    return _obs(s, keys, "chord", F.col("a"), F.col("b"), F.lit(0.8), F.col("mask"))


DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "scale_run": scale_runs, "arpeggio": arpeggios, "sequence": sequences, "ostinato": ostinati, "pedal_point": pedals,
    "rearticulation": rearticulations, "alberti_bass": alberti, "neighbor_tone": neighbor_tones, "gap_fill": gap_fills, "chord": chords,
}
DETECTORS_HERE = dict(DETECTORS)
GRADUATED = ("scale_run", "arpeggio", "neighbor_tone", "ostinato")
PROVISIONAL = ("chord", "gap_fill", "sequence")
DIAGNOSTIC = ("pedal_point", "rearticulation")
UNIVERSAL = ("scale_run", "arpeggio", "sequence", "ostinato", "neighbor_tone", "gap_fill")
KEYBOARD_STEMS = ("other", "piano", "guitar")
COHESIVE = ("scale_run", "arpeggio", "neighbor_tone", "alberti_bass")


def register_detector(name: str, fn: Callable[..., DataFrame]) -> None:
    """Add a caller's detector: (notes, beat_ms, keys) -> observations."""
    DETECTORS[name] = fn


def tier(name: str) -> str:
    return "graduated" if name in GRADUATED else "provisional" if name in PROVISIONAL else "diagnostic"


def with_notes(obs: DataFrame, notes: DataFrame, keys=KEYS) -> DataFrame:
    """Observations with the ids and times of their first and last notes."""
    p = positions(notes, keys).select(*keys, "pos", "note_id", "start_ms", "end_ms")
    a = p.select(*keys, F.col("pos").alias("pos0"), F.col("note_id").alias("first_id"), "start_ms")
    b = p.select(*keys, F.col("pos").alias("pos1"), F.col("note_id").alias("last_id"), "end_ms")
    return obs.join(a, [*keys, "pos0"]).join(b, [*keys, "pos1"])


def members(obs: DataFrame, notes: DataFrame, keys=KEYS) -> DataFrame:
    """One row per (observation, note): an equi-join on stream position."""
    p = positions(notes, keys)
    o = settle(obs).select(*keys, "pattern", "pos0", "pos1", F.col("confidence").alias("obs_confidence"), "size", F.explode(F.sequence("pos0", "pos1")).alias("pos"))
    return o.join(p, [*keys, "pos"])


def study(lined: DataFrame, beat_ms: float, family: DataFrame | None = None) -> DataFrame:
    """All detectors over a corpus: chords on whole stems, figures on melodic lines of four notes or more.

    ``lined`` is non-drum notes with line_id; the Alberti detector looks only at
    keyboard stems, or at stems named keyboard-like in ``family``.
    """
    keys = ["song_id", "stem", "line_id"]
    stem_n = lined.groupBy("song_id", "stem").agg(F.count(F.lit(1)).alias("_k")).filter("_k >= 4").select("song_id", "stem")
    n = lined.join(stem_n, ["song_id", "stem"], "left_semi")
    long_lines = n.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter("_k >= 4").select(*keys)
    lines = settle(n.join(long_lines, keys, "left_semi"))
    out = chords(n, beat_ms).withColumn("line_id", F.lit(None).cast(n.schema["line_id"].dataType))
    for name in UNIVERSAL:
        out = out.unionByName(DETECTORS[name](lines, beat_ms, keys))
    keyed = lines.filter(F.col("stem").isin(*KEYBOARD_STEMS))
    if family is not None:
        extra = family.filter(F.col("family").isin("piano", "guitar", "keyboard", "keys", "harp")).select("song_id", "stem")
        keyed = lines.join(extra, ["song_id", "stem"], "left_semi").unionByName(keyed).dropDuplicates(["note_id"])
    return out.unionByName(alberti(keyed, beat_ms, keys))


def coverage(obs: DataFrame, notes: DataFrame, keys) -> DataFrame:
    """Share of the studied notes that some observation of a pattern claims."""
    m = members(obs, notes, keys).groupBy("pattern").agg(F.count_distinct("note_id").alias("covered"))
    total = notes.agg(F.count(F.lit(1)).alias("studied"))
    return m.crossJoin(F.broadcast(total)).select("pattern", "covered", "studied", (F.col("covered") / F.col("studied")).alias("coverage"))


def apply_observations(obs: DataFrame, notes: DataFrame, keys, max_confidence: float = 0.60) -> DataFrame:
    """Annotation rows a study asks for: held re-strikes and cohesive gestures.

    The first strike of a rearticulation takes the group's latest end, echoes at
    or below the confidence are absorbed; cohesive figures tag their notes.
    """
    keys = list(keys)
    m = members(obs.filter(F.col("pattern").isin("rearticulation", *COHESIVE)), notes, keys)
    re = m.filter("pattern = 'rearticulation'")
    weak = (F.col("pos") > F.col("pos0")) & (F.col("confidence") <= max_confidence)
    g = re.groupBy(*keys, "pos0", "pos1").agg(F.max("end_ms").alias("g_end"), F.count_if(weak).alias("weak"),
                                              F.min_by("note_id", "pos").alias("first_id")).filter("weak > 0")
    j = re.join(g, [*keys, "pos0", "pos1"])
    first = F.col("pos") == F.col("pos0")
    held = j.filter(first | weak).select("note_id", F.lit("page_suppress").alias("kind"), F.when(first, "primary").otherwise("absorbed").alias("role"),
                                         F.when(first, F.col("g_end")).alias("end_ms"), F.when(~first, F.col("first_id")).alias("group_id"))
    coh = m.filter(F.col("pattern").isin(*COHESIVE) & (F.col("size") >= 3)).select(
        "note_id", F.lit("voice_cohesion").alias("kind"), F.col("pattern").alias("role"), F.lit(None).cast("double").alias("end_ms"), F.col("pos0").alias("group_id"))
    return held.unionByName(coh)


def motif_occurrences(notes: DataFrame, lengths=(4, 5, 6), max_gap_ms: float = 250.0) -> DataFrame:
    """Every interval n-gram of every stem with its start; quick repeats of a pitch count as one note."""
    keys = ["song_id", "stem"]
    n = notes.filter("stem <> 'drums'")
    s = positions(n, keys).select(*keys, "pos", "pitch", "start_ms", "end_ms")
    s = _runs(s, keys, lambda p, r: (r["pitch"] != p["pitch"]) | (r["start_ms"] - p["end_ms"] >= max_gap_ms), ["pitch", "start_ms", "end_ms"])
    m = s.groupBy(*keys, "_isl").agg(F.min("pos").alias("pos"), F.min("pitch").alias("pitch"), F.min("start_ms").alias("start_ms")).drop("_isl")
    m = settle(m)
    top = max(lengths)
    m = _seq(m, keys, {f"p{k}": nxt("pitch", k) for k in range(1, top + 2)})
    total = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= top + 2).select(*keys)
    m = m.join(total, keys, "left_semi")
    p = [F.col("pitch")] + [F.col(f"p{k}") for k in range(1, top + 2)]
    grams = F.array_compact(F.array(*[
        # the last position of a stem starts no gram, so one more note must follow
        F.when(p[L + 1].isNotNull(), F.array(*[(p[k + 1] - p[k]).cast("int") for k in range(L)])) for L in lengths]))
    return m.select(*keys, "start_ms", F.explode(grams).alias("gram")).filter(F.exists("gram", lambda x: x != 0))


def motifs(occurrences: DataFrame, min_count: int = 3) -> DataFrame:
    """N-grams heard three times or more in a stem, with their count and first start."""
    g = occurrences.groupBy("song_id", "stem", "gram").agg(F.count(F.lit(1)).alias("count"), F.min("start_ms").alias("first_ms"))
    return g.filter(F.col("count") >= min_count)


def motif_hits(notes: DataFrame, occurrences: DataFrame, top: int | None = None, min_count: int = 3, reach_ms: float = 60.0,
               chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Notes that start an occurrence of one of a song's leading motifs.

    The ranked motifs (all, or the first ``top`` per song) are joined back to
    their occurrences, so no motif's occurrences are ever gathered.
    """
    w = Window.partitionBy("song_id").orderBy(F.col("count").desc(), F.size("gram").desc(), "stem", "first_ms", "gram")
    lead = motifs(occurrences, min_count).withColumn("motif", F.row_number().over(w))
    if top is not None:
        lead = lead.filter(F.col("motif") <= top)
    lead = lead.withColumn("motif", F.col("motif") - 1)
    occ = occurrences.join(lead.drop("first_ms"), ["song_id", "stem", "gram"]).select("song_id", "stem", "motif", "count", F.col("start_ms").alias("occ_ms"))
    hit = nearest(occ, notes, ["song_id", "stem"], "occ_ms", "start_ms", reach_ms, {"note_id": F.col("note_id")}, chunk_ms)
    return hit.filter("note_id is not null").withColumn("confidence", F.least(F.lit(1.0), F.col("count") / 5.0))


def _shuffled(notes: DataFrame, keys, trials: int, seed: int) -> DataFrame:
    """Pitch-shuffled copies of every stream: ranks of a uniform hash re-deal the pitches."""
    keys = list(keys)
    t = settle(positions(notes, keys)).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    u = F.xxhash64("note_id", "trial", F.lit(seed)) / F.lit(2.0**64) + 0.5
    d = scan(t.withColumn("_u", u).select(*keys, "trial", "_u", "note_id", "pitch"), [*keys, "trial"], ["_u", "note_id"], {"_r": row_no()}, 0.25)
    deal = d.select(*keys, "trial", (F.col("_r") - 1).alias("pos"), F.col("pitch").alias("_dealt"))
    return t.drop("_u").join(deal, [*keys, "trial", "pos"]).withColumn("pitch", F.col("_dealt")).drop("_dealt", "pos")


def _retimed(notes: DataFrame, keys, trials: int, seed: int) -> DataFrame:
    """Time-shuffled copies: gaps and lengths of a stream dealt out again in hash order."""
    keys = list(keys)
    p = settle(_seq(positions(notes, keys), keys, {"_n": nxt("start_ms")}))
    t = p.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    tk = [*keys, "trial"]

    def deal(value: Column, salt: int, name: str, keep: Column) -> DataFrame:
        u = F.xxhash64("note_id", "trial", F.lit(seed + salt)) / F.lit(2.0**64) + 0.5
        d = t.filter(keep).select(*tk, "note_id", value.alias(name), u.alias("_u"))
        return scan(d, tk, ["_u", "note_id"], {"_r": row_no()}, 0.25).select(*tk, (F.col("_r") - 1).alias("pos"), name)

    gaps = deal(F.greatest(F.lit(1.0), F.col("_n") - F.col("start_ms")), 1, "_g", F.col("_n").isNotNull())
    durs = deal(F.greatest(F.lit(1.0), F.col("end_ms") - F.col("start_ms")), 2, "_d", F.lit(True))
    j = t.join(gaps, [*tk, "pos"], "left").join(durs, [*tk, "pos"])
    first = p.filter("pos = 0").select(*keys, F.col("start_ms").alias("_t0"))
    j = scan(settle(j.join(first, keys)), tk, ["pos"], {"_cum": run_sum(F.coalesce("_g", F.lit(0.0)))}, NOTES_PER_CHUNK)
    start = F.col("_t0") + F.col("_cum") - F.coalesce("_g", F.lit(0.0))
    return j.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col("_d")).drop("_g", "_d", "_cum", "_t0", "_n", "pos")


# Nulls that destroy what a figure claims; figures not listed use the pitch null.
VALID_NULLS = {"chord": ("pitch", "time"), "rearticulation": ("pitch", "time"), "pedal_point": ("pitch", "time")}


# Notes of a stream whose copies one Python pass takes, and of all streams of a pass.
COUNTS = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("c", T.LongType())])
NOTES_PER_STREAM, NOTES_PER_PASS = int(NOTES_PER_CHUNK), 20000


def _claims(notes: DataFrame, beat_ms: float, names: Sequence[str], keys, trials: int, seed: int) -> DataFrame:
    """pattern, kind, c: notes that figures claim in the real streams and in all copies of a kind, copies being rows."""
    tk = [*keys, "trial"]
    # one stream key tells the copies apart: 0 the real notes, then the pitch and the time shuffles
    late = F.col("trial") + trials
    copies = settle(notes.withColumn("trial", F.lit(0)).unionByName(_shuffled(notes, keys, trials, seed).select(*notes.columns, "trial")).unionByName(
        _retimed(notes, keys, trials, seed).withColumn("trial", late).select(*notes.columns, "trial")))
    kind = F.when(F.col("trial") == 0, "real").when(F.col("trial") <= trials, "pitch").otherwise("time")
    out = None
    for name in names:
        m = members(DETECTORS[name](copies, beat_ms, tk), copies, tk)
        c = m.groupBy("pattern", kind.alias("kind"), "trial").agg(F.count_distinct("note_id").alias("c")).groupBy("pattern", "kind").agg(F.sum("c").alias("c"))
        out = c if out is None else out.unionByName(c)
    return out


def _short_claims(notes: DataFrame, passes: int, beat_ms: float, names: Sequence[str], keys, trials: int, seed: int) -> DataFrame:
    """``_claims`` of short streams: some thousand streams a pass, which makes their copies one after the other."""
    keys = list(keys)

    def draws(name: str, salt: int) -> list[Column]:
        return [(F.xxhash64("note_id", F.lit(k), F.lit(seed + salt)) / F.lit(2.0**64) + 0.5).alias(f"_{name}{k}") for k in range(1, trials + 1)]

    rows = notes.select(*keys, "note_id", "start_ms", "end_ms", "pitch", F.pmod(F.xxhash64(*keys), F.lit(passes)).alias("_pass"),
                        *draws("p", 0), *draws("g", 1), *draws("d", 2))

    def one(p: Group) -> dict:
        s = sequences_of.Laid(sequences_of.borders(*[p[k] for k in keys]))
        ids, pitch, start, end = p["note_id"], *[p[c].astype(float) for c in ("pitch", "start_ms", "end_ms")]
        found = {(n, k): 0 for n in names for k in ("real", "pitch", "time")}

        def count(kind: str, pitch, start, end, times: int = 1, which=names) -> None:
            for n in which:
                found[n, kind] += times * sequences_of.covered(sequences_of.FIGURES[n](s, pitch, start, end, beat_ms), s.n)

        count("real", pitch, start, end)
        inner = np.flatnonzero(s.at + 1 < s.tail)
        gap, held = np.maximum(1.0, s.lead(start) - start), np.maximum(1.0, end - start)
        for k in range(1, trials + 1):
            count("pitch", pitch[s.dealt(p[f"_p{k}"], ids)], start, end)
            g = np.zeros(s.n)
            g[inner] = gap[inner][np.lexsort((ids[inner], p[f"_g{k}"][inner], s.of[inner]))]
            t = start[s.head] + s.run_sum(g) - g
            count("time", pitch, t, t + held[s.dealt(p[f"_d{k}"], ids)], which=[n for n in names if n not in sequences_of.TIMELESS])
        for n in names:
            if n in sequences_of.TIMELESS:
                found[n, "time"] = trials * found[n, "real"]
        return {"pattern": [n for n, _ in found], "kind": [k for _, k in found], "c": list(found.values())}

    counts = map_groups(rows, None, ["_pass"], [*keys, "start_ms", "note_id"], one, COUNTS)
    return counts.groupBy("pattern", "kind").agg(F.sum("c").alias("c")).filter("c > 0")


def null_model(notes: DataFrame, beat_ms: float, names: Sequence[str], keys=KEYS, trials: int = 5, seed: int = 0) -> DataFrame:
    """Coverage of each pattern against pitch- and time-shuffled copies, with a verdict.

    Streams of up to ``NOTES_PER_STREAM`` notes are dealt out whole, thousands to a Python pass, and their copies never
    leave it.  Longer streams, those with missing values and detectors of a caller's own run
    on rows, the trial number being one more stream key.  ``note_id`` is unique.
    """
    keys, names = list(keys), list(names)
    notes = settle(notes)
    own = [n for n in names if DETECTORS[n] is not DETECTORS_HERE.get(n)]
    here = [n for n in names if n not in own]
    total = notes.agg(F.count(F.lit(1)).alias("total"))
    plain = F.lit(True)
    for c in ("note_id", *keys):
        plain = plain & F.col(c).isNotNull()
    for c in ("pitch", "start_ms", "end_ms"):
        plain = plain & F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    sizes = notes.groupBy(*keys).agg(((F.count(F.lit(1)) <= NOTES_PER_STREAM) & F.bool_and(plain)).alias("_short"))
    short = notes.join(sizes.filter("_short").drop("_short"), keys, "left_semi")
    long = notes.join(sizes.filter("not _short").drop("_short"), keys, "left_semi")
    passes = -(-total.first()["total"] // NOTES_PER_PASS)
    parts = []
    if here and passes:
        parts.append(_short_claims(short, passes, beat_ms, here, keys, trials, seed))
        if not long.isEmpty():
            parts.append(_claims(settle(long), beat_ms, here, keys, trials, seed))
    if own or not parts:
        parts.append(_claims(notes, beat_ms, own or names, keys, trials, seed))
    out = reduce(DataFrame.unionByName, parts)
    g = out.groupBy("pattern").agg(*[F.sum(F.when(F.col("kind") == k, F.col("c"))).alias(k) for k in ("real", "pitch", "time")])
    grid = notes.sparkSession.createDataFrame([(n,) for n in names], "pattern string").join(g, "pattern", "left").crossJoin(F.broadcast(total))
    real = F.coalesce("real", F.lit(0)) / F.col("total")
    np_, nt = [F.coalesce(k, F.lit(0)) / F.col("total") / trials for k in ("pitch", "time")]
    null = F.when(F.col("pattern").isin(*VALID_NULLS), F.greatest(np_, nt)).otherwise(np_)
    v = grid.select("pattern", real.alias("real"), np_.alias("null_pitch"), nt.alias("null_time"), null.alias("null"))
    verdict = (F.when(F.col("real") < 1e-6, "DEAD").when(F.col("real") > 0.95, "TOO_LOOSE")
               .when((F.col("null") > 1e-9) & (F.col("real") / F.col("null") < 1.5), "NOISE").otherwise("REAL"))
    return v.select("pattern", "real", "null_pitch", "null_time", F.when(F.col("null") > 1e-9, F.col("real") / F.col("null")).alias("lift"), verdict.alias("verdict"))
