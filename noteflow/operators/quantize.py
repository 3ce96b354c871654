"""Note values and the notation time line."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.music import clip, fused, hz_to_midi, nearest_value
from ..plans.carry import carry
from ..plans.grouping import anchor_groups
from ..plans.groups import Group
from ..plans.joins import points_in
from ..plans.timeline import CHUNK_MS, islands, nxt, prev, row_no, scan, settle
from .tempo import tempo_map

# Note values in beats with their reading cost, in the order they are tried.
SYMBOLS = (
    ("whole", 4.0, 0.0), ("dotted_half", 3.0, 1.5), ("half", 2.0, 1.0), ("dotted_quarter", 1.5, 2.5),
    ("quarter", 1.0, 2.0), ("dotted_eighth", 0.75, 3.5), ("eighth", 0.5, 3.0), ("dotted_sixteenth", 0.375, 4.5),
    ("sixteenth", 0.25, 4.0), ("thirty_second", 0.125, 5.0), ("triplet", 2.0 / 3.0, 5.0),
    ("quintuplet", 0.8, 7.0), ("septuplet", 4.0 / 7.0, 8.0), ("compound_triplet", 0.75, 5.5),
)
WRITABLE = (0.25, 0.375, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0)
WRITABLE_TRIPLETS = (1.0 / 3.0, 2.0 / 3.0, 4.0 / 3.0, 8.0 / 3.0)
READABLE = (1 / 6, 1 / 4, 1 / 3, 1 / 2, 2 / 3, 3 / 4, 1.0, 4 / 3, 3 / 2, 2.0, 8 / 3, 3.0, 4.0, 6.0, 8.0)
DIVISORS = (1, 2, 3, 4, 6)


def duration_hypotheses(duration: Column, beat_ms: Column, tolerance: float = 0.08) -> Column:
    """Array of struct(rank, name, ms, probability) of the note values a duration could be."""
    wide = tolerance * 3
    entries = []
    for i, (name, beats, cost) in enumerate(SYMBOLS):
        ms = beat_ms * beats
        err = F.abs(duration - ms) / ms
        entries.append(F.when(err <= wide, F.struct(
            F.lit(i).alias("rank"), F.lit(name).alias("name"), ms.alias("ms"),
            F.greatest(F.lit(0.0), 1.0 - err / wide).alias("score"), F.lit(cost).alias("cost"))))
    scored = F.array_compact(F.array(*entries))
    total = F.aggregate(scored, F.lit(0.0), lambda a, x: a + x["score"])
    share = F.transform(scored, lambda x: F.struct(
        x["rank"].alias("rank"), x["name"].alias("name"), x["ms"].alias("ms"),
        F.when(total > 0, x["score"] / total).otherwise(0.0).alias("p"), x["cost"].alias("cost")))
    unknown = F.array(F.struct(F.lit(99).alias("rank"), F.lit("unknown").alias("name"), duration.alias("ms"),
                               F.lit(0.3).alias("p"), F.lit(5.0).alias("cost")))
    return F.when(F.size(scored) == 0, unknown).otherwise(share)


def ranked(hyp: Column) -> Column:
    """Hypotheses by falling probability, table order on ties."""
    keyed = F.transform(hyp, lambda x: F.struct((-F.round(x["p"], 12)).alias("o"), x["rank"].alias("rank"), x.alias("h")))
    return F.transform(F.array_sort(keyed), lambda x: x["h"])


def contended(order: Column) -> Column:
    return (F.size(order) >= 2) & (order[0]["p"] - F.get(order, F.lit(1))["p"] < 0.15)


def simplest(order: Column) -> Column:
    """Cheapest reading among those within 0.15 probability of the top one."""
    near = F.filter(order, lambda x: F.round(order[0]["p"] - x["p"], 12) <= 0.15)
    keyed = F.transform(near, lambda x, i: F.struct(x["cost"].alias("c"), i.alias("i"), x.alias("h")))
    return F.array_min(keyed)["h"]


def writable(beats: Column, triplets: bool = False, divisor: int | None = None) -> Column:
    """Writable value nearest to a length in beats."""
    return nearest_value(beats, _values(triplets, divisor))


def writable_at_most(beats: Column, triplets: bool = False, divisor: int | None = None) -> Column:
    """Largest writable value that fits, 0 when none does."""
    vals = F.array(*[F.lit(float(v)) for v in _values(triplets, divisor)])
    return F.coalesce(F.array_max(F.filter(vals, lambda v: v <= beats + 1e-9)), F.lit(0.0))


def _values(triplets: bool, divisor: int | None):
    if divisor:
        return (*WRITABLE, *[k / divisor for k in range(1, 2 * divisor + 1)])
    return (*WRITABLE, *(WRITABLE_TRIPLETS if triplets else ()))


def beat_knots(beats: DataFrame, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Beat index, time and following gap (the last beat keeps the gap before it), with the song's last index."""
    b = scan(beats.select("song_id", "t_ms"), ["song_id"], ["t_ms"], {"_i": row_no(), "_n": nxt("t_ms"), "_p": prev("t_ms")}, chunk_ms)
    last = beats.groupBy("song_id").agg((F.count(F.lit(1)) - 1).alias("last_i"))
    gap = F.coalesce(F.col("_n") - F.col("t_ms"), F.col("t_ms") - F.col("_p"))
    return b.join(last, "song_id").select("song_id", (F.col("_i") - 1).alias("i"), F.col("t_ms").alias("t0"), gap.alias("gap"), "last_i")


def beats_to_ms(events: DataFrame, beats: DataFrame, pos: str, name: str, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Inverse of the tempo map: time of a beat position, by equi-join on the beat index."""
    k = settle(beat_knots(beats, chunk_ms))
    last = k.select("song_id", "last_i").distinct()
    e = events.join(last, "song_id").withColumn(
        "i", F.greatest(F.lit(0).cast("bigint"), F.least(F.floor(pos), F.col("last_i") - 1)))
    j = e.drop("last_i").join(k.drop("last_i"), ["song_id", "i"])
    return j.withColumn(name, F.col("t0") + (F.col(pos) - F.col("i")) * F.col("gap")).drop("i", "t0", "gap")


def notation_quantize(notes: DataFrame, beats: DataFrame, beat_ms: float, subdivisions: int = 4,
                      chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Page start and end of each note on the tracked beat grid."""
    n = tempo_map(notes, beats, "start_ms", chunk_ms)
    h = simplest(ranked(duration_hypotheses(F.col("end_ms") - F.col("start_ms"), F.lit(float(beat_ms)))))
    n = n.withColumn("_h", h)
    snapped = F.bround(F.round(F.col("beat_pos") * subdivisions, 9)) / float(subdivisions)
    n = n.withColumn("page_pos", snapped).withColumn("page_end_pos", snapped + F.col("_h.ms") / beat_ms)
    n = n.withColumn("symbol", F.col("_h.name")).drop("_h")
    n = beats_to_ms(n, beats, "page_pos", "page_start_ms", chunk_ms)
    return beats_to_ms(n, beats, "page_end_pos", "page_end_ms", chunk_ms)


def isochronous_quantize(start: Column, duration: Column, origin: Column, beat_ms: float, subdivisions: int = 4):
    """(start, end, symbol) on an even grid from an origin."""
    step = beat_ms / subdivisions
    h = simplest(ranked(duration_hypotheses(duration, F.lit(float(beat_ms)))))
    s = origin + F.bround(F.round((start - origin) / step, 9)) * step
    return s, s + h["ms"], h["name"]


def groove_quantize(notes: DataFrame, beats: DataFrame, swing: Column, strength: Column, window_ms: Column,
                    subdivisions: int = 4, preserve_human: bool = False, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Gentle pull toward the (swung) grid; ghosts and notes inside the pocket stay put."""
    n = tempo_map(notes, beats, "start_ms", chunk_ms)
    raw, pos, gap = F.col("start_ms"), F.col("beat_pos"), F.col("local_beat_ms")
    idx = F.bround(F.round(pos * subdivisions, 9))
    target = raw + (idx / float(subdivisions) - pos) * gap
    ghost = F.col("velocity") < 30
    if preserve_human:
        far = F.abs(raw - target) > 80.0
        moved = F.greatest(F.lit(0.0), raw + F.when(target > raw, 16.0).otherwise(-16.0))
        start = F.when(ghost | ~far, raw).otherwise(moved)
        reason = F.when(ghost, "ghost_note_preserved").when(far, "preserve_human_capped").otherwise("preserve_human_within_bounds")
    else:
        phase = pos - F.floor(pos)
        off = (F.abs(phase - 0.5) < 0.5 / subdivisions) if subdivisions == 4 else F.lit(False)
        period = gap / subdivisions
        goal = target + F.when(off & (swing > 0.5), (swing - 0.5) * period).otherwise(0.0)
        s = clip(strength * (1.0 - F.col("confidence")), 0.0, 1.0)
        delta = (1 - s) * raw + s * goal - raw
        delta = F.greatest(F.lit(-40.0), F.least(F.lit(80.0), delta))
        inside = F.abs(raw - goal) <= window_ms
        start = F.when(ghost | inside, raw).otherwise(F.greatest(F.lit(0.0), raw + delta))
        reason = F.when(ghost, "ghost_note_preserved").when(inside, "within_pocket").otherwise("snapped")
    n = n.withColumn("q_start_ms", start).withColumn("reason", reason)
    return n.withColumn("q_end_ms", F.greatest(F.col("q_start_ms") + 10.0, F.col("end_ms") + F.col("q_start_ms") - raw))


def fillings(swing: float = 0.5) -> list[tuple[int, tuple[int, ...], float]]:
    """Every (divisor, slots, log prior) a beat can be read as; half-empty tuplets are left out."""
    out = []
    for d in DIVISORS:
        tuplet = d in (3, 6)
        penalty = 0.0
        if tuplet:
            swung = min(1.0, max(0.0, 1.0 - (swing - 0.5) / (2.0 / 3.0 - 0.5)))
            penalty = 2.0 * (swung if d == 3 else d / 3.0)
        for n in range(1, d + 1):
            if tuplet and n < math.ceil(2.0 / 3.0 * d):
                continue
            cost = n + penalty + 0.5 * (d - n) + 0.25 * math.log2(d)
            out += [(d, slots, -0.5 * cost) for slots in itertools.combinations(range(d), n)]
    return out


def infer_beat(fractions: Column, swing: float = 0.5) -> Column:
    """Best reading of a beat's onset fractions as struct(divisor, slots, error), null when none fits.

    The vocabulary is a constant of 73 readings, so the choice is a pure column
    expression: no join, no shuffle.
    """
    vocab = fillings(swing)
    by_n = F
    for n in range(1, 7):
        rows = [F.struct(F.lit(i).alias("i"), F.lit(d).alias("d"), F.array(*[F.lit(k / d) for k in slots]).alias("pos"), F.lit(prior).alias("prior"))
                for i, (d, slots, prior) in enumerate(vocab) if len(slots) == n]
        by_n = by_n.when(F.size(fractions) == n, F.array(*rows))
    obs = F.array_sort(fractions)

    def score(v):
        sse = F.aggregate(F.zip_with(obs, v["pos"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
        post = -sse / (2.0 * 0.08 * 0.08) + v["prior"]
        return F.struct(F.round(post, 9).alias("post"), (-v["i"]).alias("o"), v["d"].alias("divisor"), v["pos"].alias("slots"),
                        F.sqrt(sse / F.size(obs)).alias("error"))

    best = F.array_max(F.transform(by_n, score))
    return F.when(best["error"] <= 0.10, best)


def beat_fractions(notes: DataFrame, beats: DataFrame, tolerance_ms: float = 40.0, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Chord groups of each stem placed in beats: one row per group with beat start, length and fraction."""
    g = anchor_groups(notes, ["song_id", "stem"], "start_ms", "note_id", tolerance_ms, chunk_ms=chunk_ms)
    per = g.groupBy("song_id", "stem", "group_ms").agg(F.max("end_ms").alias("g_end"))
    per = scan(settle(per), ["song_id", "stem"], ["group_ms"], {"next_group_ms": nxt("group_ms")}, chunk_ms)
    m = tempo_map(per, beats, "group_ms", chunk_ms)
    idx = F.floor("beat_pos")
    late = (F.col("beat_pos") - idx) > 1.0 - 1.0 / 16.0
    m = m.withColumn("beat_no", F.when(late, idx + 1).otherwise(idx)).withColumn("_b1", F.col("beat_no") + 1)
    m = beats_to_ms(m, beats, "beat_no", "beat_start", chunk_ms)
    m = beats_to_ms(m, beats, "_b1", "beat_end", chunk_ms).drop("_b1")
    m = m.withColumn("beat_len", F.greatest(F.lit(1.0), F.col("beat_end") - F.col("beat_start")))
    return m.withColumn("frac", clip((F.col("group_ms") - F.col("beat_start")) / F.col("beat_len"), 0.0, 0.999))


def voice_rhythm(notes: DataFrame, beats: DataFrame, swing: float = 0.5, beat_ms: float = 500.0, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Page timing of every chord group from the rhythm its beat was read as.

    Groups of one beat are at least the chord tolerance apart, so the array per
    (song, stem, beat) is short whatever the song's size.  Groups of a beat without a reading
    are snapped one by one as ``notation_quantize`` does; ``by_rhythm`` tells which way was used.
    """
    m = beat_fractions(notes, beats, chunk_ms=chunk_ms)
    b = m.groupBy("song_id", "stem", "beat_no").agg(
        F.array_sort(F.collect_list(F.struct("group_ms", "frac", "g_end", "next_group_ms"))).alias("gs"),
        F.first("beat_start").alias("beat_start"), F.first("beat_end").alias("beat_end"), F.first("beat_len").alias("beat_len"))
    b = settle(b.withColumn("r", infer_beat(F.transform("gs", lambda x: x["frac"]), swing)))
    e = b.filter("r is not null").select("song_id", "stem", "beat_no", "beat_start", "beat_end", "beat_len", "r", F.posexplode("gs").alias("k", "g"))
    start = F.col("beat_start") + F.get("r.slots", F.col("k")) * F.col("beat_len")
    e = e.withColumn("page_start_ms", start).withColumn(
        "_follow", F.col("beat_start") + F.get("r.slots", F.col("k") + 1) * F.col("beat_len"))
    to_line = F.col("beat_end") - F.col("page_start_ms")
    avail = (F.least("g.g_end", F.coalesce("g.next_group_ms", F.lit(float("inf")))) - F.col("page_start_ms")) / F.col("beat_len")
    held = writable_at_most(F.least(avail, F.lit(8.0)))
    inside = (avail <= to_line / F.col("beat_len")) | (held * F.col("beat_len") <= to_line)
    tuplet = F.col("r.divisor").isin(3, 6)
    end = (F.when(F.col("_follow").isNotNull(), F.col("_follow")).when(tuplet | inside, F.col("beat_end"))
           .otherwise(F.col("page_start_ms") + held * F.col("beat_len")))
    read = e.select("song_id", "stem", F.col("g.group_ms").alias("group_ms"), "beat_no", "page_start_ms", end.alias("page_end_ms"),
                    tuplet.alias("is_tuplet"), F.col("r.divisor").cast("bigint").alias("subdivision"), F.lit(True).alias("by_rhythm"))
    left = b.filter("r is null").select("song_id", "stem", "beat_no", F.explode("gs").alias("g")).select(
        "song_id", "stem", "beat_no", F.col("g.group_ms").alias("group_ms"), F.col("g.group_ms").alias("start_ms"), F.col("g.g_end").alias("end_ms"))
    snapped = notation_quantize(settle(left), beats, beat_ms, chunk_ms=chunk_ms)
    return read.unionByName(snapped.select("song_id", "stem", "group_ms", "beat_no", "page_start_ms", "page_end_ms", F.lit(False).alias("is_tuplet"),
                                           F.lit(None).cast("bigint").alias("subdivision"), F.lit(False).alias("by_rhythm")))


def f0_notes(frames: DataFrame, min_ms: float = 30.0, floor: float = 0.5, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Runs of equal pitch in an f0 stream as notes; a run ends at the next run's first frame.

    ``frames`` has song_id, frame_idx, t_ms, hz, conf, rms (rms scaled to 0..1).
    """
    valid = (F.col("conf") >= floor) & (F.col("hz") > 0)
    f = frames.withColumn("midi", F.when(valid, F.bround(hz_to_midi("hz")).cast("bigint")).otherwise(-1))
    f = scan(f, ["song_id"], ["t_ms", "frame_idx"], {"_p": prev("midi"), "_next_t": nxt("t_ms")}, chunk_ms, keep_chunk=True)
    f = islands(f, ["song_id"], ["t_ms", "frame_idx"], lambda p, r: p["midi"] != r["midi"], ["midi"], "_isl", chunk_ms)
    # the stream's very last frame only closes the run it belongs to
    tail = F.col("_next_t").isNull() & (F.col("_p") == F.col("midi"))
    inside = ~F.coalesce(tail, F.lit(False))
    g = f.filter("midi >= 0").groupBy("song_id", "_isl", "midi").agg(
        F.min("t_ms").alias("start_ms"), F.max(F.coalesce("_next_t", "t_ms")).alias("end_ms"),
        F.avg(F.when(inside, F.col("conf"))).alias("confidence"), F.avg(F.when(inside, F.col("rms"))).alias("level"),
        F.avg(F.when(inside, F.col("hz"))).alias("f0_hz"))
    g = g.filter(F.col("end_ms") - F.col("start_ms") >= min_ms)
    return g.select("song_id", F.col("midi").alias("pitch"), "start_ms", "end_ms",
                    clip(30 + F.col("level") * 97, 1, 127).cast("bigint").alias("velocity"), "confidence", "f0_hz")


def posterior_levels(queries: DataFrame, posteriorgram: DataFrame, hop_ms: float) -> DataFrame:
    """Level at (pitch, time) for each query row; 0 outside the table."""
    q = queries.withColumn("frame_idx", (F.col("t_ms") / hop_ms).cast("bigint"))
    keys = ["song_id", "frame_idx", "pitch"]
    return q.join(posteriorgram.select(*keys, "level"), keys, "left").withColumn("level", F.coalesce("level", F.lit(0.0)))


def proportional(events: DataFrame, keys=("song_id",), t: str = "t_ms", reach: int = 9, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Interval to the next event relative to the running median of nearby intervals, as a readable ratio.

    The running window is +-9 rows, so it is taken from leads and lags that
    cross chunk borders.
    """
    e = scan(events, list(keys), [t], {"_n": nxt(t)}, chunk_ms)
    e = e.withColumn("ioi", F.greatest(F.lit(1.0), F.col("_n") - F.col(t))).filter("_n is not null").drop("_n")
    outs = {**{f"_b{k}": prev("ioi", k) for k in range(1, reach + 1)}, **{f"_f{k}": nxt("ioi", k) for k in range(1, reach + 1)}}
    e = scan(settle(e), list(keys), [t], outs, chunk_ms)
    around = F.array_sort(F.array_compact(F.array("ioi", *list(outs))))
    n = F.size(around)
    median = (F.get(around, F.floor((n - 1) / 2).cast("int")) + F.get(around, F.floor(n / 2).cast("int"))) / 2.0
    e = e.withColumn("unit", median)
    return e.select(*keys, t, "ioi", "unit", nearest_value(F.col("ioi") / F.greatest(F.col("unit"), F.lit(1.0)), READABLE).alias("ratio"))


def sustain_ceiling(notes: DataFrame, margin_ms: float = 10.0, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Latest end a note may be given: just before the next later onset of its pitch."""
    keys = ["song_id", "stem", "pitch"]
    starts = notes.select(*keys, "start_ms").distinct()
    nx = scan(starts, keys, ["start_ms"], {"_n": nxt("start_ms")}, chunk_ms)
    return notes.join(nx, [*keys, "start_ms"]).withColumn(
        "ceiling_ms", F.coalesce(F.col("_n"), F.lit(float("inf"))) - margin_ms).drop("_n")


def sustain_extensions(notes: DataFrame, frames: DataFrame, hop_ms: float, threshold: float = 0.5, max_ms: float = 400.0,
                       chunk_ms: float = CHUNK_MS) -> DataFrame:
    """March each note's end forward while its level stays up (at most 400 ms).

    ``frames`` has song_id, frame_idx, level.  A note meets at most
    max_ms / hop_ms following frames, by equi-join on the frame number.
    """
    steps = math.ceil(max_ms / hop_ms - 1e-9)
    n = sustain_ceiling(notes, chunk_ms=chunk_ms)
    s = n.select("song_id", "note_id", "end_ms", "ceiling_ms", "confidence", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k"))
    s = s.filter(F.col("end_ms") + (F.col("k") + 1) * hop_ms <= F.col("ceiling_ms")).withColumn(
        "frame_idx", ((F.col("end_ms") + F.col("k") * hop_ms) / hop_ms).cast("bigint"))
    j = s.join(frames.select("song_id", "frame_idx", "level"), ["song_id", "frame_idx"], "left")
    # steps run 0,1,2,...: the march stops at the first missing or quiet one
    ok = F.coalesce(F.col("level"), F.lit(0.0)) >= threshold
    g = j.groupBy("note_id").agg(F.min(F.when(~ok, F.col("k"))).alias("stop"), F.max("k").alias("last"))
    g = g.withColumn("march_ms", F.coalesce("stop", F.col("last") + 1) * hop_ms)
    return n.select("note_id", "end_ms", "confidence", "ceiling_ms").join(g.select("note_id", "march_ms"), "note_id", "left").withColumn(
        "march_ms", F.coalesce("march_ms", F.lit(0.0)))


def blend_extensions(posterior: Column, energy: Column, confidence: Column, max_ms: float = 400.0) -> tuple[Column, Column]:
    """(extension, confidence) from the two marches; disagreement costs confidence."""
    both = posterior.isNotNull() & energy.isNotNull()
    ext = F.when(both, 0.7 * posterior + 0.3 * energy).otherwise(F.coalesce(posterior, energy))
    dis = F.when(both, F.abs(posterior - energy) / max(max_ms, 1.0)).otherwise(0.0)
    return ext, F.greatest(F.lit(0.0), confidence - dis * 0.3)


def bass_octaves(notes: DataFrame, f0: DataFrame, tolerance: float = 1.5, min_voiced: int = 3, max_spread: float = 2.0) -> DataFrame:
    """Notes a steady f0 places an octave or two away, with the corrected pitch."""
    p = points_in(notes.select("song_id", "note_id", "pitch", "start_ms", "end_ms"),
                  f0.filter("hz > 0").select("song_id", "t_ms", "hz"), ["song_id"], "start_ms", "end_ms", "t_ms")
    g = p.groupBy("note_id", "pitch").agg(F.count(F.lit(1)).alias("voiced"), F.array_sort(F.collect_list(hz_to_midi("hz"))).alias("xs"))

    def at(share: float) -> Column:
        pos = (F.col("voiced") - 1) * F.lit(share)
        lo, hi = (F.get("xs", x.cast("int")) for x in (F.floor(pos), F.ceil(pos)))
        part = pos - F.floor(pos)
        return fused(lo, 1.0 - part, hi * part)

    g = g.withColumn("q", F.array(at(0.1), at(0.5), at(0.9)))
    delta = F.col("q")[1] - F.col("pitch")
    g = g.filter((F.col("voiced") >= min_voiced) & (F.col("q")[2] - F.col("q")[0] <= max_spread) & (F.abs(delta) > tolerance))
    move = F
    for step in (12, -12, 24, -24):
        move = move.when((F.abs(delta - step) <= tolerance) & (F.col("pitch") + step).between(0, 127), step)
    return g.withColumn("reading", F.col("q")[1]).withColumn("move", move).filter("move is not null").select(
        "note_id", "pitch", (F.col("pitch") + F.col("move")).alias("corrected_pitch"), "reading", "voiced")


def octave_stacks(notes: DataFrame, window_ms: float = 50.0, min_stack: int = 3, max_confidence: float = 0.90,
                  chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Interior members of a pitch class struck at three or more octaves at once."""
    g = anchor_groups(notes, ["song_id"], "start_ms", "note_id", window_ms, chunk_ms=chunk_ms)
    k = ["song_id", "group_ms", F.pmod("pitch", F.lit(12)).alias("pc"), "pitch"]
    best = g.groupBy(*k).agg(F.min_by(F.struct("note_id", "confidence"), F.struct(-F.col("confidence"), F.col("start_ms"), F.col("note_id"))).alias("b"))
    chain = best.groupBy("song_id", "group_ms", "pc").agg(F.count(F.lit(1)).alias("octaves"), F.min("pitch").alias("low"), F.max("pitch").alias("high"))
    j = best.join(chain.filter(F.col("octaves") >= min_stack), ["song_id", "group_ms", "pc"])
    return j.filter((F.col("pitch") > F.col("low")) & (F.col("pitch") < F.col("high")) & (F.col("b.confidence") <= max_confidence)).select(
        F.col("b.note_id").alias("note_id"), "song_id", "pitch", "pc", "octaves", "low", "high", F.col("b.confidence").alias("confidence"))


def _wobble_run(d_max: float, g_max: float, radius: float = 1.2):
    """A fragment joins the group before it while linked and no member leaves the anchor's radius.

    State of the open group: confidence and pitch of its anchor, lowest and highest pitch, then end, pitch and length of its last fragment.
    """
    def run(p: Group, entry: list, end: float):
        now, label = (list(entry[0]), ~0) if entry else (None, None)
        labels = []
        for a, (t, e, pitch, conf) in enumerate(zip(p["start_ms"].tolist(), p["end_ms"].tolist(), p["pitch"].tolist(), p["confidence"].tolist())):
            fits = now is not None and 0.0 <= t - now[4] <= g_max and e - t < d_max and now[6] < d_max and pitch != now[5]
            if fits:
                c, anchor = (conf, pitch) if conf > now[0] else (now[0], now[1])
                lo, hi = min(now[2], pitch), max(now[3], pitch)
                fits = max(anchor - lo, hi - anchor) <= radius
            if not fits:
                label, (c, anchor, lo, hi) = a, (conf, pitch, pitch, pitch)
            now = [float(c), float(anchor), float(lo), float(hi), float(e), float(pitch), float(e - t)]
            labels.append(label)
        return labels, [(label, now)] if now is not None and now[4] + g_max >= end else []

    return run


def wobble_groups(notes: DataFrame, f0: DataFrame, tempo_bpm: float, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Short neighbouring fragments whose sounding pitch never really moved.

    Fragments are linked by the next-note rules and grouped around an anchor, the most confident of them, by a
    small state carried along the stem; the steps of a group are sums, so no run of fragments is
    gathered.  The flatness of the f0 decides.
    """
    sixteenth = 60000.0 / (tempo_bpm * 4.0) if tempo_bpm > 0 else None
    d_max = min(150.0, 0.85 * sixteenth) if sixteenth else 150.0
    g_max = min(30.0, 0.5 * sixteenth) if sixteenth else 30.0
    keys, order = ["song_id", "stem"], ["start_ms", "note_id"]
    n = carry(notes.select(*keys, *order, "end_ms", "pitch", "confidence"), keys, order, ["end_ms", "pitch", "confidence"], _wobble_run(d_max, g_max), "note_id", "first_id", chunk_ms)
    seen = F.struct("first_id", "pitch")
    n = scan(n, keys, order, {"_p1": prev(seen), "_p2": prev(seen, 2)}, chunk_ms)
    step = F.when(F.col("_p1.first_id") == F.col("first_id"), F.col("pitch") - F.col("_p1.pitch"))
    before = F.when(step.isNotNull() & (F.col("_p2.first_id") == F.col("first_id")), F.col("_p1.pitch") - F.col("_p2.pitch"))
    n = n.withColumns({"_d": step, "_b": before})
    # how far two steps, or all of a group, go one way: 1 straight, 0 back to where they began
    both = F.abs("_d") + F.abs("_b")
    local = F.when(F.col("_b").isNotNull(), F.when(both > 0, F.abs(F.col("_d") + F.col("_b")) / both).otherwise(1.0))
    g = n.groupBy(*keys, "first_id").agg(
        F.count(F.lit(1)).cast("int").alias("members"), F.sum("_d").alias("net"), F.sum(F.abs("_d")).alias("way"), F.avg(local).alias("local"), F.min("start_ms").alias("w0"),
        F.max_by("end_ms", F.struct(*order)).alias("w1"), F.min_by("pitch", F.struct(-F.col("confidence"), *order)).alias("anchor_pitch")).filter("members >= 2")
    straight = F.when(F.col("way") > 0, F.abs("net") / F.col("way")).otherwise(1.0)
    g = g.filter((straight < 0.5) & F.coalesce(F.col("local") < 0.8, F.lit(True))).drop("net", "way", "local")
    p = points_in(g, f0.filter("hz > 0").select("song_id", "t_ms", "hz"), ["song_id"], "w0", "w1", "t_ms")
    s = p.groupBy(*keys, "first_id", "members", "anchor_pitch").agg(
        F.count(F.lit(1)).alias("voiced"), (F.max(hz_to_midi("hz")) - F.min(hz_to_midi("hz"))).alias("spread"))
    return s.filter("voiced >= 2 and spread <= 0.6")
