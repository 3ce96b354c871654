"""Notation rows: metric splits, voices on staves, layout, page statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.carry import Kept, carry
from ..plans.groups import Group
from ..plans.joins import points_in
from ..plans.timeline import CHUNK_MS, islands, nxt, prev, row_no, scan, settle
from .filters import position_level
from .hands import max_simultaneity
from .tempo import gate_limit, resonance_gate

# Writable shapes in ticks of 1/96 beat, longest first (base values and dotted; two-thirds of the base values).
BINARY_SHAPES = (1152, 768, 576, 384, 288, 192, 144, 96, 72, 48, 36, 24)
TERNARY_SHAPES = (512, 256, 128, 64, 32, 16)


def metric_split(start: Column, duration: Column, numerator: Column, denominator: Column) -> Column:
    """Cut a note (ticks) at the first barline or boundary stronger than where it starts, again and again.

    Every boundary lies on a whole beat, so the candidates are the beats inside
    the note and one fold visits them in order.
    """
    first = (F.floor(start / 96) + 1) * 96
    last = F.ceil((start + duration) / F.lit(96.0)).cast("bigint") * 96 - 96
    inside = F.when(last >= first, F.sequence(first, last, F.lit(96).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    piece = "array<struct<s:bigint,d:bigint>>"
    zero = F.struct(start.cast("bigint").alias("at"), F.array().cast(piece).alias("out"))

    def step(acc, b):
        level = position_level(b, numerator, denominator)
        cut = (level == 0) | (level < position_level(acc["at"], numerator, denominator))
        made = F.struct(acc["at"].alias("s"), (b - acc["at"]).alias("d"))
        return F.when(cut, F.struct(b.alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))).otherwise(acc)

    def finish(acc):
        return F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), (start + duration - acc["at"]).cast("bigint").alias("d"))))

    return F.aggregate(inside, zero, step, finish)


def writable_chain(start: Column, duration: Column) -> Column:
    """A segment as writable values, largest first; a length no value fits is kept whole."""
    # 96 ticks hold one factor of three: a length it does not divide has thirds of a beat in it
    shapes = F.when(duration % 3 != 0, F.array(*[F.lit(x).cast("bigint") for x in TERNARY_SHAPES])).otherwise(F.array(*[F.lit(x).cast("bigint") for x in BINARY_SHAPES]))
    piece = "array<struct<s:bigint,d:bigint>>"
    zero = F.struct(start.cast("bigint").alias("at"), duration.cast("bigint").alias("left"), F.array().cast(piece).alias("out"))

    def step(acc, v):
        k = F.floor(acc["left"] / v)
        made = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1).cast("bigint"))),
                           lambda i: F.struct((acc["at"] + (i - 1) * v).cast("bigint").alias("s"), v.alias("d")))
        return F.when(k >= 1, F.struct((acc["at"] + k * v).cast("bigint").alias("at"), (acc["left"] - k * v).cast("bigint").alias("left"), F.concat(acc["out"], made).alias("out"))).otherwise(acc)

    def finish(acc):
        return F.when(F.size(acc["out"]) > 0, acc["out"]).otherwise(F.array(F.struct(start.cast("bigint").alias("s"), duration.cast("bigint").alias("d"))))

    return F.aggregate(shapes, zero, step, finish)


def notation_pieces(notes: DataFrame) -> DataFrame:
    """Tied pieces of each note: rows (note, piece start, length, tie) in ticks.

    ``notes`` has note_id, start_tick, dur_tick, numerator, denominator, is_tuplet.
    """
    seg = metric_split(F.col("start_tick"), F.col("dur_tick"), F.col("numerator"), F.col("denominator"))
    whole = F.array(F.struct(F.col("start_tick").cast("bigint").alias("s"), F.col("dur_tick").cast("bigint").alias("d")))
    chain = F.flatten(F.transform(seg, lambda x: writable_chain(x["s"], x["d"])))
    p = F.when(F.col("is_tuplet") | (F.col("dur_tick") <= 0), whole).otherwise(chain)
    n = notes.withColumn("_p", p).select("note_id", F.size("_p").alias("pieces"), F.posexplode("_p").alias("i", "x"))
    tie = (F.when(F.col("pieces") == 1, F.lit(None).cast("string")).when(F.col("i") == 0, "start")
           .when(F.col("i") == F.col("pieces") - 1, "stop").otherwise("continue"))
    return n.select("note_id", F.col("i").cast("bigint").alias("piece"), F.col("x.s").alias("start_tick"), F.col("x.d").alias("dur_tick"), tie.alias("tie"))


def gridded_chords(notes: DataFrame, offset: Column, keys=("song_id", "part")) -> DataFrame:
    """Chords of the page: notes whose written onset is the same to six places.

    ``offset`` is the snapped onset in quarters.  Adds ``offset``, ``chord`` (number of the
    chord in its part, from 0) and ``place`` (of the note in its chord, by raw onset, pitch and
    id); a chord's notes are ranked, never gathered.
    """
    keys = list(keys)
    n = settle(notes.withColumn("offset", F.round(offset, 6)))
    at = n.select(*keys, "offset").distinct()
    at = scan(at, keys, ["offset"], {"_rn": row_no()}, 4096.0).select(*keys, "offset", (F.col("_rn") - 1).cast("bigint").alias("chord"))
    w = Window.partitionBy(*keys, "offset").orderBy("start_ms", "pitch", "note_id")
    return n.join(at, [*keys, "offset"]).withColumn("place", (F.row_number().over(w) - 1).cast("bigint"))


def _free_voice_run(p: Group, entry: list, end: float):
    """Nearest free voice by pitch, else a new one; state = (free at, last pitch) per voice."""
    voices = [[~k, *s, False] for k, s in enumerate(entry)]
    labels = []
    for a, (t, e, pitch) in enumerate(zip(p["start_ms"].tolist(), p["end_ms"].tolist(), p["pitch"].tolist())):
        free = [v for v in voices if t >= v[1]]
        if free:
            v = min(free, key=lambda x: abs(x[2] - pitch))
            v[1], v[2], v[3] = float(e), float(pitch), True
            labels.append(v[0])
        else:
            voices.append([a, float(e), float(pitch), True])
            labels.append(a)
    return labels, [(v[0], v[1:3] if v[3] else Kept()) for v in voices]


def register_voices(events: DataFrame, keys=("song_id", "stem"), per_staff: int = 4, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Any number of voices by register continuity, numbered by first use, four to a staff.

    ``events`` has keys, note_id, start_ms, end_ms, pitch (mean pitch of the event).
    """
    keys = list(keys)
    v = carry(events, keys, ["start_ms", "note_id"], ["end_ms", "pitch"], _free_voice_run, "note_id", "voice_start", chunk_ms)
    first = v.filter("note_id = voice_start").select(*keys, "voice_start", F.col("start_ms").alias("_t"))
    w = Window.partitionBy(*keys).orderBy("_t", "voice_start")
    return v.join(first.withColumn("voice", F.row_number().over(w)).drop("_t"), [*keys, "voice_start"]).withColumn(
        "staff", F.floor((F.col("voice") - 1) / per_staff))


def _staff_run(max_voices: int, slack_ms: float):
    """State of a voice: free at, last pitch, then number and last onset of every gesture it owns and that still goes on."""
    def run(p: Group, entry: list, end: float):
        voices = [[~k, s[0], s[1], False, dict(zip(s[2::2], s[3::2]))] for k, s in enumerate(entry)]
        labels = []
        for a, (t, e, pitch, gesture, over) in enumerate(zip(*(p[c].tolist() for c in ("start_ms", "end_ms", "pitch", "_gesture", "_over")))):
            free = [v for v in voices if v[1] <= t + slack_ms]
            owner = [v for v in free if gesture in v[4]] if gesture >= 0 else []
            if owner:
                v = owner[0]
            elif free:
                v = min(free, key=lambda x: abs(x[2] - pitch))
            elif len(voices) < max_voices:
                v = [a, 0.0, 0.0, True, {}]
                voices.append(v)
            else:
                v = min(voices, key=lambda x: abs(x[2] - pitch))
                gesture = -1  # joined as a chord tone: the voice does not come to own the gesture
            if gesture >= 0:
                for other in voices:
                    if other[4].pop(gesture, None) is not None:
                        other[3] = True
                if over > t:
                    v[4][gesture] = over
            v[1], v[2], v[3] = max(v[1], float(e)), float(pitch), True
            labels.append(v[0])
        return labels, [(v[0], [v[1], v[2], *(x for g, o in sorted(v[4].items()) if o >= end for x in (g, o))] if v[3] else Kept()) for v in voices]

    return run


def staff_voices(slots: DataFrame, keys=("song_id", "hand"), max_voices: int = 4, ms_per_beat: float = 500.0, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Voices of a staff: the free voice of nearest pitch (half a beat of overlap allowed), at most ``max_voices``.

    Where ``slots`` has a column ``gesture`` (a number of the keys, null for none), the free voice that the gesture's
    last slot went to comes first, so a figure stays in one voice.  When all are busy a slot joins the nearest
    voice, so no note is lost.
    """
    keys = list(keys)
    if "gesture" in slots.columns:
        ends = slots.filter("gesture is not null").groupBy(*keys, "gesture").agg(F.max("start_ms").alias("_over"))
        rows = slots.join(ends, [*keys, "gesture"], "left").withColumns({"_gesture": F.coalesce(F.col("gesture").cast("double"), F.lit(-1.0)), "_over": F.coalesce("_over", F.lit(0.0))})
    else:
        rows = slots.withColumns({"_gesture": F.lit(-1.0), "_over": F.lit(0.0)})
    rows = settle(rows)
    return carry(rows, keys, ["start_ms", "note_id"], ["end_ms", "pitch", "_gesture", "_over"], _staff_run(max_voices, 0.5 * ms_per_beat), "note_id", "voice_start", chunk_ms).drop("_gesture", "_over")


def top_line_order(voiced: DataFrame, keys=("song_id", "hand"), bucket_ms: float = 1000.0) -> DataFrame:
    """Voices ranked by how often each is the highest sounding one at an onset."""
    keys = list(keys)
    on = voiced.select(*keys, F.col("start_ms").alias("_t")).distinct()
    s = points_in(voiced.select(*keys, "voice_start", "pitch", "start_ms", "end_ms"), on, keys, "start_ms", "end_ms", "_t", bucket_ms, closed_end=False)
    top = s.groupBy(*keys, "_t").agg(F.max_by("voice_start", F.struct("pitch", -F.col("voice_start"))).alias("voice_start"))
    n = top.groupBy(*keys, "voice_start").agg(F.count(F.lit(1)).alias("tops"))
    allv = voiced.select(*keys, "voice_start").distinct().join(n, [*keys, "voice_start"], "left").fillna(0, ["tops"])
    w = Window.partitionBy(*keys).orderBy(F.desc("tops"), "voice_start")
    return allv.withColumn("voice", F.row_number().over(w))


def smooth_voice(voiced: DataFrame, keys, ms_per_beat: float, merge_beats: float = 0.5, fill_beats: float = 1.0,
                 beats_per_bar: int = 4, reach_beats: float = 2.0, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Close small gaps in a voice: same-pitch merges, fills to the next note, holds to a beat or half bar.

    ``voiced`` has keys, note_id, pitch, start_ms, end_ms; a hold never passes a
    barline or the next note.  With columns ``resonance`` and ``void`` (what the sound does after a note) a
    voice's own percentiles decide how far its gaps close: silent ones stay open, ringing ones close twice as far.
    """
    keys = list(keys)
    order = ["start_ms", "note_id"]
    evidence = [x for x in ("resonance", "void") if {"resonance", "void"} <= set(voiced.columns)]
    n = islands(voiced, keys, order, lambda p, r: (p["pitch"] != r["pitch"]) | (r["start_ms"] - p["end_ms"] > merge_beats * ms_per_beat), ["pitch", "end_ms"], "_isl", chunk_ms)
    m = n.groupBy(*keys, "_isl").agg(F.min("pitch").alias("pitch"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
                                     F.min_by("note_id", F.struct(*order)).alias("note_id"), F.count(F.lit(1)).alias("merged"),
                                     *[F.min_by(x, F.struct(*order)).alias(x) for x in evidence]).drop("_isl")
    m = settle(m)
    fill = F.lit(fill_beats * ms_per_beat)
    if evidence:
        m = settle(m.join(resonance_gate(m, keys), keys, "left"))
        fill = gate_limit(F.col("resonance"), F.col("void"), fill, F.lit(None).cast("double"), F.col("ring_at"), F.col("hold_at"), F.col("void_at"))
    m = scan(m, keys, order, {"_n": nxt("start_ms")}, chunk_ms)
    gap = F.col("_n") - F.col("end_ms")
    filled = F.when((gap > 0) & (gap <= fill), F.col("_n")).otherwise(F.col("end_ms"))
    m = m.withColumn("_e", filled)
    beat = F.ceil(F.col("_e") / ms_per_beat - 1e-9) * ms_per_beat
    half = F.ceil(F.col("_e") / (ms_per_beat * beats_per_bar / 2) - 1e-9) * (ms_per_beat * beats_per_bar / 2)
    bar = F.ceil(F.col("_e") / (ms_per_beat * beats_per_bar) - 1e-9) * (ms_per_beat * beats_per_bar)
    target = F.when(half - F.col("_e") <= reach_beats * ms_per_beat, half).otherwise(beat)
    hold = F.least(target, bar, F.coalesce("_n", F.lit(float("inf"))))
    open_gap = F.coalesce(F.col("_n") > F.col("_e"), F.lit(True))
    return m.withColumn("end_ms", F.when(open_gap, F.greatest("_e", hold)).otherwise(F.col("_e"))).drop("_n", "_e", *evidence, "ring_at", "hold_at", "void_at", "blind")


def route_parts(notes: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """How each stem becomes a part, and the order of the parts on the page.

    Drums one part, bass two voices, keyboards a grand staff, dense stems several
    voices, the rest one line; drums go last, others by falling mean pitch.
    """
    s = notes.groupBy("song_id", "stem").agg(F.avg("pitch").alias("mean_pitch"), F.count(F.lit(1)).alias("n"))
    s = s.join(max_simultaneity(notes), ["song_id", "stem"])
    s = s.join(families, ["song_id", "stem"], "left") if families is not None else s.withColumn("family", F.col("stem"))
    kb = F.col("stem").isin("piano", "guitar", "other") | F.col("family").isin("piano", "guitar", "keyboard", "keys", "harp")
    layout = (F.when(F.col("stem") == "drums", "drums").when(F.col("stem") == "bass", "two_voices").when(kb, "grand_staff")
              .when(F.col("max_notes") >= 3, "voices").otherwise("single"))
    w = Window.partitionBy("song_id").orderBy((F.col("stem") == "drums").cast("int"), F.round(-F.col("mean_pitch"), 9), "stem")
    return s.withColumn("layout", layout).withColumn("part", F.row_number().over(w))


def tempo_segments(beats: DataFrame, tolerance_bpm: float = 1.5, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Runs of beats whose next interval stays within the tolerance of the run's mean tempo."""

    def run(p: Group, entry: list, end: float):
        state = [~0, *entry[0]] if entry else None
        labels = []
        for a, (t, nx) in enumerate(zip(p["t_ms"].tolist(), p["next_ms"].astype(float).tolist())):
            if state is None:
                state = [a, float(t), 0]
            elif state[2] > 0 and nx == nx:
                mean = 60000.0 * state[2] / (float(t) - state[1])
                if abs(60000.0 / (float(nx) - float(t)) - mean) > tolerance_bpm:
                    state = [a, float(t), 0]
            labels.append(state[0])
            state[2] += 1
        if state and state[0] < 0:  # the entry's segment goes on: its start stays, its beats add up
            return labels, [(state[0], Kept((0.0, len(labels))))]
        return labels, [(state[0], state[1:])] if state else []

    b = settle(scan(beats, ["song_id"], ["t_ms", "beat_idx"], {"next_ms": nxt("t_ms")}, chunk_ms))
    c = carry(b, ["song_id"], ["t_ms", "beat_idx"], ["next_ms"], run, "beat_idx", "segment", chunk_ms)
    g = c.filter("next_ms is not null").groupBy("song_id", "segment").agg(
        F.min("t_ms").alias("start_ms"), F.max("next_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_beats"))
    return g.withColumn("bpm", 60000.0 * F.col("n_beats") / (F.col("end_ms") - F.col("start_ms")))


def measure_stats(rows: DataFrame) -> DataFrame:
    """Notes, rests, chords, top onsets and stable tops per measure.

    ``rows`` has song_id, part, measure, voice, onset, pitch (null = rest).
    """
    pitched = F.col("pitch").isNotNull()
    at = rows.groupBy("song_id", "part", "measure", "onset").agg(
        F.count_if(pitched).alias("notes"), F.count_if(~pitched).alias("rests"), F.max_by("voice", "pitch").alias("top_voice"))
    at = at.withColumn("has", F.col("notes") > 0)
    tops = scan(at.filter("has").withColumn("_o", F.col("measure") * 1000.0 + F.col("onset")), ["song_id", "part"], ["_o"], {"_p": prev("top_voice")}, 1.0e6)
    t = tops.groupBy("song_id", "measure").agg(F.count(F.lit(1)).alias("top_onsets"), F.count_if(F.col("top_voice") == F.col("_p")).alias("top_stable"))
    g = at.groupBy("song_id", "measure").agg(F.sum("notes").alias("notes"), F.sum("rests").alias("rests"), F.count_if(F.col("notes") >= 2).alias("chords"))
    return g.join(t, ["song_id", "measure"], "left").fillna(0, ["top_onsets", "top_stable"])


def region_stats(measures: DataFrame, size: int = 8) -> DataFrame:
    keys = ["song_id", F.floor(F.col("measure") / size).alias("region")]
    return measures.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("notes", "rests", "chords", "top_onsets", "top_stable")])


def region_winners(regions: DataFrame) -> DataFrame:
    """Per region the voice cap with the fewest rests per note and the steadiest top line (ties to the lower cap)."""
    rest = F.col("rests") / F.greatest(F.col("notes"), F.lit(1))
    stable = F.col("top_stable") / F.greatest(F.col("top_onsets"), F.lit(1))
    return regions.groupBy("song_id", "region").agg(
        F.min_by("cap", F.struct(F.round(rest, 9), F.col("cap"))).alias("fewest_rests"),
        F.min_by("cap", F.struct(-F.round(stable, 9), F.col("cap"))).alias("steadiest"), F.count_distinct("cap").alias("caps"))


def readability(rows: DataFrame, expected_len: float) -> DataFrame:
    """Rest ratio, chord share, voices, mean voice jump, singleton voices, top stability, overfull measures per song."""
    keys = ["song_id", "part"]
    pitched = rows.filter("pitch is not null")
    jump = scan(pitched.withColumn("_o", F.col("measure") * 1000.0 + F.col("onset")), [*keys, "voice"], ["_o", "row_id"], {"_p": prev("pitch")}, 1.0e6)
    a = jump.groupBy("song_id").agg(F.avg(F.abs(F.col("pitch") - F.col("_p"))).alias("mean_jump"))
    v = pitched.groupBy(*keys, "voice").agg(F.count(F.lit(1)).alias("n")).groupBy("song_id").agg(F.count_if(F.col("n") <= 2).alias("singleton_voices"), F.count(F.lit(1)).alias("voices"))
    full = rows.groupBy(*keys, "measure", "voice").agg(F.sum("dur").alias("len")).groupBy("song_id").agg(F.count_if(F.col("len") > expected_len + 1e-6).alias("overfull"))
    m = measure_stats(rows).groupBy("song_id").agg(F.sum("notes").alias("notes"), F.sum("rests").alias("rests"), F.sum("chords").alias("chords"),
                                                 F.sum("top_onsets").alias("tops"), F.sum("top_stable").alias("stable"))
    m = m.select("song_id", (F.col("rests") / F.greatest(F.col("notes"), F.lit(1))).alias("rest_ratio"), (F.col("chords") / F.greatest(F.col("tops"), F.lit(1))).alias("chord_share"),
                 (F.col("stable") / F.greatest(F.col("tops") - 1, F.lit(1))).alias("top_stability"))
    return m.join(a, "song_id", "left").join(v, "song_id", "left").join(full, "song_id", "left")


def vocabulary(rows: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Percent of each note type, the gap to a reference, and values the reference never writes."""
    def hist(df, name):
        c = df.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
        t = df.agg(F.count(F.lit(1)).alias("t"))
        return c.crossJoin(F.broadcast(t)).select("type", (100.0 * F.col("n") / F.col("t")).alias(name))

    o = hist(rows, "ours_pct")
    if reference is None:
        return o
    j = o.join(hist(reference, "ref_pct"), "type", "full_outer")
    gap = F.coalesce("ours_pct", F.lit(0.0)) - F.coalesce("ref_pct", F.lit(0.0))
    return j.select("type", "ours_pct", "ref_pct", F.when(F.abs(gap) >= 3.0, gap).alias("gap_pct"), F.col("ref_pct").isNull().alias("invented"),
                    F.col("type").isin("32nd", "64th", "128th").alias("forbidden"))


def health(rows: DataFrame, bar_ticks: int) -> DataFrame:
    """PASS/FAIL rules over notation rows, one row per run and check.

    ``rows`` has run_id, offset and length in ticks of 1/96 beat, tuplet_actual, tuplet_normal (null = none).
    All rules are conditional counts of a single pass.
    """
    over = F.col("offset") + F.col("length") > bar_ticks
    frac = F.pmod("offset", F.lit(96))
    legal = F.lit(False)
    for d in (1, 2, 3, 4, 6, 8, 12, 16):
        legal = legal | (F.pmod(frac * d, F.lit(96)) == 0)
    explained = F.col("tuplet_actual").isNotNull() & (F.pmod(frac * F.col("tuplet_actual"), F.lit(96)) == 0)
    junk = F.col("tuplet_normal").isNotNull() & ~F.col("tuplet_normal").isin(1, 2, 3, 4, 6, 8, 12, 16)
    g = rows.groupBy("run_id").agg(F.count_if(over).alias("past_barline"), F.count_if(~legal & ~explained).alias("off_grid"), F.count_if(junk).alias("junk_tuplets"),
                                   F.count_if(over & F.col("tuplet_actual").isNotNull()).alias("tuplets_over_barline"))
    checks = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("past_barline", "off_grid", "junk_tuplets", "tuplets_over_barline")])
    return g.select("run_id", F.explode(checks).alias("c")).select("run_id", "c.name", "c.value", F.when(F.col("c.value") == 0, "PASS").otherwise("FAIL").alias("status"))


def common_regions(flagged: DataFrame) -> DataFrame:
    """Regions present under every voice cap (set intersection by counting caps)."""
    caps = flagged.agg(F.count_distinct("cap").alias("caps"))
    g = flagged.groupBy("song_id", "region").agg(F.count_distinct("cap").alias("c"))
    return g.crossJoin(F.broadcast(caps)).filter("c = caps").select("song_id", "region")

