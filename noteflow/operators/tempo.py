"""Tempo, meter, beat grids and groove at song level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.music import clip
from ..plans.joins import points_in
from ..plans.timeline import CHUNK_MS, exact_percentiles, fill, fill_next, nxt, prev, row_no, scan, settle

# Ratios a witness may be folded by.
FOLDS = (1.0, 2.0, 0.5, 3.0, 1.0 / 3.0)


def snap_bpm(bpm: Column, tolerance: float = 1.5) -> Column:
    near = F.bround(bpm)
    return F.when(F.abs(bpm - near) <= tolerance, near).otherwise(bpm)


def resolve_tempo(witnesses: DataFrame) -> DataFrame:
    """Weighted consensus of a song's tempo witnesses around the strongest one.

    Two partial-aggregating passes: the anchor, then the folded votes.  Joining
    the anchor back is an equi-join of two tables of a few rows per song.
    """
    w = witnesses.filter("tempo_bpm > 0 and confidence > 0").withColumn("cw", F.col("confidence") * F.col("weight"))
    anchor = w.groupBy("song_id").agg(
        F.min_by(F.struct("source", "tempo_bpm"), F.struct(-F.col("cw"), F.col("source"))).alias("a"),
        F.count(F.lit(1)).alias("n_witnesses"))
    j = w.join(anchor, "song_id").withColumn("is_anchor", F.col("source") == F.col("a.source"))
    cand = F.array(*[F.struct(F.abs(F.col("tempo_bpm") * r - F.col("a.tempo_bpm")).alias("d"), F.lit(i).alias("i"), F.lit(r).alias("r"))
                     for i, r in enumerate(FOLDS)])
    ratio = F.when(F.col("is_anchor"), F.lit(1.0)).otherwise(F.array_min(cand)["r"])
    j = j.withColumn("ratio", ratio).withColumn("folded", F.col("tempo_bpm") * F.col("ratio"))
    j = j.withColumn("included", F.abs(F.col("folded") - F.col("a.tempo_bpm")) <= F.col("a.tempo_bpm") * 0.08)
    inc = F.col("included")

    def s(value, cond=None):
        return F.coalesce(F.sum(value if cond is None else F.when(cond, value)), F.lit(0.0))

    g = j.groupBy("song_id").agg(
        F.first("a").alias("a"), F.first("n_witnesses").alias("n_witnesses"),
        F.max(F.when(F.col("is_anchor"), F.col("confidence"))).alias("anchor_conf"),
        s(F.col("weight")).alias("total"), s(F.col("weight"), ~inc).alias("out"),
        s(F.col("cw"), inc).alias("in_cw"),
        s(F.col("cw") * F.col("folded"), inc & ~F.col("is_anchor")).alias("num"), s(F.col("cw"), inc & ~F.col("is_anchor")).alias("den"),
        F.max(F.when(F.col("is_anchor"), F.col("cw"))).alias("acw"),
        F.min(F.when(inc, F.col("folded"))).alias("lo"), F.max(F.when(inc, F.col("folded"))).alias("hi"),
        F.max((F.col("ratio") != 1.0).cast("int")).alias("folds"))
    boost = F.col("acw") * (1.0 + F.col("out") / F.col("total"))
    bpm = (F.col("num") + F.col("a.tempo_bpm") * boost) / (F.col("den") + boost)
    # nine places: a lone anchor must come back as itself before snapping
    g = g.withColumn("weighted_bpm", F.round(bpm, 9))
    deviation = F.greatest(F.col("hi") - F.col("weighted_bpm"), F.col("weighted_bpm") - F.col("lo"))
    single = F.col("n_witnesses") == 1
    return g.select(
        "song_id", F.col("a.source").alias("anchor_source"),
        snap_bpm(F.when(single, F.col("a.tempo_bpm")).otherwise(F.col("weighted_bpm"))).alias("tempo_bpm"),
        F.when(single, F.col("anchor_conf")).otherwise(clip(F.col("in_cw") / F.col("total"), 0.3, 0.95)).alias("confidence"),
        ((~single) & ((deviation > 3.0) | (F.col("out") > 0) | (F.col("folds") == 1))).alias("contention"))


def arbitrate_octave(resolved: DataFrame, witness: DataFrame) -> DataFrame:
    """Adopt a confident downbeat witness running at twice the resolved tempo."""
    j = resolved.join(witness, "song_id", "left")
    adopt = F.coalesce(
        (F.col("w_bpm") > 0) & (F.col("w_conf") >= 0.70) & (F.col("w_bpm") <= 180.0)
        & (F.abs(F.col("w_bpm") / F.col("tempo_bpm") - 2.0) <= 0.15), F.lit(False))
    return j.select(
        "song_id", F.when(adopt, snap_bpm(F.col("w_bpm"))).otherwise(F.col("tempo_bpm")).alias("tempo_bpm"),
        F.when(adopt, F.greatest("confidence", "w_conf")).otherwise(F.col("confidence")).alias("confidence"),
        adopt.alias("corrected"))


def resolve_meter(candidates: DataFrame) -> DataFrame:
    """Summed confidence per meter; a duple/triple dispute goes to the larger camp first."""
    triple = F.col("numerator") % 3 == 0
    votes = candidates.groupBy("song_id", "numerator", "denominator").agg(
        F.sum("confidence").alias("votes"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    w = Window.partitionBy("song_id")
    v = votes.withColumn("triple_n", F.sum(F.when(triple, F.col("n")).otherwise(0)).over(w)).withColumn(
        "all_n", F.sum("n").over(w))
    duple_n = F.col("all_n") - F.col("triple_n")
    dispute = (F.col("triple_n") > 0) & (duple_n > 0) & (F.col("triple_n") != duple_n)
    v = v.filter(~dispute | (triple == (F.col("triple_n") > duple_n)))
    g = v.groupBy("song_id").agg(
        F.min_by(F.struct("numerator", "denominator", "votes"), F.struct(-F.round("votes", 9), F.col("seq"))).alias("m"),
        F.sum("votes").alias("total"), F.first("all_n").alias("n"))
    share = F.when(F.col("total") > 0, F.col("m.votes") / F.col("total")).otherwise(1.0)
    return g.select("song_id", "m.numerator", "m.denominator",
                    F.when(F.col("n") == 1, F.col("m.votes")).otherwise(clip(share, 0.3, 0.95)).alias("confidence"))


def meter_by_agreement(candidates: DataFrame) -> DataFrame:
    """Alternative rule: most witnesses first, then summed confidence."""
    v = candidates.groupBy("song_id", "numerator", "denominator").agg(
        F.sum("confidence").alias("votes"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    return v.groupBy("song_id").agg(F.min_by(F.struct("numerator", "denominator"), F.struct(-F.col("n"), -F.round("votes", 9), F.col("seq"))).alias("m")).select(
        "song_id", "m.*")


def beat_gaps(beats: DataFrame, chunk_ms: float = CHUNK_MS) -> DataFrame:
    return scan(beats, ["song_id"], ["t_ms", "beat_idx"], {"next_ms": nxt("t_ms")}, chunk_ms).withColumn(
        "gap_ms", F.col("next_ms") - F.col("t_ms"))


def regularity(beats: DataFrame) -> DataFrame:
    """Confidence from the evenness of beat gaps, and the summary tempo."""
    g = beat_gaps(beats).groupBy("song_id").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("gap_ms").alias("sd"), F.avg("gap_ms").alias("m"),
        (F.max("t_ms") - F.min("t_ms")).alias("span"))
    conf = F.when((F.col("n") < 3) | (F.col("m") <= 0), 0.3).otherwise(clip(1.0 - F.col("sd") / F.col("m"), 0.1, 0.95))
    return g.select("song_id", conf.alias("confidence"),
                    (60000.0 * (F.col("n") - 1) / F.greatest(F.col("span"), F.lit(1.0))).alias("summary_bpm"))


def downbeat_mode(beats: DataFrame, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Beats per bar by the commonest rounded downbeat gap; needs three downbeats."""
    med = exact_percentiles(beat_gaps(beats, chunk_ms), ["song_id"], "gap_ms", {"beat": 0.5}, 10.0)
    down = scan(beats.filter("is_downbeat"), ["song_id"], ["t_ms", "beat_idx"], {"next_ms": nxt("t_ms")}, chunk_ms)
    j = down.join(med.select("song_id", "beat"), "song_id").withColumn("gap", F.col("next_ms") - F.col("t_ms"))
    j = j.withColumn("bar", F.bround(F.col("gap") / F.col("beat")).cast("bigint"))
    counts = j.groupBy("song_id", "bar").agg(
        F.count(F.lit(1)).alias("n"), F.count("gap").alias("gaps"), F.sum("gap").alias("s1"),
        F.sum(F.col("gap") * F.col("gap")).alias("s2"))
    good = F.col("bar") > 0
    g = counts.groupBy("song_id").agg(
        F.sum("n").alias("downbeats"), F.sum("gaps").alias("gaps"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"),
        F.min_by(F.struct("bar", "n"), F.when(good, F.struct(-F.col("n"), F.col("bar")))).alias("m"),
        F.sum(F.when(good, F.col("n"))).alias("bars")).filter("downbeats >= 3 and bars > 0")
    mean = F.col("s1") / F.col("gaps")
    cv = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("gaps") - mean * mean)) / (mean + 1e-9)
    return g.select("song_id", F.col("m.bar").alias("beats_per_bar"),
                    clip((1.0 - 4.0 * cv) * F.col("m.n") / F.col("bars"), 0.3, 0.92).alias("confidence"))


def tempo_map(events: DataFrame, beats: DataFrame, t: str, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Position of each event on the song's beat grid (piecewise linear, extrapolated at the edges).

    Beats at most 1 ms apart are one beat.  Adds beat_pos and local_beat_ms.
    """
    b = scan(beats.select("song_id", "t_ms"), ["song_id"], ["t_ms"], {"_p": prev("t_ms")}, chunk_ms)
    b = settle(b.filter(F.col("_p").isNull() | (F.col("t_ms") - F.col("_p") > 1.0)).drop("_p"))
    b = scan(b, ["song_id"], ["t_ms"], {"_i": row_no(), "_n": nxt("t_ms"), "_p": prev("t_ms")}, chunk_ms)
    # the last beat keeps the gap before it, so every row carries a usable interval
    gap = F.coalesce(F.col("_n") - F.col("t_ms"), F.col("t_ms") - F.col("_p"))
    knot = F.struct((F.col("_i") - 1).alias("i"), F.col("t_ms").alias("t0"), gap.alias("gap"))
    return _at(events, b.select("song_id", F.col("t_ms").alias("_bt"), knot.alias("_k")), t, chunk_ms)


def _at(events: DataFrame, knots: DataFrame, t: str, chunk_ms: float) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in events.columns])
    e = events.select("song_id", F.col(t).alias("_t"), F.lit(1).alias("_side"), whole.alias("_e"))
    k = knots.select("song_id", F.col("_bt").alias("_t"), F.lit(0).alias("_side"), "_k")
    both = settle(e.unionByName(k, allowMissingColumns=True))
    both = scan(both, ["song_id"], ["_t", "_side"], {"_a": fill("_k"), "_b": fill_next("_k")}, chunk_ms)
    k = F.coalesce("_a", "_b")
    pos = k["i"] + (F.col("_t") - k["t0"]) / k["gap"]
    return both.filter("_side = 1").select("_e.*", pos.alias("beat_pos"), k["gap"].alias("local_beat_ms"))


def swing(onsets: DataFrame, beats: DataFrame, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Swing ratio: where, inside each beat gap, the onset nearest the midpoint falls."""
    gaps = beat_gaps(beats, chunk_ms).filter("gap_ms > 0").select(
        "song_id", "beat_idx", F.col("t_ms").alias("g0"), "gap_ms", F.col("next_ms").alias("g1"))
    p = points_in(gaps, onsets.select("song_id", F.col("t_ms").alias("o_ms")), ["song_id"], "g0", "g1", "o_ms")
    f = (F.col("o_ms") - F.col("g0")) / F.col("gap_ms")
    p = p.withColumn("frac", f).filter((F.col("o_ms") > F.col("g0") + 0.15 * F.col("gap_ms")) & (F.col("o_ms") < F.col("g1") - 0.05 * F.col("gap_ms")))
    one = p.groupBy("song_id", "beat_idx").agg(
        F.min_by("frac", F.struct(F.abs(F.col("o_ms") - (F.col("g0") + 0.5 * F.col("gap_ms"))), F.col("o_ms"))).alias("frac"))
    used = one.groupBy("song_id").agg(F.avg("frac").alias("m"), F.count(F.lit(1)).alias("k"))
    n = beats.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))
    j = n.join(used, "song_id", "left")
    return j.select(
        "song_id",
        F.when(F.col("n") < 2, 0.5).when(F.col("k").isNull(), 0.5).otherwise(clip("m", 0.5, 0.75)).alias("swing_ratio"),
        F.when(F.col("n") < 2, 0.1).when(F.col("k").isNull(), 0.2)
        .otherwise(clip(F.col("k") / F.greatest(F.lit(1), F.col("n") - 1), 0.2, 0.9)).alias("confidence"))


def resonance_gate(evidence: DataFrame, keys=("song_id",)) -> DataFrame:
    """Calibrate ring / hold / void limits on each song's own trailing evidence (blind under 30)."""
    res = exact_percentiles(evidence, keys, "resonance", {"ring_at": 0.25, "hold_at": 0.75}, 0.01)
    void = exact_percentiles(evidence, keys, "void", {"void_at": 0.90}, 0.01)
    r = res.select(*keys, "n", *[F.when(F.col("n") >= 30, F.col(x)).alias(x) for x in ("ring_at", "hold_at")])
    v = void.select(*keys, F.when(F.col("n") >= 30, F.col("void_at")).alias("void_at"))
    return r.join(v, list(keys), "left").withColumn("blind", F.col("ring_at").isNull()).drop("n")


def gate_limit(resonance: Column, void: Column, base: Column, gap: Column, ring_at: Column, hold_at: Column,
               void_at: Column, max_hold: float = 2.0) -> Column:
    """How far a gap may be closed given what the sound does after the note."""
    return (
        F.when(ring_at.isNull() | resonance.isNull(), base)
        .when(void_at.isNotNull() & void.isNotNull() & (void >= void_at), 0.0)
        .when(gap.isNotNull() & (resonance >= hold_at), F.greatest(base * 2.0, F.least(gap, F.lit(max_hold))))
        .when(resonance >= ring_at, base * 2.0)
        .otherwise(base))


def guided(resolved: DataFrame, locks: DataFrame) -> DataFrame:
    """User locks bypass estimators: a locked value replaces the estimate with confidence 1."""
    j = resolved.join(locks, "song_id", "left")
    lock = F.col("locked_bpm")
    return j.select("song_id", F.coalesce(lock, "tempo_bpm").alias("tempo_bpm"),
                    F.when(lock.isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"),
                    lock.isNotNull().alias("guided"))


def re_anchor(beats: DataFrame, ratio: float, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Resample each song's grid at a step of 1/ratio beats by linear interpolation."""
    b = scan(beats, ["song_id"], ["t_ms", "beat_idx"], {"_i": row_no(), "_n": nxt("t_ms")}, chunk_ms)
    i = F.col("_i") - 1
    lo = F.ceil(i * float(ratio) - 1e-9)
    hi = F.when(F.col("_n").isNotNull(), F.ceil((i + 1) * float(ratio) - 1e-9) - 1).otherwise(F.floor(i * float(ratio) + 1e-9))
    b = b.filter(hi >= lo).withColumn("new_idx", F.explode(F.sequence(lo, hi)))
    frac = F.col("new_idx") / float(ratio) - (F.col("_i") - 1)
    t = F.col("t_ms") + F.when(F.col("_n").isNull(), 0.0).otherwise(frac * (F.col("_n") - F.col("t_ms")))
    return b.select("song_id", "new_idx", t.alias("t_ms"))


def interpolate_at(events: DataFrame, knots: DataFrame, t: str, knot_t: str, value: str, name: str,
                   chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Add ``value`` interpolated linearly at each event's time, clamped to the first and last knot."""
    pt = F.struct(F.col(knot_t).alias("t"), F.col(value).alias("v"))
    whole = F.struct(*[F.col(c) for c in events.columns])
    e = events.select("song_id", F.col(t).alias("_t"), F.lit(1).alias("_side"), whole.alias("_e"))
    k = knots.select("song_id", F.col(knot_t).alias("_t"), F.lit(0).alias("_side"), pt.alias("_k"))
    both = scan(e.unionByName(k, allowMissingColumns=True), ["song_id"], ["_t", "_side"],
                {"_a": fill("_k"), "_b": fill_next("_k")}, chunk_ms).filter("_side = 1")
    a, b = F.col("_a"), F.col("_b")
    span = b["t"] - a["t"]
    v = F.when(a.isNull(), b["v"]).when(b.isNull() | (span <= 0), a["v"]).otherwise(
        a["v"] + (F.col("_t") - a["t"]) / span * (b["v"] - a["v"]))
    return both.select("_e.*", v.alias(name)).filter(F.col(name).isNotNull())
