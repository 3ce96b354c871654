"""Rhythm estimators over onset tables and onset-strength frames."""

from __future__ import annotations

import json
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.draws import uniform, uniform_of
from ..functions.music import clip
from ..plans.grouping import anchor_groups, blocks
from ..plans.groups import Group, map_groups
from ..plans.joins import nearest
from ..plans.timeline import CHUNK_MS, nxt, prev, row_no, scan, settle
from .filters import denominator_for
from .tempo import interpolate_at

# Interval-ratio ideals, tactus multipliers, tempo ratios, meter numerators.
FAMILIES = (
    ("binary", (1.0, 2.0, 0.5, 4.0, 0.25)),
    ("ternary", (1.3333, 0.6667, 0.3333, 2.6667)),
    ("swing", (1.5, 0.6667, 3.0)),
    ("quintuplet", (1.25, 0.8, 2.5)),
    ("septuplet", (1.1429, 0.875, 2.2857)),
)
TACTUS = (1 / 8, 1 / 6, 1 / 4, 1 / 3, 0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0)
TEMPO_RATIOS = ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2), (3, 4), (4, 3), (5, 6), (4, 5), (5, 4))
NUMERATORS = (2, 3, 4, 5, 6, 7, 9, 12)
LEVELS = (1.0, 2.0, 3.0, 4.0, 0.5, 0.25)


def combined_onsets(onsets: DataFrame) -> DataFrame:
    """Both witnesses' onsets rounded to 1 ms, each time once per song."""
    return onsets.select("song_id", F.bround("t_ms").alias("t_ms")).distinct()


def intervals(onsets: DataFrame, lo: float, hi: float, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Successive onset intervals with the ones outside (lo, hi) removed."""
    s = scan(onsets.select("song_id", "t_ms"), ["song_id"], ["t_ms"], {"_n": nxt("t_ms")}, chunk_ms)
    return s.withColumn("ioi", F.col("_n") - F.col("t_ms")).filter((F.col("ioi") > lo) & (F.col("ioi") < hi)).drop("_n")


# Rows that meet a song's grid as one matrix; longer songs are dealt into blocks of some as many.
BLOCK, ROWS_PER_BLOCK = "_block", 4096


def _dealt(rows: DataFrame, wants: DataFrame, by: str, per: float = ROWS_PER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows and entry states of (song, block) groups for sums that need no order.

    A song's rows are dealt by a hash of ``by`` into blocks of some ``per`` rows, a short song's
    into one, so that partial sums grow with the rows and not with the chunks of time.
    """
    sizes = rows.groupBy("song_id").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("_blocks"))
    w = wants.join(sizes, "song_id")
    entries = w.select("song_id", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias(BLOCK), F.to_json(F.struct("want", "_blocks")).alias("want"))
    dealt = rows.join(w.select("song_id", "_blocks"), "song_id").withColumn(BLOCK, F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int"))
    return dealt.drop("_blocks"), entries


def density(values: DataFrame, value: str, t: str, stats: DataFrame, points: int, per_block: float = ROWS_PER_BLOCK) -> DataFrame:
    """Gaussian kernel density per song on ``points`` grid points between x_lo and x_hi.

    ``stats`` has song_id, h, x_lo, x_hi.  Values of one (song, block) meet the grid as a matrix of
    distinct values, weighted by their counts, and leave one partial sum per grid point; a song
    is never gathered in one place and no row is made per value and point.
    """
    part = ["song_id", BLOCK]
    rows = values.select("song_id", F.col(value).cast("double").alias("_x"), F.col(t).alias("_t"))
    rows, entries = _dealt(rows, stats.select("song_id", F.array(*[F.col(c).cast("double") for c in ("h", "x_lo", "x_hi")]).alias("want")), "_t", per_block)

    def sums(p: Group) -> dict:
        if not len(p):  # the hash left this block empty
            return {}
        h, lo, hi = json.loads(p.want)["want"]
        seen, times = np.unique(p["_x"], return_counts=True)
        x = lo + np.arange(points) * (hi - lo) / float(points - 1)
        total = np.zeros(points)
        for i in range(0, len(seen), 4096):
            z = (x[None] - seen[i:i + 4096, None]) / h
            total += times[i:i + 4096] @ np.exp(-0.5 * z * z)
        return {**p.key(["song_id"], points), "g": list(range(points)), "x": x.tolist(), "k": total.tolist()}

    schema = T.StructType([values.schema["song_id"], T.StructField("g", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("k", T.DoubleType())])
    made = map_groups(rows.drop("_t"), entries, part, ["_x"], sums, schema)
    return made.groupBy("song_id", "g").agg(F.first("x").alias("x"), F.round(F.sum("k"), 9).alias("density"))


def peaks(dens: DataFrame) -> DataFrame:
    """Strict local maxima of a density (a bounded grid per song)."""
    w = Window.partitionBy("song_id").orderBy("g")
    d = dens.withColumn("_l", F.lag("density").over(w)).withColumn("_r", F.lead("density").over(w))
    return d.withColumn("peak", F.coalesce((F.col("density") > F.col("_l")) & (F.col("density") > F.col("_r")), F.lit(False))).drop("_l", "_r")


def modal_tempo(notes: DataFrame, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Tempo from the modal inter-onset interval; needs 8 onsets and 6 usable intervals."""
    starts = notes.select("song_id", F.col("start_ms").alias("t_ms")).distinct().withColumn("_q", F.lit(0))
    onsets = settle(anchor_groups(starts, ["song_id"], "t_ms", "_q", 30.0, chunk_ms=chunk_ms).select(
        "song_id", F.col("group_ms").alias("t_ms")).distinct())
    iois = settle(intervals(onsets, 30.0, 2000.0, chunk_ms))
    st = iois.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("ioi").alias("sd"),
                                     F.min("ioi").alias("x_lo"), F.max("ioi").alias("x_hi"))
    onset_n = onsets.groupBy("song_id").agg(F.count(F.lit(1)).alias("_o")).filter("_o >= 8")
    st = st.filter("n >= 6").join(onset_n, "song_id", "left_semi")
    smooth = st.filter("sd > 0").withColumn("h", F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("sd"))
    pk = peaks(density(iois, "ioi", "t_ms", smooth.select("song_id", "h", "x_lo", "x_hi"), 400))
    top = pk.groupBy("song_id").agg(
        F.min_by("x", F.when(F.col("peak"), F.struct(-F.col("density"), F.col("g")))).alias("a"),
        F.min_by("x", F.struct(-F.col("density"), F.col("g"))).alias("b"))
    modal = st.join(top, "song_id", "left").select("song_id", F.coalesce("a", "b", "x_lo").alias("modal_ms"))
    j = iois.join(modal, "song_id").groupBy("song_id").agg(
        F.first("modal_ms").alias("modal_ms"),
        F.avg((F.abs(F.col("ioi") - F.col("modal_ms")) < 15.0).cast("double")).alias("concentration"))
    bpm = 60000.0 / F.col("modal_ms")
    folded = F.when(bpm > 300, bpm / F.pow(F.lit(2.0), F.ceil(F.log2(bpm / 300.0)))).otherwise(bpm)
    return j.select("song_id", "modal_ms", "concentration", folded.alias("tempo_bpm"),
                    F.least(F.lit(0.85), 0.3 + F.col("concentration") * 1.2).alias("confidence"))


def ratio_families(iois: DataFrame, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Share of interval-ratio density peaks per rhythmic family (one row per song and family)."""
    s = scan(iois, ["song_id"], ["t_ms"], {"_1": nxt("ioi"), "_2": nxt("ioi", 2)}, chunk_ms)
    r = s.select("song_id", "t_ms", F.explode(F.array(F.col("_1") / F.col("ioi"), F.col("_2") / F.col("ioi"))).alias("ratio"))
    r = settle(r.filter((F.col("ratio") > 0.4) & (F.col("ratio") < 2.6)))
    st = r.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"), (0.15 * F.stddev_samp("ratio")).alias("h"))
    st = st.filter("n >= 5 and h > 0").select("song_id", "h", F.lit(0.4).alias("x_lo"), F.lit(2.6).alias("x_hi"),
                                            (F.col("n") * F.col("h") * float(np.sqrt(2 * np.pi))).alias("scale"))
    pk = peaks(density(r, "ratio", "t_ms", st.drop("scale"), 200)).filter("peak")
    fam = F
    for name, ideals in FAMILIES:
        near = [F.abs(F.col("x") - i) < 0.1 for i in ideals]
        test = near[0]
        for c in near[1:]:
            test = test | c
        fam = fam.when(test, name)
    hit = pk.withColumn("family", fam).filter("family is not null").groupBy("song_id", "family").agg(F.sum("density").alias("s"))
    names = F.array(*[F.lit(n) for n, _ in FAMILIES])
    songs = iois.groupBy("song_id").agg(F.count(F.lit(1)).alias("_k")).join(st.select("song_id", F.lit(True).alias("_ok")), "song_id", "left")
    grid = songs.select("song_id", "_ok", F.explode(names).alias("family")).join(hit, ["song_id", "family"], "left")
    total = F.sum("s").over(Window.partitionBy("song_id"))
    share = F.when(total > 0, F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) / total)).otherwise(0.0)
    return grid.select("song_id", "family", F.when(F.col("_ok"), share).otherwise(0.5).alias("score"))


def _round_half_up(x: float, places: int) -> float:
    """Rounded as Spark and most SQL engines round doubles: by their decimal text."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def _multiples(bases: list[float]) -> set[float]:
    """Six multiples of each base period that lie within 20..300 bpm."""
    made = {_round_half_up(b * m, 6) for b in bases for m in (1, 2, 3, 4, 6, 8)}
    return {p for p in made if 0.2 <= p <= 3.0}


def lattice(onsets: DataFrame, families: DataFrame, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Best regular time lattice per song.

    Candidate periods are the twenty shortest intervals of the song, a half-bpm grid, and six
    multiples of each.  The onsets of one (song, block) meet all of them as a matrix and leave
    one partial sum per period, so no row is made per onset and period; a song of one block has
    whole sums there and keeps the periods that can still win.  Periods outside 20..300 bpm are
    not tried.
    """
    s = scan(onsets.select("song_id", "t_ms"), ["song_id"], ["t_ms"], {"_n": nxt("t_ms")}, chunk_ms)
    gap = F.col("_n") - F.col("t_ms")
    s = s.withColumn("t", F.col("t_ms") / 1000.0).withColumn(
        "ioi", F.when((gap > 50.0) & (gap < 2000.0), F.col("_n") / 1000.0 - F.col("t")))
    s = settle(s)
    r4 = F.round("ioi", 4)
    own = s.groupBy("song_id").agg(
        F.count("ioi").alias("n_ioi"), F.count(F.lit(1)).alias("events"),
        # distinct intervals at 0.1 ms inside (0.05, 2) s: at most 19 500 values
        F.slice(F.array_sort(F.collect_set(F.when(r4 > 0.05, r4))), 1, 20).alias("own")).filter("n_ioi >= 3 and events >= 4")
    common = _multiples([_round_half_up(60.0 / (i / 2.0), 4) for i in range(40, 600)])
    part = ["song_id", BLOCK]
    rows, entries = _dealt(s.select("song_id", "t", "ioi"), own.select("song_id", F.col("own").alias("want")), "t")

    def sums(p: Group) -> dict:
        if not len(p):
            return {}
        given = json.loads(p.want)
        periods = np.array(sorted(common | _multiples(given["want"])))
        t, ioi = p["t"], p["ioi"].astype(float)
        ioi = ioi[~np.isnan(ioi)]
        d, z, zz = (np.zeros(len(periods)) for _ in range(3))
        for i in range(0, len(t), 256):
            rem = np.mod(t[i:i + 256, None], periods[None])
            d += np.minimum(rem, periods[None] - rem).sum(axis=0)
        for i in range(0, len(ioi), 256):
            at = np.mod(ioi[i:i + 256, None], periods[None]) / periods[None] - 0.5
            z += at.sum(axis=0)
            zz += (at * at).sum(axis=0)
        if given["_blocks"] == 1:
            # whole sums: the score below without its per-song terms, and room for how it is rounded
            error = np.clip(d / len(t) / (periods / 2.0), 0.0, 1.0)
            spread = np.sqrt(np.maximum(0.0, zz / len(ioi) - (z / len(ioi)) ** 2))
            score = -0.4 * error - 0.1 * np.minimum(1.0, 2.0 * spread)
            best = score >= score.max() - 1e-6
            periods, d, z, zz = periods[best], d[best], z[best], zz[best]
        k = len(periods)
        return {**p.key(["song_id"], k), "period": periods.tolist(), "n": [len(t)] * k, "m": [len(ioi)] * k, "d": d.tolist(), "z": z.tolist(), "zz": zz.tolist()}

    schema = T.StructType([s.schema["song_id"], T.StructField("period", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("m", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("d", "z", "zz")]])
    g = map_groups(rows, entries, part, ["t"], sums, schema).groupBy("song_id", "period").agg(*[F.sum(c).alias(c) for c in ("n", "m", "d", "z", "zz")])
    mean = F.col("z") / F.col("m")
    g = g.select("song_id", "period", (F.col("d") / F.col("n")).alias("d"), F.sqrt(F.greatest(F.lit(0.0), F.col("zz") / F.col("m") - mean * mean)).alias("sd"))
    fam = families.groupBy("song_id").agg(
        F.max("score").alias("ratio_score"),
        F.max_by("family", F.struct("score", *[(F.col("family") == n).cast("int") for n, _ in FAMILIES])).alias("ratio_family"))
    g = g.join(fam, "song_id")
    error = clip(F.col("d") / (F.col("period") / 2.0), 0.0, 1.0)
    entropy = F.least(F.lit(1.0), F.col("sd") * 2)
    g = g.withColumn("error", error).withColumn("entropy", entropy)
    score = (1 - F.col("error")) * 0.4 + 0.5 * 0.4 + (1 - F.col("entropy")) * 0.1 + F.col("ratio_score") * 0.1
    conf = clip((1 - F.col("error")) * 0.3 + 0.5 * 0.3 + (1 - F.col("entropy")) * 0.2 + F.col("ratio_score") * 0.2, 0.0, 1.0)
    best = g.groupBy("song_id").agg(F.min_by(
        F.struct("period", "error", "entropy", conf.alias("confidence"), "ratio_family"),
        F.struct(-F.round(score, 9), F.col("period"))).alias("b")).select("song_id", "b.*")
    best = settle(best)
    return best.join(lattice_phase(s, best), "song_id")


def lattice_phase(onsets: DataFrame, best: DataFrame, bins: int = 20) -> DataFrame:
    """Phase of the winning period: centre of the fullest of 20 bins over the remainders seen."""
    j = onsets.join(best.select("song_id", "period"), "song_id").withColumn("r", F.pmod("t", "period"))
    lim = j.groupBy("song_id").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    j = j.join(lim, "song_id")
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.lit(bins - 1), F.floor((F.col("r") - F.col("lo")) / width))
    h = j.withColumn("b", F.when(width > 0, b).otherwise(0)).groupBy("song_id", "b").agg(
        F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("period").alias("p"))
    top = h.groupBy("song_id").agg(F.min_by(F.struct("b", "lo", "hi", "p"), F.struct(-F.col("n"), F.col("b"))).alias("m"))
    centre = F.col("m.lo") + (F.col("m.hi") - F.col("m.lo")) / bins * (F.col("m.b") + 0.5)
    return top.select("song_id", (centre / F.col("m.p")).alias("phase"))


def tactus(onsets: DataFrame, lat: DataFrame) -> DataFrame:
    """Beat period among multiples of the lattice, with the witness confidence."""
    mult = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(m)).alias("m")) for i, m in enumerate(TACTUS)])
    c = lat.select("song_id", "period", "phase", "confidence", F.explode(mult).alias("x")).select(
        "song_id", "confidence", (F.col("phase") * F.col("period")).alias("ph"), F.col("x.i").alias("i"),
        (F.col("period") * F.col("x.m")).alias("p")).filter((60.0 / F.col("p")).between(20.0, 300.0))
    packed = c.groupBy("song_id").agg(F.collect_list(F.struct("i", "p", "ph", "confidence")).alias("cs"))
    j = onsets.select("song_id", (F.col("t_ms") / 1000.0).alias("t")).join(packed, "song_id").select(
        "song_id", "t", F.explode("cs").alias("c")).select("song_id", "t", "c.*")
    rem = F.pmod(F.col("t") - F.col("ph"), F.col("p"))
    g = j.groupBy("song_id", "i", "p").agg(
        F.avg((F.least(rem, F.col("p") - rem) < F.col("p") * 0.15).cast("double")).alias("align"),
        F.first("confidence").alias("confidence"))
    o = F.log2(60.0 / F.col("p") / 110.0) / 0.9
    score = F.col("align") * 0.8 + F.exp(-0.5 * o * o) * 0.2
    best = g.groupBy("song_id").agg(F.min_by(F.struct("p", "align", "confidence"), F.struct(-F.round(score, 9), F.col("i"))).alias("b"))
    return best.select("song_id", (60.0 / F.col("b.p")).alias("tempo_bpm"),
                       clip(F.col("b.confidence") * 0.5 + F.col("b.align") * 0.5, 0.0, 1.0).alias("confidence"), F.lit(0.6).alias("weight"))


def pulse_field(onsets: DataFrame, tempo: DataFrame, lattice_ms: float | None = None, lattice_conf: float = 0.0) -> DataFrame:
    """Probability of each metric level of a song's tempo, and whether it is the best one."""
    lev = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("level")) for i, v in enumerate(LEVELS)])
    h = tempo.select("song_id", "tempo_bpm", "confidence", F.explode(lev).alias("x")).select(
        "song_id", F.col("x.i").alias("i"), F.col("x.level").alias("level"),
        (60000.0 / F.col("tempo_bpm") / F.col("x.level")).alias("period_ms"), (F.col("confidence") / F.col("x.level")).alias("prob"))
    h = h.filter((60000.0 / F.col("period_ms")).between(20.0, 300.0))
    packed = h.groupBy("song_id").agg(F.collect_list(F.struct("i", "level", "period_ms", "prob")).alias("hs"))
    j = packed.join(onsets.select("song_id", "t_ms"), "song_id", "left").select("song_id", "t_ms", F.explode("hs").alias("h"))
    a = F.pmod("t_ms", F.col("h.period_ms")) / F.col("h.period_ms") * (2 * np.pi)
    g = j.groupBy("song_id", "h").agg(F.count("t_ms").alias("n"), F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s")).select("song_id", "h.*", "n", "c", "s")
    res = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    g = g.withColumn("probability", F.when(F.col("n") < 4, F.col("prob")).otherwise(clip(F.col("prob") * 0.7 + res * 0.3, 0.1, 1.0)))
    w = Window.partitionBy("song_id")
    if lattice_ms is not None:
        first = F.min(F.struct(F.round(F.abs(F.col("period_ms") - lattice_ms), 9), F.col("i"))).over(w)
        is_near = first["i"] == F.col("i")
        g = g.withColumn("probability", F.when(is_near, F.col("probability") * 0.7 + lattice_conf * 0.3).otherwise(F.col("probability")))
    best = F.min(F.struct(-F.round("probability", 9), F.col("i"))).over(w)
    return g.select("song_id", "level", "period_ms", "probability", (best["i"] == F.col("i")).alias("best"), "i")


def phase(onsets: DataFrame, periods: DataFrame, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Circular mean phase of the onsets, refined by the median offset near seven predicted beats."""
    j = onsets.select("song_id", "t_ms").join(periods.select("song_id", "period_ms"), "song_id")
    a = F.pmod("t_ms", F.col("period_ms")) / F.col("period_ms") * (2 * np.pi)
    g = j.groupBy("song_id").agg(F.first("period_ms").alias("period_ms"), F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s"),
                                 F.count(F.lit(1)).alias("n"))
    ang = F.pmod(F.atan2("s", "c"), F.lit(2 * np.pi))
    few = F.col("n") < 3
    g = g.select("song_id", "period_ms", F.when(few, 0.0).otherwise(ang / (2 * np.pi) * F.col("period_ms")).alias("phase0"),
                 F.when(few, 0.0).otherwise(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))).alias("coherence"))
    pred = g.withColumn("k", F.explode(F.sequence(F.lit(-3), F.lit(3)))).withColumn("beat", F.col("phase0") + F.col("k") * F.col("period_ms"))
    hit = nearest(pred, onsets.select("song_id", "t_ms"), ["song_id"], "beat", "t_ms", 50.0, {"hit": F.col("t_ms")}, chunk_ms)
    off = F.when(F.abs(F.col("hit") - F.col("beat")) < 50.0, F.col("hit") - F.col("beat"))
    r = hit.groupBy("song_id").agg(F.first("phase0").alias("phase0"), F.first("coherence").alias("coherence"),
                                   F.first("period_ms").alias("period_ms"), F.percentile(off, F.lit(0.5)).alias("shift"))
    return r.select("song_id", "period_ms", (F.col("phase0") + F.coalesce("shift", F.lit(0.0))).alias("phase_ms"), "coherence")


def beat_accents(beats: DataFrame, frames: DataFrame, value: str = "flux", chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Onset strength at each beat by linear interpolation between frames (clamped at the ends)."""
    return interpolate_at(beats, frames, "t_ms", "t_ms", value, "accent", chunk_ms)


def downbeat_salience(accents: DataFrame, numerators=NUMERATORS, keys=("song_id",), pos: str = "beat_idx", min_bars: int = 3) -> DataFrame:
    """Best bar position and how far its mean accent stands above the other positions'.

    ``accents`` has keys, 0-based ``pos``, accent, and n (beats of the song).
    Every row is tried in all numerators; the folds are partial averages.
    """
    keys = list(keys)
    x = accents.withColumn("numerator", F.explode(F.array(*[F.lit(n) for n in numerators])))
    x = x.filter((F.col("n") >= F.col("numerator") * min_bars) & (F.col(pos) < F.floor(F.col("n") / F.col("numerator")) * F.col("numerator")))
    m = x.groupBy(*keys, "numerator", F.pmod(F.col(pos), F.col("numerator")).alias("p")).agg(F.avg("accent").alias("m"))
    g = m.groupBy(*keys, "numerator").agg(
        F.min_by("p", F.struct(-F.round("m", 9), F.col("p"))).alias("phase"), F.max("m").alias("top"), F.sum("m").alias("all"))
    other = (F.col("all") - F.col("top")) / (F.col("numerator") - 1)
    denom = F.col("top") + other
    return g.select(*keys, "numerator", "phase", F.when(denom > 0, F.greatest(F.lit(0.0), (F.col("top") - other) / denom)).otherwise(0.0).alias("salience"))


def with_count(beats: DataFrame) -> DataFrame:
    return beats.join(beats.groupBy("song_id").agg(F.count(F.lit(1)).alias("n")), "song_id")


# Beats of a song that one pass shuffles; the cells of a slab of trials it holds at once.
BEATS_PER_PASS, CELLS = 32768, 1 << 20


def _null_salience(accents: DataFrame, trials: int, seed: int) -> DataFrame:
    """Mean and 95th percentile of the salience of shuffled accents, per song and numerator, from one pass over each song."""
    def one(p: Group) -> dict:
        n, accent = len(p), p["accent"].astype(float)
        number = p["beat_idx"].astype(np.int64) * 1009
        found: dict[int, list] = {k: [] for k in NUMERATORS if n >= k * 3}
        slab = max(1, CELLS // n)
        for first in range(1, trials + 1, slab):
            trial = np.arange(first, min(first + slab, trials + 1))
            dealt = accent[np.argsort(uniform_of(number[None] + trial[:, None], 7, seed), axis=1, kind="stable")]
            for k, rows in found.items():
                m = dealt[:, :n // k * k].reshape(len(trial), n // k, k).mean(axis=1)
                top = m.max(axis=1)
                other = (m.sum(axis=1) - top) / (k - 1)
                over = np.maximum(0.0, (top - other) / np.where(top + other > 0, top + other, 1.0))
                rows.append(np.where(top + other > 0, over, 0.0))
        drawn = {k: np.concatenate(v) for k, v in found.items()}
        return {**p.key(["song_id"], len(drawn)), "numerator": list(drawn), "baseline": [float(v.mean()) for v in drawn.values()],
                "threshold": [float(np.percentile(v, 95)) for v in drawn.values()]}

    schema = T.StructType([accents.schema["song_id"], T.StructField("numerator", T.IntegerType()), T.StructField("baseline", T.DoubleType()), T.StructField("threshold", T.DoubleType())])
    return map_groups(accents.select("song_id", "beat_idx", "accent"), None, ["song_id"], ["beat_idx"], one, schema)


def scored_meters(accents: DataFrame, trials: int = 100, seed: int = 0) -> DataFrame:
    """Salience corrected for chance by shuffled accents (permutations in the order of a draw per beat and trial).

    One permutation per trial serves all numerators.  A song of up to ``BEATS_PER_PASS`` beats is
    shuffled and folded as a matrix of trials, and only two numbers per numerator leave it.  In a
    longer one ranks come from a two-level count over the draws, so it is not sorted in one task.
    """
    accents = settle(accents)
    real = downbeat_salience(accents)
    plain = F.count_if(F.col("accent").isNotNull() & ~F.isnan("accent")) == F.count(F.lit(1))
    short = accents.groupBy("song_id").agg(((F.max("n") <= BEATS_PER_PASS) & (F.max("n") == F.count(F.lit(1))) & plain).alias("_short"))
    marked = accents.join(short, "song_id")
    base = _null_salience(marked.filter("_short").drop("_short"), trials, seed)
    t = marked.filter("not _short").drop("_short").withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    t = scan(t.withColumn("_u", uniform(F.col("beat_idx").cast("bigint") * 1009 + F.col("trial"), 7, seed)), ["song_id", "trial"], ["_u", "beat_idx"], {"_rn": row_no()}, 0.25)
    null = downbeat_salience(t.select("song_id", "trial", (F.col("_rn") - 1).alias("beat_idx"), "accent", "n"), keys=("song_id", "trial"))
    base = base.unionByName(null.groupBy("song_id", "numerator").agg(
        F.avg("salience").alias("baseline"), F.percentile("salience", F.lit(0.95)).alias("threshold")))
    j = real.join(base, ["song_id", "numerator"])
    lift = (F.col("salience") - F.col("baseline")) / (1.0 - F.col("baseline"))
    return j.withColumn("score", F.when(F.col("baseline") >= 1.0, 0.0).otherwise(clip(lift, 0.0, 1.0))).withColumn(
        "significant", (F.col("baseline") < 1.0) & (F.col("salience") > F.col("threshold")))


def time_signature(beats: DataFrame, scored: DataFrame, ratio_family: Column | None = None) -> DataFrame:
    """Best significant numerator with phase, or 4/4 at 0.3; weak winners keep phase 0."""
    family = F.lit("binary") if ratio_family is None else ratio_family
    best = scored.filter("significant").groupBy("song_id").agg(
        F.min_by(F.struct("numerator", "score", "phase"), F.struct(-F.round("score", 9), F.col("numerator"))).alias("b"))
    songs = beats.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))
    j = songs.join(best, "song_id", "left")
    ok = (F.col("n") >= 8) & F.col("b").isNotNull()
    return j.select("song_id", F.when(ok, F.col("b.numerator")).otherwise(4).alias("numerator"),
                    F.when(ok, denominator_for(F.col("b.numerator"), family)).otherwise(4).alias("denominator"),
                    F.when(ok, F.col("b.score")).otherwise(0.3).alias("confidence"),
                    F.when(ok & (F.col("b.score") >= 0.30), F.col("b.phase")).otherwise(0).alias("phase"))


def spectral_meter(accents: DataFrame) -> DataFrame:
    """Numerator whose bar rate holds the largest share of the accent spectrum.

    Only the few bins around each bar rate are summed (a direct transform); the
    total power follows from the sum of squares.
    """
    m = accents.groupBy("song_id").agg(F.avg("accent").alias("mean"), F.count(F.lit(1)).alias("cnt")).filter("cnt >= 16")
    j = accents.join(m, "song_id").withColumn("x", F.col("accent") - F.col("mean"))
    half = F.floor(F.col("cnt") / 2)
    targets = F.array(*[F.struct(F.lit(k).alias("numerator"), F.bround(F.col("cnt") / F.lit(float(k))).cast("bigint").alias("bin")) for k in NUMERATORS])
    usable = F.filter(targets, lambda t: (F.col("cnt") >= t["numerator"] * 3) & (t["bin"] > 0) & (t["bin"] <= half))
    bins = F.array_distinct(F.flatten(F.transform(usable, lambda t: F.filter(
        F.array(t["bin"] - 1, t["bin"], t["bin"] + 1), lambda b: (b >= 0) & (b <= half)))))
    alt = F.when(F.pmod("beat_idx", F.lit(2)) == 0, F.col("x")).otherwise(-F.col("x"))
    tot = j.groupBy("song_id").agg(F.sum(F.col("x") * F.col("x")).alias("ss"), F.sum("x").alias("s0"), F.sum(alt).alias("sn"))
    e = j.select("song_id", "beat_idx", "x", "cnt", F.explode(bins).alias("bin"))
    ang = F.col("beat_idx") * F.col("bin") * (-2 * np.pi) / F.col("cnt")
    p = e.groupBy("song_id", "bin").agg(F.sum(F.col("x") * F.cos(ang)).alias("re"), F.sum(F.col("x") * F.sin(ang)).alias("im"))
    p = p.select("song_id", "bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("pw"))
    per = m.select("song_id", "cnt", F.explode(usable).alias("t")).select("song_id", "cnt", "t.*")
    per = per.join(p.withColumnRenamed("bin", "b"), "song_id").filter(F.abs(F.col("b") - F.col("bin")) <= 1)
    s = per.groupBy("song_id", "cnt", "numerator").agg(F.sum("pw").alias("pw")).join(tot, "song_id")
    nyq = F.when(F.col("cnt") % 2 == 0, F.col("sn") * F.col("sn")).otherwise(0.0)
    total = (F.col("cnt") * F.col("ss") + F.col("s0") * F.col("s0") + nyq) / 2.0 + 1e-8
    s = s.withColumn("share", F.col("pw") / total).filter("share > 0")
    return s.groupBy("song_id").agg(F.min_by(F.struct("numerator", "share"), F.struct(-F.round("share", 9), F.col("numerator"))).alias("b")).select("song_id", "b.*")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _block_autocorr(xs: pd.Series, own: pd.Series, lags: pd.Series) -> pd.Series:
    """Products of a block's own frames with themselves shifted by each lag, summed."""
    out = []
    for x, n, k in zip(xs, own, lags):
        x, n = np.asarray(x, dtype=float), int(n)
        out.append([float(np.dot(x[:min(n, len(x) - l)], x[l:l + min(n, len(x) - l)])) if l < len(x) else 0.0 for l in range(int(k))])
    return pd.Series(out)


def autocorrelation(frames: DataFrame, value: str, max_lag: int, block: int = 512) -> DataFrame:
    """Autocorrelation sums per song and lag, from fixed-size blocks of frames."""
    b = blocks(frames, ["song_id"], "frame_idx", value, block, max_lag)
    a = b.select("song_id", F.posexplode(_block_autocorr("xs", "own", F.lit(max_lag + 1))).alias("lag", "v"))
    return a.groupBy("song_id", "lag").agg(F.sum("v").alias("ac"))


def _seconds(ms: float) -> float:
    """The double nearest to the decimal number of seconds (a plain division can miss it by one bit)."""
    return round(ms / 1000.0, 12)


def correct_octave(tempo: DataFrame, frames: DataFrame, hop_ms: float, value: str = "flux",
                   min_improvement: float = 0.15) -> DataFrame:
    """Re-read a tempo against twelve related ratios using the onset autocorrelation.

    Lags are bounded by the slowest tempo allowed, so a song is summarised by
    one short array before the ratios are compared.
    """
    hop = _seconds(hop_ms)
    max_lag = int(np.floor(60.0 / 20.0 / hop)) + 1
    ac = autocorrelation(frames, value, max_lag).groupBy("song_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "ac"))), lambda x: x["ac"]).alias("ac"))
    n = frames.groupBy("song_id").agg(F.count(F.lit(1)).alias("frames"))
    j = tempo.join(ac, "song_id").join(n, "song_id")
    j = j.withColumn("a", F.when(F.col("ac")[0] > 0, F.transform("ac", lambda x: x / F.col("ac")[0])).otherwise(F.col("ac")))

    def at(bpm: Column) -> Column:
        period = F.lit(60.0) / bpm / hop
        lo = F.floor(period)
        frac = period - lo
        v = F.get("a", lo.cast("int")) * (1 - frac) + F.get("a", (lo + 1).cast("int")) * frac
        return F.when((lo < 1) | (lo + 1 >= F.col("frames")), 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(v, F.lit(0.0))))

    def prior(bpm: Column) -> Column:
        o = F.log2(bpm / 110.0) / 0.9
        return F.exp(-0.5 * o * o)

    def salience(bpm: Column, d: int) -> Column:
        return F.greatest(F.lit(0.0), at(bpm * d) - 0.5 * (at(bpm * (d + 0.5)) + at(bpm * (d - 0.5))))

    ratio = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a / b).alias("r")) for i, (a, b) in enumerate(TEMPO_RATIOS)])
    c = j.select("song_id", "tempo_bpm", "confidence", "frames", "a", F.explode(ratio).alias("x")).select(
        "song_id", "tempo_bpm", "confidence", "frames", "a", F.col("x.i").alias("i"), (F.col("tempo_bpm") * F.col("x.r")).alias("bpm"))
    c = c.filter(F.col("bpm").between(20.0, 300.0))
    bpm = F.col("bpm")
    eff = F.greatest(F.lit(0.0), at(bpm) - 0.3 * F.greatest(at(bpm * 2), at(bpm * 3))) * prior(bpm)
    c = c.select("song_id", "tempo_bpm", "confidence", "frames", "i", "bpm", F.round(eff, 9).alias("eff"),
                 F.least(salience(bpm, 2), salience(bpm, 3)).alias("coh"), prior(bpm).alias("prior"))
    entry = F.struct((-F.col("eff")).alias("o"), F.col("i"), F.col("bpm"), F.col("eff"), F.col("coh"), F.col("prior"))
    g = c.groupBy("song_id").agg(F.first("tempo_bpm").alias("raw"), F.first("confidence").alias("confidence"),
                                 F.first("frames").alias("frames"), F.array_sort(F.collect_list(entry)).alias("cs"))
    exact = F.coalesce(F.filter("cs", lambda x: x["i"] == 0)[0], F.col("cs")[0])
    g = g.withColumn("_e", exact).withColumn("_b", F.col("cs")[0])
    margin = min_improvement * (1.0 + clip("confidence", 0.0, 1.0))
    keep = (F.col("_b.i") == 0) | (F.col("_b.eff") - F.col("_e.eff") < margin)
    g = g.withColumn("_r", F.when(keep, F.col("_e")).otherwise(F.col("_b")))
    g = g.withColumn("_slow", F.filter("cs", lambda x: (x["bpm"] < F.col("_r.bpm")) & (x["coh"] >= 0.05) & (x["prior"] >= 0.4)
                                       & (x["coh"] >= F.col("_r.coh") + 0.04)))
    comp = F.array_max(F.transform("_slow", lambda x: F.struct(x["coh"].alias("coh"), (-x["i"]).alias("i"), x["bpm"].alias("bpm"))))
    enough = (F.col("frames") >= 8) & (F.col("raw") > 0)
    return g.select("song_id", F.when(enough, F.coalesce(comp["bpm"], F.col("_r.bpm"))).otherwise(F.col("raw")).alias("tempo_bpm"),
                    F.when(~enough, "insufficient_evidence").when(F.size("_slow") > 0, "compound_tactus")
                    .when(F.col("_r.i") == 0, "no_correction_needed").otherwise("related_ratio").alias("reason"))


@F.pandas_udf(T.DoubleType())
def _window_tempo(xs: pd.Series, lo: pd.Series, hi: pd.Series, hop: pd.Series) -> pd.Series:
    """Tempo of the strongest autocorrelation peak in a bpm band, by parabolic interpolation."""
    out = []
    for x, a, b, h in zip(xs, lo, hi, hop):
        x = np.asarray(x, dtype=float)
        val = None
        if len(x) >= 8:
            e = x - x.mean()
            ac = np.correlate(e, e, mode="full")[len(e) - 1:]
            if ac[0] > 0:
                ac = ac / ac[0]
                l1 = min(int(60.0 / (h * a)), len(ac) - 2)
                l0 = max(2, int(60.0 / (h * b)))
                if l1 > l0:
                    k = int(np.argmax(ac[l0:l1])) + l0
                    d = ac[k - 1] - 2 * ac[k] + ac[k + 1]
                    shift = 0.5 * (ac[k - 1] - ac[k + 1]) / d if abs(d) > 1e-12 else 0.0
                    val = 60.0 / (h * (k + float(np.clip(shift, -1.0, 1.0))))
        out.append(val)
    return pd.Series(out, dtype="float64")


def local_tempo(frames: DataFrame, reference: DataFrame, hop_ms: float, window_s: float = 12.0, hop_s: float = 3.0,
                value: str = "flux") -> DataFrame:
    """Tempo per hopping window; a window is a bounded array, so songs of any length spread out."""
    fps = 1000.0 / hop_ms
    win, hop = int(window_s * fps), int(hop_s * fps)
    last = F.floor(F.col("frame_idx") / hop)
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("frame_idx") - win + 1) / F.lit(float(hop))))
    n = frames.groupBy("song_id").agg(F.count(F.lit(1)).alias("frames"))
    w = frames.select("song_id", "frame_idx", F.col(value).alias("x"), F.explode(F.sequence(first, last)).alias("w"))
    g = w.groupBy("song_id", "w").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))).alias("r"))
    g = g.join(n, "song_id").filter((F.col("w") * hop < F.greatest(F.lit(1), F.col("frames") - win))).join(reference, "song_id")
    bpm = _window_tempo(F.transform("r", lambda x: x["x"]), F.col("tempo_bpm") * 0.75, F.col("tempo_bpm") * 1.33, F.lit(_seconds(hop_ms)))
    return g.select("song_id", "w", ((F.col("w") * hop + win / 2.0) / fps).alias("t_s"), "tempo_bpm", bpm.alias("local_bpm")).filter("local_bpm is not null")


def drift_class(curve: DataFrame, points_per_chunk: float = 10000.0) -> DataFrame:
    """Steady, step change, accelerando or ritardando from a song's local tempo curve."""
    outs = {f"_p{k}": prev("local_bpm", k) for k in range(1, 5)}
    curve = settle(curve)
    c = scan(curve, ["song_id"], ["w"], {**outs, "_i": row_no()}, points_per_chunk)
    n = c.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))
    c = c.join(n, "song_id")
    five = (F.col("local_bpm") + F.col("_p1") + F.col("_p2") + F.col("_p3") + F.col("_p4")) / 5.0
    c = c.withColumn("sm", F.when(F.col("n") >= 5, five).otherwise(F.col("local_bpm"))).filter("sm is not null")
    c = scan(settle(c.select("song_id", "w", "n", "tempo_bpm", "sm")), ["song_id"], ["w"], {"_q": prev("sm")}, points_per_chunk)
    d = F.col("sm") - F.col("_q")
    g = c.groupBy("song_id").agg(
        F.first("n").alias("n"), F.first("tempo_bpm").alias("ref"), (F.max("sm") - F.min("sm")).alias("span_bpm"),
        F.avg((d > 0).cast("double")).alias("up"), F.avg((d < 0).cast("double")).alias("down"),
        F.coalesce(F.max(F.abs(d)), F.lit(0.0)).alias("biggest"), F.percentile(F.abs(d), F.lit(0.5)).alias("med"))
    mono = F.greatest("up", "down")
    steady = F.col("span_bpm") / F.greatest(F.col("ref"), F.lit(1.0)) <= 0.06
    step = (F.col("biggest") >= 0.10 * F.col("ref")) & (F.col("biggest") > 2.5 * (F.col("med") + 1e-9))
    few = F.col("n") < 4
    kind = (F.when(few | steady, "steady").when(step, "step_change")
            .when((mono >= 0.85) & (F.col("up") > F.col("down")), "accelerando").when(mono >= 0.85, "ritardando").otherwise("steady"))
    conf = (F.when(few, 0.0).when(steady, 0.9).when(step, 0.7).when(mono >= 0.85, F.least(F.lit(0.85), mono)).otherwise(0.5))
    return g.select("song_id", kind.alias("kind"), "span_bpm", conf.alias("confidence"))
