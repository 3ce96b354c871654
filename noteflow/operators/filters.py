"""Row verdicts and projections (filters are verdicts first, dropping is an export choice)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.music import STEM_RANGES, clip, col, half_even, in_scale

MICRO_MS = 60.0


def split_valid(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row contract of a note: (accepted rows, quarantined rows with a reason)."""
    reason = (
        F.when(F.col("end_ms") < F.col("start_ms"), "end before start")
        .when(~F.col("pitch").between(0, 127), "pitch out of range")
    )
    tagged = notes.withColumn("confidence", clip("confidence", 0.0, 1.0)).withColumn("reason", reason)
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def notes_from_events(events: DataFrame) -> DataFrame:
    """Detector rows (start_s, end_s, pitch, amplitude) to notes."""
    return events.select(
        "*",
        (F.col("start_s") * 1000.0).alias("start_ms"),
        (F.col("end_s") * 1000.0).alias("end_ms"),
        clip(half_even(F.col("amplitude") * 127), 1, 127).cast("bigint").alias("velocity"),
        F.col("amplitude").alias("confidence"),
    ).drop("start_s", "end_s", "amplitude")


def legitimacy(duration: Column, confidence: Column, ratio: Column) -> Column:
    """Verdict on micro notes; a known harmonic ratio relaxes the confidence floor."""
    short = duration < MICRO_MS
    purge = F.when(ratio.isNull(), confidence < 0.15).otherwise((confidence < 0.35) & (ratio < 0.5))
    return F.when(short & purge, "purge_candidate").otherwise("legitimate")


def range_offenders(notes: DataFrame, stem: Column | str = "stem") -> DataFrame:
    """Notes outside the plausible range of a judged stem."""
    s = col(stem)
    lo, hi = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, (a, b) in STEM_RANGES.items():
        lo = F.when(s == name, a).otherwise(lo)
        hi = F.when(s == name, b).otherwise(hi)
    below, above = F.col("pitch") < lo, F.col("pitch") > hi
    return notes.filter(s.isin(*STEM_RANGES)).filter(below | above).withColumn(
        "place", F.when(below, "below").otherwise("above")
    )


def key_fit(pitch: Column, key: Column, confidence: Column) -> tuple[Column, Column]:
    """(in key, weight factor); weak key evidence never weighs a note."""
    weak, inside = confidence < 0.5, in_scale(pitch, key)
    factor = (
        F.when(weak, 1.0).when(inside, 1.05).when(confidence > 0.8, 0.90).when(confidence > 0.65, 0.95).otherwise(0.98)
    )
    return weak | inside, factor


def drop_for_export(notes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Remove notes whose latest verdict asks for it: one anti join on the union of verdicts.

    ``verdicts`` holds (note_id, kind, verdict), already reduced to the latest row.
    """
    bad = verdicts.filter(
        ((F.col("kind") == "legitimacy_verdict") & (F.col("verdict") == "purge_candidate"))
        | ((F.col("kind") == "harmonic_legitimacy") & F.col("verdict").isin("noise", "hallucination"))
        | ((F.col("kind") == "note_support") & (F.col("verdict") == "unsupported"))
        | ((F.col("kind") == "octave_stack") & (F.col("verdict") == "interior"))
        | ((F.col("kind") == "range_plausibility") & (F.col("verdict") == "implausible"))
        | ((F.col("kind") == "consolidation") & (F.col("verdict") == "absorbed"))
    )
    return notes.join(bad.select("note_id"), "note_id", "left_anti")


def page_timing(start: Column, end: Column, refined: Column, sustain_end: Column,
                n_start: Column, n_end: Column) -> tuple[Column, Column]:
    """Notation timing wins; else the refined onset and the longer end, never an empty span."""
    s = F.coalesce(n_start, refined, start)
    e = F.coalesce(n_end, F.greatest(end, sustain_end), end)
    return s, F.when(s >= e, s + F.greatest(F.lit(1.0), end - start)).otherwise(e)


def subdivisions_per_beat(numerator: Column, denominator: Column) -> Column:
    return F.when((denominator == 8) & numerator.isin(6, 9, 12), 3).otherwise(4)


def denominator_for(numerator: Column, ratio_family: Column) -> Column:
    return F.when(numerator.isin(6, 9, 12) & (ratio_family == "ternary"), 8).otherwise(4)


def region_type(void: Column, resonance: Column, active: Column, margin: float = 0.10) -> Column:
    """Leading acoustic class, or ``uncertain`` when it is not ahead by the margin."""
    ranked = F.sort_array(
        F.array(*[F.struct(v.alias("p"), F.lit(n).alias("n")) for v, n in
                  ((void, "silent"), (resonance, "resonant"), (active, "active"))]), asc=False)
    clear = (ranked[0]["p"] > 0) & (ranked[0]["p"] - ranked[1]["p"] >= margin)
    return F.when(clear, ranked[0]["n"]).otherwise("uncertain")


def confidence_penalty(region: Column, void: Column, resonance: Column) -> Column:
    return (
        F.when(region == "silent", F.least(F.lit(0.8), void * 0.9))
        .when(region == "resonant", F.least(F.lit(0.4), resonance * 0.5))
        .otherwise(0.0)
    )


def zcr_class(onset: Column, sustained: Column, limit: float = 0.35) -> Column:
    """Zero-crossing class of a note from its first and later frames."""
    return (
        F.when((onset > limit) & (sustained < limit * 0.6), "percussive")
        .when((onset > limit) & (sustained > limit), "noise")
        .when((onset < limit) & (sustained < limit), "tonal")
        .otherwise("uncertain")
    )


def harmonic_verdict(has_series: Column, match: Column, inharmonicity: Column, hps: Column,
                     zcr: Column, retrograde: Column, is_drum: Column, confidence: Column) -> Column:
    """Verdict ladder over the per-note witnesses."""
    perc = zcr == "percussive"
    good = (match >= 0.7) & (inharmonicity < 0.05)
    with_series = (
        F.when(good & ((hps >= 0.4) | perc), "tonal")
        .when(good, "uncertain")
        .when(perc & (retrograde != "tonal"), "percussion")
        .otherwise("uncertain")
    )
    without = (
        F.when(perc & (retrograde == "tonal"), "uncertain")
        .when(perc | is_drum | (retrograde == "percussive"), "percussion")
        .when(confidence < 0.5, "hallucination")
        .otherwise("noise")
    )
    return F.when(zcr == "noise", "noise").when(has_series, with_series).otherwise(without)


def family_ladder(n_notes: Column, b: Column, slope: Column, vibrato: Column, attack: Column,
                  even_odd: Column, brightness: Column) -> Column:
    """Instrument family of a voice line as struct(family, confidence, contested)."""

    def out(family: str, conf: float, contested: bool) -> Column:
        return F.struct(F.lit(family).alias("family"), F.lit(conf).alias("confidence"), F.lit(contested).alias("contested"))

    still = vibrato.isNull() | (vibrato < 6.0)
    stiff = (b > 1e-5) & (slope < -0.3) & still
    soft = b <= 1e-5
    steady = (F.abs(slope) < 0.3) & (vibrato.isNull() | (vibrato < 20.0))
    return (
        F.when(n_notes < 3, out("mid_body", 0.3, True))
        .when(stiff & (b >= 1.5e-4), out("piano", 0.8, False))
        .when(stiff & (attack >= 0.15), out("guitar", 0.7, False))
        .when(stiff, out("mid_body", 0.4, True))
        .when(soft & (vibrato >= 20.0), out("vibrato_lead", 0.6, True))
        .when(soft & (even_odd < 0.4), out("clarinet_like", 0.65, False))
        .when(soft & (brightness > -10.0) & steady, out("brass", 0.65, False))
        .otherwise(out("mid_body", 0.35, True))
    )


def position_level(ticks: Column, numerator: Column, denominator: Column) -> Column:
    """Metric strength of a position in ticks of 1/96 beat: 0 bar, 1 pulse, 2 beat, 3 below."""
    bar = numerator * 96
    pos = F.pmod(ticks, bar)
    compound = (denominator == 8) & numerator.isin(6, 9, 12)
    even = (~compound) & (numerator % 2 == 0) & (numerator >= 4)
    return (
        F.when(pos == 0, 0)
        .when(compound & (F.pmod(pos, F.lit(288)) == 0), 1)
        .when(even & (pos * 2 == bar), 1)
        .when(F.pmod(pos, F.lit(96)) == 0, 2)
        .otherwise(3)
    )


def snap_quarters(ql: Column, subdivision: int = 4, cap: int | None = 2,
                  triplet: Column | None = None, divisor: int | None = None) -> Column:
    """Snap quarter lengths to the page grid; a tuplet grid wins only when clearly closer."""
    grid = max(1, subdivision)
    if cap:
        grid = min(grid, cap)
        if cap < 3:
            divisor, triplet = None, None
    binary = F.bround(ql * grid) / float(grid)
    if divisor:
        other, allowed = F.bround(ql * divisor) / float(divisor), F.lit(True)
    elif triplet is not None:
        other, allowed = F.bround(ql * 3.0) / 3.0, triplet
    else:
        return binary
    return F.when(allowed & (F.abs(ql - other) + 1e-4 < F.abs(ql - binary)), other).otherwise(binary)
