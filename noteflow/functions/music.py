"""Column expressions: pitch arithmetic, verdict ladders, key strings, text.

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen and can be pushed into scans by Catalyst.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence tiers, stem pitch ranges, chord shapes, note names.
CONFIDENCE_TIERS = (
    (1.0, "perfect"),
    (0.8, "high"),
    (0.5, "medium"),
    (0.25, "low"),
    (0.0, "hallucination"),
)
STEM_RANGES = {"bass": (23, 67), "vocals": (36, 88)}
NOTE_PITCH_CLASS = {
    "C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5,
    "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11,
}
TRIADS = ((0, 4, 7), (0, 3, 7), (0, 3, 6), (0, 4, 8))
TETRADS = ((0, 4, 7, 11), (0, 4, 7, 10), (0, 3, 7, 10), (0, 3, 6, 10), (0, 3, 6, 9))
MAJOR_SCALE = (0, 2, 4, 5, 7, 9, 11)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), col(c)))


def half_even(c: str | Column) -> Column:
    """Round to an integer, halves to even."""
    return F.bround(col(c)).cast("bigint")


def midi_to_hz(p: str | Column) -> Column:
    """440 * 2^((p - 69) / 12)."""
    return F.lit(440.0) * F.pow(F.lit(2.0), (col(p) - 69) / 12.0)


def hz_to_midi(hz: str | Column) -> Column:
    """69 + 12 * log2(hz / 440)."""
    return F.lit(69.0) + F.lit(12.0) * F.log2(col(hz) / 440.0)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, from the exact errors of the product and of the sum.

    Engines that fuse an interpolation's last step give it so, and a value at a limit falls the same way.
    """
    def halves(x: Column) -> tuple[Column, Column]:
        t = x * 134217729.0
        top = t - (t - x)
        return top, x - top

    (ah, al), (bh, bl) = halves(a), halves(b)
    p = a * b
    lost = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    back = s - p
    return s + (((p - (s - back)) + (c - back)) + lost)


def confidence_tier(c: str | Column) -> Column:
    """Highest tier at or below the value clamped into [0, 1]."""
    v = clip(c, 0.0, 1.0)
    whens = F
    for floor, name in CONFIDENCE_TIERS:
        whens = whens.when(v >= floor, name)
    return whens


def pitch_class(p: str | Column) -> Column:
    return F.pmod(col(p), F.lit(12))


def pitch_class_mask(pitches: Column) -> Column:
    """12-bit set of pitch classes of an array of pitches."""
    return F.aggregate(
        pitches, F.lit(0), lambda acc, p: acc.bitwiseOR(F.pow(F.lit(2), F.pmod(p, F.lit(12))).cast("int"))
    )


def chord_masks() -> list[int]:
    """Pitch-class sets of every triad and tetrad in every transposition."""
    out = set()
    for shape in (*TRIADS, *TETRADS):
        for root in range(12):
            out.add(sum(1 << ((root + s) % 12) for s in shape))
    return sorted(out)


def is_chord_mask(mask: Column) -> Column:
    """Test a 12-bit set against all chord shapes (a small constant IN set)."""
    return mask.isin(chord_masks())


def tonic_pc(key: str | Column) -> Column:
    """Pitch class of a key name's tonic, null for an unknown name."""
    base = F.regexp_replace(F.trim(col(key)), "m+$", "")
    table = F.create_map(*[F.lit(x) for kv in NOTE_PITCH_CLASS.items() for x in kv])
    return F.try_element_at(table, base)


def is_minor(key: str | Column) -> Column:
    return F.trim(col(key)).endswith("m")


def key_number(key: str | Column) -> Column:
    """Tonic pitch class, plus 12 in minor."""
    return tonic_pc(key) + F.when(is_minor(key), 12).otherwise(0)


def in_scale(pitch: str | Column, key: str | Column) -> Column:
    """Pitch belongs to the key's scale; a minor key uses its relative major's set.

    Key names outside the 24 detector names fall back to the C major set.
    """
    known = col(key).isin(*MAJOR_KEYS, *MINOR_KEYS)
    root = F.when(is_minor(key), F.pmod(tonic_pc(key) + 3, F.lit(12))).otherwise(tonic_pc(key))
    root = F.when(known, root).otherwise(0)
    return F.pmod(col(pitch) - root, F.lit(12)).isin(*MAJOR_SCALE)


# The detector's key names, fifths order; index i of both lists is a relative pair.
MAJOR_KEYS = ("C", "G", "D", "A", "E", "B", "F#", "Db", "Ab", "Eb", "Bb", "F")
MINOR_KEYS = ("Am", "Em", "Bm", "F#m", "C#m", "G#m", "D#m", "Bbm", "Fm", "Cm", "Gm", "Dm")


def elapsed_text(seconds: str | Column) -> Column:
    """``1h 02m 03s`` from an hour on, else ``2m 03s``."""
    s = F.greatest(F.lit(0).cast("bigint"), col(seconds).cast("bigint"))
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(
        h > 0, F.format_string("%dh %02dm %02ds", h.cast("bigint"), m.cast("bigint"), r.cast("bigint"))
    ).otherwise(F.format_string("%dm %02ds", m.cast("bigint"), r.cast("bigint")))


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def nearest_value(x: Column, values: Sequence[float]) -> Column:
    """Member of a constant list closest to x; ties go to the earlier member."""
    scored = F.array(*[F.struct(F.abs(x - F.lit(float(v))).alias("d"), F.lit(i).alias("i"), F.lit(float(v)).alias("v"))
                       for i, v in enumerate(values)])
    return F.array_min(scored)["v"]
