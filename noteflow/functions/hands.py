"""Two-hand feasibility of a sorted set of pitches, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Span limits in semitones.
PROFILES = {"comfortable": 12, "standard": 14, "virtuoso": 17}


@dataclass(frozen=True)
class Limits:
    """Physical limits of one pianist."""

    span: int = 17
    fingers: int = 5
    total: int = 10
    inner_gap: int = 6
    crossings: int = 1
    strike_beats: float = 0.125
    roll_beats: float = 0.02
    leap: int = 20
    leap_beats: float = 0.5
    repeat_hz: float = 12.0


def profile(name: str) -> Limits:
    return Limits(span=PROFILES[name])


def hand_ok(p: Column, lim: Limits) -> Column:
    """One hand can hold the sorted pitches: enough fingers, span, and at most one wide inner gap."""
    n = F.size(p)
    wide = F.size(F.filter(F.zip_with(F.slice(p, 2, F.greatest(n - 1, F.lit(0))), F.slice(p, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: a - b),
                           lambda g: g > lim.inner_gap))
    return (n == 0) | ((n <= lim.fingers) & (F.element_at(p, -1) - F.element_at(p, 1) <= lim.span) & (wide <= 1))


def _parts(p: Column, i: Column, j: Column) -> tuple[Column, Column]:
    n = F.size(p)
    outer = F.concat(F.slice(p, F.lit(1), i), F.slice(p, j + 1, n - j))
    return outer, F.slice(p, i + 1, j - i)


def two_hands(p: Column, lim: Limits = Limits()) -> Column:
    """struct(ok, low, high): the first workable split, uncrossed hands preferred; null hands when none."""
    n = F.size(p)
    idx = F.sequence(F.lit(0), n)

    def options(i):
        ends = F.sequence(i, n) if lim.crossings > 0 else F.array(n)

        def option(j):
            outer, inner = _parts(p, i, j)
            crossed = (F.size(outer) > 0) & (F.size(inner) > 0) & (i > 0) & (j < n)
            swap = (F.size(outer) > 0) & (F.size(inner) > 0) & (F.get(outer, F.lit(0)) > F.get(inner, F.lit(0)))
            good = hand_ok(outer, lim) & hand_ok(inner, lim)
            return F.when(good, F.struct(crossed.alias("crossed"), (i * 100 + j).alias("o"), F.when(swap, inner).otherwise(outer).alias("low"),
                                         F.when(swap, outer).otherwise(inner).alias("high")))

        return F.transform(ends, option)

    crossed_or_not = F.array_min(F.array_compact(F.flatten(F.transform(idx, options))))

    def cut(j):
        return F.slice(p, F.lit(1), j), F.slice(p, j + 1, n - j)

    # uncrossed splits come first and are only n; the full search runs when none of them works
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: hand_ok(cut(j)[0], lim) & hand_ok(cut(j)[1], lim))
    plain = F.transform(F.slice(cuts, 1, 1), lambda j: F.struct(F.lit(False).alias("crossed"), F.lit(0).alias("o"), cut(j)[0].alias("low"), cut(j)[1].alias("high")))
    search = F.coalesce(F.get(plain, F.lit(0)), crossed_or_not)
    # one hand holding everything is the first split tried; it settles most instants without the search
    alone = F.struct(F.lit(False).alias("crossed"), F.lit(0).alias("o"), p.alias("low"), F.slice(p, 1, F.lit(0)).alias("high"))
    found = F.when(hand_ok(p, lim), alone).when(n <= lim.total, search)
    # the one-element transform names the result, so that it is computed once
    out = F.transform(F.array(found), lambda f: F.struct(f.isNotNull().alias("ok"), f["low"].alias("low"), f["high"].alias("high")))
    return F.get(out, F.lit(0))
