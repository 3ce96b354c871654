"""Playability on two hands: time lines, strain, summaries, hand split, simultaneity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.hands import Limits, two_hands
from ..plans.grouping import anchor_groups
from ..plans.joins import points_in
from ..plans.timeline import CHUNK_MS, max_before, nxt, prev, run_sum, scan, settle


def max_simultaneity(notes: DataFrame, keys=("song_id", "stem"), chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Most notes sounding at once: a running sum over starts and ends, ends first at equal times."""
    keys = list(keys)
    ev = F.array(F.struct(F.col("start_ms").alias("t"), F.lit(1).alias("delta")), F.struct(F.col("end_ms").alias("t"), F.lit(-1).alias("delta")))
    e = notes.select(*keys, "note_id", F.explode(ev).alias("e")).select(*keys, "note_id", "e.t", "e.delta")
    s = scan(e, keys, ["t", "delta", "note_id"], {"level": run_sum("delta")}, chunk_ms)
    return s.groupBy(*keys).agg(F.greatest(F.lit(0), F.max("level")).alias("max_notes"))


def sounding_timeline(notes: DataFrame, lim: Limits = Limits(), bucket_ms: float = 1000.0) -> DataFrame:
    """Elementary spans between event times with the sounding pitches and their feasibility."""
    n = notes.filter("end_ms > start_ms").select("song_id", "start_ms", "end_ms", "pitch")
    times = n.select("song_id", F.explode(F.array("start_ms", "end_ms")).alias("t0")).distinct()
    spans = scan(times, ["song_id"], ["t0"], {"t1": nxt("t0")}).filter("t1 is not null")
    p = points_in(n, spans, ["song_id"], "start_ms", "end_ms", "t0", bucket_ms, closed_end=False)
    g = p.groupBy("song_id", "t0", "t1").agg(F.array_sort(F.collect_set("pitch")).alias("pitches"))
    return g.withColumn("hands", two_hands(F.col("pitches"), lim)).withColumn(
        "verdict", F.when(F.col("hands.ok"), "playable").otherwise("impossible"))


def strike_timeline(notes: DataFrame, beat_ms: float, lim: Limits = Limits(), chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Struck chords with feasibility; an impossible chord may still be rolled in playable parts."""
    n = notes.filter("end_ms > start_ms").select("song_id", "start_ms", "note_id", "pitch", "end_ms")
    g = anchor_groups(n, ["song_id"], "start_ms", "note_id", lim.strike_beats * beat_ms, chunk_ms=chunk_ms)
    part = F.bround((F.col("start_ms") - F.col("group_ms")) / (lim.roll_beats * beat_ms))
    sub = g.groupBy("song_id", "group_ms", part.alias("part")).agg(F.array_sort(F.collect_set("pitch")).alias("ps"), F.max("end_ms").alias("e"))
    sub = sub.withColumn("part_ok", two_hands(F.col("ps"), lim)["ok"])
    s = sub.groupBy("song_id", F.col("group_ms").alias("t0")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("pitches"), F.count(F.lit(1)).alias("parts"), F.bool_and("part_ok").alias("parts_ok"),
        F.max("e").alias("e"))
    last = n.groupBy("song_id").agg(F.max("end_ms").alias("song_end"))
    s = scan(settle(s), ["song_id"], ["t0"], {"_n": nxt("t0")}, chunk_ms).join(last, "song_id")
    s = s.withColumn("t1", F.coalesce("_n", "song_end")).withColumn("hands", two_hands(F.col("pitches"), lim))
    verdict = F.when(F.col("hands.ok"), "playable").when((F.col("parts") > 1) & F.col("parts_ok"), "rolled").otherwise("impossible")
    return s.select("song_id", "t0", "t1", "pitches", "hands", verdict.alias("verdict"))


def strain(timeline: DataFrame, beat_ms: float, lim: Limits = Limits()) -> DataFrame:
    """Hand leaps and fast repetitions between successive instants."""
    s = scan(timeline, ["song_id"], ["t0"], {"_q": prev(F.struct("t0", "pitches", "hands", "verdict"))})
    dt = (F.col("t0") - F.col("_q.t0")) / beat_ms

    def centre(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)

    def leap(side: str) -> Column:
        a, b = F.col("_q.hands")[side], F.col("hands")[side]
        jump = F.abs(centre(b) - centre(a))
        both = (F.size(a) > 0) & (F.size(b) > 0) & F.col("_q.verdict").eqNullSafe(F.lit("playable")) & (F.col("verdict") == "playable")
        return F.when(both & (jump >= lim.leap) & (dt > 0) & (dt <= lim.leap_beats), F.struct(F.lit("leap_" + side).alias("kind"), jump.alias("amount")))

    hz = 1000.0 / (F.col("t0") - F.col("_q.t0"))
    again = F.size(F.array_intersect("pitches", "_q.pitches")) > 0
    rep = F.when(again & (dt > 0) & (hz > lim.repeat_hz), F.struct(F.lit("repetition").alias("kind"), hz.alias("amount")))
    return s.select("song_id", "t0", F.explode(F.array_compact(F.array(leap("low"), leap("high"), rep))).alias("x")).select("song_id", "t0", "x.kind", "x.amount")


def playability(timeline: DataFrame, lim: Limits = Limits()) -> DataFrame:
    """Pass rates by time and instant, causes, and time per simultaneity bucket."""
    d, n = F.col("t1") - F.col("t0"), F.size("pitches")
    ok = F.col("verdict").isin("playable", "rolled")

    def ms(cond):
        return F.coalesce(F.sum(F.when(cond, d)), F.lit(0.0))

    return timeline.groupBy("song_id").agg(
        F.sum(d).alias("sounding_ms"), F.count(F.lit(1)).alias("instants"), F.count_if(ok).alias("playable_instants"), ms(ok).alias("playable_ms"),
        F.count_if(F.col("verdict") == "rolled").alias("rolled"), ms(~ok & (n > lim.total)).alias("too_many_ms"), ms(~ok & (n <= lim.total)).alias("reach_ms"),
        F.sum(F.greatest(F.lit(0), n - lim.total) * d).alias("excess_ms"), F.max(n).alias("max_notes"),
        F.max(F.element_at("pitches", -1) - F.element_at("pitches", 1)).alias("max_span"),
        ms(n <= 5).alias("n1_5"), ms(n.between(6, 8)).alias("n6_8"), ms(n.between(9, 10)).alias("n9_10"), ms(n.between(11, 15)).alias("n11_15"), ms(n >= 16).alias("n16_up"))


def worst_instants(timeline: DataFrame, k: int = 8) -> DataFrame:
    """The k hardest impossible instants of each song by size, span, duration."""
    bad = timeline.filter("verdict = 'impossible'").withColumn("n", F.size("pitches")).withColumn(
        "span", F.element_at("pitches", -1) - F.element_at("pitches", 1)).withColumn("dur", F.col("t1") - F.col("t0"))
    w = Window.partitionBy("song_id").orderBy(F.desc("n"), F.desc("span"), F.desc("dur"), "t0")
    return bad.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("song_id", "t0", "n", "span", "dur", "rank")


def monophonic_share(events: DataFrame, keys=("song_id", "stem")) -> DataFrame:
    """1 - overlap / total over event spans with a running reach."""
    s = scan(events, list(keys), ["start_ms", "end_ms", "note_id"], {"_r": max_before("end_ms")})
    over = F.when(F.col("start_ms") < F.col("_r"), F.least("_r", "end_ms") - F.col("start_ms")).otherwise(0.0)
    g = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(over).alias("o"), F.sum(F.greatest(F.lit(0.0), F.col("end_ms") - F.col("start_ms"))).alias("t"))
    share = F.when((F.col("n") < 2) | (F.col("t") <= 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("o") / F.col("t")))
    return g.select(*keys, share.alias("share"), (share >= 0.70).alias("one_voice"))


# Split boundaries and costs of the two-hand split.
BOUNDARIES = tuple(range(52, 75, 2))


def split_costs(notes: DataFrame, beat_ms: float) -> DataFrame:
    """Cost of every boundary per (song, beat): reach, fingers and inner gaps of both hands."""
    w0 = F.floor(F.col("start_ms") / beat_ms)
    w1 = F.greatest(w0, F.ceil(F.col("end_ms") / beat_ms) - 1)
    g = notes.select("song_id", "pitch", F.explode(F.sequence(w0, w1)).alias("w")).groupBy("song_id", "w").agg(F.array_sort(F.collect_set("pitch")).alias("ps"))

    def hand(p):
        n = F.size(p)
        less = F.greatest(n - 1, F.lit(0))
        gaps = F.array_sort(F.zip_with(F.slice(p, 2, less), F.slice(p, 1, less), lambda a, b: a - b))
        inner = F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0)))
        wide = F.aggregate(inner, F.lit(0).cast("bigint"), lambda a, x: a + F.greatest(F.lit(0).cast("bigint"), x - 5))
        cost = F.greatest(F.lit(0), F.element_at(p, -1) - F.element_at(p, 1) - 14) + F.greatest(F.lit(0), n - 5) * 3.0 + wide * 1.5
        return F.when(n > 0, cost).otherwise(0.0)

    def at(b):
        return (hand(F.filter("ps", lambda x: x < b)) + hand(F.filter("ps", lambda x: x >= b))).cast("double")

    costs = [at(b) for b in BOUNDARIES]
    return g.select("song_id", "w", F.array(*costs).alias("cost"))


def hand_boundaries(costs: DataFrame, switch: float = 0.4, beats_per_chunk: int = 2000) -> DataFrame:
    """Cheapest boundary path through a song's beats.

    A chunk of beats is summarised by its 12 x 12 table of cheapest costs from
    entry to exit boundary; the tables of a song are chained (a few hundred
    numbers per chunk) and every chunk is then traced on its own.
    """
    k = len(BOUNDARIES)
    move = switch * np.abs(np.subtract.outer(BOUNDARIES, BOUNDARIES)).astype(float)
    c = costs.withColumn("chunk", F.floor(F.col("w") / beats_per_chunk))
    first = c.groupBy("song_id").agg(F.min("chunk").alias("_first"))
    c = c.join(first, "song_id").withColumn("opens", F.col("chunk") == F.col("_first")).drop("_first")

    def forward(cost: np.ndarray, opens: bool):
        """Cheapest cost to each boundary at each beat, per entry boundary paid for its own move.

        A song's first beat is entered free of cost, so the costs of its first chunk add up in the
        order of the beats and ties go to the lowest boundary before, whatever the path began with.
        """
        best = np.tile(cost[0], (k, 1)) if opens else move + cost[0][None, :]
        back = []
        for row in cost[1:]:
            step = best[:, :, None] + move[None, :, :]
            prev_b = step.argmin(axis=1)
            best = np.take_along_axis(step, prev_b[:, None, :], axis=1)[:, 0, :] + row[None, :]
            back.append(prev_b)
        return best, back

    def table(p: pd.DataFrame) -> pd.DataFrame:
        best, _ = forward(np.stack(p.sort_values("w")["cost"].to_numpy()), bool(p["opens"].iloc[0]))
        return pd.DataFrame({"song_id": [p["song_id"].iloc[0]], "chunk": [p["chunk"].iloc[0]], "best": [best.ravel().tolist()]})

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("chunk").reset_index(drop=True)
        total, came = np.zeros(k), []
        for b in p["best"]:
            m = np.asarray(b).reshape(k, k)
            step = total[:, None] + m
            came.append(step.argmin(axis=0))
            total = step.min(axis=0)
        exits = [int(total.argmin())]
        for c_ in reversed(came):
            exits.append(int(c_[exits[-1]]))
        exits = exits[::-1]
        return pd.DataFrame({"song_id": p["song_id"], "chunk": p["chunk"], "enter": exits[:-1], "leave": exits[1:]})

    def trace(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({"song_id": [], "w": [], "boundary": []})
        p = p.sort_values("w")
        _, back = forward(np.stack(p["cost"].to_numpy()), bool(p["opens"].iloc[0]))
        enter, at = int(e["enter"].iloc[0]), int(e["leave"].iloc[0])
        path = [at]
        for b in reversed(back):
            path.append(int(b[enter, path[-1]]))
        return pd.DataFrame({"song_id": p["song_id"].to_numpy(), "w": p["w"].to_numpy(), "boundary": [BOUNDARIES[i] for i in reversed(path)]})

    ks = costs.schema["song_id"].dataType
    t = c.groupBy("song_id", "chunk").applyInPandas(table, T.StructType([T.StructField("song_id", ks), T.StructField("chunk", T.LongType()),
        T.StructField("best", T.ArrayType(T.DoubleType()))]))
    e = t.groupBy("song_id").applyInPandas(chain, T.StructType([T.StructField("song_id", ks), T.StructField("chunk", T.LongType()),
        T.StructField("enter", T.IntegerType()), T.StructField("leave", T.IntegerType())]))
    return c.groupBy("song_id", "chunk").cogroup(e.groupBy("song_id", "chunk")).applyInPandas(
        trace, T.StructType([T.StructField("song_id", ks), T.StructField("w", T.LongType()), T.StructField("boundary", T.LongType())]))


def assign_hands(notes: DataFrame, beat_ms: float) -> DataFrame:
    """Treble or bass for every note by the boundary of the beat it starts in."""
    b = hand_boundaries(settle(split_costs(notes, beat_ms)))
    n = notes.withColumn("w", F.floor(F.col("start_ms") / beat_ms))
    return n.join(b, ["song_id", "w"], "left").withColumn("hand", F.when(F.col("pitch") >= F.col("boundary"), "treble").otherwise("bass"))
