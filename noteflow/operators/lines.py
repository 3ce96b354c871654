"""Voice lines and melodic threads (greedy assignment with a small open state)."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.carry import carry
from ..plans.grouping import anchor_groups
from ..plans.groups import Group
from ..plans.timeline import CHUNK_MS, settle
from .filters import family_ladder


def assign_min_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of rows to columns (shortest augmenting paths)."""
    if cost.shape[0] > cost.shape[1]:
        return [(i, j) for j, i in assign_min_cost(cost.T)]
    n, m = cost.shape
    if n == 1:
        return [(0, int(cost[0].argmin()))]
    owner = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for i in range(n):
        dist, seen = np.full(m, np.inf), np.zeros(m, dtype=bool)
        came = np.full(m, -1)
        row, col, base = i, -1, 0.0
        while True:
            alt = base + cost[row] - u[row] - v
            better = ~seen & (alt < dist)
            dist[better], came[better] = alt[better], col
            col = int(np.argmin(np.where(seen, np.inf, dist)))
            base = dist[col]
            seen[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        u[i] += base
        for j in np.flatnonzero(seen):
            if owner[j] >= 0:
                u[owner[j]] += base - dist[j]
            v[j] -= base - dist[j]
        while came[col] >= 0:
            owner[col] = owner[came[col]]
            col = came[col]
        owner[col] = i
    return [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]


NO_LINE = 1e6


def _cheapest(options: list[list[tuple[float, int]]], lines: int) -> dict[int, int]:
    """Note -> line (from 0) at least total cost; equal totals go to no line, then to the earlier lines, first note first.

    A note never needs more than its ``n`` cheapest lines, one of which the other notes leave free,
    so up to four notes are tried in all ways.  Larger chords take any cheapest assignment.
    """
    n = len(options)
    if n > 4:
        cost = np.full((n, lines), NO_LINE)
        for a, own in enumerate(options):
            for c, b in own:
                cost[a, b - 1] = c
        return {a: b for a, b in assign_min_cost(cost) if cost[a, b] < NO_LINE} if cost.size else {}
    best = None
    for way in itertools.product(*[[(NO_LINE, 0), *sorted(own)[:n]] for own in options]):
        used = [b for _, b in way if b]
        if len(set(used)) < len(used):
            continue
        total = way[0][0]
        for c, _ in way[1:]:
            total += c
        key = (total, [b for _, b in way])
        if best is None or key < best:
            best = key
    return {a: b - 1 for a, b in enumerate(best[1]) if b}


def _voice_run(p: Group, entry: list, end: float):
    """Chord groups (25 ms) joined to open lines at least total cost; state = (pitch, end, start) per line."""
    lines = [[~k, *s] for k, s in enumerate(entry)]
    t, e, pitch, group = (p[c].tolist() for c in ("start_ms", "end_ms", "pitch", "group_ms"))
    labels = [0] * len(p)
    i = 0
    while i < len(p):
        j = i
        while j < len(p) and group[j] == group[i]:
            j += 1
        lines = [ln for ln in lines if t[i] - ln[2] <= 300.0]
        options = []  # per note (cost, line), lines from 1
        for a in range(i, j):
            own = []
            for b, ln in enumerate(lines):
                over, jump = ln[2] - t[a], abs(pitch[a] - ln[1])
                if over > 30.0 or jump > 12 or -over > 300.0:
                    continue
                c = jump + (over / 30.0 if over > 0 else -over / 50.0)
                if c <= 12.0:
                    own.append((c, b + 1))
            options.append(own)
        taken = _cheapest(options, len(lines))
        for a in range(i, j):
            b = taken.get(a - i)
            if b is None:
                lines.append([a, float(pitch[a]), float(e[a])])
                labels[a] = a
            else:
                labels[a] = lines[b][0]
                lines[b] = [lines[b][0], float(pitch[a]), float(e[a])]
        i = j
    return labels, [(ln[0], ln[1:]) for ln in lines if ln[2] + 300.0 >= end]


def voice_lines(notes: DataFrame, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Monophonic lines per (song, stem): adds line_id, the id of the line's first note."""
    # chunks are cut on group anchors, so no chord group straddles two of them
    g = settle(anchor_groups(notes, ["song_id", "stem"], "start_ms", "note_id", 25.0, chunk_ms=chunk_ms))
    return carry(g, ["song_id", "stem"], ["group_ms", "start_ms", "pitch", "note_id"], ["end_ms"], _voice_run, "note_id",
                 chunk_ms=chunk_ms).drop("group_ms")


def _thread_run(beat_ms: float):
    limit = 2.0 * max(beat_ms, 1.0)

    def run(p: Group, entry: list, end: float):
        threads = [[~k, *s] for k, s in enumerate(entry)]
        labels = []
        for a, (t, pitch) in enumerate(zip(p["start_ms"].tolist(), p["pitch"].tolist())):
            threads = [th for th in threads if t - th[1] <= limit]
            best, least = None, float("inf")
            for th in threads:
                gap, jump = t - th[1], abs(pitch - th[2])
                if gap <= 45.0 or jump > 12:
                    continue
                c = jump + 2.0 * (gap / limit) * 12
                if c < least:
                    best, least = th, c
            if best is None:
                threads.append([a, float(t), float(pitch)])
                labels.append(a)
            else:
                best[1], best[2] = float(t), float(pitch)
                labels.append(best[0])
        return labels, [(th[0], th[1:]) for th in threads if th[1] + limit >= end]

    return run


def melodic_threads(notes: DataFrame, beat_ms: float, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Greedy threads of least jump and gap per (song, stem): adds line_id."""
    return carry(notes, ["song_id", "stem"], ["start_ms", "pitch", "note_id"], [], _thread_run(beat_ms), "note_id", chunk_ms=chunk_ms)


def line_stats(lined: DataFrame) -> DataFrame:
    g = lined.groupBy("song_id", "stem", "line_id").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("song_id", "stem").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("notes"),
                                            F.avg("n").alias("mean_len"), F.max("n").alias("max_len"),
                                            F.count_if(F.col("n") >= 4).alias("usable"))


FEATURES = ("even_odd", "slope", "vibrato", "attack", "brightness")


def pool_fingerprints(notes: DataFrame, keys=("song_id", "stem", "line_id")) -> DataFrame:
    """Median timbre features of each line; inharmonicity from the lowest third by f0.

    A line is a phrase (silence ends it), so medians run over a bounded group;
    NaN features are masked to null.
    """
    keys = list(keys)
    n = notes.withColumns({f: F.when(~F.isnan(f), F.col(f)) for f in (*FEATURES, "b")})
    w = Window.partitionBy(*keys)
    n = n.withColumn("_r", F.row_number().over(w.orderBy("f0_hz", "note_id"))).withColumn("_n", F.count(F.lit(1)).over(w))
    low = F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    return n.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_notes"), *[F.percentile(f, F.lit(0.5)).alias(f) for f in FEATURES],
        F.percentile(F.when(low, F.col("b")), F.lit(0.5)).alias("b"))


def line_identity(pooled: DataFrame, votes: DataFrame, families: dict[str, str]) -> DataFrame:
    """One instrument family per line: unanimous stem votes, then the stem's own family, then the ladder.

    ``votes`` holds (note's line keys, family, confidence, contested).
    """
    keys = ["song_id", "stem", "line_id"]
    v = votes.groupBy(*keys).agg(F.min("family").alias("v_lo"), F.max("family").alias("v_hi"),
                                 F.bool_or("contested").alias("v_con"), F.percentile("confidence", F.lit(0.5)).alias("v_conf"))
    lad = family_ladder(F.col("n_notes"), F.col("b"), F.col("slope"), F.col("vibrato"), F.col("attack"), F.col("even_odd"), F.col("brightness"))
    known = F
    for stem, fam in families.items():
        known = known.when(F.col("stem") == stem, fam)
    j = pooled.join(v, keys, "left").withColumn("_l", lad).withColumn("_k", known)
    unanimous = (F.col("v_lo") == F.col("v_hi")) & ~F.col("v_con")
    vocals = F.col("stem") == "vocals"
    own = F.col("_k").isNotNull() & ~vocals
    return j.select(
        *keys,
        F.when(unanimous, F.col("v_lo")).when(own | vocals, F.col("_k")).otherwise(F.col("_l.family")).alias("family"),
        F.when(unanimous, F.col("v_conf")).when(own | vocals, 1.0).otherwise(F.col("_l.confidence")).alias("confidence"),
        F.when(unanimous | own, False).when(vocals, F.col("_l.family") != "mid_body").otherwise(F.col("_l.contested")).alias("contested"))
