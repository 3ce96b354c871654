"""Scoring of transcriptions against references and of patterns against nulls."""

from __future__ import annotations

from bisect import bisect_left
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.draws import uniform
from ..plans.carry import carry
from ..plans.grouping import anchor_groups
from ..plans.groups import Group, map_groups
from ..plans.joins import nearest
from ..plans.timeline import CHUNK, CHUNK_MS, exact_percentiles, halo, islands, nxt, prev, run_sum, scan, settle


def stage_survival(notes: DataFrame, reference: DataFrame, stages: Sequence[tuple[Column, Column]],
                   tolerance_ms: float = 750.0) -> DataFrame:
    """Share of reference notes still recoverable after each stage (one row per stage).

    Stage-tagged copies of notes and reference share one nearest join keyed by
    (stage, song, pitch), so all stages are scored in a single pass.
    """
    tagged = F.array_compact(F.array(*[
        F.when(keep, F.struct(F.lit(i).alias("stage"), t.alias("t"))) for i, (t, keep) in enumerate(stages)]))
    ours = notes.select("song_id", "pitch", F.explode(tagged).alias("s")).select("song_id", "pitch", "s.stage", "s.t")
    ref = reference.select("song_id", "pitch", "ref_ms", F.explode(F.array(*[F.lit(i) for i in range(len(stages))])).alias("stage"))
    hit = nearest(ref, ours, ["stage", "song_id", "pitch"], "ref_ms", "t", tolerance_ms, {"hit": F.col("t")})
    g = hit.groupBy("stage").agg(F.avg(F.col("hit").isNotNull().cast("double")).alias("share"))
    delta = F.col("share") - F.lag("share").over(Window.orderBy("stage"))
    return g.withColumn("delta", delta).withColumn("flagged", F.coalesce(F.col("delta") <= -0.05, F.lit(False)))


def _claim(t: list[float], side: list[int], cap: float, inclusive: bool) -> list[int]:
    """Which candidate each row takes (-1: none, or a candidate's row); rows in order of time, side and id."""
    places = [i for i, s in enumerate(side) if not s]
    times = [t[i] for i in places]
    free = [True] * len(places)
    taken = [-1] * len(t)
    for i, s in enumerate(side):
        if not s:
            continue
        best, least = -1, (cap, 0.0)
        for j in range(bisect_left(times, t[i] - cap - 1e-6), len(times)):
            gap = abs(times[j] - t[i])
            if times[j] - t[i] > cap:
                break
            # of equal distances the earlier candidate, of equal times the smaller id
            if free[j] and (gap <= cap if inclusive else gap < cap) and (best < 0 or (gap, times[j]) < least):
                best, least = j, (gap, times[j])
        if best >= 0:
            free[best] = False
            taken[i] = places[best]
    return taken


def claim_once(reference: DataFrame, candidates: DataFrame, cap: float, keys=("song_id", "pitch"), inclusive: bool = False, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Greedy one-to-one matching: in time order each reference note takes the nearest unused candidate.

    ``reference`` has keys, ref_id, t; ``candidates`` has keys, cand_id, t.  No claim
    reaches over a pause longer than the cap, so a sequence falls into pieces there that do not
    depend on each other.  Pieces inside a (keys, chunk) are worked where they lie, any number of
    keys in one pass; only those a chunk border cuts, seen by the copies of the rows
    within the cap behind it, are left to ``_claim_across``.  Adds cand_id and error (signed, candidate - reference).
    """
    keys = list(keys)
    both = reference.select(*keys, F.col("t").cast("double").alias("t"), F.lit(1).alias("side"), F.col("ref_id").cast("bigint").alias("id")).unionByName(
        candidates.select(*keys, F.col("t").cast("double").alias("t"), F.lit(0).alias("side"), F.col("cand_id").cast("bigint").alias("id")))
    seen = halo(both, "t", float(cap), float(cap), max(float(chunk_ms), float(cap)))

    def one(p: Group) -> dict:
        t, home = p["t"], p["_home"].astype(bool)
        piece = np.cumsum(np.concatenate([[False], np.diff(t) > cap]))
        cut = np.zeros(piece[-1] + 1, bool)
        cut[piece[~home]] = True
        whole = ~cut[piece]
        side, ids = p["side"].tolist(), p["id"].tolist()
        times = t.tolist()
        edges = np.flatnonzero(np.concatenate([[True], np.diff(piece) > 0])).tolist() + [len(t)]
        rows, taken = [], [-1] * len(times)
        for lo, hi in zip(edges, edges[1:]):
            if not whole[lo]:
                rows += [i for i in range(lo, hi) if home[i]]
                continue
            rows += [i for i in range(lo, hi) if side[i]]
            if 0 < sum(side[lo:hi]) < hi - lo:
                taken[lo:hi] = [lo + x if x >= 0 else -1 for x in _claim(times[lo:hi], side[lo:hi], cap, inclusive)]
        return {**p.key(keys, len(rows)), "t": [times[i] for i in rows], "side": [side[i] for i in rows], "id": [ids[i] for i in rows], "open": [not whole[i] for i in rows],
                "cand_id": [ids[taken[i]] if taken[i] >= 0 else None for i in rows], "error": [times[taken[i]] - times[i] if taken[i] >= 0 else None for i in rows]}

    schema = T.StructType([*[both.schema[k] for k in keys], T.StructField("t", T.DoubleType()), T.StructField("side", T.IntegerType()), T.StructField("id", T.LongType()),
                           T.StructField("open", T.BooleanType()), T.StructField("cand_id", T.LongType()), T.StructField("error", T.DoubleType())])
    made = settle(map_groups(seen, None, [*keys, CHUNK], ["t", "side", "id"], one, schema))
    done = made.filter("not open").select(*keys, F.col("id").alias("ref_id"), "cand_id", "error")
    rest = made.filter("open").select(*keys, "t", "side", "id")
    return done if rest.isEmpty() else done.unionByName(_claim_across(rest, cap, keys, inclusive, chunk_ms))


def _claim_across(both: DataFrame, cap: float, keys: list[str], inclusive: bool, chunk_ms: float) -> DataFrame:
    """``claim_once`` for sequences of any length (keys, t, side, id), carried over chunk borders.

    A reference is decided once every candidate within the cap behind it has been
    seen, so the state of the sequence is the unused candidates of the last two caps.
    """
    both = settle(both.withColumns({"_at": F.col("t") + F.col("side") * float(cap), "_row": F.col("id") * 2 + F.col("side")}))

    def run(p: Group, entry: list, end: float):
        open_ = [[~k, *s] for k, s in enumerate(entry)]
        labels = list(range(len(p)))
        for a, (at, t, side, i) in enumerate(zip(p["_at"].tolist(), p["t"].tolist(), p["side"].tolist(), p["id"].tolist())):
            open_ = [c for c in open_ if at - c[1] <= 2 * cap + 1e-6]
            if not side:
                open_.append([a, t, i])
                continue
            near = [c for c in open_ if (abs(c[1] - t) <= cap if inclusive else abs(c[1] - t) < cap)]
            if near:
                best = min(near, key=lambda c: (abs(c[1] - t), c[1], c[2]))
                labels[a] = best[0]
                open_.remove(best)
        return labels, [(c[0], c[1:]) for c in open_ if c[1] + 2 * cap + 1e-6 >= end]

    made = carry(both, keys, ["_at", "side", "t", "id"], [], run, "_row", "_with", chunk_ms)
    cand = F.when(F.col("_with") != F.col("_row"), F.floor(F.col("_with") / 2))
    m = made.filter("side = 1").select(*keys, F.col("id").alias("ref_id"), cand.alias("cand_id"), F.col("t").alias("_t"))
    at = both.filter("side = 0").select(*keys, F.col("id").alias("cand_id"), F.col("t").alias("_c"))
    return m.join(at, [*keys, "cand_id"], "left").select(*keys, "ref_id", "cand_id", (F.col("_c") - F.col("_t")).alias("error"))


def soft_recall(matched: DataFrame, sigma: float) -> DataFrame:
    """Mean of exp(-d^2 / 2 sigma^2) over all reference notes, unmatched counting 0."""
    k = F.exp(-(F.col("error") * F.col("error")) / (2.0 * sigma * sigma))
    return matched.groupBy("song_id").agg((F.sum(F.coalesce(k, F.lit(0.0))) / F.count(F.lit(1))).alias("soft_recall"),
                                          F.count(F.lit(1)).alias("reference_notes"))


def timing_moments(matched: DataFrame) -> DataFrame:
    """Bias, spread and RMSE of the signed errors; the ratio is infinite when nothing spreads."""
    g = matched.filter("error is not null").groupBy("song_id").agg(
        F.avg("error").alias("delta"), F.stddev_pop("error").alias("sigma"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
    return g.withColumn("ratio", F.when(F.col("sigma") > 0, F.abs("delta") / F.col("sigma")).otherwise(float("inf")))


def scores(hits: DataFrame, ours: DataFrame, reference: DataFrame) -> DataFrame:
    """Precision, recall and F1 per song from matched pairs and the two note counts."""
    h = hits.groupBy("song_id").agg(F.count("cand_id").alias("hits"))
    o = ours.groupBy("song_id").agg(F.count(F.lit(1)).alias("ours"))
    r = reference.groupBy("song_id").agg(F.count(F.lit(1)).alias("reference"))
    j = r.join(o, "song_id", "full_outer").join(h, "song_id", "left").fillna(0, ["hits", "ours", "reference"])
    p = F.col("hits") / F.greatest(F.col("ours"), F.lit(1))
    q = F.col("hits") / F.greatest(F.col("reference"), F.lit(1))
    return j.withColumns({"precision": p, "recall": q}).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))


def chord_events(notes: DataFrame, window_ms: float, keys=("song_id",)) -> DataFrame:
    """Notes struck together as one event with its sorted pitches (a chord is short by nature)."""
    g = anchor_groups(notes.select(*keys, "start_ms", "note_id", "pitch", "end_ms"), list(keys), "start_ms", "note_id", window_ms)
    return g.groupBy(*keys, F.col("group_ms").alias("t_ms")).agg(F.array_sort(F.collect_list("pitch")).alias("pitches"), F.max("end_ms").alias("end_ms"))


def chord_stats(events: DataFrame, keys=("song_id",)) -> DataFrame:
    """Chord share, sizes, spread and the share of parallel moves between equal-sized chords."""
    e = scan(events, list(keys), ["t_ms"], {"_n": nxt("pitches")})
    n = F.size("pitches")
    moves = F.array_distinct(F.zip_with("pitches", "_n", lambda a, b: b - a))
    comparable = (n >= 3) & (n == F.size("_n"))
    parallel = comparable & (F.size(moves) == 1) & (moves[0] != 0)
    multi = n >= 2
    spread = F.element_at("pitches", -1) - F.get("pitches", F.lit(0))
    return e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.sum(n).alias("noteheads"), F.avg(multi.cast("double")).alias("chord_share"),
        F.coalesce(F.avg(F.when(multi, n)), F.lit(0.0)).alias("mean_size"), F.max(n).alias("max_size"),
        F.coalesce(F.avg(F.when(multi, spread)), F.lit(0.0)).alias("spread"),
        F.count_if(comparable).alias("comparable"), (F.count_if(parallel) / F.greatest(F.count_if(comparable), F.lit(1))).alias("parallel_share"))


def phrase_stats(events: DataFrame, factor: float = 3.0) -> DataFrame:
    """Phrases end where the gap exceeds three median gaps."""
    e = settle(scan(events.select("song_id", "t_ms"), ["song_id"], ["t_ms"], {"_n": nxt("t_ms")}).withColumn("ioi", F.col("_n") - F.col("t_ms")))
    med = exact_percentiles(e, ["song_id"], "ioi", {"median_ioi": 0.5}, 10.0).filter("n >= 3")
    j = e.join(med, "song_id")
    g = j.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ioi") > factor * F.col("median_ioi")).alias("breaks"),
                                 F.first("median_ioi").alias("median_ioi"), F.max("ioi").alias("longest"))
    return g.select("song_id", (F.col("breaks") + 1).alias("phrases"), (F.col("n") / (F.col("breaks") + 1)).alias("mean_len"), "median_ioi",
                    F.when(F.col("median_ioi") > 0, F.col("longest") / F.col("median_ioi")).otherwise(0.0).alias("longest_gap_x"))


def ratio_profile(events: DataFrame, keys=("song_id",)) -> DataFrame:
    """Share of successive interval ratios per 1/4-octave bin of log2 in [-3, 3]."""
    keys = list(keys)
    e = scan(events.select(*keys, "t_ms"), keys, ["t_ms"], {"_n": nxt("t_ms"), "_m": nxt("t_ms", 2)})
    r = F.log2((F.col("_m") - F.col("_n")) / (F.col("_n") - F.col("t_ms")))
    e = e.filter((F.col("_n") - F.col("t_ms") > 1e-6) & (F.col("_m") - F.col("_n") > 1e-6)).withColumn("r", r).filter(F.abs("r") <= 3.0)
    b = e.groupBy(*keys, F.least(F.lit(23), F.floor((F.col("r") + 3.0) * 4.0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


# Ratio classes of successive intervals, as log2.
RATIO_CLASSES = (("1:4", 0.25), ("1:3", 1 / 3), ("1:2", 0.5), ("2:3", 2 / 3), ("3:4", 0.75), ("1:1", 1.0), ("4:3", 4 / 3),
                 ("3:2", 1.5), ("2:1", 2.0), ("3:1", 3.0), ("4:1", 4.0))


def named_ratios(events: DataFrame, tolerance: float = 0.18) -> DataFrame:
    """Count of each named ratio of successive intervals; far ones are ``other``."""
    e = scan(events.select("song_id", "t_ms"), ["song_id"], ["t_ms"], {"_n": nxt("t_ms"), "_m": nxt("t_ms", 2)})
    a, b = F.col("_n") - F.col("t_ms"), F.col("_m") - F.col("_n")
    r = F.log2(b / a)
    best = F.array_min(F.array(*[F.struct(F.abs(r - F.log2(F.lit(v))).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, v) in enumerate(RATIO_CLASSES)]))
    e = e.filter((a > 1e-6) & (b > 1e-6)).withColumn("_b", best)
    return e.groupBy("song_id", F.when(F.col("_b.d") <= tolerance, F.col("_b.name")).otherwise("other").alias("ratio")).agg(F.count(F.lit(1)).alias("n"))


def pitch_profile_correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson r of two 12-bin pitch-class counts per song (absent bins count as zero)."""
    def bins(df, name):
        return df.groupBy("song_id").agg(*[F.count_if(F.pmod("pitch", F.lit(12)) == i).cast("double").alias(f"{name}{i}") for i in range(12)])

    j = bins(a, "a").join(bins(b, "b"), "song_id")
    ax, bx = [F.col(f"a{i}") for i in range(12)], [F.col(f"b{i}") for i in range(12)]
    ma, mb = sum(ax[1:], ax[0]) / 12.0, sum(bx[1:], bx[0]) / 12.0
    cov = sum([(x - ma) * (y - mb) for x, y in zip(ax[1:], bx[1:])], (ax[0] - ma) * (bx[0] - mb))
    va = sum([(x - ma) * (x - ma) for x in ax[1:]], (ax[0] - ma) * (ax[0] - ma))
    vb = sum([(x - mb) * (x - mb) for x in bx[1:]], (bx[0] - mb) * (bx[0] - mb))
    return j.select("song_id", F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("r"))


def grid_error(notes: DataFrame, beat_ms: float) -> DataFrame:
    sub = F.col("start_ms") / (beat_ms / 4.0)
    return notes.groupBy("song_id").agg(F.avg(F.abs(sub - F.bround(sub))).alias("grid_error"), (F.sum(F.col("end_ms") - F.col("start_ms"))).alias("sounding_ms"))


def pareto_front(points: DataFrame, axes: Sequence[str], deals: int = 64) -> DataFrame:
    """Points no other point of the song beats on every axis (smaller is better); equal points stay together.

    A skyline in two phases: a song's points are dealt to ``deals`` shares and each keeps its own front,
    then the fronts of a song meet once.  A null beats nothing and is not beaten.
    """
    axes, names = list(axes), points.columns

    def front(p: Group) -> dict:
        x = np.stack([p[a].astype(float) for a in axes], axis=1)
        order = np.lexsort(x.T[::-1])
        kept: list[int] = []
        held = np.zeros((0, len(axes)))
        for at in order:  # nothing later in this order beats an earlier point
            if not ((held <= x[at]).all(axis=1) & (held < x[at]).any(axis=1)).any():
                kept.append(int(at))
                held = np.concatenate([held, x[at][None]])
        return {c: p[c][kept].tolist() for c in names}

    schema = points.schema
    dealt = points.withColumn(CHUNK, F.pmod(F.xxhash64(*axes), F.lit(deals)))
    local = map_groups(dealt, None, ["song_id", CHUNK], axes, front, schema)
    return map_groups(local, None, ["song_id"], axes, front, schema)


def auc(samples: DataFrame, keys: Sequence[str], score: str, positive: str, width: float) -> DataFrame:
    """Rank-sum AUC with average ranks on ties, from counts per distinct score.

    Scores are pre-aggregated and ranked by a two-level running count, so the
    samples themselves are never sorted in one task.
    """
    keys = list(keys)
    v = samples.groupBy(*keys, F.col(score).alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(positive)).alias("_p"))
    v = scan(v, keys, ["_x"], {"_cum": run_sum("_n")}, width)
    mean_rank = F.col("_cum") - (F.col("_n") - 1) / 2.0
    g = v.groupBy(*keys).agg(F.sum(F.col("_p") * mean_rank).alias("rank_sum"), F.sum("_p").alias("pos"), F.sum("_n").alias("all"))
    neg = F.col("all") - F.col("pos")
    return g.select(*keys, F.when((F.col("pos") > 0) & (neg > 0), (F.col("rank_sum") - F.col("pos") * (F.col("pos") + 1) / 2.0) / (F.col("pos") * neg)).alias("auc"))


def pairwise_scores(labels: DataFrame) -> DataFrame:
    """Same-voice pair precision, recall and F1 from contingency counts (no pair is formed).

    ``labels`` has song_id, true_voice, pred_voice.
    """
    c = labels.groupBy("song_id", "true_voice", "pred_voice").agg(F.count(F.lit(1)).alias("n"))

    def pairs(by):
        return c.groupBy("song_id", *by).agg(F.sum("n").alias("n")).groupBy("song_id").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"))

    j = pairs(["true_voice", "pred_voice"]).withColumnRenamed("p", "tp").join(
        pairs(["true_voice"]).withColumnRenamed("p", "t"), "song_id").join(pairs(["pred_voice"]).withColumnRenamed("p", "m"), "song_id")
    prec = F.when(F.col("m") > 0, F.col("tp") / F.col("m")).otherwise(0.0)
    rec = F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0)
    j = j.withColumns({"precision": prec, "recall": rec})
    return j.select("song_id", "precision", "recall", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0).alias("f1"))


def transition_accuracy(labels: DataFrame) -> DataFrame:
    """Share of a true voice's successive notes that stay in one predicted voice."""
    s = scan(labels, ["song_id", "true_voice"], ["start_ms", "note_id"], {"_p": prev("pred_voice")})
    return s.filter("_p is not null").groupBy("song_id").agg(F.avg((F.col("pred_voice") == F.col("_p")).cast("double")).alias("accuracy"))


def distortion(source: DataFrame, candidates: DataFrame, cap_ms: float = 250.0) -> DataFrame:
    """What a page loses against its source: onset shift, duration error, lost overlaps, order flips, dropped notes."""
    ref = source.select("song_id", "pitch", F.col("note_id").alias("ref_id"), F.col("start_ms").alias("t"))
    can = candidates.select("song_id", "pitch", F.col("note_id").alias("cand_id"), F.col("start_ms").alias("t"))
    m = settle(claim_once(ref, can, cap_ms, inclusive=True))
    total = m.groupBy("song_id").agg(F.avg(F.col("cand_id").isNull().cast("double")).alias("dropped"))
    j = m.filter("cand_id is not null").drop("pitch", "error").join(
        source.select("song_id", F.col("note_id").alias("ref_id"), "start_ms", "end_ms", "pitch"), ["song_id", "ref_id"]).join(
        candidates.select("song_id", F.col("note_id").alias("cand_id"), F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1")), ["song_id", "cand_id"])
    nb = F.struct("start_ms", "c0")
    j = scan(settle(j), ["song_id"], ["start_ms", "end_ms", "pitch", "ref_id"], {f"_n{k}": nxt(nb, k) for k in range(1, 12)})
    kept, lost, open_ = F.lit(0), F.lit(0), F.lit(True)
    for k in range(1, 12):
        n = F.col(f"_n{k}")
        open_ = open_ & F.coalesce(n["start_ms"] < F.col("end_ms"), F.lit(False))
        kept = kept + (open_ & (n["c0"] < F.col("c1"))).cast("int")
        lost = lost + (open_ & (n["c0"] >= F.col("c1"))).cast("int")
    n1 = F.col("_n1")
    moved = F.coalesce(n1["start_ms"] != F.col("start_ms"), F.lit(False))
    flip = moved & ((F.col("c0") - n1["c0"]) * (F.col("start_ms") - n1["start_ms"]) < 0)
    dur = F.col("end_ms") - F.col("start_ms")
    g = j.groupBy("song_id").agg(
        F.avg(F.abs(F.col("c0") - F.col("start_ms"))).alias("onset"),
        F.avg(F.abs(F.col("c1") - F.col("c0") - dur) / F.greatest(dur, F.lit(1.0))).alias("duration"),
        F.sum(kept).alias("kept"), F.sum(lost).alias("lost"), F.count_if(flip).alias("flips"), F.count_if(moved).alias("moves"))
    g = g.select("song_id", "onset", "duration", (F.col("lost") / F.greatest(F.col("kept") + F.col("lost"), F.lit(1))).alias("overlap"),
                 (F.col("flips") / F.greatest(F.col("moves"), F.lit(1))).alias("ordering"))
    return total.join(g, "song_id", "left")


def label_consistency(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Share of a label's instances that show its commonest value (ties to the smaller value)."""
    c = rows.groupBy("song_id", label, value).agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("song_id", label).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("m"), F.sum("n").alias("total"))
    return g.select("song_id", label, F.col(f"m.{value}").alias(value), (F.col("m.n") / F.col("total")).alias("share"))


def injected_bias(reference: DataFrame, offsets_ms: Sequence[float], cap_ms: float) -> DataFrame:
    """Recovered mean error when the reference is shifted by known offsets, and the slope through them."""
    off = F.array(*[F.lit(float(o)) for o in offsets_ms])
    c = reference.withColumn("offset_ms", F.explode(off))
    keys = ["song_id", "pitch", "offset_ms"]
    m = claim_once(c.select(*keys, F.col("note_id").alias("ref_id"), F.col("start_ms").alias("t")),
                   c.select(*keys, F.col("note_id").alias("cand_id"), (F.col("start_ms") + F.col("offset_ms")).alias("t")), cap_ms, keys)
    per = m.groupBy("offset_ms").agg(F.avg("error").alias("recovered"))
    slope = per.agg(F.regr_slope("recovered", "offset_ms").alias("slope"))
    return per.crossJoin(F.broadcast(slope))


def degrade(notes: DataFrame, seed: int = 0, onset_sd: float = 60.0, duration_sd: float = 1.39, floor: float = 0.15) -> DataFrame:
    """Controlled noise on onsets and durations; a note's draw depends only on its id and the seed."""
    def normal(salt: int) -> Column:
        number = F.col("note_id").cast("bigint")
        return F.sqrt(-2.0 * F.log(uniform(number, salt, seed))) * F.cos(2.0 * np.pi * uniform(number, salt + 1, seed))

    start = F.greatest(F.lit(0.0), F.col("start_ms") + onset_sd * normal(1))
    dur = (F.col("end_ms") - F.col("start_ms")) * F.greatest(F.lit(floor), 1.0 + duration_sd * normal(3))
    return notes.withColumn("_s", start).withColumn("_d", dur).withColumn("start_ms", F.col("_s")).withColumn(
        "end_ms", F.col("_s") + F.col("_d")).drop("_s", "_d")
