"""Key estimation from notes: chroma, profile correlation, stability."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.music import MAJOR_KEYS, MINOR_KEYS, NOTE_PITCH_CLASS, in_scale, is_minor, tonic_pc

# Probe-tone profiles of a major and a minor key on pitch class 0.
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def spans(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return notes.groupBy(*keys).agg(
        F.min("start_ms").alias("span_start"), F.max("end_ms").alias("span_end"), F.count(F.lit(1)).alias("n_notes"))


def _framed(notes: DataFrame, keys: Sequence[str], n_frames: int) -> DataFrame:
    """Notes with their first and last chroma frame and the weight per frame."""
    j = notes.join(spans(notes, keys), list(keys))
    span = F.greatest(F.lit(1.0), F.col("span_end") - F.col("span_start"))
    end = F.greatest(F.col("start_ms") + 1.0, F.col("end_ms"))
    top = F.lit(n_frames - 1).cast("bigint")

    def frame(t):
        return ((t - F.col("span_start")) / span * (n_frames - 1)).cast("bigint")

    f0 = F.least(top, F.greatest(F.lit(0).cast("bigint"), frame(F.col("start_ms"))))
    j = j.withColumn("f0", f0).withColumn("f1", F.least(top, F.greatest(F.col("f0"), frame(end))))
    return j.select(*keys, F.pmod("pitch", F.lit(12)).alias("pc"), "f0", "f1",
                    ((end - F.col("start_ms")) / 1000.0 / (F.col("f1") - F.col("f0") + 1)).alias("per"))


def chroma(notes: DataFrame, keys: Sequence[str] = ("song_id",), n_frames: int = 200) -> DataFrame:
    """Sounding seconds per (frame, pitch class) over ``n_frames`` frames of the key's span."""
    j = _framed(notes.filter("stem <> 'drums'"), keys, n_frames)
    return j.select(*keys, "pc", "per", F.explode(F.sequence("f0", "f1")).alias("frame")).groupBy(
        *keys, "frame", "pc").agg(F.sum("per").alias("weight"))


def mean_chroma(notes: DataFrame, keys: Sequence[str] = ("song_id",), n_frames: int = 200) -> DataFrame:
    """Edge-weighted mean chroma per pitch class.

    The first and last 15 % of frames weigh 2.  A note adds the same amount to
    every frame it covers, so its total is its amount times a count of plain and
    edge frames: nothing is exploded.
    """
    j = _framed(notes.filter("stem <> 'drums'"), keys, n_frames)
    edge = max(1, int(n_frames * 0.15)) if n_frames >= 10 else 0
    zero = F.lit(0).cast("bigint")
    head = F.greatest(zero, F.least(F.col("f1"), F.lit(edge - 1)) - F.col("f0") + 1)
    tail = F.greatest(zero, F.col("f1") - F.greatest(F.col("f0"), F.lit(n_frames - edge)) + 1)
    frames = F.col("f1") - F.col("f0") + 1 + (head + tail if edge else zero)
    total = float(n_frames + 2 * edge)
    return j.groupBy(*keys, "pc").agg((F.sum(F.col("per") * frames) / total).alias("w"))


def detect_key(pc_weights: DataFrame, keys: Sequence[str] = ("song_id",)) -> DataFrame:
    """Best of 24 rotated profiles by Pearson correlation, relative pairs settled by the raised seventh.

    ``pc_weights`` is long (keys, pc, w).  Each key needs five sums per
    candidate, so a group is reduced to twelve numbers before the 24 scores are
    taken; absent pitch classes count as zero.
    """
    keys = list(keys)
    wide = pc_weights.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col("pc") == i, F.col("w"))), F.lit(0.0)).alias(f"_p{i}") for i in range(12)])
    vec = F.array(*[F.col(f"_p{i}") for i in range(12)])
    total = sum((F.col(f"_p{i}") for i in range(1, 12)), F.col("_p0"))
    wide = wide.select(*keys, F.when(total > 0, F.transform(vec, lambda x: x / total)).otherwise(vec).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / 12.0
    wide = wide.withColumn("_c", F.transform("v", lambda x: x - mean))
    wide = wide.withColumn("_ss", F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x))

    # one constant row per candidate, scored by one loop: the expression does not grow with their number
    table = []
    for minor, names in ((0, MAJOR_KEYS), (1, MINOR_KEYS)):
        profile = MINOR_PROFILE if minor else MAJOR_PROFILE
        m = sum(profile) / 12.0
        for i, name in enumerate(names):
            root = NOTE_PITCH_CLASS[name.rstrip("m")]
            dev = [profile[(j - root) % 12] - m for j in range(12)]
            table.append(F.struct(F.array(*map(F.lit, dev)).alias("dev"), F.lit(sum(x * x for x in dev)).alias("norm"), F.lit(-(12 * minor + i)).alias("rank"),
                                  F.lit(name).alias("key"), F.lit(i).alias("idx"), F.lit(minor).alias("minor"), F.lit(root).alias("root")))

    def scored(c):
        num = F.aggregate(F.zip_with("_c", c["dev"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        r = F.when(F.col("_ss") > 0, num / F.sqrt(F.col("_ss") * c["norm"])).otherwise(0.0)
        return F.struct(r.alias("r"), *[c[x].alias(x) for x in ("rank", "key", "idx", "minor", "root")])

    wide = wide.withColumn("_all", F.transform(F.array(*table), scored))
    # compared on 12 places: ties go to list order whatever the summation order
    ranked = F.transform("_all", lambda x: F.struct(F.round(x["r"], 12).alias("r12"), x["rank"].alias("rank"), x["r"].alias("r"),
                                                    *[x[c].alias(c) for c in ("key", "idx", "minor", "root")]))
    wide = wide.withColumn("_all", ranked)
    wide = wide.withColumn("_best", F.array_max("_all"))
    other = F.filter("_all", lambda x: (x["idx"] == F.col("_best.idx")) & (x["minor"] != F.col("_best.minor")))[0]
    wide = wide.withColumn("_rel", other)
    mroot = F.when(F.col("_best.minor") == 1, F.col("_best.root")).otherwise(F.col("_rel.root"))
    raised, natural = F.get("v", F.pmod(mroot + 11, F.lit(12)).cast("int")), F.get("v", F.pmod(mroot + 10, F.lit(12)).cast("int"))
    wants_minor = (raised > natural * 1.15).cast("int")
    close = F.abs(F.col("_rel.r") - F.col("_best.r")) < 0.05
    flip = close & (wants_minor != F.col("_best.minor"))
    pick = F.when(flip, F.col("_rel")).otherwise(F.col("_best"))
    return wide.select(*keys, pick["key"].alias("key"), pick["r"].alias("correlation"),
                       F.greatest(F.lit(0.0), F.least(F.lit(1.0), (pick["r"] + 0.5) / 1.5)).alias("confidence"))


def key_of_songs(notes: DataFrame) -> DataFrame:
    return detect_key(mean_chroma(notes))


def same_center(a, b):
    """Keys share a tonal centre: equal, or a relative major/minor pair."""
    pa, pb, ma, mb = tonic_pc(a), tonic_pc(b), is_minor(a), is_minor(b)
    rel = F.when(ma, F.pmod(pa + 3, F.lit(12))).otherwise(pa) == F.when(mb, F.pmod(pb + 3, F.lit(12))).otherwise(pb)
    return rel


def key_windows(notes: DataFrame, windows: int = 12) -> DataFrame:
    """Key per overlapping window (width 2 hops) of every song, windows under 12 notes left out."""
    pitched = notes.filter("stem <> 'drums'")
    j = pitched.join(spans(pitched, ["song_id"]), "song_id")
    span = F.greatest(F.lit(1.0), F.col("span_end") - F.col("span_start"))
    hop = span / float(windows)
    i = F.floor((F.col("start_ms") - F.col("span_start")) / hop)
    around = F.filter(F.array(i - 2, i - 1, i, i + 1), lambda x: (x >= 0) & (x < windows))
    w0 = F.col("span_start") + F.col("win") * hop
    w1 = F.least(F.col("span_end"), w0 + span / float(windows) * 2.0)
    n = j.withColumn("win", F.explode(around)).filter((F.col("start_ms") >= w0) & (F.col("start_ms") < w1))
    n = n.drop("span_start", "span_end", "n_notes")
    big = n.groupBy("song_id", "win").agg(F.count(F.lit(1)).alias("held")).filter("held >= 12")
    kept = detect_key(mean_chroma(n, ["song_id", "win"]), ["song_id", "win"])
    return kept.join(big, ["song_id", "win"])


def key_stability(notes: DataFrame, windows: int = 12, min_agreement: float = 0.70, margin: float = 0.04) -> DataFrame:
    """Does one key hold for the song, and which key should be reported.

    All per-song decisions run on a song's histogram and at most ``windows``
    window keys, never on its notes.
    """
    pitched = notes.filter("stem <> 'drums'")
    whole = key_of_songs(pitched).select("song_id", F.col("key").alias("global_key"), F.col("confidence").alias("raw"))
    counts = pitched.groupBy("song_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.pmod("pitch", F.lit(12)) == i).alias(f"_h{i}") for i in range(12)])
    per = key_windows(pitched, windows).groupBy("song_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("win", "key"))), lambda x: x["key"]).alias("win_keys"))
    j = whole.join(counts, "song_id").join(per, "song_id", "left")
    j = j.withColumn("win_keys", F.when(F.col("n") >= 24, F.coalesce("win_keys", F.array().cast("array<string>")))
                     .otherwise(F.array().cast("array<string>")))
    m = F.size("win_keys")

    def agree(key):
        return F.size(F.filter("win_keys", lambda k: same_center(k, key)))

    j = j.withColumn("tested", m > 0).withColumn("agreement", F.when(m > 0, agree(F.col("global_key")) / m).otherwise(1.0))
    j = j.withColumn("stable", F.col("agreement") >= min_agreement)
    distinct = F.array_distinct("win_keys")
    votes = F.transform(distinct, lambda k: F.struct(
        F.size(F.filter("win_keys", lambda x: x == k)).alias("c"), (-F.array_position("win_keys", k)).alias("o"), k.alias("k")))
    j = j.withColumn("_top", F.array_max(votes))
    outvoted = (~F.col("stable")) & (F.col("_top.c") > m / 2.0) & ~same_center(F.col("_top.k"), F.col("global_key"))
    j = j.withColumn("chosen", F.when(outvoted, F.col("_top.k")).otherwise(F.col("global_key")))

    def cover(key):
        inside = sum((F.when(in_scale(F.lit(i), key), F.col(f"_h{i}")).otherwise(0) for i in range(1, 12)),
                     F.when(in_scale(F.lit(0), key), F.col("_h0")).otherwise(0))
        return inside / F.col("n")

    j = j.withColumn("_cands", F.array_distinct(F.concat(F.array("chosen"), "win_keys")))
    j = j.withColumn("_cov", F.transform("_cands", lambda k: F.struct(cover(k).alias("c"), k.alias("k"))))
    # equal coverage goes to the alphabetically first name
    j = j.withColumn("_cov", F.array_sort("_cov", lambda a, b: F.when(a["c"] > b["c"], -1).when(a["c"] < b["c"], 1)
                                          .when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))
    better = F.col("tested") & (F.col("_cov")[0]["c"] > cover(F.col("chosen")) + margin)
    j = j.withColumn("reported", F.when(better, F.col("_cov")[0]["k"]).otherwise(F.col("chosen")))
    changed = F.col("reported") != F.col("global_key")
    final = F.when(changed & F.col("tested"), agree(F.col("reported")) / m).otherwise(F.col("agreement"))
    return j.select("song_id", "global_key", F.col("reported").alias("key"), F.col("raw").alias("raw_confidence"),
                    final.alias("agreement"), (F.col("raw") * final).alias("confidence"), "stable", m.alias("windows"))
