"""The sequence plans with chunks of 2.5 s, so that every song of the tables crosses several borders; same statements, same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus_stats as cs
from ..operators import evaluation as e
from ..operators import hands as h
from ..operators import lines as ln
from ..operators import page as p
from ..operators import quantize as q
from ..operators import rhythm as r
from ..operators import tempo as t
from ..plans.grouping import anchor_groups
from ..sources import corpus as c
from .evaluation import pair
from .registry import ORACLES, QUERIES, r6

WIDTH = 2500.0


def bordered(name: str):
    """Register as ``<id>_borders`` against the statement of the query ``name``."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        short = f"{name}_borders"
        QUERIES[short], ORACLES[short] = fn, ORACLES[name]
        return fn

    return wrap


def rounded(df: DataFrame, places: dict[str, int], *plain: str) -> DataFrame:
    return df.select(*plain, *[F.round(x, k).alias(x) for x, k in places.items()])


@bordered("w02_anchored_groups")
def w02(s, d):
    g = anchor_groups(c.notes(s, d).select("song_id", "start_ms", "note_id"), ["song_id"], "start_ms", "note_id", 45.0, chunk_ms=WIDTH)
    return rounded(g, {"group_ms": 6}, "note_id")


@bordered("v01_voice_lines")
def v01(s, d):
    return ln.voice_lines(c.notes(s, d), WIDTH).select("song_id", "stem", "note_id", "line_id")


@bordered("v02_melodic_threads")
def v02(s, d):
    return ln.melodic_threads(c.notes(s, d), 480.0, WIDTH).select("song_id", "stem", "note_id", "line_id")


@bordered("v04_register_voices")
def v04(s, d):
    v = p.register_voices(c.notes(s, d), chunk_ms=WIDTH)
    return v.select("song_id", "stem", "note_id", *[F.col(x).cast("bigint").alias(x) for x in ("voice", "staff")])


@bordered("w39_tempo_segments")
def w39(s, d):
    g = p.tempo_segments(c.beats(s, d), chunk_ms=WIDTH)
    return g.select("song_id", "segment", *[F.round(x, 6).alias(x) for x in ("start_ms", "end_ms")], "n_beats", r6("bpm").alias("bpm"))


@bordered("j18_claim_once_match")
def j18(s, d):
    """With a cap of 2 s most pieces reach over a border here, and are carried."""
    return e.claim_once(*pair(s, d), 2000.0, chunk_ms=WIDTH).select("ref_id", "cand_id", F.round("error", 6).alias("error"))


@bordered("j03_nearest_kick")
def j03(s, d):
    n = c.notes(s, d)
    return rounded(cs.phase_deltas(n.filter("stem = 'bass'"), n.filter("stem = 'drums'"), chunk_ms=WIDTH), {"delta_ms": 6}, "song_id", "note_id")


@bordered("w25_tempo_map")
def w25(s, d):
    m = t.tempo_map(c.notes(s, d), c.beats(s, d), "start_ms", WIDTH).withColumn("local_bpm", 60000 / F.col("local_beat_ms"))
    return rounded(m, {"beat_pos": 6, "local_beat_ms": 6, "local_bpm": 6}, "note_id")


@bordered("w27_proportional_durations")
def w27(s, d):
    g = anchor_groups(c.notes(s, d).select("song_id", "start_ms", "note_id"), ["song_id"], "start_ms", "note_id", 90.0, chunk_ms=WIDTH)
    x = q.proportional(g.select("song_id", F.col("group_ms").alias("t_ms")).distinct(), chunk_ms=WIDTH)
    return rounded(x, {"t_ms": 6, "unit": 5, "ratio": 6}, "song_id")


@bordered("w28_max_simultaneity")
def w28(s, d):
    return h.max_simultaneity(c.notes(s, d), chunk_ms=WIDTH).withColumn("max_notes", F.col("max_notes").cast("bigint"))


@bordered("s03_f0_notes")
def s03(s, d):
    fr = c.frames(s, d).withColumn("conf", F.when(F.col("flatness") / 10 < 0.9, 0.9).otherwise(0.1))
    return rounded(q.f0_notes(fr, chunk_ms=WIDTH), {"start_ms": 6, "end_ms": 6, "f0_hz": 6}, "song_id", "pitch")


@bordered("r02_modal_ioi_tempo")
def r02(s, d):
    return rounded(r.modal_tempo(c.notes(s, d), WIDTH), {"modal_ms": 6, "tempo_bpm": 6, "confidence": 6}, "song_id")


@bordered("r04_lattice_search")
def r04(s, d):
    on = r.combined_onsets(c.onsets(s, d))
    lat = r.lattice(on, r.ratio_families(r.intervals(on, 50.0, 2000.0, WIDTH), WIDTH), WIDTH)
    return rounded(lat, {"period": 6, "error": 5, "entropy": 5, "confidence": 5}, "song_id")
