"""Musical statements on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from noteflow.functions import music as m
from noteflow.functions.hands import Limits, profile, two_hands
from noteflow.operators import annotations as an
from noteflow.operators import filters as f
from noteflow.operators import page as pg
from noteflow.operators import patterns as p
from noteflow.operators import quantize as q
from noteflow.operators import rhythm as r
from noteflow.operators import tempo as t

NOTE = "note_id long, song_id long, stem string, pitch long, start_ms double, end_ms double, confidence double"


def stream(spark, pitches, step=250.0, length=200.0, conf=0.9):
    return spark.createDataFrame([(i, 1, "piano", x, i * step, i * step + length, conf) for i, x in enumerate(pitches)], NOTE)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


FIGURES = [
    ("scale_run", [60, 62, 64, 65, 67, 69], 250.0, 1), ("scale_run", [60, 62, 60, 62], 250.0, 0),
    ("arpeggio", [60, 64, 67, 72], 250.0, 1), ("arpeggio", [60, 61, 62, 63], 250.0, 0),
    ("sequence", [60, 62, 64, 62, 64, 66], 250.0, 1), ("ostinato", [60, 64, 60, 64, 60, 64], 250.0, 1),
    ("pedal_point", [48] * 4, 500.0, 1), ("rearticulation", [60] * 4, 100.0, 1), ("rearticulation", [60] * 4, 600.0, 0),
    ("alberti_bass", [60, 67, 64, 67] * 2, 250.0, 1), ("alberti_bass", [60, 67, 64, 67], 250.0, 0),
    ("neighbor_tone", [60, 62, 60, 70], 250.0, 1), ("gap_fill", [60, 67, 65, 64], 250.0, 1), ("gap_fill", [60, 67, 69, 71], 250.0, 0),
]


@pytest.mark.parametrize("name,pitches,step,count", FIGURES)
def test_figures(spark, name, pitches, step, count):
    assert p.DETECTORS[name](stream(spark, pitches, step), 500.0).count() == count


def test_chord_figure(spark):
    n = stream(spark, [60, 64, 67, 61, 62], 10.0)
    got = p.chords(n.filter("note_id < 3"), 500.0).collect()
    assert len(got) == 1 and got[0].size == 3
    assert p.chords(n.filter("note_id > 1"), 500.0).count() == 0


def test_rounding_and_tiers(spark):
    assert [one(spark, m.half_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, m.confidence_tier(F.lit(0.79))) == "medium" and one(spark, m.confidence_tier(F.lit(2.0))) == "perfect"
    assert one(spark, m.elapsed_text(F.lit(3723))) == "1h 02m 03s" and one(spark, m.elapsed_text(F.lit(123))) == "2m 03s"
    assert one(spark, m.key_number(F.lit("F#m"))) == 18 and one(spark, m.in_scale(F.lit(61), F.lit("C"))) is False


def test_consolidation_respects_attacks(spark):
    rows = [(1, 1, "piano", 60, 0.0, 100.0, 0.9), (2, 1, "piano", 60, 140.0, 200.0, 0.8), (3, 1, "piano", 60, 500.0, 600.0, 0.8), (4, 1, "piano", 60, 615.0, 700.0, 0.7)]
    n = spark.createDataFrame(rows, NOTE)
    onsets = spark.createDataFrame([(1, "piano", 140.0), (1, "piano", 615.0)], "song_id long, stem string, t_ms double")
    runs = {r_.note_id: r_.run_note for r_ in an.consolidate(n, onsets, chunk_ms=130.0).collect()}
    assert runs == {1: 1, 2: 2, 3: 3, 4: 3}
    assert {r_.note_id: r_.run_note for r_ in an.consolidate(n, None).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_latest_annotation_wins(spark):
    a = spark.createDataFrame([(1, "k", 1, 5.0), (1, "k", 9, 7.0), (1, "j", 3, 1.0)], "note_id long, kind string, seq long, value double")
    assert {(x.kind, x.value) for x in an.latest(a).collect()} == {("k", 7.0), ("j", 1.0)}


@pytest.mark.parametrize("start,dur,num,den,pieces", [
    (0, 288, 4, 4, [(0, 288)]), (96, 192, 4, 4, [(96, 96), (192, 96)]), (144, 96, 4, 4, [(144, 48), (192, 48)]), (288, 192, 4, 4, [(288, 96), (384, 96)]),
])
def test_metric_split(spark, start, dur, num, den, pieces):
    col = pg.metric_split(F.lit(start).cast("bigint"), F.lit(dur).cast("bigint"), F.lit(num), F.lit(den))
    assert [(x.s, x.d) for x in one(spark, col)] == pieces


def test_split_conserves_duration(spark, sf):
    from noteflow.catalog.page import ticks

    n = ticks(spark, sf).withColumn("is_tuplet", F.lit(False))
    got = pg.notation_pieces(n).groupBy("note_id").agg(F.sum("dur_tick").alias("got"))
    # on the sixteenth grid every piece is fully writable
    n = n.filter("dur_tick % 24 = 0 and start_tick % 24 = 0")
    assert n.count() > 20 and n.join(got, "note_id").filter("dur_tick <> got").count() == 0


def test_hands(spark):
    def ok(ps, lim=Limits()):
        return one(spark, two_hands(F.array(*[F.lit(x).cast("bigint") for x in ps]), lim)["ok"])

    assert ok([60, 64, 67]) and ok([36, 43, 48, 60, 64, 67, 72])
    assert not ok(list(range(40, 51 + 20))[:11])
    assert not ok([21, 60, 108]) and ok([48, 60, 64]) and not ok([30, 48, 66, 84], profile("comfortable"))


def test_tempo_map_round_trip(spark):
    beats = spark.createDataFrame([(1, i, 100.0 + 480.0 * i + (i * 13) % 40) for i in range(12)], "song_id long, beat_idx long, t_ms double")
    ev = spark.createDataFrame([(i, 1, -300.0 + 173.0 * i) for i in range(40)], "id long, song_id long, start_ms double")
    pos = t.tempo_map(ev, beats, "start_ms", 700.0)
    back = q.beats_to_ms(pos, beats, "beat_pos", "ms", 700.0).collect()
    assert len(back) == 40 and all(abs(x.ms - x.start_ms) < 1e-6 for x in back)


def test_beat_rhythm(spark):
    def read(fr):
        b = one(spark, q.infer_beat(F.array(*[F.lit(x) for x in fr])))
        return None if b is None else (b.divisor, [round(x, 3) for x in b.slots])

    assert read([0.0]) == (1, [0.0]) and read([0.01, 0.5]) == (2, [0.0, 0.5])
    assert read([0.0, 0.25, 0.5, 0.75]) == (4, [0.0, 0.25, 0.5, 0.75])
    assert read([0.0, 0.33, 0.67]) == (3, [0.0, 0.333, 0.667])


def test_tempo_referee_folds_octaves(spark):
    w = spark.createDataFrame([(1, "a", 120.0, 0.9, 1.0), (1, "b", 60.0, 0.8, 0.8), (1, "c", 95.0, 0.5, 0.6)],
                              "song_id long, source string, tempo_bpm double, confidence double, weight double")
    x = t.resolve_tempo(w).first()
    assert x.tempo_bpm == 120.0 and x.contention and x.anchor_source == "a"


def test_meter_camp_beats_one_confident_outlier(spark):
    c = spark.createDataFrame([(1, 3, 4, 0.9, 1), (1, 4, 4, 0.5, 2), (1, 2, 4, 0.45, 3)], "song_id long, numerator int, denominator int, confidence double, seq int")
    assert t.resolve_meter(c).first().numerator == 4


def test_modal_tempo_of_steady_notes(spark):
    n = stream(spark, [60] * 40, 500.0 + 0.0).withColumn("start_ms", F.col("start_ms") + F.col("note_id") % 3)
    x = r.modal_tempo(n).first()
    assert abs(x.tempo_bpm - 120.0) < 1.5 and x.confidence > 0.8


def test_key_of_a_scale(spark):
    from noteflow.operators import keys as k

    n = stream(spark, [60, 62, 64, 65, 67, 69, 71, 72] * 6 + [60, 64, 67, 60] * 3)
    x = k.key_of_songs(n).first()
    assert x.key == "C" and x.confidence > 0.7
    s = k.key_stability(n).first()
    assert s.key == "C" and s.stable and s.agreement >= 0.7


def test_verdicts(spark):
    v = f.legitimacy(F.lit(30.0), F.lit(0.1), F.lit(None).cast("double"))
    assert one(spark, v) == "purge_candidate"
    assert one(spark, f.legitimacy(F.lit(30.0), F.lit(0.3), F.lit(0.6))) == "legitimate"
    assert one(spark, f.region_type(F.lit(0.5), F.lit(0.45), F.lit(0.1))) == "uncertain"


def test_hand_split_equals_plain_viterbi(spark):
    import random

    from noteflow.operators import hands as h

    rnd = random.Random(2)
    rows = [(1, w, [float(rnd.randint(0, 6)) for _ in h.BOUNDARIES]) for w in range(37)] + [(2, 4, [1.0] * 12)]
    df = spark.createDataFrame(rows, "song_id long, w long, cost array<double>")

    def total(path):
        return sum(c[h.BOUNDARIES.index(b)] for b, (_, _, c) in zip(path, rows[:37])) + 0.4 * sum(abs(a - b) for a, b in zip(path, path[1:]))

    best = [0.0 + x for x in rows[0][2]]
    for _, _, c in rows[1:37]:
        best = [min(best[i] + 0.4 * abs(a - b) for i, a in enumerate(h.BOUNDARIES)) + c[j] for j, b in enumerate(h.BOUNDARIES)]
    for size in (5, 8, 1000):
        got = [x.boundary for x in sorted(h.hand_boundaries(df, beats_per_chunk=size).filter("song_id = 1").collect(), key=lambda x: x.w)]
        assert len(got) == 37 and math.isclose(total(got), min(best))


def test_register_voices_do_not_depend_on_chunks(spark):
    n = stream(spark, [60, 72, 61, 73, 50, 60, 74] * 6, 90.0, 150.0)
    a = {x.note_id: x.voice for x in pg.register_voices(n, chunk_ms=1e9).collect()}
    assert a == {x.note_id: x.voice for x in pg.register_voices(n, chunk_ms=400.0).collect()} and max(a.values()) >= 2


def test_hand_split_breaks_ties_beat_by_beat(spark):
    import random

    from noteflow.operators import hands as h

    rnd = random.Random(5)
    rows = [(s, w, [rnd.choice((0.0, 0.5, 1.5)) for _ in h.BOUNDARIES]) for s in range(20) for w in range(40)]
    df = spark.createDataFrame(rows, "song_id long, w long, cost array<double>")
    got = {(x.song_id, x.w): x.boundary for x in h.hand_boundaries(df).collect()}
    k = range(len(h.BOUNDARIES))
    for s in range(20):
        costs = [c for song, _, c in rows if song == s]
        best, back = costs[0], []
        for c in costs[1:]:
            ways = [[best[i] + 0.4 * (2 * abs(i - j)) for i in k] for j in k]
            back.append([w.index(min(w)) for w in ways])
            best = [min(w) + c[j] for j, w in enumerate(ways)]
        path = [best.index(min(best))]
        for b in reversed(back):
            path.append(b[path[-1]])
        assert [got[(s, w)] for w in range(40)] == [h.BOUNDARIES[i] for i in reversed(path)]


def test_bass_octave_spread_at_the_limit(spark):
    hz = [440.0 * 2 ** ((x - 69) / 12) for x in (47, 50, 53, 53, 65)]
    n = spark.createDataFrame([(1, 1, 64, 0.0, 100.0)], "song_id long, note_id long, pitch long, start_ms double, end_ms double")
    f0 = spark.createDataFrame([(1, 20.0 * i, x) for i, x in enumerate(hz)], "song_id long, t_ms double, hz double")
    assert q.bass_octaves(n, f0, max_spread=12.0).count() == 0
    assert q.bass_octaves(n, f0, max_spread=12.1).first().corrected_pitch == 52


def test_seconds_of_a_hop_are_the_decimal_number():
    assert r._seconds(92.88) == 0.09288 and r._seconds(23.22) == 0.02322


def test_meter_null_of_short_and_long_songs(spark, monkeypatch):
    rows = [(s, i, float((i * 7 + s) % 11) + (3.0 if i % 4 == 0 else 0.0), n) for s, n in ((1, 30), (2, 61), (3, 7)) for i in range(n)]
    a = spark.createDataFrame(rows, "song_id long, beat_idx long, accent double, n long")
    short = {(x.song_id, x.numerator): x for x in r.scored_meters(a, 20).collect()}
    seen = []
    once = r._null_salience
    monkeypatch.setattr(r, "_null_salience", lambda x, *rest: seen.append(x.count()) or once(x, *rest))
    monkeypatch.setattr(r, "BEATS_PER_PASS", 40)
    long = {(x.song_id, x.numerator): x for x in r.scored_meters(a, 20).collect()}
    assert seen == [37] and set(short) == set(long)
    for k, x in short.items():
        assert abs(x.baseline - long[k].baseline) < 1e-12 and abs(x.threshold - long[k].threshold) < 1e-12
        assert x.significant == long[k].significant
