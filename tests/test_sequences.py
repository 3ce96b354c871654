"""Short sequences in one Python pass against the operators on rows."""

import random

from noteflow.operators import patterns as p
from noteflow.operators import texture as tx


def streams(spark, n=24, seed=3):
    rnd = random.Random(seed)
    rows, at = [], 0
    for song in range(n):
        low = [(60, 61, 62, 63, 64), (48, 52, 55), (60, 61), (48, 52, 55, 60), (60, 62, 64, 67, 72)][song % 5]
        cell, t = [rnd.choice(low) for _ in range(rnd.choice([3, 4, 5]))], 0.0
        if song % 4 == 1:
            cell = [48, 55, 52, 55]
        for i in range(rnd.choice([1, 3, 12, 40, 70])):
            pitch = cell[i % len(cell)] if rnd.random() < 0.85 else rnd.choice(low)
            if song % 6 == 5:  # one pattern climbing on
                pitch = 50 + i // len(cell) + cell[i % len(cell)] % 12
            t += rnd.choice([0.0, 7.25, 30.5, 45.0, 130.0, 700.0])
            at += 1
            rows.append((song, "piano", at * 7 % 1009 + 1009 * song, t, t + rnd.choice([0.5, 90.0, 1300.0]), pitch, 0.5))
    return spark.createDataFrame(rows, "song_id long, stem string, note_id long, start_ms double, end_ms double, pitch long, confidence double").repartition(2)


def table(df):
    return {(r["pattern"], r["kind"]): r["c"] for r in df.collect()}


def test_figures_of_short_streams_and_their_copies_are_those_of_the_detectors(spark):
    notes, names = p.settle(streams(spark)), list(p.DETECTORS)
    want = table(p._claims(notes, 480.0, names, p.KEYS, 2, 0))
    assert len({n for n, _ in want}) == len(names)
    assert table(p._short_claims(notes, 3, 480.0, names, p.KEYS, 2, 0)) == want


def test_copies_of_short_streams_are_no_rows(spark, monkeypatch):
    seen, real = [], p._claims
    monkeypatch.setattr(p, "_claims", lambda notes, *a: seen.append(notes.count()) or real(notes, *a))
    notes, names = streams(spark, 8), ["pedal_point", "chord"]
    whole = {r["pattern"]: r for r in p.null_model(notes, 480.0, names, trials=1).collect()}
    assert not seen
    monkeypatch.setattr(p, "NOTES_PER_STREAM", 12)
    cut = {r["pattern"]: r for r in p.null_model(notes, 480.0, names, trials=1).collect()}
    assert whole == cut and 0 < seen[0] < notes.count()


def regioned(spark, seed=5):
    rnd = random.Random(seed)
    rows = []
    for song in range(9):
        for i in range(rnd.choice([2, 30, 80])):
            t = rnd.choice([0.0, 40.0, 2000.0]) + 4000.0 * rnd.randint(0, 4) + rnd.choice([0, 60, 700, 1500]) + rnd.random()
            region = None if t > 18000 else int(t // 4000)
            at = None if region is None else 4000.0 * region
            rows.append((song, region, len(rows) * 37 % 1009, t, t + rnd.choice([50.0, 900.0, 2600.0]), rnd.choice([48, 50, 52, 55, 60, 64, 67]), rnd.choice(["piano", "bass", None][:2 + song % 2]),
                         at, None if at is None else at + 4000.0))
    return spark.createDataFrame(rows, "song_id long, region long, note_id long, start_ms double, end_ms double, pitch long, family string, r_start double, r_end double").repartition(2)


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_textures_of_short_regions_are_those_on_rows(spark):
    notes = tx.settle(regioned(spark))
    known = notes.filter("region is not null")
    got = rounded(tx.texture(notes, 60.0, 5))
    assert got == rounded(tx._texture_rows(known, 60.0, 5)) and len({r[-1] for r in got}) >= 4


def test_copies_of_short_songs_are_no_rows(spark, monkeypatch):
    notes = tx.settle(regioned(spark))
    want = rounded(tx._null_rows(notes, ("pitch", "family", "time"), 2, 0, window_ms=60.0, min_notes=5))
    seen, real = [], tx._null_rows
    monkeypatch.setattr(tx, "_null_rows", lambda rows, *a, **k: seen.append(rows.count()) or real(rows, *a, **k))
    null = ("song_id", "mode", "null_churn", "null_expected", "draws")
    assert rounded(tx.null_churn(notes, draws=2, window_ms=60.0, min_notes=5).select(*null)) == want and not seen
    monkeypatch.setattr(tx, "NOTES_AT_ONCE", 30)
    assert rounded(tx.null_churn(notes, draws=2, window_ms=60.0, min_notes=5).select(*null)) == want and 0 < seen[0] < notes.count()
