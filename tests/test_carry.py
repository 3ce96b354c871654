"""State machines must equal one sequential run, whatever the join strategy and the files' layout."""

import random

import pytest

from noteflow.operators import page
from noteflow.operators import lines as ln
from noteflow.plans import carry as plan


def notes(n=1200, seed=3):
    rnd = random.Random(seed)
    t, rows = 0.0, []
    for i in range(n):
        t += rnd.choice([0.0, 20.0, 60.0, 120.0, 250.0])
        rows.append((i, i % 2, "piano", rnd.randint(40, 80), t, t + rnd.choice([50.0, 150.0, 900.0, 4000.0])))
    return rows


COLS = "note_id long, song_id long, stem string, pitch long, start_ms double, end_ms double"


@pytest.fixture(params=[(True, "10m"), (True, "-1"), (False, "10m"), (False, "-1")], ids=["aqe-bc", "aqe", "bc", "plain"])
def joins(spark, request):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, request.param):
        spark.conf.set(k, str(v).lower())
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """One song pair in eight files, rows dealt without regard to time."""
    path = str(tmp_path_factory.mktemp("notes") / "n")
    spark.createDataFrame(notes(), COLS).repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def voices_in_order(rows):
    out = {}
    for song in (0, 1):
        voices = []
        for r in sorted((r for r in rows if r[1] == song), key=lambda r: (r[4], r[0])):
            free = [v for v in voices if r[4] >= v[1]]
            if free:
                v = min(free, key=lambda v: abs(v[2] - r[3]))
                v[1], v[2] = r[5], r[3]
            else:
                v = [r[0], r[5], r[3]]
                voices.append(v)
            out[r[0]] = v[0]
    return out


def test_register_voices(files, joins):
    want = voices_in_order(notes())
    for width in (1500.0, 30000.0):
        got = {r.note_id: r.voice_start for r in page.register_voices(files, chunk_ms=width).collect()}
        assert got == want


def test_threads_and_staff_voices_ignore_widths(files, joins):
    for operator, name in ((lambda w: ln.melodic_threads(files, 480.0, w), "line_id"),
                           (lambda w: page.staff_voices(files, ("song_id", "stem"), chunk_ms=w), "voice_start"),
                           (lambda w: ln.voice_lines(files, w), "line_id")):
        whole = {r["note_id"]: r[name] for r in operator(1e9).select("note_id", name).collect()}
        assert len(set(whole.values())) > 1
        assert {r["note_id"]: r[name] for r in operator(2000.0).select("note_id", name).collect()} == whole


def segments_in_order(times, tolerance=1.5):
    out, start, n = [], None, 0
    for i, t in enumerate(times):
        nx = times[i + 1] if i + 1 < len(times) else None
        if start is None:
            start, n = i, 0
        elif n > 0 and nx is not None and abs(60000.0 / (nx - t) - 60000.0 * n / (t - times[start])) > tolerance:
            start, n = i, 0
        out.append(start)
        n += 1
    return out


@pytest.mark.parametrize("steady", [True, False])
def test_tempo_segments_settle_in_few_rounds(spark, steady, monkeypatch):
    rnd, t, times = random.Random(5), 0.0, []
    beat = 500.0
    for i in range(2500):
        if not steady and i % 37 == 0:
            beat = rnd.choice([400.0, 450.0, 500.0, 600.0])
        times.append(t)
        t += beat + rnd.choice([-0.5, 0.0, 0.5])
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "song_id long, beat_idx long, t_ms double").repartition(6)
    rounds = []
    keep = plan.checkpoint
    monkeypatch.setattr(plan, "checkpoint", lambda d: rounds.append(1) or keep(d))
    got = page.tempo_segments(df, chunk_ms=2500.0).collect()  # 500 chunks
    want = segments_in_order(times)
    counts = {}
    for s in want[:-1]:
        counts[s] = counts.get(s, 0) + 1
    assert {r["segment"]: r["n_beats"] for r in got} == counts
    assert len(rounds) < 2 * 10
