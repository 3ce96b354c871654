"""Group passes, claims, skylines, moving percentiles and recurrence edges against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteflow.operators import evaluation as e
from noteflow.operators import frames as f
from noteflow.operators import rhythm as r
from noteflow.plans.groups import map_groups


def test_groups_of_any_size_and_null_keys(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "a", "b"]), k, i) for i, k in enumerate([0] * 25_000 + [rnd.randrange(1, 900) for _ in range(5000)])]
    df = spark.createDataFrame(rows, "name string, k int, v long").repartition(5)
    schema = T.StructType([df.schema["name"], df.schema["k"], T.StructField("n", T.LongType()), T.StructField("s", T.LongType()), T.StructField("up", T.BooleanType())])

    def one(p):
        v = p["v"]
        return {**p.key(["name", "k"]), "n": [len(p)], "s": [int(v.sum())], "up": [bool((np.diff(v) > 0).all())]}

    got = {(x["name"], x["k"]): (x["n"], x["s"]) for x in map_groups(df, None, ["name", "k"], ["v"], one, schema).filter("up").collect()}
    want = {}
    for name, k, v in rows:
        n, s = want.get((name, k), (0, 0))
        want[name, k] = n + 1, s + v
    assert got == want


def claims_in_order(ref, can, cap, inclusive):
    used, out = set(), {}
    for rid, t in sorted(ref, key=lambda x: (x[1], x[0])):
        near = [(abs(c - t), c, i) for i, c in can if i not in used and (abs(c - t) <= cap if inclusive else abs(c - t) < cap)]
        out[rid] = min(near)[2] if near else None
        used.add(out[rid])
    return out


@pytest.mark.parametrize("inclusive", [False, True])
def test_claims_equal_the_sequential_rule_at_any_width(spark, inclusive):
    rnd = random.Random(2)
    ref = [(i, rnd.choice([0, 1]), float(rnd.randrange(0, 60_000, 50))) for i in range(700)]
    can = [(i, rnd.choice([0, 1]), float(rnd.randrange(0, 60_000, 50))) for i in range(700)]
    want = {}
    for song in (0, 1):
        want |= claims_in_order([(i, t) for i, s, t in ref if s == song], [(i, t) for i, s, t in can if s == song], 150.0, inclusive)
    a = spark.createDataFrame([(i, s, 60, t) for i, s, t in ref], "ref_id long, song_id long, pitch long, t double")
    b = spark.createDataFrame([(i, s, 60, t) for i, s, t in can], "cand_id long, song_id long, pitch long, t double")
    at = {i: t for i, _, t in can}
    for width in (900.0, 1e9):
        got = e.claim_once(a, b, 150.0, inclusive=inclusive, chunk_ms=width).collect()
        assert {x["ref_id"]: x["cand_id"] for x in got} == want
        t0 = {i: t for i, _, t in ref}
        assert all(x["error"] is None if x["cand_id"] is None else abs(x["error"] - (at[x["cand_id"]] - t0[x["ref_id"]])) < 1e-9 for x in got)


def test_skyline_equals_all_pairs(spark):
    rnd = random.Random(3)
    rows = [(s, i, float(rnd.randrange(12)), float(rnd.randrange(12)), None if i == 5 else float(rnd.randrange(12))) for s in range(3) for i in range(150)]
    df = spark.createDataFrame(rows, "song_id long, i long, x double, y double, z double")
    got = {(p["song_id"], p["i"]) for p in e.pareto_front(df, ["x", "y", "z"], deals=7).collect()}

    def beats(a, b):
        return None not in a and None not in b and all(p <= q for p, q in zip(a, b)) and a != b

    want = {(s, i) for s, i, *v in rows if not any(t == s and beats(w, v) for t, _, *w in rows)}
    assert got == want


def test_sliding_percentile():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 60):
        x = rng.integers(0, 9, n).astype(float)
        for before, after, p in ((3, 2, 0.15), (0, 0, 0.5), (5, 4, 0.5)):
            want = [np.percentile(x[max(0, i - before):i + after + 1], 100 * p) for i in range(n)]
            assert np.allclose(f.sliding_percentile(x, before, after, p), want)


def test_density_and_multiples(spark):
    values = [(1, float(i * 700), 100.0 + i % 5) for i in range(400)]
    st = spark.createDataFrame([(1, 2.0, 90.0, 110.0)], "song_id long, h double, x_lo double, x_hi double")
    got = r.density(spark.createDataFrame(values, "song_id long, t_ms double, v double"), "v", "t_ms", st, 50, 30_000.0).orderBy("g").collect()
    for row in got:
        want = sum(np.exp(-0.5 * ((row["x"] - v) / 2.0) ** 2) for _, _, v in values)
        assert abs(row["density"] - want) < 1e-6
    assert len(got) == 50 and r._round_half_up(0.0000005, 6) == 1e-06 and 0.2 in r._multiples([0.1])


@pytest.mark.parametrize("tile", [7, 512])
def test_recurrence_edges_equal_all_pairs(spark, tile):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    x[20:30] = x[:10] + 0.01
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "song_id long, i long, feat array<double>")
    got = {(e_["i"], e_["j"]): (e_["affinity"], e_["path"], e_["weight"]) for e_ in f.recurrence_edges(df, tile=tile).collect()}
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    d = np.round(1 - u @ u.T, 12)
    k = int(2 * np.ceil(np.sqrt(40 - 5)))
    near = {i: sorted((d[i, j], j) for j in range(40) if abs(i - j) >= 3)[:k] for i in range(40)}
    width = np.median([v[-1][0] for v in near.values()])
    aff, path = {}, {}
    for i, v in near.items():
        for dist, j in v:
            for a in ((i, j), (j, i)):
                aff[a] = max(aff.get(a, 0), np.exp(-dist / width))
    step = ((x[1:] - x[:-1]) ** 2).sum(axis=1)
    for i, s in enumerate(step):
        path[i, i + 1] = path[i + 1, i] = np.exp(-s / (np.median(step) + 1e-9))
    both = set(aff) | set(path)
    p, q = np.zeros(40), np.zeros(40)
    for i, j in both:
        p[i] += path.get((i, j), 0)
        q[i] += aff.get((i, j), 0)
    mu = (p @ (p + q)) / (((p + q) ** 2).sum() + 1e-9)
    assert set(got) == both
    assert all(abs(got[a][2] - (mu * aff.get(a, 0) + (1 - mu) * path.get(a, 0))) < 1e-9 for a in both)


def test_short_song_is_one_block_however_long_it_lasts(spark):
    rows = spark.createDataFrame([(1, 40_000.0 * i) for i in range(100)] + [(2, float(i)) for i in range(9000)], "song_id long, t double")
    wants = spark.createDataFrame([(1, [0.5]), (2, [0.25])], "song_id long, want array<double>")
    dealt, entries = r._dealt(rows, wants, "t")
    assert {(x.song_id, x.n) for x in entries.groupBy("song_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {(1, 1), (2, 3)}
    assert dealt.count() == 9100 and dealt.filter("song_id = 1").select("_block").distinct().count() == 1


def test_lattice_of_one_block_and_of_many(spark, monkeypatch):
    times = [(s, round(1000.0 * s + 333.0 * i + (i * 37) % (5 * s + 1))) for s in (1, 2, 3) for i in range(120)]
    on = spark.createDataFrame([(s, float(t)) for s, t in times], "song_id long, t_ms double")
    fam = r.ratio_families(r.intervals(on, 50.0, 2000.0))
    whole = r.lattice(on, fam).orderBy("song_id").collect()
    deal = r._dealt
    monkeypatch.setattr(r, "_dealt", lambda rows, wants, by, per=None: deal(rows, wants, by, 16))
    parts = r.lattice(on, fam).orderBy("song_id").collect()
    assert [x.period for x in whole] == [x.period for x in parts] and len(whole) == 3
    for a, b in zip(whole, parts):
        assert abs(a.error - b.error) < 1e-9 and abs(a.entropy - b.entropy) < 1e-9 and a.phase == b.phase


def test_partials_are_sought_once_per_pitch(spark):
    n = spark.createDataFrame([(i, 1 + i % 2, 57 + i % 3) for i in range(60)], "note_id long, song_id long, pitch long")
    spectrum = spark.range(1101).selectExpr("1L as song_id", "id as bin", "case when id % 22 = 0 then 1d else 0.01d end as mag")
    got = f.harmonic_series(n, spectrum, 10.0, 11025.0).collect()
    assert {x.song_id for x in got} == {1} and {x.note_id for x in got} == {i for i in range(60) if i % 2 == 0}
    by_pitch = {}
    for x in got:
        by_pitch.setdefault(57 + x.note_id % 3, set()).add((x.partials, x.inharmonicity, x.confidence))
    assert all(len(v) == 1 for v in by_pitch.values()) and len(by_pitch) == 3
    plan = f.harmonic_series(n, spectrum, 10.0, 11025.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") > plan.index("Join") and "Aggregate [song_id" in plan[plan.index("Generate explode"):]


def test_partials_are_not_sent_to_the_driver(spark, tmp_path):
    spark.createDataFrame([(i, 1 + i % 3, 45 + i % 30) for i in range(90)], "note_id long, song_id long, pitch long").write.parquet(f"{tmp_path}/n")
    songs = spark.range(1101).selectExpr("id as bin", "case when id % 11 = 0 then 1d when id % 11 = 1 then 0.5d else 0.01d end as mag", "explode(array(1L, 2L)) as song_id")
    songs.write.parquet(f"{tmp_path}/s")
    n, spectrum = spark.read.parquet(f"{tmp_path}/n"), spark.read.parquet(f"{tmp_path}/s")
    h = f.harmonic_series(n, spectrum, 10.0, 11025.0)
    joins = [x for x in h._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
    assert joins and not any("bin" in x for x in joins)  # files this small are broadcast, and 56 rows a pitch with them
    want = {}
    for pitch in range(45, 75):
        found = []
        for k in range(1, 9):
            target = 440.0 * 2.0 ** ((pitch - 69) / 12.0) * k
            c = math.ceil(target / 10.0 - 0.5)
            mag = {b: (1.0 if b % 11 == 0 else 0.5 if b % 11 == 1 else 0.01) for b in range(max(0, c - 3), min(1101, c + 4))}
            if target > 11025.0:
                continue
            b = max((b for b in mag if abs(b - c) <= 2), key=lambda b: (mag[b], -b))
            lo, hi = mag.get(b - 1), mag.get(b + 1)
            den = None if lo is None or hi is None else lo - 2 * mag[b] + hi
            freq = (b + (max(-1.0, min(1.0, 0.5 * (lo - hi) / den)) if den is not None and abs(den) > 1e-12 else 0.0)) * 10.0
            if freq > 0 and abs(1200 * math.log2(freq / target)) <= (30 if k <= 3 else 50 if k <= 5 else 70):
                found.append((abs(freq - target) / target / k, 1.0 / k))
        if len(found) >= 2:
            want[pitch] = (len(found), round(sum(x for x, _ in found) / sum(w for _, w in found), 9))
    assert len(want) > 5
    got = {(x.song_id, 45 + x.note_id % 30): (x.partials, round(x.inharmonicity, 9)) for x in h.collect()}
    assert got == {(s, p): v for s in (1, 2) for p, v in want.items() if any(45 + i % 30 == p and 1 + i % 3 == s for i in range(90))}


def test_recurrence_edges_are_ranked_once_in_a_song_of_one_wide_tile(spark, monkeypatch):
    rnd = random.Random(8)
    df = f.settle(spark.createDataFrame([(1, i, [rnd.randint(1, 4) + 0.0 for _ in range(3)]) for i in range(70)], "song_id long, i long, feat array<double>"))
    seen, real = [], f.map_groups
    monkeypatch.setattr(f, "map_groups", lambda *a: seen.append(f.settle(real(*a))) or seen[-1])
    wide, cut = [sorted(map(tuple, f.recurrence_edges(df, tile=t).collect())) for t in (4, 2)]
    assert [r[:3] for r in wide] == [r[:3] for r in cut] and np.allclose([r[3:] for r in wide], [r[3:] for r in cut])
    # 18 neighbours of each beat leave a song whose beats are one tile to look through, 18 for each such tile otherwise
    assert seen[0].count() == 70 * 18 < seen[1].count()


def plain_verdict(levels):
    """Held and rising frames of one song, frame by frame."""
    delta = [None] + [None if a is None or b is None else b - a for a, b in zip(levels, levels[1:])]

    def at(values, p):
        values, pos = sorted(values), p * (len(values) - 1)
        return values[math.floor(pos)] + (values[math.ceil(pos)] - values[math.floor(pos)]) * (pos - math.floor(pos))

    e40, d90 = at([x for x in levels if x is not None], 0.4), at([abs(d) for d in delta if d is not None], 0.9)
    hit = [d is not None and d > d90 for d in delta]
    held = [i for i, d in enumerate(delta) if d is not None and levels[i] > e40 and not any(hit[max(0, i - 2):i + 1])]
    return sum(delta[i] > 0.02 * max(levels[i], 1e-9) for i in held) / len(held) if held else 0.0


def test_solo_verdict_writes_a_row_a_chunk(spark, monkeypatch):
    rnd = random.Random(11)
    rows = [(s, i * (1 + s % 3) + (900 if i > 40 else 0), None if rnd.random() < 0.05 else rnd.random(), rnd.random(), 0.05 * rnd.random(), 0.1, 2.0) for s in range(6) for i in range(8 + 25 * s)]
    rows += [(9, 0, 0.5, 1.0, 0.1, 0.1, 1.0), (None, 0, 0.5, 1.0, 0.1, 0.1, 1.0), (None, 1, 0.7, 1.0, 0.1, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "song_id long, frame_idx long, harmonic double, percussive double, percussive_high double, low double, total double").repartition(4)
    written, settle = [], f.settle
    monkeypatch.setattr(f, "settle", lambda x: written.append(settle(x)) or written[-1])
    got = f.solo_verdict(df).collect()
    assert sum(x.count() for x in written) == 7  # one for each song that has an id
    assert {x.song_id for x in got} == set(range(6))
    for x in got:
        own = [r for r in rows if r[0] == x.song_id]
        assert abs(x.swell - plain_verdict([r[2] for r in own])) < 1e-9 and abs(x.low_share - 0.05) < 1e-9
        assert abs(x.kit - sum(r[4] for r in own) / sum(r[3] for r in own)) < 1e-9
    for width in (2, 7, 64):  # songs over many chunks, some of them empty or of one frame
        cut = f.solo_verdict(df, frames_per_chunk=width).collect()
        assert sorted((x.song_id, round(x.kit, 9), round(x.swell, 9), x.verdict) for x in cut) == sorted((x.song_id, round(x.kit, 9), round(x.swell, 9), x.verdict) for x in got)
