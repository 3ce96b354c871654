"""Texture vectors against a direct computation on one region."""

import random

import numpy as np

from noteflow.operators import texture as tx


def direct(ns, r0, r1, win):
    ns = sorted(ns, key=lambda x: (x[1], x[0]))
    stacks, cur = [], []
    for x in ns:
        if cur and x[1] - cur[0][1] > win:
            stacks.append(cur)
            cur = []
        cur.append(x)
    stacks.append(cur)
    multi = [s for s in stacks if len(s) > 1]

    def like(s):
        ps = sorted(x[3] for x in s)
        iv = [(b - a) % 12 for i, a in enumerate(ps) for b in ps[i + 1:]]
        return (sum(v in tx.CHORD_INTERVALS for v in iv) - sum(v in tx.CLUSTER_INTERVALS for v in iv)) / len(iv)

    likeness = np.mean([like(s) for s in multi]) if multi else 0.0
    chordality = np.clip(sum(map(len, multi)) / len(ns) * (0.5 + 0.5 * max(likeness, 0)), 0, 1)
    split = np.median([x[3] for x in ns])
    top, bot = [x for x in ns if x[3] > split], [x for x in ns if x[3] <= split]
    d = np.abs(np.diff([x[3] for x in top]))
    motion = np.mean((d > 0) & (d <= 2)) if len(top) > 2 else 0.0
    v = np.diff([x[1] for x in bot]) if len(bot) > 2 else np.array([])
    v = v[v > 1]
    reg = np.clip(1 - v.std() / (v.mean() + 1e-9), 0, 1) if len(v) >= 3 else 0.0
    ind = 1 - np.mean([min(abs(b[1] - x[1]) for b in bot) <= win for x in top])
    sus = np.mean([min(1.0, 0.25 * sum(x[1] + win < y[1] < x[2] for y in ns)) for x in ns])
    g = np.zeros(64)
    for x in ns:
        g[int((x[1] - r0) / (r1 - r0) * 63)] += 1
    g -= g.mean()
    ost = np.clip(np.correlate(g, g, "full")[64:].max() / (g @ g + 1e-9), 0, 1)
    return [chordality, motion, reg, ind, sus, ost]


def test_vector(spark):
    rnd = random.Random(4)
    rows = [(1, 0, i, rnd.choice([0, 30, 500, 900, 1400, 2000, 2500, 3100, 3500]) + rnd.randint(0, 20) + 0.5, 0.0, rnd.randint(48, 72)) for i in range(30)]
    rows = [(s, r, i, t, t + rnd.choice([50.0, 400.0, 1500.0]), p) for s, r, i, t, _, p in rows]
    df = spark.createDataFrame([(*x, "piano", 0.0, 4000.0) for x in rows],
                               "song_id long, region long, note_id long, start_ms double, end_ms double, pitch long, family string, r_start double, r_end double")
    got = tx.texture_vector(df, 60.0).first()
    want = direct([(i, t, e, p) for _, _, i, t, e, p in rows], 0.0, 4000.0, 60.0)
    assert np.allclose([got.chordality, got.motion, got.regularity, got.independence, got.sustain, got.ostinato], want)
    assert tx.texture(df, 60.0).first().n == 30


def test_motif_pairs_carry_sections_and_all_ten_witnesses_are_graded(spark, sf):
    from noteflow.catalog import alignment
    from noteflow.sources import corpus

    where = {r["note_id"]: int(r["start_ms"] // 4000) for r in corpus.notes(spark, sf).select("note_id", "start_ms").collect()}
    rows = alignment.j19(spark, sf).select("a_id", "b_id", "section_same").collect()
    kind = {n: "ABC"[i * i % 3] for n, i in where.items()}
    assert rows and all(r["section_same"] == float(kind[r["a_id"]] == kind[r["b_id"]]) for r in rows)
    assert {r["witness"] for r in alignment.j19b(spark, sf).select("witness").collect()} == {
        "pitch_prox", "register", "ioi_regular", "metric_pos", "duration_compat", "overlap", "family_same", "stem_same", "motif_cont", "section_same"}


def test_motif_leads_hold_only_what_tells_rivals(spark, monkeypatch):
    seen, real = [], tx.scan
    monkeypatch.setattr(tx, "scan", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    rows = [(1, i, 100.0 * i, 100.0 * i + 50, 60 + i, "piano", "piano", 1 if i % 3 else None, 0 if i % 3 else None) for i in range(7)]
    events = spark.createDataFrame(rows, "song_id long, note_id long, start_ms double, end_ms double, pitch long, family string, stem string, motif long, occurrence long")
    got = {(r.a.note_id, r.b.note_id, r.positive, r.b.pitch) for r in tx.motif_pairs(events, 480.0, 2.0).collect()}
    assert got == {(1, 2, True, 62), (2, 4, True, 64), (4, 5, True, 65), (1, 3, False, 63), (1, 4, False, 64), (2, 3, False, 63), (2, 5, False, 65), (4, 6, False, 66)}
    lead = next(x for x in seen if "_n24" in x.columns)
    assert lead.schema["_n24"].dataType.names == ["note_id", "start_ms"] and set(lead.columns) >= {"note_id", "start_ms"} and "stem" not in lead.columns
