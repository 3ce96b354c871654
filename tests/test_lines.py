"""Chunked state machines must equal one sequential run over each stem."""

import math
import random

import numpy as np

from noteflow.operators import lines as ln


def corpus(spark, songs=4, n=120, seed=7):
    rnd = random.Random(seed)
    rows, i = [], 0
    for s in range(songs):
        t = 0.0
        for _ in range(n):
            t += rnd.choice([0.0, 5.0, 40.0, 90.0, 150.0, 260.0, 700.0 if s == 3 else 120.0])
            rows.append((i, s, "piano", rnd.randint(48, 72), t, t + rnd.choice([30.0, 80.0, 200.0])))
            i += 1
    return rows, spark.createDataFrame(rows, "note_id long, song_id long, stem string, pitch long, start_ms double, end_ms double")


def sequential_threads(rows, beat):
    limit, out = 2 * beat, {}
    for song in {r[1] for r in rows}:
        threads = []
        for r in sorted((r for r in rows if r[1] == song), key=lambda r: (r[4], r[3], r[0])):
            best, least = None, math.inf
            for th in threads:
                gap, jump = r[4] - th[1], abs(r[3] - th[2])
                if gap <= 45 or gap > limit or jump > 12:
                    continue
                cost = jump + 2.0 * gap / limit * 12
                if cost < least:
                    best, least = th, cost
            if best is None:
                threads.append([r[0], r[4], r[3]])
                out[r[0]] = r[0]
            else:
                best[1], best[2] = r[4], r[3]
                out[r[0]] = best[0]
    return out


def test_threads_do_not_depend_on_chunks(spark):
    rows, df = corpus(spark)
    want = sequential_threads(rows, 480.0)
    for width in (400.0, 1500.0, 1e9):
        got = {r.note_id: r.line_id for r in ln.melodic_threads(df, 480.0, width).collect()}
        assert got == want


def test_voice_lines_do_not_depend_on_chunks(spark):
    _, df = corpus(spark, seed=11)
    whole = {r.note_id: r.line_id for r in ln.voice_lines(df, 1e9).collect()}
    cut = {r.note_id: r.line_id for r in ln.voice_lines(df, 1000.0).collect()}
    assert whole == cut


def test_assignment_is_minimal():
    rnd = np.random.default_rng(3)
    from itertools import permutations

    for _ in range(50):
        n, m = int(rnd.integers(1, 5)), int(rnd.integers(1, 6))
        cost = rnd.integers(0, 20, (n, m)).astype(float)
        got = sum(cost[i, j] for i, j in ln.assign_min_cost(cost))
        k = min(n, m)
        if n <= m:
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), k))
        else:
            best = min(sum(cost[p[j], j] for j in range(m)) for p in permutations(range(n), k))
        assert abs(got - best) < 1e-9


def test_equal_assignments_take_the_earlier_line_first():
    from noteflow.operators.lines import _cheapest

    assert _cheapest([[(3.0, 1), (4.0, 2)], [(2.0, 1), (3.0, 2)]], 2) == {0: 0, 1: 1}
    assert _cheapest([[(3.0, 2)], [(3.0, 2)]], 2) == {1: 1}
    assert _cheapest([[(1.0, 1)], [(1.0, 1), (5.0, 2)], [(1.0, 1)]], 2) == {1: 1, 2: 0}
    assert _cheapest([[], []], 0) == {}
