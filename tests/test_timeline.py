"""Two-level plans must equal plain whole-key windows, wherever chunks are cut."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteflow.plans import joins
from noteflow.plans import timeline as tl
from noteflow.plans.grouping import anchor_groups, blocks


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data, i = [], 0
    # key 0 holds far more than a third of the rows
    for key, n in ((0, 400), (1, 40), (2, 3), (3, 1)):
        t = 0.0
        for _ in range(n):
            t += rnd.choice([0.0, 1.0, 7.0, 30.0, 31.0, 400.0, 5000.0 if rnd.random() < 0.05 else 20.0])
            data.append((key, t, i, rnd.randint(0, 9), rnd.choice([None, rnd.randint(0, 5)])))
            i += 1
    return spark.createDataFrame(data, "k long, t double, id long, v long, w long").cache()


@pytest.mark.parametrize("width", [50.0, 333.0, 1e9])
def test_scan_equals_windows(rows, width):
    got = tl.scan(rows, ["k"], ["t", "id"], {
        "p1": tl.prev("v"), "p3": tl.prev("v", 3), "n1": tl.nxt("v"), "n4": tl.nxt("v", 4), "s": tl.run_sum("v"), "m": tl.run_max("v"),
        "mb": tl.max_before("v"), "f": tl.fill("w"), "fn": tl.fill_next("w"), "fa": tl.fill_after("w"), "rn": tl.row_no()}, width)
    w = Window.partitionBy("k").orderBy("t", "id")
    up, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    on, after = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(1, Window.unboundedFollowing)
    want = rows.select(
        "k", "t", "id", "v", "w", F.lag("v").over(w).alias("p1"), F.lag("v", 3).over(w).alias("p3"), F.lead("v").over(w).alias("n1"), F.lead("v", 4).over(w).alias("n4"),
        F.sum("v").over(up).alias("s"), F.max("v").over(up).alias("m"), F.max("v").over(before).alias("mb"), F.last("w", True).over(up).alias("f"),
        F.first("w", True).over(on).alias("fn"), F.first("w", True).over(after).alias("fa"), F.row_number().over(w).alias("rn"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("width", [40.0, 700.0, 1e9])
def test_islands(rows, width):
    got = {r.id: r.isl.id for r in tl.islands(rows, ["k"], ["t", "id"], lambda p, r: r["t"] - p["t"] > 25.0, name="isl", chunk_ms=width).collect()}
    want, last = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.t, r.id)):
        if r.k not in last or r.t - last[r.k][0] > 25.0:
            last[r.k] = (r.t, r.id)
        else:
            last[r.k] = (r.t, last[r.k][1])
        want[r.id] = last[r.k][1]
    assert got == want


@pytest.mark.parametrize("width", [60.0, 1e9])
def test_anchor_groups(rows, width):
    got = {r.id: r.g for r in anchor_groups(rows.select("k", "t", "id"), ["k"], "t", "id", 30.0, "g", chunk_ms=width).collect()}
    want, anchor = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.t, r.id)):
        if r.k not in anchor or r.t - anchor[r.k] > 30.0:
            anchor[r.k] = r.t
        want[r.id] = anchor[r.k]
    assert got == want


@pytest.mark.parametrize("width", [100.0, 1e9])
def test_nearest_and_as_of(rows, width):
    left, right = rows.filter("id % 2 = 0").select("k", "t", "id"), rows.filter("id % 2 = 1").select("k", F.col("t").alias("rt"))
    data, other = left.collect(), right.collect()
    got = {r.id: r.hit for r in joins.nearest(left, right, ["k"], "t", "rt", 20.0, {"hit": F.col("rt")}, width).collect()}
    for r in data:
        near = sorted((abs(o.rt - r.t), o.rt) for o in other if o.k == r.k and abs(o.rt - r.t) <= 20.0)
        assert got[r.id] == (near[0][1] if near else None)
    seen = {r.id: r.last for r in joins.as_of(left, right, ["k"], "t", "rt", {"last": F.col("rt")}, width).collect()}
    for r in data:
        assert seen[r.id] == max((o.rt for o in other if o.k == r.k and o.rt <= r.t), default=None)


def test_exact_percentiles(rows):
    import numpy as np

    got = {r.k: (r.a, r.b) for r in tl.exact_percentiles(rows, ["k"], "t", {"a": 0.5, "b": 0.9}, 100.0).collect()}
    for k in got:
        ts = [r.t for r in rows.filter(F.col("k") == k).collect()]
        assert np.allclose(got[k], np.percentile(ts, [50, 90]))


def test_blocks_are_bounded(spark):
    f = spark.range(1000).select(F.lit(1).alias("s"), F.col("id").alias("i"), F.col("id").cast("double").alias("x"))
    b = blocks(f, ["s"], "i", "x", 100, 20).collect()
    assert len(b) == 10 and max(len(r.xs) for r in b) == 120 and sum(r.own for r in b) == 1000


def test_no_window_is_keyed_by_song_alone(spark, sf):
    """The plan of a scan never sorts rows by song only: the chunk is always part of the key."""
    from noteflow.sources import corpus as c

    plan = tl.scan(c.notes(spark, sf), ["song_id"], ["start_ms", "note_id"], {"p": tl.prev("pitch")})._jdf.queryExecution().executedPlan().toString()
    assert "song_id" in plan and "_chunk" in plan
