"""Averages at a limit, and times halfway between two millionths."""

import itertools

from pyspark.sql import functions as F

from noteflow.catalog.registry import half6
from noteflow.functions.sums import steady_avg
from noteflow.operators import corpus_stats as cs

QUARTER = [0.2598, 0.2699, 0.0015, 0.1609, 0.5579]  # on average 0.25; added up in this order, less


def test_average_at_the_limit_in_every_order(spark):
    assert sum(QUARTER) / 5 < 0.25
    rows = [(i, v) for i, p in enumerate(itertools.permutations(QUARTER)) for v in p]
    got = spark.createDataFrame(rows, "g int, v double").coalesce(1).groupBy("g").agg(steady_avg("v").alias("a"))
    assert {r.a for r in got.collect()} == {0.25}


def test_measure_at_the_limit_is_no_trouble(spark):
    notes = spark.createDataFrame([(1, 100.0 * i, v) for i, v in enumerate(QUARTER)], "song_id long, start_ms double, confidence double").coalesce(1)
    tempo = spark.createDataFrame([(1, 0.0, 480.0, 4)], "song_id long, first_beat_ms double, beat_ms double, numerator int")
    assert cs.trouble_map(notes, tempo).count() == 0


def test_average_of_values_no_decimal_holds(spark):
    df = spark.createDataFrame([(1, 1e30), (1, 3e30), (2, float("nan")), (3, None), (4, 0.5), (4, None)], "g int, v double")
    got = {r.g: r.a for r in df.groupBy("g").agg(steady_avg("v").alias("a")).collect()}
    assert got[1] == 2e30 and got[2] != got[2] and got[3] is None and got[4] == 0.5


def test_halfway_times_round_by_millionths(spark):
    r = spark.createDataFrame([(16.0791695, 2.5e-6, -2.5e-6)], "a double, b double, c double").select(*[half6(x).alias(x) for x in "abc"]).first()
    assert list(r) == [16.079169, 3e-6, -3e-6]
