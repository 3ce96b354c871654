"""Anchored grouping of near-simultaneous events, and fixed-size block arrays."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .timeline import CHUNK, CHUNK_MS, settle
from .walk import walk


def anchor_groups(df: DataFrame, keys: Sequence[str], t: str, tie: str, window: float,
                  name: str = "group_ms", strict: bool = False, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Add the time of the group anchor: an event joins while within ``window`` of the group's first event.

    Anchors are the steps of a walk over the distinct times of a key; events then
    take the last anchor up to their time, in a window over (keys, chunk).  No
    group or run of events is gathered, however long it is.  Equal times share a
    group, so ``tie`` does not matter.
    """
    keys = list(keys)
    times = settle(df.select(*keys, F.col(t).cast("double").alias("_t")).distinct().withColumn("_reach", F.lit(float(window))))
    anchors = walk(times, keys, "_t", "_reach", chunk_ms, closed=strict)
    rows = df.drop(CHUNK).withColumn("_t", F.col(t).cast("double"))
    rows = rows.withColumn(CHUNK, F.floor(F.col("_t") / F.lit(float(chunk_ms)))).withColumn("_a", F.lit(None).cast("double"))
    both = rows.unionByName(anchors.withColumn("_a", F.col("_t")), allowMissingColumns=True)
    held = Window.partitionBy(*keys, CHUNK).orderBy("_t", F.col("_a").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(name, F.last("_a", ignorenulls=True).over(held)).filter("_a is null")
    return out.select(*[c for c in df.columns if c != CHUNK], name)


def blocks(df: DataFrame, keys: Sequence[str], idx: str, value: str, size: int, reach: int) -> DataFrame:
    """Fixed-size arrays of a frame series, each extended by the next ``reach`` frames.

    Adds (block, xs) with xs starting at frame block * size; arrays never exceed
    size + reach values however long the series is.
    """
    b = F.floor(F.col(idx) / size)
    back = F.floor((F.col(idx) - reach) / size)
    d = df.select(*keys, F.col(idx).alias("_i"), F.col(value).cast("double").alias("_x"),
                  F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), back), b)).alias("block"))
    g = d.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_r"),
                                      F.count_if(F.floor(F.col("_i") / size) == F.col("block")).alias("own"))
    return g.select(*keys, "block", "own", F.transform("_r", lambda x: x["_x"]).alias("xs"))
