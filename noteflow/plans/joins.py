"""Range, overlap and nearest joins as equi-joins on (key, time chunk)."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .timeline import CHUNK, CHUNK_MS, chunked, halo, local_window


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    reach: float,
    values: Mapping[str, Column],
    chunk_ms: float = CHUNK_MS,
) -> DataFrame:
    """Left rows with the columns ``values`` of the nearest right row within ``reach``.

    Both sides are merged in time order inside (key, chunk) and the last right
    row seen from either direction is the candidate, so the work is linear: no
    pair of rows is ever materialised.  Equal distances go to the earlier row.
    """
    keys = list(keys)
    payload = F.struct(F.col(right_t).cast("double").alias("_rt"), *[c.alias(n) for n, c in values.items()])
    r = halo(right.select(*keys, F.col(right_t).cast("double").alias("_t"), payload.alias("_r")),
             "_t", reach, reach, chunk_ms).drop("_home")
    whole = F.struct(*[F.col(c) for c in left.columns if c != CHUNK])
    l = left.select(*keys, F.col(left_t).cast("double").alias("_t"), whole.alias("_l"),
                    F.floor(F.col(left_t) / F.lit(float(chunk_ms))).alias(CHUNK))
    both = l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).withColumn("_side", F.lit(1)).unionByName(
        r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)).withColumn("_side", F.lit(0)))
    fwd = local_window(keys, ["_t", "_side"]).rowsBetween(Window.unboundedPreceding, 0)
    back = local_window(keys, [F.col("_t").desc(), F.col("_side")]).rowsBetween(Window.unboundedPreceding, 0)
    seen = (both.withColumn("_p", F.last("_r", ignorenulls=True).over(fwd))
            .withColumn("_n", F.last("_r", ignorenulls=True).over(back))
            .filter("_side = 1"))
    dp = F.col("_t") - F.col("_p._rt")
    dn = F.col("_n._rt") - F.col("_t")
    pick = F.when(F.col("_n").isNull() | (dp <= dn), F.col("_p")).otherwise(F.col("_n"))
    seen = seen.withColumn("_b", pick)
    ok = F.abs(F.col("_b._rt") - F.col("_t")) <= F.lit(float(reach))
    return seen.select(
        "_l.*",
        *[F.when(ok, F.col(f"_b.{n}")).alias(n) for n in values],
    )


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    values: Mapping[str, Column],
    chunk_ms: float = CHUNK_MS,
) -> DataFrame:
    """Left rows with ``values`` of the last right row at or before ``left_t`` (no horizon)."""
    from .timeline import fill, scan

    keys = list(keys)
    payload = F.struct(*[c.alias(n) for n, c in values.items()])
    whole = F.struct(*[F.col(c) for c in left.columns if c != CHUNK])
    l = left.select(*keys, F.col(left_t).cast("double").alias("_t"), F.lit(1).alias("_side"), whole.alias("_l"))
    r = right.select(*keys, F.col(right_t).cast("double").alias("_t"), F.lit(0).alias("_side"), payload.alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    both = scan(both, keys, ["_t", "_side"], {"_b": fill("_r")}, chunk_ms)
    return both.filter("_side = 1").select("_l.*", *[F.col(f"_b.{n}").alias(n) for n in values])


def spread(df: DataFrame, start: str, end: str, bucket_ms: float, name: str = "_bucket") -> DataFrame:
    """One row per time bucket an interval touches."""
    b = F.lit(float(bucket_ms))
    lo, hi = F.least(start, end), F.greatest(start, end)
    return df.withColumn(name, F.explode(F.sequence(F.floor(lo / b), F.floor(hi / b))))


def points_in(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    t: str,
    bucket_ms: float = 1000.0,
    closed_end: bool = True,
    how: str = "inner",
) -> DataFrame:
    """Pairs (interval, point) with start <= t <= end, equi-joined on time buckets.

    A point has one bucket, so no pair is met twice; intervals are copied to
    the buckets they touch.
    """
    iv = spread(intervals, start, end, bucket_ms)
    pt = points.withColumn("_bucket", F.floor(F.col(t) / F.lit(float(bucket_ms))))
    inside = (F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end) if closed_end else F.col(t) < F.col(end))
    a, b = iv.alias("iv"), pt.alias("pt")
    cond = F.lit(True)
    for k in [*keys, "_bucket"]:
        cond = cond & (F.col(f"iv.{k}") == F.col(f"pt.{k}"))
    out = a.join(b, cond & inside, how)
    drop = [*keys, "_bucket"]
    return out.select(*[F.col(f"iv.{c}") for c in intervals.columns],
                      *[F.col(f"pt.{c}") for c in points.columns if c not in drop])


def overlaps(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    more_than: float,
    bucket_ms: float = 1000.0,
) -> DataFrame:
    """Pairs of intervals sharing more than ``more_than`` ms.

    ``a`` has a_start, a_end and ``b`` has b_start, b_end.  Both sides are spread
    over buckets and a pair counts only in the bucket of its later start.
    """
    x, y = spread(a, "a_start", "a_end", bucket_ms), spread(b, "b_start", "b_end", bucket_ms)
    j = x.join(y, [*keys, "_bucket"])
    first = F.floor(F.greatest("a_start", "b_start") / F.lit(float(bucket_ms)))
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return j.filter((first == F.col("_bucket")) & (shared > more_than)).drop("_bucket")


__all__ = ["nearest", "as_of", "spread", "points_in", "overlaps", "chunked"]
