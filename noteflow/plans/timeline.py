"""Skew-safe sequence plans.

A song is a time line, and one song may hold a large share of a corpus, so no
window in this library is partitioned by song alone.  Every sequence operator
works on (song, time chunk) groups:

* ``scan`` - unbounded lag/lead, running sums and fills.  Each chunk is reduced
  to one summary row, the summaries are scanned per song (they are thousands of
  times fewer than the rows), and the carried values are joined back on
  (song, chunk).  Rows move once: the local window, the summary and the join
  share one hash partitioning.
* ``halo`` - operators with a bounded reach (nearest within 60 ms, ties within
  40 ms).  Rows close to a chunk border are copied into the neighbouring chunk,
  and a plain local window gives the exact answer in one shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint

CHUNK_MS = 30000.0
CHUNK = "_chunk"


@dataclass(frozen=True)
class Spec:
    """One output column of ``scan``."""

    kind: str
    value: Any = None
    k: int = 1


def prev(value: Any, k: int = 1) -> Spec:
    """Value ``k`` rows earlier in the key's whole sequence, null when there is none."""
    return Spec("prev", value, k)


def nxt(value: Any, k: int = 1) -> Spec:
    """Value ``k`` rows later."""
    return Spec("next", value, k)


def run_sum(value: Any) -> Spec:
    """Running sum up to and including the row."""
    return Spec("sum", value)


def run_max(value: Any) -> Spec:
    """Running maximum up to and including the row."""
    return Spec("max", value)


def max_before(value: Any) -> Spec:
    """Running maximum over the strictly earlier rows."""
    return Spec("max_before", value)


def fill(value: Any) -> Spec:
    """Last non-null value up to and including the row."""
    return Spec("fill", value)


def fill_next(value: Any) -> Spec:
    """First non-null value from the row on."""
    return Spec("fill_next", value)


def fill_after(value: Any) -> Spec:
    """First non-null value on a strictly later row."""
    return Spec("fill_after", value)


def row_no() -> Spec:
    """1-based position in the key's sequence."""
    return Spec("sum", F.lit(1))


def _col(value: Any) -> Column:
    return F.col(value) if isinstance(value, str) else value


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result that the next plan reads twice.

    ``scan`` reads its input once for the chunk summaries and once for the rows,
    so a chain of scans would repeat its beginning 2^n times.  A reliable
    checkpoint between the links keeps work and plans linear and survives lost
    executors.  Callers narrow or filter the rows first.
    """
    return checkpoint(df)


def chunked(df: DataFrame, t: str, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Add the time-chunk column unless an earlier plan on this frame already did."""
    if CHUNK in df.columns:
        return df
    return df.withColumn(CHUNK, F.floor(F.col(t) / F.lit(float(chunk_ms))))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outs: Mapping[str, Spec],
    chunk_ms: float = CHUNK_MS,
    keep_chunk: bool = False,
) -> DataFrame:
    """Add whole-sequence window columns without a window over a whole song.

    ``order[0]`` must be the numeric column chunks are cut on; the remaining
    columns break ties and must make the order total.
    """
    keys, order = list(keys), list(order)
    part = [*keys, CHUNK]
    cols = list(df.columns)
    base = chunked(df, order[0], chunk_ms)
    specs = list(outs.items())
    for i, (_, s) in enumerate(specs):
        base = base.withColumn(f"_v{i}", _col(s.value))

    fwd = Window.partitionBy(*part).orderBy(*order)
    back = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    whole = Window.partitionBy(*part)
    upto = fwd.rowsBetween(Window.unboundedPreceding, 0)
    before = fwd.rowsBetween(Window.unboundedPreceding, -1)
    onward = back.rowsBetween(Window.unboundedPreceding, 0)
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    k_prev = max([s.k for _, s in specs if s.kind == "prev"], default=0)
    k_next = max([s.k for _, s in specs if s.kind == "next"], default=0)

    local = base
    if k_prev or k_next:
        local = local.withColumn("_rn", F.row_number().over(fwd))
    if k_next:
        local = local.withColumn("_left", F.count(F.lit(1)).over(whole) - F.col("_rn"))
    for i, (_, s) in enumerate(specs):
        v = F.col(f"_v{i}")
        part_value = {
            "prev": lambda: F.lag(v, s.k).over(fwd),
            "next": lambda: F.lead(v, s.k).over(fwd),
            "sum": lambda: F.sum(v).over(upto),
            "max": lambda: F.max(v).over(upto),
            "max_before": lambda: F.max(v).over(before),
            "fill": lambda: F.last(v, ignorenulls=True).over(upto),
            "fill_next": lambda: F.last(v, ignorenulls=True).over(onward),
            "fill_after": lambda: F.last(v, ignorenulls=True).over(after),
        }[s.kind]()
        local = local.withColumn(f"_l{i}", part_value)

    # one summary row per chunk
    position = F.struct(*[F.col(c) for c in order])
    aggs = []
    tails = F.struct(*[F.col(f"_v{i}") for i, (_, s) in enumerate(specs) if s.kind == "prev"])
    heads = F.struct(*[F.col(f"_v{i}") for i, (_, s) in enumerate(specs) if s.kind == "next"])
    summary_in = base
    if k_prev > 1 or k_next > 1:
        summary_in = local
    if k_prev == 1:
        aggs.append(F.array(F.max_by(tails, position)).alias("_tail"))
    elif k_prev:
        at_end = F.when(
            F.count(F.lit(1)).over(whole) - F.col("_rn") < k_prev, F.struct("_rn", tails.alias("r"))
        )
        summary_in = summary_in.withColumn("_t", at_end)
        aggs.append(
            F.transform(F.array_sort(F.collect_list("_t")), lambda x: x["r"]).alias("_tail")
        )
    if k_next == 1:
        aggs.append(F.array(F.min_by(heads, position)).alias("_head"))
    elif k_next:
        summary_in = summary_in.withColumn(
            "_h", F.when(F.col("_rn") <= k_next, F.struct("_rn", heads.alias("r")))
        )
        aggs.append(
            F.transform(F.array_sort(F.collect_list("_h")), lambda x: x["r"]).alias("_head")
        )
    for i, (_, s) in enumerate(specs):
        v = F.col(f"_v{i}")
        if s.kind == "sum":
            aggs.append(F.sum(v).alias(f"_s{i}"))
        elif s.kind in ("max", "max_before"):
            aggs.append(F.max(v).alias(f"_s{i}"))
        elif s.kind == "fill":
            aggs.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(f"_s{i}"))
        elif s.kind in ("fill_next", "fill_after"):
            aggs.append(F.min_by(v, F.when(v.isNotNull(), position)).alias(f"_s{i}"))
    summary = summary_in.groupBy(*part).agg(*aggs)

    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    chunks_back = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc())
    earlier = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    later = chunks_back.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.col(c) for c in part]
    if k_prev:
        carried.append(
            F.flatten(F.collect_list("_tail").over(over_chunks.rowsBetween(-k_prev, -1))).alias("_pt")
        )
    if k_next:
        carried.append(
            F.flatten(F.collect_list("_head").over(over_chunks.rowsBetween(1, k_next))).alias("_nh")
        )
    for i, (_, s) in enumerate(specs):
        c = F.col(f"_s{i}")
        if s.kind == "sum":
            carried.append(F.sum(c).over(earlier).alias(f"_c{i}"))
        elif s.kind in ("max", "max_before"):
            carried.append(F.max(c).over(earlier).alias(f"_c{i}"))
        elif s.kind == "fill":
            carried.append(F.last(c, ignorenulls=True).over(earlier).alias(f"_c{i}"))
        elif s.kind in ("fill_next", "fill_after"):
            carried.append(F.last(c, ignorenulls=True).over(later).alias(f"_c{i}"))
    joined = local.join(summary.select(*carried), part)

    results = {}
    for i, (name, s) in enumerate(specs):
        here, carry = F.col(f"_l{i}"), (
            None if s.kind in ("prev", "next") else F.col(f"_c{i}")
        )
        if s.kind == "prev":
            reach_back = F.size("_pt") + F.col("_rn") - s.k - 1
            results[name] = F.when(F.col("_rn") > s.k, here).otherwise(
                F.get("_pt", reach_back)[f"_v{i}"]
            )
        elif s.kind == "next":
            results[name] = F.when(F.col("_left") >= s.k, here).otherwise(
                F.get("_nh", (F.lit(s.k - 1) - F.col("_left")).cast("int"))[f"_v{i}"]
            )
        elif s.kind == "sum":
            results[name] = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif s.kind in ("max", "max_before"):
            results[name] = F.greatest(here, carry)
        else:
            results[name] = F.coalesce(here, carry)
    kept = [F.col(c) for c in cols if c not in results]
    if keep_chunk and CHUNK not in cols:
        kept.append(F.col(CHUNK))
    out = joined.select(*kept, *[c.alias(n) for n, c in results.items()])
    return out if keep_chunk else out.drop(CHUNK)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    starts: Callable[[Column, Column], Column],
    cols: Sequence[str] = (),
    name: str = "island",
    chunk_ms: float = CHUNK_MS,
    keep_chunk: bool = False,
) -> DataFrame:
    """Label runs of rows; ``starts(prev, row)`` is true when a row opens a new run.

    ``prev`` and ``row`` are structs of the order columns and ``cols``.  The
    label is the first row's order tuple, so it is unique within the keys and
    does not depend on partitioning.  Runs are closed inside each chunk; whether
    a chunk's first row continues the chunk before is decided on one summary row
    per chunk.
    """
    keys, order = list(keys), list(order)
    part = [*keys, CHUNK]
    columns = list(df.columns)
    base = chunked(df, order[0], chunk_ms)
    seen = list(dict.fromkeys([*order, *cols]))
    row = F.struct(*[F.col(c) for c in seen])
    here = F.struct(*[F.col(c) for c in order])
    fwd = Window.partitionBy(*part).orderBy(*order)
    local = base.withColumn("_prev", F.lag(row).over(fwd))
    opens = F.col("_prev").isNotNull() & F.coalesce(starts(F.col("_prev"), row), F.lit(False))
    local = local.withColumn("_mark", F.when(opens, here)).drop("_prev")
    local = local.withColumn("_fill", F.last("_mark", ignorenulls=True).over(fwd.rowsBetween(Window.unboundedPreceding, 0)))
    summary = local.groupBy(*part).agg(F.min_by(row, here).alias("_head"), F.max_by(row, here).alias("_tail"), F.max("_mark").alias("_last"))
    over = Window.partitionBy(*keys).orderBy(CHUNK)
    summary = summary.withColumn("_pt", F.lag("_tail").over(over))
    fresh = F.col("_pt").isNull() | F.coalesce(starts(F.col("_pt"), F.col("_head")), F.lit(False))
    first = F.when(fresh, F.struct(*[F.col(f"_head.{c}").alias(c) for c in order]))
    summary = summary.withColumn("_first", first)
    carry = F.last(F.coalesce("_last", "_first"), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    joined = local.join(summary.select(*part, "_first", carry.alias("_carry")), part)
    kept = [F.col(c) for c in columns if c != name]
    if keep_chunk and CHUNK not in columns:
        kept.append(F.col(CHUNK))
    out = joined.select(*kept, F.coalesce("_fill", "_first", "_carry").alias(name))
    return out if keep_chunk else out.drop(CHUNK)


def halo(
    df: DataFrame,
    t: str,
    before: float = 0.0,
    after: float = 0.0,
    chunk_ms: float = CHUNK_MS,
) -> DataFrame:
    """Copy rows near a chunk border into the chunk that can still see them.

    A row is visible in every chunk that holds a time in
    ``[t - after, t + before]``; ``_home`` marks the copy in its own chunk.
    """
    w = F.lit(float(chunk_ms))
    lo = F.floor((F.col(t) - F.lit(float(after))) / w)
    hi = F.floor((F.col(t) + F.lit(float(before))) / w)
    return df.withColumn(CHUNK, F.explode(F.sequence(lo, hi))).withColumn(
        "_home", F.col(CHUNK) == F.floor(F.col(t) / w)
    )


def local_window(keys: Sequence[str], order: Sequence[Any]):
    """Window over one (keys, chunk) group of a haloed frame."""
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    width: float,
) -> DataFrame:
    """Exact linear-interpolated percentiles per key, safe for hot keys.

    Equal values are pre-aggregated map-side, ranks come from a two-level scan
    over value buckets of ``width``, and only the rows at the wanted ranks
    survive.  Keys may hold any number of rows; no task holds a key's values.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = scan(counts, keys, ["_x"], {"_cum": run_sum("_n")}, width)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    j = ranked.join(totals, keys)
    aggs = [F.max("_total").alias("n")]
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            at = (F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum"))
            aggs.append(F.max(F.when(at, F.col("_x"))).alias(f"_{name}_{tag}"))
    g = j.groupBy(*keys).agg(*aggs)
    outs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return g.select(*keys, "n", *outs)
