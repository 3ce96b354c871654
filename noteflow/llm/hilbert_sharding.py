"""Sharding along a Hilbert curve over quantised metadata.

Each dimension is quantised to 2**bits cells of about equal row counts, the cells of a row give
its index on the Hilbert curve, and the rows in curve order are cut into shards.  Rows of a
shard are then close in every dimension, so the min/max values of a shard prune files for
filters on any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import number_rows, store

CODE = "_code"


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of an (n, d) array of cell numbers below 2**bits.

    Works on the transposed form: undo the excess turns from the top bit down, take the Gray
    code across dimensions, then interleave the bits.
    """
    x = cells.astype(np.int64).copy()
    d = x.shape[1]
    for level in range(bits - 1, 0, -1):
        top, low = np.int64(1 << level), np.int64((1 << level) - 1)
        for i in range(d):
            is_set = (x[:, i] & top) != 0
            swap = np.where(is_set, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(is_set, low, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, d - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[:, i] >> level) & 1)
    return out


def cell_bounds(df: DataFrame, column: str, bits: int) -> list:
    """Ascending lower bounds, fewer than 2**bits, that cut the rows of ``column`` into about equal parts.

    Numbers use a mergeable quantile sketch over all rows.  Texts are counted per value and the
    values ranked by code point, so one very frequent value fills cells of its own.
    """
    n = 1 << bits
    if dict(df.dtypes)[column] == "string":
        counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_c"))
        run = number_rows(counts, [F.col(column)], "_i", "_c", "_before")
        total = df.agg(F.count(column)).first()[0]
        if not total:
            return []
        firsts = run.groupBy(F.expr(f"cast(_before * {n} div {total} as int)").alias("cell")).agg(F.min(column).alias("low"))
        return sorted((r["low"] for r in firsts.collect()), key=lambda v: v.encode())[:n]  # at most 2**bits rows
    cuts = df.agg(F.percentile_approx(column, [i / n for i in range(n)], 20 * n).alias("q")).first()["q"]
    return sorted({v for v in cuts or [] if v is not None})


def cell_of(column: Column, bounds: list) -> Column:
    """Cell of a value: how many bounds are not above it, less one; null falls in cell 0."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b) for b in bounds])
    return F.coalesce(F.greatest(F.size(F.filter(held, lambda b: b <= column)) - 1, F.lit(0)), F.lit(0)).cast("int")


def shard(docs: DataFrame, dims: list[str], id_col: str, size_col: str, shards: int = 40, law: str = "rows", bits: int = 5,
          carry: tuple = ()) -> DataFrame:
    """Shard, slot and curve index of every row, with the ``dims``, ``id_col``, ``size_col`` and ``carry`` columns.

    ``law`` "rows" cuts runs whose row counts differ by at most one; "bytes" cuts where the
    running size passes equal parts of the total, so sizes differ by one row's size at most.
    Rows with a null dimension lie in that dimension's first cell; rows of one cell are ordered
    by a hash of the id and the id, so repeated rows lie side by side.  An empty table gives an
    empty result; one row goes to shard 0 ("rows") and shards may stay empty.
    ``len(dims) * bits`` must not pass 62.
    """
    if law not in ("rows", "bytes") or len(dims) * bits > 62:
        raise ValueError("law is rows or bytes, and dims * bits at most 62")
    base = store(docs.select(*dict.fromkeys([id_col, size_col, *dims, *carry])), "shard")
    codes = [cell_of(F.col(c), cell_bounds(base, c, bits)).alias(f"{CODE}{i}") for i, c in enumerate(dims)]
    coded = base.select("*", *codes)
    names = [f"{CODE}{i}" for i in range(len(dims))]

    @F.pandas_udf("long")
    def on_curve(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(curve_index(np.column_stack([p.to_numpy() for p in part]), bits))

    coded = coded.withColumn("curve", on_curve(*names)).drop(*names)
    order = [F.col("curve"), F.xxhash64(id_col), F.col(id_col)]
    if law == "rows":
        ranked = number_rows(coded, order, "_rank")
        n = base.count()
        put = ranked.withColumn("shard", F.expr(f"cast(_rank * {shards} div {max(n, 1)} as int)"))
        first = F.expr(f"(cast(shard as long) * {n} + {shards - 1}) div {shards}")
        return put.withColumn("slot", F.col("_rank") - first).drop("_rank")
    ranked = number_rows(coded, order, "_rank", size_col, "_before")
    total = max(base.agg(F.sum(size_col)).first()[0] or 1, 1)
    put = ranked.withColumn("shard", F.least(F.expr(f"cast(_before * {shards} div {total} as int)"), F.lit(shards - 1)))
    firsts = put.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row per shard
    return put.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_rank") - F.col("_first")).drop("_rank", "_before", "_first")


def pruning_table(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Rows and least and greatest value of every dimension per shard: what a reader needs to skip files."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))])
