"""Preparing embedding tables: usable vectors, bounded samples, blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Columns id (long) and vec (array of double) of the vectors that take part.

    Left out are null ids, null or zero vectors, vectors with a null or non-finite component,
    and vectors of another length than the most frequent one (the longer on a tie).  Rows with
    the same id count once, with the smallest vector.
    """
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0.0)
    v = v.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(fine, F.lit(False)))
    top = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return v.filter(F.size("vec") == (top["d"] if top else 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of an array column as one (n, d) matrix."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def sample(rows: DataFrame, n: int, most: int, *columns: str) -> pd.DataFrame:
    """About ``most`` of the ``n`` rows, those with the smallest hash of ``id``; never over twice as many."""
    space = 1 << 24
    cut = min(space, int(space * most / max(n, 1)) + 1)
    got = rows.filter(F.pmod(F.xxhash64("id"), F.lit(space)) < cut).select("id", *columns).limit(2 * most).toPandas()
    return got.sort_values("id").reset_index(drop=True)
