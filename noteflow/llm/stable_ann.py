"""Approximate nearest neighbours in a low-dimensional stable projection.

Vectors are projected on a few random Gaussian directions: the squared projected distance of
two points over their squared distance follows a chi-square law.  A kd-tree over the projected
points yields neighbours by growing projected distance, each is verified by its true distance,
and the search stops when the next projected distance is so large against the k-th best that,
by the chi-square test, a nearer point is left with a probability of at most 1 - ``confidence``.

A kd-tree fitted on a bounded sample cuts the projected space into cells; every row is
assigned to one.  A query first searches its own cell, then all cells the test leaves open.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import store
from .vectors import matrix, sample, usable


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p, for an even m (closed form, bisected)."""
    if m % 2:
        raise ValueError("an even number of projections")
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        below = 1 - math.exp(-mid / 2) * sum((mid / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (mid, hi) if below < p else (lo, mid)
    return hi


def kd_groups(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of kd-tree leaves of at most ``size`` points: median cuts of the widest dimension."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        g = todo.pop()
        if len(g) <= size:
            leaves.append(g)
            continue
        p = points[g]
        axis = np.argmax(p.max(axis=0) - p.min(axis=0))
        order = np.argsort(p[:, axis], kind="stable")
        todo += [g[order[: len(g) // 2]], g[order[len(g) // 2:]]]
    return [g for g in leaves if len(g)]


class Cells:
    """Median cuts fitted on a sample, kept as a flat tree; ``find`` gives each point's cell."""

    def __init__(self, points: np.ndarray, size: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, left, right; axis -1: cell number in left
        self.cells = 0
        self.grow(points, size)

    def grow(self, p: np.ndarray, size: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0))
        axis = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if len(p) else 0
        cut = float(np.median(p[:, axis])) if len(p) else 0.0
        left = p[:, axis] < cut if len(p) else np.zeros(0, bool)
        if len(p) <= size or not left.any() or left.all():
            self.nodes[at] = (-1, 0.0, self.cells, 0)
            self.cells += 1
        else:
            self.nodes[at] = (axis, cut, self.grow(p[left], size), self.grow(p[~left], size))
        return at

    def find(self, p: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(p), np.int64), [(0, np.arange(len(p)))]
        while todo:
            node, rows = todo.pop()
            axis, cut, a, b = self.nodes[node]
            if axis < 0:
                out[rows] = a
            elif len(rows):
                left = p[rows, axis] < cut
                todo += [(a, rows[left]), (b, rows[~left])]
        return out


def box_distance(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of ``q`` from each box."""
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(axis=1)


def slack(q: np.ndarray) -> float:
    """Squared projected distance that equal vectors may have by rounding alone: their products differ with the batch."""
    return 1e-18 * float((q * q).sum())


def search_block(vecs: np.ndarray, proj: np.ndarray, ids: np.ndarray, queries: pd.DataFrame, k: int, limit: float) -> pd.DataFrame:
    """The best ``k`` rows of one block for every query, not farther than its ``bound``."""
    leaves = kd_groups(proj, 64)
    low, high = np.array([proj[g].min(axis=0) for g in leaves]), np.array([proj[g].max(axis=0) for g in leaves])
    found = []
    for qid, qv, qp, bound in zip(queries["q_id"], matrix(queries["q_vec"]), matrix(queries["q_proj"]), queries["q_bound"]):
        near = box_distance(low, high, qp)
        best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
        for leaf in np.argsort(near, kind="stable"):
            if near[leaf] > limit * bound * bound + slack(qp):
                break
            g = leaves[leaf]
            diff = vecs[g] - qv
            d = np.sqrt((diff * diff).sum(axis=1))
            keep = (ids[g] != qid) & (d <= bound)
            if keep.any():
                best_d, best_i = np.concatenate([best_d, d[keep]]), np.concatenate([best_i, ids[g][keep]])
                if len(best_d) >= k:
                    top = np.lexsort((best_i, best_d))[:k]
                    best_d, best_i = best_d[top], best_i[top]
                    bound = min(bound, best_d[-1])
        found.append(pd.DataFrame({"query_id": qid, "vec_id": best_i, "score": best_d}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, m: int = 8,
           confidence: float = 0.98, cell_rows: int = 8192, sample_rows: int = 20_000, query_rows: int = 2048, seed: int = 29) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row whose id ``every`` divides.

    Every usable vector is indexed; the sample of about ``sample_rows`` rows only places the
    cells' cuts.  A cell with more than ``cell_rows`` rows (many copies of one vector) is dealt
    to several blocks; queries of neighbouring cells are taken in blocks of about ``query_rows``, and a block of
    the index is sent only to the query blocks that ask for it.  Ties go to the
    smaller id; with fewer than k candidates all are given.  See ``vectors.usable`` for rows
    that take no part and repeated ids.  No usable vector or query: an empty result.
    """
    data = store(usable(rows, id_col, vec_col), "vectors")
    n = data.count()
    head = data.select(F.size("vec").alias("d")).first()
    matrix_r = np.random.default_rng(seed).normal(size=(head["d"] if head else 1, m))
    fitted = sample(data, n, sample_rows, "vec")
    points = matrix(fitted["vec"]) @ matrix_r if len(fitted) else np.zeros((0, m))
    cells = Cells(points, max(8, int(cell_rows * len(points) / max(n, 1))))
    limit = chi_square_quantile(confidence, m)

    @F.pandas_udf("struct<proj:array<double>,cell:bigint>")
    def placed(vec: pd.Series) -> pd.DataFrame:
        p = matrix(vec) @ matrix_r if len(vec) else np.zeros((0, m))
        return pd.DataFrame({"proj": list(p), "cell": cells.find(p)})

    index = store(data.withColumn("p", placed("vec")).select("id", "vec", "p.proj", "p.cell"), "index")
    # one row per cell, so at most as many as the sample's cells
    is_query = F.col("id") % every == 0
    stats = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("queries"), *[F.min(F.get("proj", F.lit(i))).alias(f"lo{i}") for i in range(m)],
                                      *[F.max(F.get("proj", F.lit(i))).alias(f"hi{i}") for i in range(m)]).orderBy("cell").toPandas()
    numbers = stats["cell"].to_numpy()
    low, high = stats[[f"lo{i}" for i in range(m)]].to_numpy(float), stats[[f"hi{i}" for i in range(m)]].to_numpy(float)
    parts = -(-stats["n"].to_numpy() // cell_rows)
    parts_of = dict(zip(numbers.tolist(), parts.tolist()))
    # cells are numbered along the tree: neighbours share a query block, a cell of very many queries has several
    asks = stats["queries"].to_numpy()
    shares = np.maximum(1, -(-asks // query_rows))
    first_share = np.cumsum(np.where(shares > 1, shares, 0)) - np.where(shares > 1, shares, 0) + (np.cumsum(asks) - asks) // query_rows
    share_of = {c: (int(f), int(s)) for c, f, s in zip(numbers.tolist(), first_share, shares)}

    @F.pandas_udf("bigint")
    def query_block(cell: pd.Series, spot: pd.Series) -> pd.Series:
        return pd.Series([share_of[c][0] + x % share_of[c][1] for c, x in zip(cell, spot)], dtype="int64")

    queries = index.filter(is_query).withColumn("qb", query_block("cell", F.pmod(F.xxhash64("id"), F.lit(1 << 40))))

    @F.pandas_udf("array<bigint>")
    def own_parts(cell: pd.Series) -> pd.Series:
        return pd.Series([[c * 65536 + s for s in range(parts_of[c])] for c in cell])

    @F.pandas_udf("array<bigint>")
    def open_parts(proj: pd.Series, cell: pd.Series, bound: pd.Series) -> pd.Series:
        out = []
        for p, c, b in zip(matrix(proj), cell, bound):
            near = (box_distance(low, high, p) <= limit * b * b + slack(p)) & (numbers != c)
            out.append([int(x) * 65536 + s for x in numbers[near] for s in range(parts_of[int(x)])])
        return pd.Series(out)

    salt = F.create_map(*[F.lit(x) for c, s in parts_of.items() if s > 1 for x in (c, s)]) if max(parts_of.values(), default=1) > 1 else None
    of_cell = F.coalesce(salt[F.col("cell")], F.lit(1)) if salt is not None else F.lit(1)
    blocks = index.withColumn("block", F.col("cell") * 65536 + F.pmod(F.xxhash64("id"), of_cell))

    def run(_: tuple, rows_: pd.DataFrame, queries_: pd.DataFrame) -> pd.DataFrame:
        if not len(rows_) or not len(queries_):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(matrix(rows_["vec"]), matrix(rows_["proj"]), rows_["id"].to_numpy(), queries_, k, limit)

    def visit(asked: DataFrame) -> DataFrame:
        asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("block", "qb", "id", "vec", "proj", "bound")])
        wanted = asked.select(F.col("q_block").alias("block"), F.col("q_qb").alias("qb")).distinct()
        return blocks.join(wanted, "block").select("block", "qb", "id", "vec", "proj").groupBy("block", "qb").cogroup(asked.groupBy("q_block", "q_qb")).applyInPandas(
            run, "query_id bigint, vec_id bigint, score double")

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    cols = ["id", "qb", "vec", "proj"]
    first = visit(queries.select(*cols, F.lit(float("inf")).alias("bound"), F.explode(own_parts("cell")).alias("block")))
    first = store(first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "first")
    bounds = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    asked = queries.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    second = visit(asked.select(*cols, "bound", F.explode(open_parts("proj", "cell", "bound")).alias("block")))
    both = first.drop("rank").unionByName(second).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")
