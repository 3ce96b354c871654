"""Near-duplicate embeddings by cover trees and dual traversal.

On unit vectors cosine >= c is a distance of at most sqrt(2 - 2c).  Rows are dealt to the nodes
of a shallow cover tree fitted on a bounded sample; nodes near each other share a block, one with many
rows is dealt to several.  A row is sent to the pairs of its block with every block that may hold a row
within reach, by two tests on its distances from the nodes.  In a pair's task
each block is a cover tree of its own (levels of halving radii) and both are walked together: a
node pair farther apart than the reach and both radii is dropped, one that lies within it as a
whole is counted without forming pairs, and leaves are compared by exact cosines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import store
from .vectors import matrix, sample, usable

SLACK = 1e-7  # of distances computed from inner products; only ever keeps more pairs for the exact test


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


@dataclass
class Node:
    """Row numbers below a centre, all within ``radius`` of it; a leaf has no children."""

    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def build(x: np.ndarray, rows: np.ndarray, scale: float, floor: float, leaf: int = 256, fan: int = 48) -> Node:
    """Cover tree of ``x[rows]``: children cover the node's rows within half its scale.

    At most ``fan`` children are opened at a level; rows none of them covers stay together in
    one leaf (their nodes would hold one row each).
    """
    centre = x[rows[0]]
    d = distances(x[rows], centre[None])[:, 0]
    node = Node(rows, centre, float(d.max()) + SLACK)
    if len(rows) <= leaf or node.radius <= floor:
        return node
    half, left = scale / 2, rows
    while half > node.radius:
        half /= 2
    groups = []
    for _ in range(fan):
        if not len(left):
            break
        near = distances(x[left], x[left[0]][None])[:, 0] <= half
        groups.append(left[near])
        left = left[~near]
    if len(groups) == 1 and not len(left):
        return build(x, rows, half, floor, leaf, fan)
    small = [g for g in groups if len(g) < 4]
    node.children = [build(x, g, half, floor, leaf, fan) for g in groups if len(g) >= 4]
    rest = np.concatenate([left, *small])
    if len(rest) == len(rows):
        node.children = []
    elif len(rest):
        d = distances(x[rest], x[rest[0]][None])[:, 0]
        node.children.append(Node(rest, x[rest[0]], float(d.max()) + SLACK))
    return node


class Links:
    """Link counts and a spanning forest of the links seen, over the rows of one task."""

    def __init__(self, n: int):
        self.count, self.parent = np.zeros(n, np.int64), np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            r, s = self.root(i), self.root(j)
            if r != s:
                self.parent[max(r, s)] = min(r, s)

    def all_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every row of ``a`` with every row of ``b`` (the same array: with every other)."""
        if a is b:
            self.count[a] += len(a) - 1
        else:
            self.count[a] += len(b)
            self.count[b] += len(a)
        self.join(np.concatenate([a[1:], b]), np.full(len(a) - 1 + len(b), a[0]))

    def matrix(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        self.count[a] += linked.sum(axis=1)
        self.count[b] += linked.sum(axis=0)
        while linked.any():
            # the row with most links joins its partners; rows that share them need no more edges of those columns
            some = np.flatnonzero(linked.any(axis=1))
            r = some[np.argmax(linked[some].sum(axis=1))]
            cols = np.flatnonzero(linked[r])
            self.join(b[cols], np.full(len(cols), a[r]))
            part = linked[:, cols]
            hit = np.flatnonzero(part.any(axis=1))
            self.join(a[hit], b[cols[part[hit].argmax(axis=1)]])
            linked[:, cols] = False


def compare(x: np.ndarray, norms: np.ndarray, raw: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, links: Links, tile: int = 512) -> None:
    """Exact cosines of two leaves, a tile of rows at a time."""
    same = a is b
    for i in range(0, len(a), tile):
        rows = a[i:i + tile]
        cols = b[i:] if same else b
        cos = x[rows] @ x[cols].T
        linked = cos >= least
        for r, c in zip(*np.nonzero(np.abs(cos - least) < 1e-9)):  # settle what rounding could turn
            linked[r, c] = raw[rows[r]] @ raw[cols[c]] / (norms[rows[r]] * norms[cols[c]]) >= least
        if same:  # pairs once: columns behind the row
            linked &= np.arange(len(cols))[None] > np.arange(len(rows))[:, None]
        if linked.any():
            r, c = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            links.matrix(rows[r], cols[c], linked[np.ix_(r, c)])


def traverse(raw: np.ndarray, first: int, least: float) -> Links:
    """Links among rows of two blocks: rows before ``first`` against the rest, or, with none behind, within one block."""
    norms = np.sqrt((raw * raw).sum(axis=1))
    x = raw / norms[:, None]
    reach = float(np.sqrt(2 - 2 * least))
    links = Links(len(x))
    a = build(x, np.arange(first), 2.0, reach / 8)
    b = a if first == len(x) else build(x, np.arange(first, len(x)), 2.0, reach / 8)
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        d = 0.0 if p is q else float(distances(p.centre[None], q.centre[None])[0, 0])
        if d - p.radius - q.radius > reach + SLACK:
            continue
        if d + p.radius + q.radius < reach - SLACK:
            links.all_pairs(p.rows, q.rows)
        elif p is q:
            if p.children:
                todo += [(u, v) for i, u in enumerate(p.children) for v in p.children[i:]]
            else:
                compare(x, norms, raw, p.rows, p.rows, least, links)
        elif not p.children and not q.children:
            compare(x, norms, raw, p.rows, q.rows, least, links)
        elif not q.children or (p.children and p.radius >= q.radius):
            todo += [(u, q) for u in p.children]
        else:
            todo += [(p, v) for v in q.children]
    return links


def cover_pivots(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of the cover-tree level, radii halving, that first has ``cells`` nodes or covers every row by itself."""
    if not len(x):
        return x
    radius, centres = 2.0, [0]
    while len(centres) < cells and radius > 1e-3:
        radius /= 2
        near = distances(x, x[centres]).min(axis=1)
        while near.max() > radius and len(centres) < cells:
            centres.append(int(near.argmax()))
            near = np.minimum(near, distances(x, x[centres[-1:]])[:, 0])
    return x[centres]


def neighbours_first(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order that keeps close ones together: by the coarse pivot each is nearest to, then by the distance from it."""
    coarse = distances(pivots, pivots[:max(1, int(len(pivots) ** 0.5))])
    return np.lexsort((coarse.min(axis=1), coarse.argmin(axis=1)))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, cell_rows: int = 4096,
                    block_rows: int = 40_000, sample_rows: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    n_links counts the other usable vectors of cosine >= ``least``, component_id is the smallest
    id reachable over links.  Vectors that take no part (``vectors.usable``) link with nothing
    and are kept as components of their own.  Rows with the same id give equal rows; a null id
    has a null component and is not kept.  Links are exact: the sample, of ``sample_rows`` or, for
    very many rows, up to 16 times as many, only chooses the cells.  A task holds two blocks
    of about ``block_rows``.
    """
    data = store(usable(rows, id_col, vec_col), "vectors")
    n = data.count()
    fitted = matrix(sample(data, n, max(sample_rows, min(16 * sample_rows, 8 * (n // cell_rows))), "vec")["vec"]) if n else np.zeros((0, 1))
    unit = fitted / np.sqrt((fitted * fitted).sum(axis=1))[:, None] if len(fitted) else fitted
    pivots = cover_pivots(unit, max(1, min(len(unit) // 8, n // cell_rows)))
    pivots = pivots[neighbours_first(pivots)] if len(pivots) else np.zeros((1, 1))

    @F.pandas_udf("struct<cell:bigint,off:double>")
    def placed(vec: pd.Series) -> pd.DataFrame:
        v = matrix(vec)
        v = v / np.sqrt((v * v).sum(axis=1))[:, None]
        d = distances(v, pivots)
        return pd.DataFrame({"cell": d.argmin(axis=1), "off": d.min(axis=1)})

    index = store(data.withColumn("p", placed("vec")).select("id", "vec", "p.cell", "p.off"), "index")
    # one row per cell, at most an eighth of the sample
    stats = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius")).orderBy("cell").collect()
    radius = np.full(len(pivots), -np.inf)  # of cells with rows
    first, parts, block, filled = np.zeros(len(pivots), int), np.ones(len(pivots), int), 0, 0
    for r in stats:
        c = r["cell"]
        radius[c], parts[c] = r["radius"], -(-r["n"] // block_rows)
        if filled and (parts[c] > 1 or filled + r["n"] > block_rows):
            block, filled = block + 1, 0
        first[c], filled = block, filled + r["n"]
        if parts[c] > 1:
            block, filled = block + int(parts[c]), 0
    total = block + 1
    holds = np.zeros((len(pivots), total), np.float32)  # which blocks a cell's rows lie in
    for r in stats:
        holds[r["cell"], first[r["cell"]]:first[r["cell"]] + parts[r["cell"]]] = 1
    reach = float(np.sqrt(2 - 2 * least))

    @F.pandas_udf("array<bigint>")
    def meetings(vec: pd.Series, cell: pd.Series, off: pd.Series, block: pd.Series) -> pd.Series:
        """Block pairs a row belongs to, each as smaller block * total + larger block."""
        v = matrix(vec)
        d = distances(v / np.sqrt((v * v).sum(axis=1))[:, None], pivots)
        # a row within reach of this one lies within its cell's radius, and no nearer to another pivot than to its own
        meets = (d <= radius[None] + reach + SLACK) & (d - off.to_numpy()[:, None] <= 2 * reach + SLACK)
        meets[np.arange(len(v)), cell] = True
        own = block.to_numpy()
        return pd.Series([np.minimum(o, g) * total + np.maximum(o, g) for o, g in zip(own, map(np.flatnonzero, meets.astype(np.float32) @ holds > 0))])

    @F.pandas_udf("bigint")
    def block_of(cell: pd.Series, spot: pd.Series) -> pd.Series:
        c = cell.to_numpy()
        return pd.Series(first[c] + spot.to_numpy() % parts[c], dtype="int64")

    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    dealt = index.withColumn("block", block_of("cell", spot))
    met = dealt.select("id", "vec", "block", F.explode(meetings("vec", "cell", "off", "block")).alias("pair"))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["block", "id"], ignore_index=True)
        ids, first = p["id"].to_numpy(), int((p["block"] == p["block"].iloc[0]).sum())
        one_block = key[0] // total == key[0] % total
        if first == len(p) and not one_block:  # the other block is empty
            return pd.DataFrame({"id": [], "links": [], "root": []})
        links = traverse(matrix(p["vec"]), first, least)
        has = np.flatnonzero(links.count)
        return pd.DataFrame({"id": ids[has], "links": links.count[has], "root": ids[[links.root(i) for i in has]]})

    found = store(met.groupBy("pair").applyInPandas(run, "id bigint, links bigint, root bigint"), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    classes = components(found, "id", "root")
    out = rows.select(F.col(id_col).alias("_id")).join(counts.withColumnRenamed("id", "_id"), "_id", "left").join(
        classes.withColumnRenamed("node", "_id"), "_id", "left")
    component = F.coalesce("component", F.col("_id").cast("long"))
    return out.select(F.col("_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("_id").cast("long") == component, F.lit(False)).alias("kept"))
