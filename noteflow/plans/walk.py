"""Leaps along a sequence: from a row, on to the first row beyond its reach.

Anchored groups (a group ends where its first event is out of reach) and greedy
choices of figures (one taken blocks the starts inside it) are walks of this
kind.  Where a walk enters a chunk decides where it leaves, and only the rows
within one reach of the chunk's start can be entered, so a chunk is a short
table "entered up to here -> left there".  The tables of a song are followed in
order, one small row per chunk, and a second pass marks the rows stepped on.
"""

from __future__ import annotations

import json
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint
from .groups import Group, map_groups
from .timeline import CHUNK


def _leaps(x: np.ndarray, reach: np.ndarray, closed: bool) -> np.ndarray:
    """Index of the first row out of each row's reach; a distance equal to it is in reach unless ``closed``."""
    n = len(x)
    to = np.searchsorted(x, x + reach, "left" if closed else "right")
    # decided by the difference, as a sum may round across the border
    beyond = (lambda j: x[j] - x >= reach) if closed else (lambda j: x[j] - x > reach)
    back = np.maximum(to - 1, 0)
    to = np.where((back > np.arange(n)) & beyond(back), back, to)
    here = np.minimum(to, n - 1)
    return np.where((to < n) & ~beyond(here), to + 1, to)


def _enter(x: np.ndarray, state: list | None, closed: bool) -> int:
    if state is None:
        return 0
    gap = x - state[0]
    out = gap >= state[1] if closed else gap > state[1]
    return int(np.argmax(out)) if out.any() else len(x)


def walk(rows: DataFrame, keys: Sequence[str], x: str, reach: str, width: float, closed: bool = False) -> DataFrame:
    """Columns keys, chunk, ``x``: the rows stepped on, from each key's first row; also the last one before each chunk.

    ``rows`` has keys, ``x`` (one row for each value of a key) and ``reach``, and is read
    three times.  ``closed``: a row at exactly the reach is stepped on.
    """
    keys = list(keys)
    part = [*keys, CHUNK]
    r = rows.select(*keys, F.col(x).cast("double").alias("_x"), F.col(reach).cast("double").alias("_r"),
                    F.floor(F.col(x) / F.lit(float(width))).alias(CHUNK))
    longest = float(r.agg(F.max("_r")).first()[0] or 0.0)
    fields = [r.schema[k] for k in part]

    def table(p: Group) -> dict:
        at, far = p["_x"], p["_r"]
        to = _leaps(at, far, closed).tolist()
        left = [0] * len(at)
        for i in range(len(at) - 1, -1, -1):
            left[i] = i if to[i] >= len(at) else left[to[i]]
        start = float(p[CHUNK][0]) * width
        steps, i = [], 0
        while i < len(at) and (i == 0 or at[i - 1] <= start + longest):
            if steps and steps[-1][3] == left[i]:
                steps[-1][0] = at[i]
            else:
                steps.append([at[i], at[left[i]], far[left[i]], left[i]])
            i += 1
        return {**p.key(part), "steps": [json.dumps([s[:3] for s in steps])]}

    tables = checkpoint(map_groups(r, None, part, ["_x"], table, T.StructType([*fields, T.StructField("steps", T.StringType())])))

    def follow(p: Group) -> dict:
        state, want = None, []
        for steps in p["steps"]:
            want.append(json.dumps(state))
            for last, at, far in json.loads(steps):
                if state is None or (last - state[0] >= state[1] if closed else last - state[0] > state[1]):
                    state = [at, far]
                    break
        return {**{k: p[k].tolist() for k in part}, "want": want}

    entries = map_groups(tables, None, keys, [CHUNK], follow, T.StructType([*fields, T.StructField("want", T.StringType())]))

    def mark(p: Group) -> dict:
        at, state = p["_x"], json.loads(p.want)
        to, got = _leaps(at, p["_r"], closed), [] if state is None else [state[0]]
        i = _enter(at, state, closed)
        while i < len(at):
            got.append(float(at[i]))
            i = int(to[i])
        return {**p.key(part, len(got)), "_x": got}

    marks = map_groups(r, entries, part, ["_x"], mark, T.StructType([*fields, T.StructField("_x", T.DoubleType())]))
    return marks.withColumnRenamed("_x", x)
