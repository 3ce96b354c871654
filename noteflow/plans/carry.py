"""Exact state machines over a song without one task per song.

Greedy assignments (voice lines, melodic threads, staff voices) read a song in
order and keep a small open state.  Here every (song, time chunk) runs in
parallel from a guessed entry state; a chunk whose guess differs from the exit
state of the chunk before it runs again, until nothing changes.  The first
chunk of a song is right from the start and silence empties the state, so a few
rounds settle a corpus; the result equals the sequential one.

A chunk reports a line it did not touch, or only counted on, as ``Kept``: such
exits are composed along the song between rounds, so a state that outlives many
chunks reaches the last of them in one round instead of one round per chunk.

Rows and entry states of a chunk are dealt together by (keys, chunk) in one
exchange right before the pass; no join decides where they lie.

States carry no line ids (only what later decisions look at), so they settle
even when a line outlives many chunks; ids are threaded through afterwards from
the per-chunk exit tables.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any, Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint
from .groups import Group, map_groups
from .timeline import CHUNK, CHUNK_MS


@dataclass(frozen=True)
class Kept:
    """Exit state of an entry line: the entry state, ``add`` added element by element."""

    add: tuple = ()


# run(rows in order, entry states, chunk end) -> (label per row, [(label, state)]):
# a label is a row position (a line that row opens) or ~k for the k-th entry state;
# a state is a list of numbers, or Kept for an entry line.
Run = Callable[[Group, list, float], tuple[list[int], list[tuple[int, Any]]]]


def carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], run: Run,
          row_id: str, name: str = "line_id", chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Add ``name``: the row_id of the first row of the line each row was assigned to.

    Runs Spark jobs while settling; ``df`` should be cheap to re-read.
    """
    keys, order = list(keys), list(order)
    part = [*keys, CHUNK]
    width = float(chunk_ms)
    need = list(dict.fromkeys([*keys, row_id, *order, *cols]))
    rows = df.select(*need).withColumn(CHUNK, F.floor(F.col(order[0]) / F.lit(width)))
    key_fields = [rows.schema[k] for k in part]
    id_type = rows.schema[row_id].dataType

    def execute(p: Group):
        end = (float(p[CHUNK][0]) + 1.0) * width
        return run(p, json.loads(p.want), end)

    def summarise(p: Group) -> dict:
        _, leaving = execute(p)
        ids = p[row_id].tolist()
        states = [{"k": ~a, "d": list(s.add)} if isinstance(s, Kept) else {"s": s} for a, s in leaving]
        return {**p.key(part), "used": [p.want], "leave": [json.dumps(states)], "ids": [[ids[a] if a >= 0 else None for a, _ in leaving]],
                "slots": [[-1 if a >= 0 else ~a for a, _ in leaving]]}

    def emit(p: Group) -> dict:
        labels, _ = execute(p)
        ids = p[row_id].tolist()
        return {row_id: ids, **p.key(part, len(p)), "_own": [ids[a] if a >= 0 else None for a in labels], "_slot": [-1 if a >= 0 else ~a for a in labels]}

    def apply(entries: DataFrame, one, schema: T.StructType, some: bool = False) -> DataFrame:
        given = rows.join(entries.select(*part), part, "left_semi") if some else rows
        return map_groups(given, entries, part, order, one, schema)

    sum_schema = T.StructType([*key_fields, T.StructField("used", T.StringType()), T.StructField("leave", T.StringType()),
                               T.StructField("ids", T.ArrayType(id_type)), T.StructField("slots", T.ArrayType(T.IntegerType()))])
    out_schema = T.StructType([rows.schema[row_id], *key_fields, T.StructField("_own", id_type), T.StructField("_slot", T.IntegerType())])

    def compose(t: Group) -> dict:
        """Entry state of each chunk from the exits before it: one small row per chunk of a song."""
        now: list = []
        want = []
        for used, leave in zip(t["used"], t["leave"]):
            want.append(json.dumps(now))
            known, after = len(json.loads(used)), []
            for x in json.loads(leave):
                if "s" in x:
                    after.append(x["s"])
                elif x["k"] < len(now):
                    after.append([a + b for a, b in zip(now[x["k"]], x["d"])] if x["d"] else now[x["k"]])
            now = after + now[known:]  # lines the chunk has not met yet pass it by
        return {**{c: t[c].tolist() for c in sum_schema.fieldNames()}, "want": want}

    want_schema = T.StructType([*sum_schema.fields, T.StructField("want", T.StringType())])

    def wanted(table: DataFrame) -> DataFrame:
        return map_groups(table, None, keys, [CHUNK], compose, want_schema)

    start = rows.select(*part).distinct().withColumn("want", F.lit("[]"))
    table = checkpoint(apply(start, summarise, sum_schema))
    while True:
        state = checkpoint(wanted(table))
        stale = state.filter("want <> used").select(*part, "want")
        if stale.isEmpty():
            break
        again = apply(stale, summarise, sum_schema, some=True)
        table = checkpoint(table.join(stale.select(*part), part, "left_anti").unionByName(again.select(*table.columns)))

    done = apply(state, emit, out_schema)

    # thread ids through the exit tables: one small row per chunk
    def resolve(t: Group) -> dict:
        before: list = []
        got = []
        for ids, slots in zip(t["ids"], t["slots"]):
            got.append(list(before))
            before = [before[s] if s >= 0 else i for i, s in zip(ids, slots)]
        return {**{c: t[c].tolist() for c in part}, "entry_ids": got}

    ids = map_groups(table.select(*part, "ids", "slots"), None, keys, [CHUNK], resolve, T.StructType([*key_fields, T.StructField("entry_ids", T.ArrayType(id_type))]))
    out = done.join(ids, part).select(row_id, *keys, F.coalesce("_own", F.get("entry_ids", F.col("_slot"))).alias(name))
    return checkpoint(df.join(out, [row_id, *keys]))
