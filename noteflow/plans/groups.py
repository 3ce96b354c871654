"""One Python pass over (keys, chunk) groups, each with an entry state.

Rows and entry states are dealt together by one exchange on the group columns,
right before the pass: no join or runtime re-plan decides where a group lies.
A group's entry state is its first row; rows follow in order.  A batch is turned
into arrays once and groups are slices of them, so thousands of groups of one or two rows
cost little more than one long group.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ENTRY = "want"


class Group:
    """The rows of one group: ``group[column]`` is an array, ``group.want`` the entry state."""

    __slots__ = ("_arrays", "_lo", "_hi", "want")

    def __init__(self, arrays: dict[str, np.ndarray], lo: int, hi: int, want: str | None = None) -> None:
        self._arrays, self._lo, self._hi, self.want = arrays, lo, hi, want

    def __getitem__(self, name: str) -> np.ndarray:
        return self._arrays[name][self._lo:self._hi]

    def __len__(self) -> int:
        return self._hi - self._lo

    def key(self, names: Sequence[str], times: int = 1) -> dict[str, list]:
        """The group's columns ``names``, each ``times`` times."""
        return {c: [self._arrays[c][self._lo]] * times for c in names}


def _array(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers as a numpy array (null is NaN), anything else as Python objects."""
    if pa.types.is_nested(column.type):
        out = np.empty(len(column), object)
        for i, v in enumerate(column.to_pylist()):
            out[i] = v
        return out
    return column.to_numpy()


def _starts(table: pa.RecordBatch, part: Sequence[str], before: list | None) -> np.ndarray:
    """Positions at which a group begins; ``before`` holds the group columns of the row before the first."""
    new = np.zeros(table.num_rows, bool)
    for i, c in enumerate(part):
        col = table.column(c)
        new[1:] |= pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)), True).to_numpy(zero_copy_only=False)
        if before is not None:
            new[0] |= col[0].as_py() != before[i]
        if col.null_count:  # nulls are one group
            null = col.is_null().to_numpy(zero_copy_only=False)
            new[1:] &= ~(null[1:] & null[:-1])
    if before is None:
        new[0] = True
    return np.flatnonzero(new)


def map_groups(rows: DataFrame, entries: DataFrame | None, part: Sequence[str], order: Sequence[str],
               one: Callable[[Group], dict], schema: T.StructType) -> DataFrame:
    """Apply ``one`` to every group of ``part``; it returns lists for the columns of ``schema``.

    ``entries`` (part, want) gives each group's state, found as ``want`` of the group.
    Groups pass through in batches, so memory holds one batch and one group.
    """
    part, order, names = list(part), list(order), schema.fieldNames()
    lead = 0
    if entries is not None:
        blank = {f.name: F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType) for f in rows.schema if f.name not in part}
        heads = entries.select(*part, ENTRY, *[c.alias(n) for n, c in blank.items()])
        rows = rows.withColumn(ENTRY, F.lit(None).cast("string")).unionByName(heads)
        order, lead = [F.col(ENTRY).isNull(), *order], 1
    out_schema = to_arrow_schema(schema)

    def work(held: list[pa.RecordBatch], cuts: list[int]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        arrays = {c: _array(table.column(c)) for c in table.column_names}
        out: dict[str, list] = {c: [] for c in names}
        for lo, hi in zip(cuts, cuts[1:]):
            for c, v in one(Group(arrays, lo + lead, hi, arrays[ENTRY][lo] if lead else None)).items():
                out[c] += v
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type, from_pandas=True) for f in out_schema], schema=out_schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _starts(batch, part, before)
            before = [batch.column(c)[batch.num_rows - 1].as_py() for c in part]
            if len(new) and (held or len(new) > 1):
                size = sum(h.num_rows for h in held)
                cuts = ([0] if held else []) + [size + int(i) for i in new]
                yield work([*held, batch.slice(0, int(new[-1]))], cuts)
                held = []
            held.append(batch.slice(int(new[-1])) if len(new) else batch)
        if held:
            yield work(held, [0, sum(h.num_rows for h in held)])

    return rows.repartition(*part).sortWithinPartitions(*part, *order).mapInArrow(over, schema)
