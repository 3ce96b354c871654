"""Registered queries and their oracle statements."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Adapter views for the oracle, in dependency order (FIXTURES.md, section 2).
VIEWS: dict[str, str] = {
    "notes": """
select event_id as note_id, user_id as song_id,
  case event_type when 'click' then 'piano' when 'view' then 'vocals'
       when 'purchase' then 'bass' when 'signup' then 'guitar' else 'drums' end as stem,
  48 + k % 24 as pitch, us / 150000000e0 as start_ms,
  us / 150000000e0 + 20e0 + value * 6e0 as end_ms,
  1 + k as velocity, least(1e0, value / 100e0) as confidence
from (select event_id, user_id, event_type, value,
        cast(json_extract_string(props, '$.k') as bigint) as k,
        epoch_us(ts) - 1704067200000000 as us from events) e""",
    "beats": """
select song_id, i as beat_idx, t0 + i * 480e0 + (song_id * 7 + i * 13) % 40 as t_ms
from (select song_id, i, t0 from (
  select song_id, t0, unnest(range(0, cast(floor((t1 - t0) / 480e0) as bigint) + 2)) as i
  from (select song_id, min(start_ms) as t0, max(end_ms) as t1 from notes group by song_id) a) b) c""",
    "onsets": """
select song_id, stem, case when note_id % 2 = 0 then 'w1' else 'w2' end as witness,
  greatest(0e0, start_ms + (note_id * 37) % 50 - 25) as t_ms, confidence as energy
from notes where note_id % 3 <> 0""",
    "annotations": """
select note_id, 'onset_refinement' as kind, note_id as seq, start_ms - note_id % 30 as value from notes
union all
select note_id, 'onset_refinement', note_id + 1000000000, start_ms + note_id % 7 from notes where note_id % 5 = 0
union all
select note_id, 'sustain_extension', note_id, end_ms + note_id % 90 from notes where note_id % 2 = 0""",
    "tempo_witnesses": """
select o_custkey as song_id, o_orderpriority as source,
  60e0 + cast(sum(o_orderkey) % 1200 as double) / 10e0 as tempo_bpm,
  0.3e0 + cast(max(o_orderkey) % 60 as double) / 100e0 as confidence,
  case o_orderpriority when '1-URGENT' then 1e0 when '2-HIGH' then 0.8e0
       when '3-MEDIUM' then 0.7e0 else 0.6e0 end as weight
from orders group by o_custkey, o_orderpriority""",
    "sections": """
select distinct song_id, cast(floor(start_ms / 4000e0) as bigint) as idx,
  substr('ABC', cast((floor(start_ms / 4000e0) * floor(start_ms / 4000e0)) % 3 as int) + 1, 1) as label,
  floor(start_ms / 4000e0) * 4000e0 as start_ms, floor(start_ms / 4000e0) * 4000e0 + 4000e0 as end_ms
from notes""",
    "frames": """
select l_suppkey as song_id, rn - 1 as frame_idx, (rn - 1) * 23.22e0 as t_ms,
  l_quantity / 50e0 as rms, l_extendedprice / 100000e0 as flux, l_discount * 10e0 as flatness,
  case when l_linenumber % 4 = 0 then 0e0 else 110e0 * power(2e0, (l_partkey % 24) / 12e0) end as hz
from (select *, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey,
        l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) as rn
      from lineitem) f""",
    "telemetry": """
select user_id as session, row_number() over (partition by user_id order by ts, event_id) as seq,
  ts as t_wall, event_type as stage,
  case when k < 10 then 'stage_start' when k < 20 then 'stage_end' else 'decision' end as type,
  'd' || cast(k % 31 as varchar) as decision_type
from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) e""",
}
NEEDS = {"beats": ["notes"], "onsets": ["notes"], "annotations": ["notes"], "sections": ["notes"]}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SECTIONS = (
    "filters", "lookups", "keys", "tempo", "rhythm",
    "quantize", "patterns", "lines", "evaluation", "hands", "page", "frames", "scans", "telemetry", "alignment", "sinks", "borders",
)


def r6(c):
    """Round to 6 places after a tiny shift, so that exact halves fall the same way in both engines."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1.37e-8), 6)


def half6(c):
    """Round to 6 places by way of millionths, as DuckDB does: a time halfway in decimals may lie below it as a double."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


def drawn(number: str, salt: int) -> str:
    """SQL of the draw that ``functions.draws.uniform`` makes of a whole number."""
    step = f"((({number}) % 1000000007) * 48271 + {salt * 69621 + 1013904223}) % 2147483647"
    return f"(((({step}) * 48271 + ({number}) % 65521) % 2147483647 * 16807 + {salt}) % 2147483647 + 0.5e0) / 2147483647e0"


def with_views(views: str, ctes: str, body: str) -> str:
    """Oracle statement with the adapter views it needs as leading CTEs."""
    wanted: list[str] = []
    for v in views.split():
        for need in [*NEEDS.get(v, []), v]:
            if need not in wanted:
                wanted.append(need)
    parts = [f"{v} as ({VIEWS[v]})" for v in wanted]
    if ctes.strip():
        parts.append(ctes.strip())
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def query(name: str, views: str = "", ctes: str = "", sql: str | None = None):
    """Register a Spark query and, when given, the statement it must agree with."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, ctes, sql)
        return fn

    return wrap


def load() -> None:
    """Import every section so that its queries register."""
    for s in SECTIONS:
        importlib.import_module(f"noteflow.catalog.{s}")
