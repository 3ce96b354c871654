"""Run telemetry (batch forms; the streams are tested against them)."""

from pyspark.sql import functions as F

from ..sources import corpus as c
from ..sources import tables as tb
from ..streaming import telemetry as t
from .registry import query


@query("l01_event_dedupe", "telemetry", "", "select session, seq, type from telemetry")
def l01(s, d):
    e = c.telemetry(s, d)
    return t.deduplicated(e.unionByName(e.filter("seq % 3 = 0"))).select("session", "seq", "type")


@query("l02_stage_timing", "telemetry", """
x as (select *, last_value(case when type = 'stage_start' then seq end ignore nulls) over w as ss, last_value(case when type = 'stage_start' then t_wall end ignore nulls) over w as st from telemetry where type <> 'decision'
  window w as (partition by session, stage order by seq rows between unbounded preceding and current row))""", """
select session, stage, ss as start_seq, seq as end_seq, round((epoch_us(t_wall) - epoch_us(st)) / 1000e0, 3) as elapsed_ms from x where type = 'stage_end' and ss is not null""")
def l02(s, d):
    return t.stage_timings(c.telemetry(s, d)).withColumn("elapsed_ms", F.round("elapsed_ms", 3))


MS = ["click:d4", "view:d9", "purchase:d14", "signup:d2", "error:d7", "click:d20", "view:d30", "error:d11"]
MSL = "(" + ", ".join(f"'{m}'" for m in MS) + ")"


@query("l03_run_progress", "telemetry", "", f"""
select session, arg_max(stage, seq) filter (where type = 'decision') as current_stage, count(*) filter (where type = 'decision') as decisions,
  count(distinct case when type = 'decision' and stage || ':' || decision_type in {MSL} then stage || ':' || decision_type end) as milestones,
  least(1, count(distinct case when type = 'decision' and stage || ':' || decision_type in {MSL} then stage || ':' || decision_type end) / 8e0) as fraction from telemetry group by session""")
def l03(s, d):
    return t.progress(c.telemetry(s, d), MS, ()).select("session", "current_stage", "decisions", "milestones", "fraction")


@query("l04_quiet_sessions", "telemetry", """
x as (select session, max(t_wall) as la from telemetry group by session)""", """
select session, round((epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(la)) / 1000e0, 3) as silent_ms from x where epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(la) > 20000000""")
def l04(s, d):
    q = t.quiet_sessions(t.progress(c.telemetry(s, d), MS, ()), "2024-01-31 00:00:00")
    return q.select("session", F.round("silent_ms", 3).alias("silent_ms"))


@query("l05_session_stats", "telemetry", "", """
select session, count(*) as emitted, least(count(*), 60) as retained, greatest(count(*) - 60, 0) as evicted, round((epoch_us(max(t_wall)) - epoch_us(min(t_wall))) / 1000e0, 3) as uptime_ms from telemetry group by session""")
def l05(s, d):
    x = t.session_stats(c.telemetry(s, d), 60)
    return x.select("session", "emitted", *[F.col(v).cast("bigint").alias(v) for v in ("retained", "evicted")], F.round("uptime_ms", 3).alias("uptime_ms"))


@query("t01_ledger_query", "telemetry", "", "select session, seq, decision_type from telemetry where type = 'decision' and decision_type = 'd7' and stage = 'click'")
def t01(s, d):
    q = tb.query_decisions(c.telemetry(s, d).filter("type = 'decision'"), "d7", "click")
    return q.select("session", "seq", "decision_type")


@query("t02_last_events", "telemetry", "", """
select session, seq, type from (select *, row_number() over (partition by session order by seq desc) as r from telemetry) q where r <= 5""")
def t02(s, d):
    return t.last_events(c.telemetry(s, d), 5).select("session", "seq", "type")


@query("r08_pulse_annealing", "notes", """
rd as (select song_id, 480e0 as period_ms, start_ms as t_ms, max(confidence) as strength, row_number() over (partition by song_id order by start_ms) as k, start_ms - lag(start_ms) over (partition by song_id order by start_ms) as dt from notes group by song_id, start_ms),
an(song_id, k, t_ms, a) as (select song_id, k, t_ms, strength from rd where k = 1 union all select r.song_id, r.k, r.t_ms, n.a * exp(-0.00005e0 * r.dt) + r.strength * (1 - exp(-0.00005e0 * r.dt)) from an n join rd r on r.song_id = n.song_id and r.k = n.k + 1)""", """
select song_id, round(t_ms, 6) as t_ms, round(a, 8) as annealed from an""")
def r08(s, d):
    rd = c.notes(s, d).groupBy("song_id", F.col("start_ms").alias("t_ms")).agg(F.max("confidence").alias("strength")).withColumn("period_ms", F.lit(480.0))
    return t.anneal(rd).select("song_id", F.round("t_ms", 6).alias("t_ms"), F.round("annealed", 8).alias("annealed"))
