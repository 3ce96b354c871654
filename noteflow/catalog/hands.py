"""Playability and hands."""

from pyspark.sql import functions as F

from ..functions.hands import profile, two_hands
from ..operators import hands as h
from ..operators import evaluation as e
from ..sources import corpus as c
from .evaluation import EV
from .registry import query

FEAS = """
fe as (select song_id, t, {ps} as ps from {src}),
sp as (select song_id, t, ps, list_concat(ps[1:i], ps[j+1:]) as o, ps[i+1:j] as n from fe, range(0, 40) a(i), range(0, 40) b(j) where i <= len(ps) and j >= i and j <= len(ps)),
fs as (select song_id, t, any_value(ps) as ps, bool_or(
  (len(o) = 0 or (len(o) <= 5 and o[-1] - o[1] <= {span} and len([k for k in range(2, len(o) + 1) if o[k] - o[k-1] > 6]) <= 1))
  and (len(n) = 0 or (len(n) <= 5 and n[-1] - n[1] <= {span} and len([k for k in range(2, len(n) + 1) if n[k] - n[k-1] > 6]) <= 1))) and len(any_value(ps)) <= 10 as ok from sp group by song_id, t)"""


def wide(s, d):
    """Notes spread over four octaves and more, so that some chords are out of reach."""
    return c.notes(s, d).withColumn("pitch", F.col("pitch") + 12 * (F.col("note_id") % 4) - 12)


WN = "wn as (select song_id, note_id, start_ms, end_ms, pitch + 12 * (note_id % 4) - 12 as pitch from notes)"
WEV = WN + "," + EV.replace("gp as (select n.*,", "gp as (select n.song_id, n.note_id, n.start_ms, n.end_ms, n.pitch + 12 * (n.note_id % 4) - 12 as pitch,").replace("t <= n.start_ms) as t from notes n)", "t <= n.start_ms) as t from notes n)")


@query("c07_c08_hand_feasibility", "notes", WEV.replace("{w}", "120") + "," + FEAS.format(ps="list_sort(list_distinct(ps))", src="ev", span=12), """
select song_id, round(t, 6) as t_ms, len(ps) as n, ok as playable from fs""")
def c07(s, d):
    ev = e.chord_events(wide(s, d), 120.0).withColumn("ps", F.array_sort(F.array_distinct("pitches")))
    return ev.select("song_id", F.round("t_ms", 6).alias("t_ms"), F.size("ps").cast("bigint").alias("n"),
                     two_hands(F.col("ps"), profile("comfortable"))["ok"].alias("playable"))


@query("w28_max_simultaneity", "notes", """
ev as (select song_id, stem, start_ms as t, 1 as dl, note_id from notes union all select song_id, stem, end_ms, -1, note_id from notes),
lv as (select song_id, stem, sum(dl) over (partition by song_id, stem order by t, dl, note_id) as l from ev)""", "select song_id, stem, cast(max(l) as bigint) as max_notes from lv group by song_id, stem")
def w28(s, d):
    return h.max_simultaneity(c.notes(s, d)).withColumn("max_notes", F.col("max_notes").cast("bigint"))


TL = WN + """,
tm as (select distinct song_id, start_ms as t from wn union select song_id, end_ms from wn),
el as (select song_id, t, lead(t) over (partition by song_id order by t) as t1 from tm),
so as (select e.song_id, e.t, e.t1, list_sort(list(distinct pitch)) as ps from el e join wn n on n.song_id = e.song_id and n.start_ms <= e.t and n.end_ms > e.t where t1 is not null group by all)"""


@query("w29_sounding_timeline", "notes", TL + "," + FEAS.format(ps="ps", src="so", span=17), """
select fs.song_id, round(fs.t, 6) as t0, round(so.t1, 6) as t1, len(fs.ps) as n, case when ok then 'playable' else 'impossible' end as verdict from fs join so on so.song_id = fs.song_id and so.t = fs.t""")
def w29(s, d):
    t = h.sounding_timeline(wide(s, d))
    return t.select("song_id", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), F.size("pitches").cast("bigint").alias("n"), "verdict")


# strikes within 60 ms of the group's first; parts of a roll are 9.6 ms apart
STRIKES = WN + """,
kt as (select distinct song_id, start_ms as t from wn where end_ms > start_ms),
ka(song_id, t) as (select song_id, min(t) from kt group by song_id
  union all select song_id, t from (select a.song_id, (select min(k.t) from kt k where k.song_id = a.song_id and k.t - a.t > 60e0) as t from ka a) q where t is not null),
kn as (select n.*, (select max(a.t) from ka a where a.song_id = n.song_id and a.t <= n.start_ms) as g from wn n where end_ms > start_ms),
kp as (select song_id, g, round_even((start_ms - g) / 9.6e0, 0) as part, list_sort(list(distinct pitch)) as ps, max(end_ms) as e from kn group by all),
kg as (select song_id, g, list_sort(list_distinct(flatten(list(ps)))) as ps, count(*) as parts from kp group by all),
kc as (select song_id, 'w' as what, g, cast(null as double) as part, ps from kg union all select song_id, 'p', g, part, ps from kp),
""" + FEAS.format(ps="ps", src="(select what || ':' || song_id || ':' || g || ':' || coalesce(part, 0) as song_id, 0 as t, ps from kc) z", span=12) + """,
kf as (select what, k.song_id, g, ok from kc k join fs on fs.song_id = what || ':' || k.song_id || ':' || g || ':' || coalesce(part, 0)),
kv as (select song_id, g, bool_and(ok) filter (where what = 'w') as ok, bool_and(ok) filter (where what = 'p') as parts_ok from kf group by all),
ke as (select song_id, max(end_ms) as song_end from wn where end_ms > start_ms group by song_id)"""


@query("w30_strike_timeline", "notes", STRIKES, """
select song_id, round(g, 6) as t0, round(coalesce(lead(g) over (partition by song_id order by g), song_end), 6) as t1, len(ps) as n,
  case when ok then 'playable' when parts > 1 and parts_ok then 'rolled' else 'impossible' end as verdict from kg join kv using (song_id, g) join ke using (song_id)""")
def w30(s, d):
    t = h.strike_timeline(wide(s, d), 480.0, profile("comfortable"))
    return t.select("song_id", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), F.size("pitches").cast("bigint").alias("n"), "verdict")


@query("w31_strain")
def w31(s, d):
    return h.strain(h.strike_timeline(wide(s, d), 480.0), 480.0)


@query("w32_playability_summary", "notes", TL + "," + FEAS.format(ps="ps", src="so", span=17), """
select fs.song_id, round(sum(t1 - fs.t), 5) as sounding_ms, count(*) as instants, count(*) filter (where ok) as playable_instants, round(coalesce(sum(t1 - fs.t) filter (where ok), 0), 5) as playable_ms,
  round(coalesce(sum(t1 - fs.t) filter (where not ok and len(fs.ps) > 10), 0), 5) as too_many_ms, cast(max(len(fs.ps)) as bigint) as max_notes, max(fs.ps[-1] - fs.ps[1]) as max_span from fs join so on so.song_id = fs.song_id and so.t = fs.t group by fs.song_id""")
def w32(s, d):
    p = h.playability(h.sounding_timeline(wide(s, d)))
    return p.select("song_id", "instants", "playable_instants", *[F.round(x, 5).alias(x) for x in ("sounding_ms", "playable_ms", "too_many_ms")],
                    F.col("max_notes").cast("bigint").alias("max_notes"), "max_span")


@query("t03_worst_instants", "notes", TL + "," + FEAS.format(ps="ps", src="so", span=12) + """,
bd as (select fs.song_id, fs.t, len(fs.ps) as n, fs.ps[-1] - fs.ps[1] as span, t1 - fs.t as dur from fs join so on so.song_id = fs.song_id and so.t = fs.t where not ok)""", """
select song_id, round(t, 6) as t0, n, span, round(dur, 6) as dur, rank from (select *, row_number() over (partition by song_id order by n desc, span desc, dur desc, t) as rank from bd) q where rank <= 8""")
def t03(s, d):
    x = h.worst_instants(h.sounding_timeline(wide(s, d), profile("comfortable")))
    return x.select("song_id", F.round("t0", 6).alias("t0"), F.col("n").cast("bigint").alias("n"), "span", F.round("dur", 6).alias("dur"), F.col("rank").cast("bigint").alias("rank"))


@query("w36_monophonic_share", "notes", """
rr as (select *, max(end_ms) over (partition by song_id, stem order by start_ms, end_ms, note_id rows between unbounded preceding and 1 preceding) as r from notes)""", """
select song_id, stem, round(case when count(*) < 2 then 1 else greatest(0, 1 - sum(case when start_ms < r then least(r, end_ms) - start_ms else 0 end) / sum(end_ms - start_ms)) end, 6) as share from rr group by song_id, stem""")
def w36(s, d):
    return h.monophonic_share(c.notes(s, d)).select("song_id", "stem", F.round("share", 6).alias("share"))


@query("v05_hand_split", "notes", WN + """,
wx as (select song_id, pitch, unnest(range(cast(floor(start_ms / 480) as bigint), greatest(cast(floor(start_ms / 480) as bigint) + 1, cast(ceil(end_ms / 480) as bigint)))) as w from wn),
ws as (select song_id, w, list_sort(list(distinct pitch)) as ps from wx group by all),
hb as (select song_id, w, b, list_filter(ps, lambda x: x < b) as l, list_filter(ps, lambda x: x >= b) as r from ws, range(52, 75, 2) q(b)),
hh as (select song_id, w, b, l as p from hb union all select song_id, w, b, r from hb),
hg as (select *, list_sort([p[k] - p[k-1] for k in range(2, len(p) + 1)]) as g from hh),
hc as (select song_id, w, b, cast(sum(case when len(p) = 0 then 0 else greatest(0, p[-1] - p[1] - 14) + greatest(0, len(p) - 5) * 3 + coalesce(list_sum([greatest(0, x - 5) for x in g[1:greatest(len(g) - 1, 0)]]), 0) * 1.5 end) as double) as cost from hg group by all),
hk as (select song_id, w, row_number() over (partition by song_id order by w) as k, list(cost order by b) as cs from hc group by song_id, w),
-- cheapest cost of a path to each of the twelve boundaries, with the paths; moving costs 0.8 a step of two
hp(song_id, k, c, path, ws) as (
  select song_id, k, cs, list_transform(range(1, 13), lambda i: [i]), [w] from hk where k = 1
  union all
  select song_id, k, list_transform(f, lambda x: x.c), list_transform(range(1, 13), lambda j: list_append(path[f[j].i], j)), list_append(ws, w)
  from (select h.song_id, h.k, h.w, p.path, p.ws, list_transform(range(1, 13), lambda j: {'c': list_min(list_transform(range(1, 13), lambda i: p.c[i] + 0.4e0 * (2 * abs(i - j)))) + h.cs[j],
      'i': list_position(list_transform(range(1, 13), lambda i: p.c[i] + 0.4e0 * (2 * abs(i - j))), list_min(list_transform(range(1, 13), lambda i: p.c[i] + 0.4e0 * (2 * abs(i - j)))))}) as f
    from hp p join hk h on h.song_id = p.song_id and h.k = p.k + 1) q),
hl as (select song_id, path[list_position(c, list_min(c))] as best, ws from (select *, row_number() over (partition by song_id order by k desc) as rn from hp) q where rn = 1),
hv as (select song_id, unnest(ws) as w, 50 + 2 * unnest(best) as boundary from hl)""", """
select n.song_id, note_id, case when pitch >= boundary then 'treble' else 'bass' end as hand, cast(boundary as bigint) as boundary
from wn n left join hv on hv.song_id = n.song_id and hv.w = cast(floor(start_ms / 480) as bigint)""")
def v05(s, d):
    return h.assign_hands(wide(s, d), 480.0).select("song_id", "note_id", "hand", "boundary")


@query("v05_split_costs", "notes", WN + """,
wx as (select song_id, pitch, unnest(range(cast(floor(start_ms / 480) as bigint), greatest(cast(floor(start_ms / 480) as bigint) + 1, cast(ceil(end_ms / 480) as bigint)))) as w from wn),
ws as (select song_id, w, list_sort(list(distinct pitch)) as ps from wx group by all),
hb as (select song_id, w, b, list_filter(ps, lambda x: x < b) as l, list_filter(ps, lambda x: x >= b) as r from ws, range(52, 75, 2) q(b)),
hh as (select song_id, w, b, l as p from hb union all select song_id, w, b, r from hb),
hg as (select *, list_sort([p[k] - p[k-1] for k in range(2, len(p) + 1)]) as g from hh)""", """
select song_id, w, b as boundary, round(cast(sum(case when len(p) = 0 then 0 else greatest(0, p[-1] - p[1] - 14) + greatest(0, len(p) - 5) * 3 + coalesce(list_sum([greatest(0, x - 5) for x in g[1:greatest(len(g) - 1, 0)]]), 0) * 1.5 end) as double), 3) as cost from hg group by all""")
def v05b(s, d):
    x = h.split_costs(wide(s, d), 480.0).select("song_id", "w", F.posexplode("cost").alias("i", "cost"))
    return x.select("song_id", "w", (52 + 2 * F.col("i")).cast("bigint").alias("boundary"), F.round("cost", 3).alias("cost"))


