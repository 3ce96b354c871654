"""Notation rows."""

from pyspark.sql import functions as F

from ..operators import page as p
from ..operators.filters import snap_quarters
from ..sources import corpus as c
from .registry import query, r6

TICKS = """
tk as (select note_id, cast(floor(start_ms / 10) as bigint) * 2 as st, 12 * (1 + note_id % 60) as du, cast([4, 3, 6, 5][cast(song_id % 4 as int) + 1] as bigint) as num, case when song_id % 4 = 2 then 8 else 4 end as den from notes)"""
LEVEL = "case when {x} % (num * 96) = 0 then 0 when den = 8 and num in (6, 9, 12) and {x} % 288 = 0 then 1 when not (den = 8 and num in (6, 9, 12)) and num % 2 = 0 and num >= 4 and ({x} % (num * 96)) * 2 = num * 96 then 1 when {x} % 96 = 0 then 2 else 3 end"
SPLIT = TICKS + f""",
cu(note_id, num, den, pp, fin, s, d) as (
  select note_id, num, den, st, st + du, cast(null as bigint), cast(null as bigint) from tk
  union all
  select note_id, num, den, coalesce(cut, fin), fin, pp, coalesce(cut, fin) - pp from (
    select note_id, num, den, pp, fin, (select min(b) from (select (pp // 96 + 1 + k) * 96 as b from range(0, 64) r(k)) q where b < fin and ({LEVEL.format(x='b')} = 0 or {LEVEL.format(x='b')} < {LEVEL.format(x='pp')})) as cut
    from cu where pp < fin) z),
sg as (select note_id, s, d from cu where s is not null)"""


def ticks(s, d):
    num = F.get(F.array(*[F.lit(x).cast("bigint") for x in (4, 3, 6, 5)]), (F.col("song_id") % 4).cast("int"))
    return c.notes(s, d).select("note_id", (F.floor(F.col("start_ms") / 10) * 2).alias("start_tick"), (12 * (1 + F.col("note_id") % 60)).alias("dur_tick"),
                                num.alias("numerator"), F.when(F.col("song_id") % 4 == 2, 8).otherwise(4).alias("denominator"))


@query("w38_metric_split", "notes", SPLIT, "select note_id, s as start_tick, d as dur_tick from sg")
def w38(s, d):
    n = ticks(s, d)
    seg = p.metric_split(F.col("start_tick"), F.col("dur_tick"), F.col("numerator"), F.col("denominator"))
    return n.select("note_id", F.explode(seg).alias("x")).select("note_id", F.col("x.s").alias("start_tick"), F.col("x.d").alias("dur_tick"))


PIECES = SPLIT + f""",
sp as (select unnest({list(p.BINARY_SHAPES)}) as v, false as tern union all select unnest({list(p.TERNARY_SHAPES)}), true),
pc(note_id, d0, pp, rest, s, d) as (
  select note_id, d, s, d, cast(null as bigint), cast(null as bigint) from sg
  union all
  select note_id, d0, pp + v, rest - v, pp, v from (select *, (select max(v) from sp where tern = (d0 % 3 <> 0) and v <= rest) as v from pc) z where v is not null),
pw as (select note_id, s, d from pc where s is not null
  union all select note_id, s, d from sg where not exists(select 1 from sp where tern = (d % 3 <> 0) and v <= d)),
pn as (select *, row_number() over (partition by note_id order by s) - 1 as piece, count(*) over (partition by note_id) as n from pw)"""


@query("w45_notation_pieces", "notes", PIECES, """
select note_id, piece, s as start_tick, d as dur_tick, case when n = 1 then null when piece = 0 then 'start' when piece = n - 1 then 'stop' else 'continue' end as tie from pn""")
def w45(s, d):
    return p.notation_pieces(ticks(s, d).withColumn("is_tuplet", F.lit(False)))


VOICES = """
vn as (select *, row_number() over (partition by song_id, stem order by start_ms, note_id) as k from notes),
vo(song_id, stem, k, note_id, start_ms, id, open) as (
  select distinct song_id, stem, cast(0 as bigint), cast(null as bigint), cast(null as double), cast(null as bigint), cast([] as struct(id bigint, e double, p bigint)[]) from vn
  union all
  select song_id, stem, k, note_id, start_ms, coalesce(pick.id, note_id),
    case when pick is null then list_append(open, {'id': note_id, 'e': end_ms, 'p': pitch})
      else list_transform(open, lambda x: case when x.id = pick.id then {'id': x.id, 'e': end_ms, 'p': pitch} else x end) end
  from (select n.song_id, n.stem, n.k, n.note_id, n.start_ms, n.end_ms, n.pitch, vo.open,
      list_sort(list_transform(list_filter(range(1, len(vo.open) + 1), lambda i: n.start_ms >= vo.open[i].e),
        lambda i: {'c': abs(vo.open[i].p - n.pitch), 'i': i, 'id': vo.open[i].id}))[1] as pick
    from vo join vn n on n.song_id = vo.song_id and n.stem = vo.stem and n.k = vo.k + 1) a),
vf as (select song_id, stem, id, row_number() over (partition by song_id, stem order by start_ms, id) as voice from vo where note_id = id)"""


@query("w03_gridded_chords", "notes", """
gs as (select song_id, stem as part, note_id, start_ms, pitch, round(round_even(start_ms / 480e0 * 2, 0) / 2e0, 6) as "offset" from notes)""", """
select song_id, part, note_id, "offset", dense_rank() over (partition by song_id, part order by "offset") - 1 as chord,
  row_number() over (partition by song_id, part, "offset" order by start_ms, pitch, note_id) - 1 as place from gs""")
def w03(s, d):
    n = c.notes(s, d).withColumnRenamed("stem", "part")
    return p.gridded_chords(n, snap_quarters(F.col("start_ms") / 480.0)).select("song_id", "part", "note_id", "offset", "chord", "place")


@query("v04_register_voices", "notes", VOICES, """
select song_id, stem, note_id, voice, cast((voice - 1) // 4 as bigint) as staff from vo join vf using (song_id, stem, id) where note_id is not null""")
def v04(s, d):
    v = p.register_voices(c.notes(s, d))
    return v.select("song_id", "stem", "note_id", *[F.col(x).cast("bigint").alias(x) for x in ("voice", "staff")])


def staffed(s, d):
    return c.notes(s, d).withColumn("hand", F.when(F.col("pitch") >= 60, "treble").otherwise("bass"))


STAFF = """
sn as (select song_id, case when pitch >= 60 then 'treble' else 'bass' end as hand, note_id, start_ms, end_ms, pitch from notes),
sk as (select *, row_number() over (partition by song_id, hand order by start_ms, note_id) as k from sn),
sv(song_id, hand, k, note_id, id, open) as (
  select distinct song_id, hand, cast(0 as bigint), cast(null as bigint), cast(null as bigint), cast([] as struct(id bigint, e double, p bigint)[]) from sk
  union all
  select song_id, hand, k, note_id, coalesce(pick.id, note_id),
    case when pick is null then list_append(open, {'id': note_id, 'e': end_ms, 'p': pitch})
      else list_transform(open, lambda x: case when x.id = pick.id then {'id': x.id, 'e': greatest(x.e, end_ms), 'p': pitch} else x end) end
  from (select *, case when len(free) > 0 then list_sort(free)[1] when len(open) >= 4 then list_sort(every)[1] end as pick
    from (select n.song_id, n.hand, n.k, n.note_id, n.start_ms, n.end_ms, n.pitch, sv.open,
        list_transform(list_filter(range(1, len(sv.open) + 1), lambda i: sv.open[i].e <= n.start_ms + 240e0), lambda i: {'c': abs(sv.open[i].p - n.pitch), 'i': i, 'id': sv.open[i].id}) as free,
        list_transform(range(1, len(sv.open) + 1), lambda i: {'c': abs(sv.open[i].p - n.pitch), 'i': i, 'id': sv.open[i].id}) as every
      from sv join sk n on n.song_id = sv.song_id and n.hand = sv.hand and n.k = sv.k + 1) a) b),
so as (select sv.song_id, sv.hand, sv.note_id, sv.id, n.start_ms, n.end_ms, n.pitch from sv join sn n on n.note_id = sv.note_id),
st as (select song_id, hand, start_ms as t from so group by all),
sp as (select st.song_id, st.hand, st.t, arg_max(id, [pitch, -id]) as id from st join so on so.song_id = st.song_id and so.hand = st.hand and so.start_ms <= t and so.end_ms > t group by all),
sr as (select v.song_id, v.hand, v.id, count(p.id) as tops from (select distinct song_id, hand, id from so) v left join sp p on p.song_id = v.song_id and p.hand = v.hand and p.id = v.id group by all),
sq as (select *, row_number() over (partition by song_id, hand order by tops desc, id) as voice from sr)"""


@query("v03_w37_staff_voices", "notes", STAFF, "select song_id, hand, note_id, voice, tops from so join sq using (song_id, hand, id)")
def v03(s, d):
    v = p.staff_voices(staffed(s, d), ms_per_beat=480.0)
    v = v.join(p.top_line_order(v), ["song_id", "hand", "voice_start"])
    return v.select("song_id", "hand", "note_id", F.col("voice").cast("bigint").alias("voice"), "tops")


# the same machine with gestures: a list of (gesture, voice), the latest owner of each
GESTURES = """
gn as (select song_id, case when pitch >= 60 then 'treble' else 'bass' end as hand, note_id, start_ms, end_ms, pitch, case when note_id % 3 <> 0 then cast(floor(start_ms / 700) as bigint) end as g from notes),
gk as (select *, row_number() over (partition by song_id, hand order by start_ms, note_id) as k from gn),
gv(song_id, hand, k, note_id, id, open, own) as (
  select distinct song_id, hand, cast(0 as bigint), cast(null as bigint), cast(null as bigint), cast([] as struct(id bigint, e double, p bigint)[]), cast([] as struct(g bigint, id bigint)[]) from gk
  union all
  select song_id, hand, k, note_id, coalesce(pick, note_id),
    case when pick is null then list_append(open, {'id': note_id, 'e': end_ms, 'p': pitch})
      else list_transform(open, lambda x: case when x.id = pick then {'id': x.id, 'e': greatest(x.e, end_ms), 'p': pitch} else x end) end,
    case when g is null or joined then own else list_append(list_filter(own, lambda x: x.g <> g), {'g': g, 'id': coalesce(pick, note_id)}) end
  from (select *, len(free) = 0 and len(open) >= 4 as joined, case when mine is not null then mine when len(free) > 0 then list_sort(free)[1].id when len(open) >= 4 then list_sort(every)[1].id end as pick
    from (select *, list_filter(own, lambda x: x.g = g and list_contains(list_transform(free, lambda f: f.id), x.id))[1].id as mine
      from (select n.song_id, n.hand, n.k, n.note_id, n.start_ms, n.end_ms, n.pitch, n.g, gv.open, gv.own,
        list_transform(list_filter(range(1, len(gv.open) + 1), lambda i: gv.open[i].e <= n.start_ms + 240e0), lambda i: {'c': abs(gv.open[i].p - n.pitch), 'i': i, 'id': gv.open[i].id}) as free,
        list_transform(range(1, len(gv.open) + 1), lambda i: {'c': abs(gv.open[i].p - n.pitch), 'i': i, 'id': gv.open[i].id}) as every
      from gv join gk n on n.song_id = gv.song_id and n.hand = gv.hand and n.k = gv.k + 1) a) b) c)"""


@query("v03_gesture_voices", "notes", GESTURES, "select song_id, hand, note_id, id as voice_start from gv where note_id is not null")
def v03b(s, d):
    """Two notes of three belong to a figure of 0.7 s, which keeps its voice while that is free."""
    n = staffed(s, d).withColumn("gesture", F.when(F.col("note_id") % 3 != 0, F.floor(F.col("start_ms") / 700)))
    return p.staff_voices(n, ms_per_beat=480.0).select("song_id", "hand", "note_id", "voice_start")


@query("w35_gated_smoothing", "notes", """
en as (select *, (note_id * 37 % 101) / 100e0 as res, (note_id * 53 % 97) / 96e0 as void from notes),
sb as (select *, case when pitch = lag(pitch) over w and start_ms - lag(end_ms) over w <= 240e0 then 0 else 1 end as b from en window w as (partition by song_id order by start_ms, note_id)),
si as (select *, sum(b) over (partition by song_id order by start_ms, note_id rows unbounded preceding) as isl from sb),
sm as (select song_id, min(start_ms) as start_ms, max(end_ms) as end_ms, arg_min(note_id, [start_ms, note_id]) as note_id, arg_min(res, [start_ms, note_id]) as res, arg_min(void, [start_ms, note_id]) as void from si group by song_id, isl),
ca as (select song_id, case when count(*) >= 30 then quantile_cont(res, 0.25) end as ring, case when count(*) >= 30 then quantile_cont(void, 0.9) end as still from sm group by song_id),
sx as (select sm.*, lead(start_ms) over (partition by song_id order by start_ms, note_id) as nx, case when ring is null then 480e0 when void >= still then 0e0 when res >= ring then 960e0 else 480e0 end as lim from sm join ca using (song_id)),
sf as (select *, case when nx - end_ms > 0 and nx - end_ms <= lim then nx else end_ms end as e from sx),
sh as (select *, ceil(e / 480e0 - 1e-9) * 480e0 as beat, ceil(e / 960e0 - 1e-9) * 960e0 as half, ceil(e / 1920e0 - 1e-9) * 1920e0 as bar from sf)""", """
select song_id, note_id, round(start_ms, 6) as start_ms, round(case when coalesce(nx > e, true) then greatest(e, least(case when half - e <= 960e0 then half else beat end, bar, coalesce(nx, 1e300))) else e end, 6) as end_ms from sh""")
def w35b(s, d):
    """One voice a song, so that its evidence is enough to calibrate the gate."""
    n = c.notes(s, d).withColumns({"resonance": (F.col("note_id") * 37 % 101) / 100.0, "void": (F.col("note_id") * 53 % 97) / 96.0})
    return p.smooth_voice(n, ["song_id"], 480.0).select("song_id", "note_id", F.round("start_ms", 6).alias("start_ms"), F.round("end_ms", 6).alias("end_ms"))


@query("w35_gap_smoothing", "notes", """
sb as (select *, case when pitch = lag(pitch) over w and start_ms - lag(end_ms) over w <= 240e0 then 0 else 1 end as b from notes window w as (partition by song_id, stem order by start_ms, note_id)),
si as (select *, sum(b) over (partition by song_id, stem order by start_ms, note_id rows unbounded preceding) as isl from sb),
sm as (select song_id, stem, min(pitch) as pitch, min(start_ms) as start_ms, max(end_ms) as end_ms, arg_min(note_id, [start_ms, note_id]) as note_id, count(*) as merged from si group by song_id, stem, isl),
sx as (select *, lead(start_ms) over (partition by song_id, stem order by start_ms, note_id) as nx from sm),
sf as (select *, case when nx - end_ms > 0 and nx - end_ms <= 480e0 then nx else end_ms end as e from sx),
sh as (select *, ceil(e / 480e0 - 1e-9) * 480e0 as beat, ceil(e / 960e0 - 1e-9) * 960e0 as half, ceil(e / 1920e0 - 1e-9) * 1920e0 as bar from sf)""", """
select song_id, stem, note_id, pitch, round(start_ms, 6) as start_ms,
  round(case when coalesce(nx > e, true) then greatest(e, least(case when half - e <= 960e0 then half else beat end, bar, coalesce(nx, 1e300))) else e end, 6) as end_ms, merged from sh""")
def w35(s, d):
    x = p.smooth_voice(c.notes(s, d), ["song_id", "stem"], 480.0)
    return x.select("song_id", "stem", "note_id", "pitch", F.round("start_ms", 6).alias("start_ms"), F.round("end_ms", 6).alias("end_ms"), "merged")


@query("v06_t04_part_routing", "notes", """
ev as (select song_id, stem, start_ms as t, 1 as dl, note_id from notes union all select song_id, stem, end_ms, -1, note_id from notes),
lv as (select song_id, stem, sum(dl) over (partition by song_id, stem order by t, dl, note_id) as l from ev), mx as (select song_id, stem, max(l) as m from lv group by all),
st as (select song_id, stem, avg(pitch) as mp from notes group by all)""", """
select song_id, stem, case when stem = 'drums' then 'drums' when stem = 'bass' then 'two_voices' when stem in ('piano', 'guitar', 'other') then 'grand_staff' when m >= 3 then 'voices' else 'single' end as layout,
  row_number() over (partition by song_id order by stem = 'drums', round(-mp, 9), stem) as part from st join mx using (song_id, stem)""")
def v06(s, d):
    return p.route_parts(c.notes(s, d)).select("song_id", "stem", "layout", F.col("part").cast("bigint").alias("part"))


SEGMENTS = """
bn as (select *, lead(t_ms) over w as nx, row_number() over w as k from beats window w as (partition by song_id order by t_ms, beat_idx)),
se(song_id, k, t, nx, seg, t0, n) as (
  select song_id, k, t_ms, nx, beat_idx, t_ms, cast(1 as bigint) from bn where k = 1
  union all
  select song_id, k, t_ms, nx, case when cut then beat_idx else seg end, case when cut then t_ms else t0 end, case when cut then 1 else n + 1 end
  from (select b.*, se.seg, se.t0, se.n, b.nx is not null and abs(60000e0 / (b.nx - b.t_ms) - 60000e0 * se.n / (b.t_ms - se.t0)) > 1.5e0 as cut
    from se join bn b on b.song_id = se.song_id and b.k = se.k + 1) a)"""


@query("w39_tempo_segments", "notes beats", SEGMENTS, """
select song_id, seg as segment, round(min(t), 6) as start_ms, round(max(nx), 6) as end_ms, count(*) as n_beats, round(60000e0 * count(*) / (max(nx) - min(t)) + 1.37e-8, 6) as bpm
from se where nx is not null group by song_id, seg""")
def w39(s, d):
    g = p.tempo_segments(c.beats(s, d))
    return g.select("song_id", "segment", *[F.round(x, 6).alias(x) for x in ("start_ms", "end_ms")], "n_beats", r6("bpm").alias("bpm"))


PAGE = """
pg as (select song_id, note_id as row_id, stem as part, cast(floor(start_ms / 1920) as bigint) as measure, note_id % 3 as voice, floor((start_ms - floor(start_ms / 1920) * 1920) / 120) as onset, case when note_id % 5 <> 0 then pitch end as pitch, note_id % 9 as dur from notes)"""


def page(s, d):
    t, i = F.col("start_ms"), F.col("note_id")
    m = F.floor(t / 1920)
    return c.notes(s, d).select("song_id", i.alias("row_id"), F.col("stem").alias("part"), m.alias("measure"), (i % 3).alias("voice"),
                                F.floor((t - m * 1920) / 120).alias("onset"), F.when(i % 5 != 0, F.col("pitch")).alias("pitch"), (i % 9).alias("dur"))


MST = PAGE + """,
oa as (select song_id, part, measure, onset, count(pitch) as notes, count(*) - count(pitch) as rests, arg_max(voice, pitch) as tv from pg group by all),
ot as (select *, lag(tv) over (partition by song_id, part order by measure, onset) as pv from oa where notes > 0),
mt as (select song_id, measure, count(*) as top_onsets, count(*) filter (where tv = pv) as top_stable from ot group by all),
ms as (select song_id, measure, cast(sum(notes) as bigint) as notes, cast(sum(rests) as bigint) as rests, count(*) filter (where notes >= 2) as chords from oa group by all)"""


ONE = PAGE.replace("pg as", "px as") + """,
pg as (select song_id, part, measure, onset, pitch, min(row_id) as row_id, arg_min(voice, row_id) as voice, arg_min(dur, row_id) as dur from px where pitch is not null group by all
  union all select song_id, part, measure, onset, pitch, row_id, voice, dur from px where pitch is null)"""
MST1 = MST.replace(PAGE, ONE)


@query("a20_measure_stats", "notes", MST1, """
select song_id, measure, notes, rests, chords, coalesce(top_onsets, 0) as top_onsets, coalesce(top_stable, 0) as top_stable from ms left join mt using (song_id, measure)""")
def a20(s, d):
    return p.measure_stats(page1(s, d))


def page1(s, d):
    """Rows with one note per pitch at an onset, so that the top voice is unambiguous."""
    x = page(s, d)
    k = ["song_id", "part", "measure", "onset", "pitch"]
    notes = x.filter("pitch is not null").groupBy(*k).agg(F.min("row_id").alias("row_id"), F.min_by("voice", "row_id").alias("voice"), F.min_by("dur", "row_id").alias("dur"))
    return notes.unionByName(x.filter("pitch is null").select(notes.columns))


@query("a20_region_stats", "notes", MST1, """
select song_id, measure // 2 as region, cast(sum(notes) as bigint) as notes, cast(sum(rests) as bigint) as rests, cast(sum(chords) as bigint) as chords, cast(sum(coalesce(top_onsets, 0)) as bigint) as top_onsets, cast(sum(coalesce(top_stable, 0)) as bigint) as top_stable
from ms left join mt using (song_id, measure) group by all""")
def a20b(s, d):
    return p.region_stats(p.measure_stats(page1(s, d)), 2)


CAPS = """
rg as (select song_id, cast(floor(start_ms / 3840) as bigint) as region, cap, count(*) filter (where note_id % cap = 0) as rests, count(*) as notes, count(*) filter (where velocity % cap = 1) as top_stable, count(*) as top_onsets
  from notes cross join (values (1), (2), (3), (4)) q(cap) group by all)"""


def capped(s, d):
    n = c.notes(s, d).select("song_id", F.floor(F.col("start_ms") / 3840).alias("region"), "note_id", "velocity", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("cap"))
    one = F.count(F.lit(1))
    return n.groupBy("song_id", "region", "cap").agg(F.count_if(F.col("note_id") % F.col("cap") == 0).alias("rests"), one.alias("notes"),
                                                    F.count_if(F.col("velocity") % F.col("cap") == 1).alias("top_stable"), one.alias("top_onsets"))


@query("a21_region_winner", "notes", CAPS, """
select song_id, region, arg_min(cap, [round(rests / notes, 9), cap]) as fewest_rests, arg_min(cap, [-round(top_stable / top_onsets, 9), cap]) as steadiest, count(distinct cap) as caps from rg group by all""")
def a21(s, d):
    return p.region_winners(capped(s, d))


@query("u02_common_regions", "notes", CAPS, """
select song_id, region from rg where rests > 2 group by all having count(distinct cap) = (select count(distinct cap) from rg where rests > 2)""")
def u02(s, d):
    return p.common_regions(capped(s, d).filter("rests > 2"))


@query("u03_check_union", "notes", "", """
select name from (select distinct stem || '_count' as name from notes where note_id % 2 = 0 union select distinct case when stem = 'bass' then 'bass_extra' else stem || '_count' end from notes where note_id % 2 = 1) q""")
def u03(s, d):
    n = c.notes(s, d)
    a = n.filter("note_id % 2 = 0").select(F.concat("stem", F.lit("_count")).alias("name"))
    b = n.filter("note_id % 2 = 1").select(F.when(F.col("stem") == "bass", "bass_extra").otherwise(F.concat("stem", F.lit("_count"))).alias("name"))
    return a.union(b).dropDuplicates(["name"])


@query("a19_readability", "notes", MST1 + """,
rj as (select song_id, abs(pitch - lag(pitch) over (partition by song_id, part, voice order by measure, onset, row_id)) as jump from pg where pitch is not null),
ra as (select song_id, avg(jump) as mean_jump from rj group by song_id),
rv as (select song_id, count(*) filter (where n <= 2) as singleton_voices, count(*) as voices from (select song_id, part, voice, count(*) as n from pg where pitch is not null group by all) q group by song_id),
ro as (select song_id, count(*) filter (where len > 16 + 1e-6) as overfull from (select song_id, part, measure, voice, sum(dur) as len from pg group by all) q group by song_id),
rm as (select song_id, sum(notes) as notes, sum(rests) as rests, sum(chords) as chords, sum(coalesce(top_onsets, 0)) as tops, sum(coalesce(top_stable, 0)) as stable from ms left join mt using (song_id, measure) group by song_id)""", """
select song_id, round(rests / greatest(notes, 1), 6) as rest_ratio, round(chords / greatest(tops, 1), 6) as chord_share, round(stable / greatest(tops - 1, 1), 6) as top_stability,
  round(mean_jump, 6) as mean_jump, singleton_voices, voices, overfull from rm left join ra using (song_id) left join rv using (song_id) left join ro using (song_id)""")
def a19(s, d):
    x = p.readability(page1(s, d), 16.0)
    return x.select("song_id", *[F.round(v, 6).alias(v) for v in ("rest_ratio", "chord_share", "top_stability", "mean_jump")], "singleton_voices", "voices", "overfull")


TYPES = "['whole', 'half', 'quarter', 'eighth', '16th', '32nd']"


@query("a22_vocabulary", "notes", f"""
o as (select ({TYPES})[cast(note_id % 6 as int) + 1] as type from notes where stem <> 'drums'), r as (select ({TYPES})[cast(note_id * note_id % 5 as int) + 1] as type from notes where stem = 'drums'),
oh as (select type, 100e0 * count(*) / (select count(*) from o) as op from o group by type), rh as (select type, 100e0 * count(*) / (select count(*) from r) as rp from r group by type)""", """
select coalesce(oh.type, rh.type) as type, round(op, 6) as ours_pct, round(rp, 6) as ref_pct, case when abs(coalesce(op, 0) - coalesce(rp, 0)) >= 3 then round(coalesce(op, 0) - coalesce(rp, 0), 6) end as gap_pct, rp is null as invented, coalesce(oh.type, rh.type) in ('32nd', '64th', '128th') as forbidden
from oh full join rh on oh.type = rh.type""")
def a22(s, d):
    names = F.array(*[F.lit(x) for x in ("whole", "half", "quarter", "eighth", "16th", "32nd")])
    i = F.col("note_id")
    n = c.notes(s, d)
    o = n.filter("stem <> 'drums'").select(F.get(names, (i % 6).cast("int")).alias("type"))
    r = n.filter("stem = 'drums'").select(F.get(names, (i * i % 5).cast("int")).alias("type"))
    return p.vocabulary(o, r).select("type", *[F.round(x, 6).alias(x) for x in ("ours_pct", "ref_pct", "gap_pct")], "invented", "forbidden")


HEAL = """
hr as (select song_id as run_id, cast(floor(start_ms / 10) as bigint) % 384 as off, 6 * (1 + note_id % 40) as len, case when note_id % 4 = 0 then 3 when note_id % 4 = 1 then 5 end as ta, case when note_id % 4 = 0 then 2 when note_id % 4 = 1 then 5 end as tn from notes),
hc as (select run_id, count(*) filter (where off + len > 384) as past_barline,
  count(*) filter (where not list_bool_or([((off % 96) * q) % 96 = 0 for q in [1, 2, 3, 4, 6, 8, 12, 16]]) and not coalesce(((off % 96) * ta) % 96 = 0, false)) as off_grid,
  count(*) filter (where tn is not null and tn not in (1, 2, 3, 4, 6, 8, 12, 16)) as junk_tuplets, count(*) filter (where off + len > 384 and ta is not null) as tuplets_over_barline from hr group by run_id)"""


@query("p16_a23_health_checks", "notes", HEAL, """
select run_id, name, value, case when value = 0 then 'PASS' else 'FAIL' end as status from hc unpivot (value for name in (past_barline, off_grid, junk_tuplets, tuplets_over_barline))""")
def p16(s, d):
    i = F.col("note_id")
    rows = c.notes(s, d).select(F.col("song_id").alias("run_id"), (F.floor(F.col("start_ms") / 10) % 384).alias("offset"), (6 * (1 + i % 40)).alias("length"),
                                F.when(i % 4 == 0, 3).when(i % 4 == 1, 5).alias("tuplet_actual"), F.when(i % 4 == 0, 2).when(i % 4 == 1, 5).alias("tuplet_normal"))
    return p.health(rows, 384)


