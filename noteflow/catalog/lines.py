"""Voice lines, threads, studies."""

from pyspark.sql import functions as F

from ..operators import lines as ln
from ..operators import patterns as p
from ..sources import corpus as c
from .patterns import dense, small
from .registry import query


# one step per chord: open lines as a list of (id, last pitch, last end), chords of up to three notes by all their choices
VOICES = """
vs as (select distinct song_id, stem, start_ms as t from notes),
va(song_id, stem, g) as (select song_id, stem, min(t) from vs group by all
  union all select song_id, stem, t from (select a.song_id, a.stem, (select min(s.t) from vs s where s.song_id = a.song_id and s.stem = a.stem and s.t - a.g > 25) as t from va a) q where t is not null),
vn as (select n.*, (select max(a.g) from va a where a.song_id = n.song_id and a.stem = n.stem and a.g <= n.start_ms) as g from notes n),
vg as (select song_id, stem, row_number() over (partition by song_id, stem order by g) as k, list({'id': note_id, 't': start_ms, 'e': end_ms, 'p': pitch} order by start_ms, pitch, note_id) as ns
  from vn group by song_id, stem, g),
-- one step per chord: the cheapest choice of an open line or none (a million) for each of its notes
vl(song_id, stem, k, ids, lines, open) as (
  select distinct song_id, stem, cast(0 as bigint), cast([] as bigint[]), cast([] as bigint[]), cast([] as struct(id bigint, p bigint, e double)[]) from vg
  union all
  select song_id, stem, k, list_transform(ns, lambda n: n.id), list_transform(range(1, len(ns) + 1), lambda j: case when take[j] = 0 then ns[j].id else live[take[j]].id end),
    list_concat(list_transform(range(1, len(live) + 1), lambda i: case when list_contains(take, i) then {'id': live[i].id, 'p': ns[list_position(take, i)].p, 'e': ns[list_position(take, i)].e} else live[i] end),
      list_transform(list_filter(range(1, len(ns) + 1), lambda j: take[j] = 0), lambda j: {'id': ns[j].id, 'p': ns[j].p, 'e': ns[j].e}))
  from (select song_id, stem, k, ns, live, case len(ns)
      when 1 then [list_sort(o[1])[1].i]
      when 2 then list_sort(flatten(list_transform(o[1], lambda x: list_transform(list_filter(o[2], lambda y: y.i = 0 or y.i <> x.i), lambda y: {'c': x.c + y.c, 'w': [x.i, y.i]}))))[1].w
      else list_sort(flatten(list_transform(o[1], lambda x: flatten(list_transform(list_filter(o[2], lambda y: y.i = 0 or y.i <> x.i), lambda y:
        list_transform(list_filter(o[3], lambda z: z.i = 0 or (z.i <> x.i and z.i <> y.i)), lambda z: {'c': x.c + y.c + z.c, 'w': [x.i, y.i, z.i]}))))))[1].w end as take
    from (select song_id, stem, k, ns, live, list_transform(ns, lambda n: list_concat([{'c': 1000000e0, 'i': 0}], list_filter(list_transform(range(1, len(live) + 1), lambda i:
        {'c': case when live[i].e - n.t > 30 or abs(n.p - live[i].p) > 12 or n.t - live[i].e > 300 then 1e9
          when live[i].e > n.t then abs(n.p - live[i].p) + (live[i].e - n.t) / 30e0 else abs(n.p - live[i].p) + (n.t - live[i].e) / 50e0 end, 'i': i}), lambda x: x.c <= 12))) as o
      from (select g.song_id, g.stem, g.k, g.ns, list_filter(l.open, lambda x: g.ns[1].t - x.e <= 300) as live
        from vl l join vg g on g.song_id = l.song_id and g.stem = l.stem and g.k = l.k + 1) a) b) c)"""


@query("v01_voice_lines", "notes", VOICES, "select song_id, stem, unnest(ids) as note_id, unnest(lines) as line_id from vl")
def v01(s, d):
    return ln.voice_lines(c.notes(s, d)).select("song_id", "stem", "note_id", "line_id")


# one step per note of a stem: open threads as a list of (id, last start, last pitch), the cheapest first
THREADS = """
tn as (select *, row_number() over (partition by song_id, stem order by start_ms, pitch, note_id) as k from notes),
th(song_id, stem, k, note_id, line_id, open) as (
  select distinct song_id, stem, cast(0 as bigint), cast(null as bigint), cast(null as bigint), cast([] as struct(id bigint, t double, p bigint)[]) from tn
  union all
  select song_id, stem, k, note_id, coalesce(pick.id, note_id),
    case when pick is null then list_append(live, {'id': note_id, 't': start_ms, 'p': pitch})
      else list_transform(live, lambda x: case when x.id = pick.id then {'id': x.id, 't': start_ms, 'p': pitch} else x end) end
  from (select song_id, stem, k, note_id, start_ms, pitch, live,
      list_sort(list_transform(list_filter(range(1, len(live) + 1), lambda i: start_ms - live[i].t > 45 and abs(pitch - live[i].p) <= 12),
        lambda i: {'c': abs(pitch - live[i].p) + 2e0 * ((start_ms - live[i].t) / 960e0) * 12, 'i': i, 'id': live[i].id}))[1] as pick
    from (select n.song_id, n.stem, n.k, n.note_id, n.start_ms, n.pitch, list_filter(th.open, lambda x: n.start_ms - x.t <= 960e0) as live
      from th join tn n on n.song_id = th.song_id and n.stem = th.stem and n.k = th.k + 1) a) b)"""


@query("v02_melodic_threads", "notes", THREADS, "select song_id, stem, note_id, line_id from th where note_id is not null")
def v02(s, d):
    return ln.melodic_threads(c.notes(s, d), 480.0).select("song_id", "stem", "note_id", "line_id")


@query("v02_line_stats", "notes", THREADS + """,
ln as (select song_id, stem, line_id, count(*) as n from th where note_id is not null group by all)""", """
select song_id, stem, count(*) as lines, cast(sum(n) as bigint) as notes, avg(n) as mean_len, max(n) as max_len, count(*) filter (where n >= 4) as usable from ln group by song_id, stem""")
def v02b(s, d):
    return ln.line_stats(ln.melodic_threads(c.notes(s, d), 480.0))


FP = """
fp as (select note_id, song_id, stem, note_id // 5 as line_id, case when note_id % 7 <> 0 then (note_id % 9) * 2.5e-5 end as b, (note_id % 13) / 10e0 - 0.9e0 as slope, case when note_id % 4 <> 0 then (note_id % 31) * 1e0 end as vibrato,
  (note_id % 30) / 100e0 as attack, (note_id % 10) / 10e0 as even_odd, 0e0 - (note_id % 20) as brightness, 440 * power(2, (pitch - 69) / 12e0) as f0_hz from notes),
lo as (select *, row_number() over (partition by song_id, stem, line_id order by f0_hz, note_id) as r, count(*) over (partition by song_id, stem, line_id) as n from fp),
po as (select song_id, stem, line_id, count(*) as n_notes, median(even_odd) as even_odd, median(slope) as slope, median(vibrato) as vibrato, median(attack) as attack, median(brightness) as brightness, median(b) filter (where r <= greatest(1, n // 3)) as b from lo group by all)"""


def fingerprints(s, d):
    i = F.col("note_id")
    from ..functions.music import midi_to_hz

    return c.notes(s, d).select(
        "note_id", "song_id", "stem", F.floor(i / 5).alias("line_id"), F.when(i % 7 != 0, (i % 9) * 2.5e-5).otherwise(float("nan")).alias("b"),
        ((i % 13) / 10.0 - 0.9).alias("slope"), F.when(i % 4 != 0, (i % 31) * 1.0).otherwise(float("nan")).alias("vibrato"), ((i % 30) / 100.0).alias("attack"),
        ((i % 10) / 10.0).alias("even_odd"), (0.0 - (i % 20)).alias("brightness"), midi_to_hz("pitch").alias("f0_hz"))


@query("a12_fingerprint_pooling", "notes", FP, """
select song_id, stem, line_id, n_notes, round(even_odd, 6) as even_odd, round(slope, 6) as slope, round(vibrato, 6) as vibrato, round(b, 8) as b from po""")
def a12(s, d):
    f = ln.pool_fingerprints(fingerprints(s, d))
    return f.select("song_id", "stem", "line_id", "n_notes", *[F.round(x, 6).alias(x) for x in ("even_odd", "slope", "vibrato")], F.round("b", 8).alias("b"))


FAM = {"bass": "bass", "drums": "drums", "vocals": "vocals"}


@query("a13_line_identity", "notes", FP + """,
vt as (select song_id, stem, note_id // 5 as line_id, min(case when note_id % 2 = 0 then 'piano' else 'guitar' end) as lo, max(case when note_id % 2 = 0 then 'piano' else 'guitar' end) as hi, bool_or(note_id % 17 = 0) as con, median(confidence) as cf from notes where note_id % 3 = 0 group by all),
ld as (select po.*, lo, hi, con, cf, case when n_notes < 3 then 'mid_body' when b > 1e-5 and slope < -0.3 and (vibrato is null or vibrato < 6) then case when b >= 1.5e-4 then 'piano' when attack >= 0.15 then 'guitar' else 'mid_body' end
  when b <= 1e-5 and vibrato >= 20 then 'vibrato_lead' when b <= 1e-5 and even_odd < 0.4 then 'clarinet_like' when b <= 1e-5 and brightness > -10 and abs(slope) < 0.3 and (vibrato is null or vibrato < 20) then 'brass' else 'mid_body' end as lad
  from po left join vt using (song_id, stem, line_id))""", """
select song_id, stem, line_id, case when lo = hi and not con then lo when stem in ('bass', 'drums', 'vocals') then stem else lad end as family,
  case when lo = hi and not con then false when stem in ('bass', 'drums') then false when stem = 'vocals' then lad <> 'mid_body' else lad not in ('piano', 'guitar', 'clarinet_like', 'brass') end as contested from ld""")
def a13(s, d):
    i = F.col("note_id")
    v = c.notes(s, d).filter("note_id % 3 = 0").select("song_id", "stem", F.floor(i / 5).alias("line_id"),
                                                      F.when(i % 2 == 0, "piano").otherwise("guitar").alias("family"), "confidence", (i % 17 == 0).alias("contested"))
    r = ln.line_identity(ln.pool_fingerprints(fingerprints(s, d)), v, FAM)
    return r.select("song_id", "stem", "line_id", "family", "contested")


def studied(s, d):
    n = dense(s, d, small(5)).filter("stem <> 'drums'")
    return ln.melodic_threads(n, 480.0)


@query("w19_pattern_study")
def w19(s, d):
    o = p.study(studied(s, d), 480.0)
    return o.select("song_id", "stem", "pattern", "pos0", "pos1", "size", "confidence")


@query("w20_apply_observations")
def w20(s, d):
    """Re-strikes and cohesive figures of every stem as annotation rows."""
    n = dense(s, d, small(2))
    o = p.rearticulations(n, 1600.0).unionByName(p.neighbor_tones(n, 1600.0))
    return p.apply_observations(o, n, p.KEYS)
