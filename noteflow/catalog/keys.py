"""Pitch-class weights, chroma, key, stability."""

from pyspark.sql import functions as F

from ..functions import music as m

from ..operators import corpus_stats as cs
from ..operators import keys as k
from ..sources import corpus as c
from .filters import KEY_LIST
from .registry import query, r6

FRAMED = """
sp as (select song_id, min(start_ms) as s0, greatest(1, max(end_ms) - min(start_ms)) as span from notes where stem <> 'drums' group by song_id),
fr as (select n.song_id, pitch % 12 as pc, greatest(start_ms + 1, end_ms) - start_ms as dur,
   least(199, greatest(0, cast(trunc((start_ms - s0) / span * 199) as bigint))) as f0,
   least(199, greatest(least(199, greatest(0, cast(trunc((start_ms - s0) / span * 199) as bigint))), cast(trunc((greatest(start_ms + 1, end_ms) - s0) / span * 199) as bigint))) as f1
   from notes n join sp using (song_id) where stem <> 'drums'),
ch as (select song_id, unnest(range(f0, f1 + 1)) as frame, pc, dur / 1000 / (f1 - f0 + 1) as per from fr),
wm as (select song_id, pc, sum(per * case when frame < 30 or frame >= 170 then 2 else 1 end) / 260 as w from ch group by song_id, pc)"""
PROFILES = f"""
prof as (select 0 as minor, unnest(range(12)) as deg, unnest([{', '.join(map(str, k.MAJOR_PROFILE))}]) as val
  union all select 1, unnest(range(12)), unnest([{', '.join(map(str, k.MINOR_PROFILE))}])),
kn as (select i - 1 as id, ({KEY_LIST})[i] as key, (i - 1) % 12 as idx, (i - 1) // 12 as minor,
   list_position(['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B'], replace(replace(replace(rtrim(({KEY_LIST})[i], 'm'), 'C#', 'Db'), 'D#', 'Eb'), 'G#', 'Ab')) - 1 as root
  from range(1, 25) r(i)),
g0 as (select distinct song_id from wm),
v as (select g0.song_id, p.pc, coalesce(w, 0) / sum(coalesce(w, 0)) over (partition by g0.song_id) as x from g0 cross join range(12) p(pc) left join wm on wm.song_id = g0.song_id and wm.pc = p.pc),
sc as (select song_id, kn.id, key, idx, kn.minor, root, corr(x, val) as r from v cross join kn join prof on prof.minor = kn.minor and prof.deg = (v.pc - root + 12) % 12 group by all),
best as (select *, row_number() over (partition by song_id order by round(r, 12) desc, id) as rn from sc),
b1 as (select * from best where rn = 1),
pr as (select b1.song_id, b1.key, b1.r, b1.minor, o.key as okey, o.r as orr, case when b1.minor = 1 then b1.root else o.root end as mroot from b1 join sc o on o.song_id = b1.song_id and o.idx = b1.idx and o.minor <> b1.minor),
fl as (select pr.*, abs(orr - r) < 0.05 and (case when a.x > b.x * 1.15 then 1 else 0 end) <> minor as flip from pr join v a on a.song_id = pr.song_id and a.pc = (mroot + 11) % 12 join v b on b.song_id = pr.song_id and b.pc = (mroot + 10) % 12)"""


@query("a02_pitch_class_histogram", "notes", """
h as (select song_id, pitch % 12 as pc, sum(greatest(1, end_ms - start_ms)) as w from notes group by all)""", """
select song_id, pc, round(w / sqrt(sum(w * w) over (partition by song_id)), 6) as weight from h""")
def a02(s, d):
    return cs.pitch_class_weights(c.notes(s, d), ["song_id"]).select("song_id", "pc", F.round("w", 6).alias("weight"))


@query("a03_chroma", "notes", FRAMED, "select song_id, frame, pc, round(sum(per), 8) as weight from ch group by all")
def a03(s, d):
    return k.chroma(c.notes(s, d)).select("song_id", "frame", "pc", F.round("weight", 8).alias("weight"))


@query("a04_weighted_chroma_mean", "notes", FRAMED, "select song_id, pc, round(w, 8) as weight from wm")
def a04(s, d):
    return k.mean_chroma(c.notes(s, d)).select("song_id", "pc", F.round("w", 8).alias("weight"))


@query("a05_key_detection", "notes", FRAMED + "," + PROFILES, """
select song_id, case when flip then okey else key end as key, round(greatest(0, least(1, (case when flip then orr else r end + 0.5) / 1.5)), 6) as confidence from fl""")
def a05(s, d):
    return k.key_of_songs(c.notes(s, d)).select("song_id", "key", F.round("confidence", 6).alias("confidence"))


def centre(key):
    """Tonic of a key, of the relative major for a minor one."""
    tonic = f"list_position(['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B'], replace(replace(replace(rtrim({key}, 'm'), 'C#', 'Db'), 'D#', 'Eb'), 'G#', 'Ab'))"
    return f"(case when {key} like '%m' then ({tonic} + 2) % 12 else {tonic} - 1 end)"


SONGKEY = "select song_id, case when flip then okey else key end as key, greatest(0, least(1, (case when flip then orr else r end + 0.5) / 1.5)) as raw from fl"
WINDOWED = FRAMED.replace("from notes", "from nw").replace("notes n join", "nw n join")


@query("a06_key_stability", "notes", f"""
gk as (with {FRAMED}, {PROFILES} {SONGKEY}),
ns as (select n.*, min(start_ms) over (partition by song_id) as a, max(end_ms) over (partition by song_id) as z from notes n where stem <> 'drums'),
nv as materialized (select *, unnest(range(12)) as w from ns),
nw as materialized (select song_id as song, w, song_id || ':' || w as song_id, stem, pitch, start_ms, end_ms from nv
  where start_ms >= a + w * (greatest(1, z - a) / 12) and start_ms < least(z, a + w * (greatest(1, z - a) / 12) + greatest(1, z - a) / 12 * 2)),
wk as (with {WINDOWED}, {PROFILES} {SONGKEY}),
wh as (select song, w, key, count(*) over (partition by song) as m from (select song, w, any_value(song_id) as sid, count(*) as held from nw group by song, w) q join wk on wk.song_id = sid where held >= 12),
hs as (select song_id, count(*) as n from ns group by song_id),
hk as materialized (select kc.song_id, kc.key, count(*) filter (where list_contains([0, 2, 4, 5, 7, 9, 11], (kc.pitch - {centre('kc.key')} + 120) % 12)) / any_value(kc.n) as cover from (select hs.song_id, n, pitch, unnest({KEY_LIST}) as key from hs join ns using (song_id)) kc group by kc.song_id, kc.key),
j0 as (select gk.song_id, gk.key as global_key, raw, hs.n, case when hs.n >= 24 then coalesce((select list(key order by w) from wh where wh.song = gk.song_id), []) else [] end as ks from gk join hs using (song_id)),
j1 as (select *, len(ks) as m, case when len(ks) > 0 then len(list_filter(ks, lambda k: {centre('k')} = {centre('global_key')})) / len(ks) else 1e0 end as agreement,
  list_sort(list_transform(list_distinct(ks), lambda k: {{'c': -len(list_filter(ks, lambda x: x = k)), 'o': list_position(ks, k), 'k': k}}))[1] as top from j0),
j2 as (select *, agreement >= 0.70 as stable, case when agreement < 0.70 and -top.c > m / 2 and {centre('top.k')} <> {centre('global_key')} then top.k else global_key end as chosen from j1),
j3 as (select j2.*, (select c.cover from hk c where c.song_id = j2.song_id and c.key = chosen) as own,
  (select arg_min({{'k': c.key, 'c': c.cover}}, {{'c': -c.cover, 'k': c.key}}) from hk c where c.song_id = j2.song_id and (c.key = chosen or list_contains(ks, c.key))) as best from j2),
j4 as (select *, case when m > 0 and best.c > own + 0.04 then best.k else chosen end as reported from j3),
j5 as (select *, case when reported <> global_key and m > 0 then len(list_filter(ks, lambda k: {centre('k')} = {centre('reported')})) / m else agreement end as final from j4)""", """
select song_id, global_key, reported as key, round(raw + 1.37e-8, 6) as raw_confidence, round(final + 1.37e-8, 6) as agreement, round(raw * final + 1.37e-8, 6) as confidence, stable, cast(m as int) as windows from j5""")
def a06(s, d):
    r = k.key_stability(c.notes(s, d))
    return r.select("song_id", "global_key", "key", *[r6(x).alias(x) for x in ("raw_confidence", "agreement", "confidence")], "stable", "windows")


@query("c02_key_numbers", "notes", f"x as (select note_id, ({KEY_LIST})[cast(note_id % 24 as int) + 1] as key from notes)", """
select note_id, key, list_position(['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B'], replace(replace(replace(rtrim(key, 'm'), 'C#', 'Db'), 'D#', 'Eb'), 'G#', 'Ab')) - 1
  + case when key like '%m' then 12 else 0 end as key_number from x""")
def c02(s, d):
    names = F.array(*[F.lit(x) for x in (*m.MAJOR_KEYS, *m.MINOR_KEYS)])
    n = c.notes(s, d).select("note_id", F.get(names, (F.col("note_id") % 24).cast("int")).alias("key"))
    return n.withColumn("key_number", m.key_number("key"))


@query("c01_midi_hz", "notes", "", """
select note_id, round(440 * power(2, (pitch - 69) / 12e0), 6) as hz, round(69 + 12 * log2(440 * power(2, (pitch - 69) / 12e0) / 440), 6) as midi from notes""")
def c01(s, d):
    hz = m.midi_to_hz("pitch")
    return c.notes(s, d).select("note_id", F.round(hz, 6).alias("hz"), F.round(m.hz_to_midi(hz), 6).alias("midi"))


