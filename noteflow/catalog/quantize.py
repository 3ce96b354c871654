"""Note values and the notation time line."""

from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import quantize as q
from ..plans.grouping import anchor_groups
from ..plans.timeline import row_no, scan
from ..sources import corpus as c
from .registry import query
from .rhythm import ANCH
from .tempo import MAP

SYM = ", ".join(f"({i}, '{n}', {b!r}e0, {k}e0)" for i, (n, b, k) in enumerate(q.SYMBOLS))
HYP = f"""
sy(rank, name, beats, cost) as (values {SYM}),
hy as (select note_id, rank, name, beats * 480 as ms, cost, greatest(0, 1 - abs(end_ms - start_ms - beats * 480) / (beats * 480) / 0.24) as sc
  from notes, sy where abs(end_ms - start_ms - beats * 480) / (beats * 480) <= 0.24),
hp as (select *, case when sum(sc) over (partition by note_id) > 0 then sc / sum(sc) over (partition by note_id) else 0 end as p from hy),
hr as (select *, row_number() over (partition by note_id order by round(p, 12) desc, rank) as rn, max(p) over (partition by note_id) as top from hp),
pick as (select n.note_id, coalesce(h.name, 'unknown') as name, coalesce(h.ms, n.end_ms - n.start_ms) as ms, coalesce(h.p, 0.3) as p,
  coalesce(h.p - (select p from hr x where x.note_id = n.note_id and x.rn = 2) < 0.15, false) as contended from notes n left join hr h on h.note_id = n.note_id and h.rn = 1),
simp as (select note_id, arg_min(name, [cost, rn]) as name, arg_min(ms, [cost, rn]) as ms from hr where round(top - p, 12) <= 0.15 group by note_id)"""


@query("q01_duration_hypotheses", "notes", HYP, "select note_id, name as symbol, round(p, 6) as probability, contended from pick")
def q01(s, d):
    o = q.ranked(q.duration_hypotheses(F.col("end_ms") - F.col("start_ms"), F.lit(480.0)))
    n = c.notes(s, d).select("note_id", o.alias("o"))
    return n.select("note_id", F.col("o")[0]["name"].alias("symbol"), F.round(F.col("o")[0]["p"], 6).alias("probability"), q.contended(F.col("o")).alias("contended"))


W = "[" + ", ".join(f"{v!r}e0" for v in q.WRITABLE) + "]"
WT = "[" + ", ".join(f"{v!r}e0" for v in (*q.WRITABLE, *q.WRITABLE_TRIPLETS)) + "]"


@query("q02_writable_values", "notes", "x as (select note_id, (end_ms - start_ms) / 120 as b from notes)", f"""
select note_id, round(list_min([[abs(v - b), i, v] for v, i in {WT}])[3], 6) as nearest, coalesce(list_max([v for v in {W} if v <= b + 1e-9]), 0) as at_most from x""")
def q02(s, d):
    b = (F.col("end_ms") - F.col("start_ms")) / 120.0
    return c.notes(s, d).select("note_id", F.round(q.writable(b, triplets=True), 6).alias("nearest"), q.writable_at_most(b).alias("at_most"))


TOMS = """
lastb as (select song_id, max(i) as last_i from bi group by song_id)"""


@query("q03_notation_quantize", "notes beats", MAP + "," + HYP + "," + TOMS + """,
sn as (select pos.note_id, pos.song_id, round_even(round(beat_pos * 4, 9), 0) / 4e0 as sp, round_even(round(beat_pos * 4, 9), 0) / 4e0 + coalesce(simp.ms, end_ms - start_ms) / 480e0 as ep, coalesce(simp.name, 'unknown') as symbol
  from pos left join simp using (note_id)),
ix as (select sn.*, greatest(0, least(cast(floor(sp) as bigint), last_i - 1)) as i1, greatest(0, least(cast(floor(ep) as bigint), last_i - 1)) as i2 from sn join lastb using (song_id))""", """
select note_id, symbol, round(a.t_ms + (sp - i1) * a.gap, 5) as page_start_ms, round(b.t_ms + (ep - i2) * b.gap, 5) as page_end_ms
from ix join bi a on a.song_id = ix.song_id and a.i = i1 join bi b on b.song_id = ix.song_id and b.i = i2""")
def q03(s, d):
    n = q.notation_quantize(c.notes(s, d), c.beats(s, d), 480.0)
    return n.select("note_id", "symbol", F.round("page_start_ms", 5).alias("page_start_ms"), F.round("page_end_ms", 5).alias("page_end_ms"))


@query("q04_groove_quantize", "notes beats", MAP + """,
gq as (select *, start_ms + (round_even(round(beat_pos * 4, 9), 0) / 4e0 - beat_pos) * local_beat_ms + case when abs(beat_pos - floor(beat_pos) - 0.5) < 0.125 then 0.1 * local_beat_ms / 4 else 0 end as goal,
   greatest(0, least(1, 0.4 * (1 - confidence))) as st from pos),
gd as (select *, greatest(-40, least(80, (1 - st) * start_ms + st * goal - start_ms)) as delta, case when velocity < 30 then 'ghost_note_preserved' when abs(start_ms - goal) <= 15 then 'within_pocket' else 'snapped' end as reason from gq),
gs as (select *, case when reason = 'snapped' then greatest(0, start_ms + delta) else start_ms end as qs from gd)""", """
select note_id, reason, round(qs, 5) as q_start_ms, round(greatest(qs + 10, end_ms + qs - start_ms), 5) as q_end_ms from gs""")
def q04(s, d):
    g = q.groove_quantize(c.notes(s, d), c.beats(s, d), F.lit(0.6), F.lit(0.4), F.lit(15.0))
    return g.select("note_id", "reason", F.round("q_start_ms", 5).alias("q_start_ms"), F.round("q_end_ms", 5).alias("q_end_ms"))


FILL = ", ".join(f"({i}, {dv}, {len(sl)}, [{', '.join(f'{k / dv!r}e0' for k in sl)}], {pr!r}e0)" for i, (dv, sl, pr) in enumerate(q.fillings()))


def observed(s, d):
    """Onset fractions of the anchored groups falling in each even 960 ms span of a song."""
    g = anchor_groups(c.notes(s, d).select("song_id", "start_ms", "note_id"), ["song_id"], "start_ms", "note_id", 40.0)
    g = g.select("song_id", "group_ms").distinct().withColumn("beat_no", F.floor(F.col("group_ms") / 960.0))
    return g.groupBy("song_id", "beat_no").agg(F.array_sort(F.collect_list(F.col("group_ms") / 960.0 - F.col("beat_no"))).alias("fr"))


@query("q05_beat_rhythm", "notes", ANCH.format(w=40) + f""",
vo(i, d, n, pos, prior) as (values {FILL}),
ob as (select song_id, cast(floor(t / 960) as bigint) as beat_no, list(t / 960 - floor(t / 960) order by t) as fr from gr group by all),
sc as (select song_id, beat_no, i, d, prior, list_sum([(fr[k] - pos[k]) * (fr[k] - pos[k]) for k in range(1, 7) if k <= n]) as sse, n from ob join vo on len(fr) = n),
bs as (select *, row_number() over (partition by song_id, beat_no order by round(-sse / (2 * 0.08e0 * 0.08e0) + prior, 9) desc, i) as rn from sc)""", """
select ob.song_id, ob.beat_no, len(fr) as onsets, case when sqrt(sse / n) <= 0.1 then d end as divisor, round(case when sqrt(sse / n) <= 0.1 then sqrt(sse / n) end, 6) as error
from ob left join bs on bs.song_id = ob.song_id and bs.beat_no = ob.beat_no and rn = 1""")
def q05(s, d):
    o = observed(s, d).withColumn("r", q.infer_beat(F.col("fr")))
    return o.select("song_id", "beat_no", F.size("fr").cast("bigint").alias("onsets"), F.col("r.divisor").alias("divisor"), F.round("r.error", 6).alias("error"))


def at_beat(x):
    """Time of a beat position, from ``bi`` as lists per song."""
    i = f"cast(greatest(0, least(floor({x}), len(ts) - 2)) as int)"
    return f"(ts[{i} + 1] + ({x} - {i}) * gaps[{i} + 1])"


@query("q06_voice_rhythm", "notes beats", MAP + f""",
vo(i, d, n, pos, prior) as (values {FILL}),
bl as (select song_id, list(t_ms order by i) as ts, list(gap order by i) as gaps from bi group by song_id),
qs as (select distinct song_id, stem, start_ms as t from notes),
qa(song_id, stem, g) as (select song_id, stem, min(t) from qs group by all
  union all select song_id, stem, t from (select a.song_id, a.stem, (select min(s.t) from qs s where s.song_id = a.song_id and s.stem = a.stem and s.t - a.g > 40) as t from qa a) q where t is not null),
qn as (select n.*, (select max(a.g) from qa a where a.song_id = n.song_id and a.stem = n.stem and a.g <= n.start_ms) as g from notes n),
qg as (select song_id, stem, g, max(end_ms) as e from qn group by all),
qx as (select *, lead(g) over (partition by song_id, stem order by g) as nx from qg),
qp as (select qx.song_id, stem, g, e, qx.nx, b.i + (g - b.t_ms) / b.gap as bp from qx join bi b on b.song_id = qx.song_id and (g >= b.t_ms or b.pv is null) and (g < b.nx or b.nx is null)),
qb as (select *, case when bp - floor(bp) > 1 - 1e0 / 16 then floor(bp) + 1 else floor(bp) end as bn from qp),
qt as (select qb.*, {at_beat('bn')} as b0, {at_beat('(bn + 1)')} as b1 from qb join bl using (song_id)),
qf as (select *, greatest(1, b1 - b0) as bl, greatest(0, least(0.999e0, (g - b0) / greatest(1, b1 - b0))) as fr, row_number() over (partition by song_id, stem, bn order by g) as k from qt),
ql as (select song_id, stem, bn, list(fr order by fr) as fs from qf group by all),
qc as (select song_id, stem, bn, i, d, pos, n, prior, list_sum([(fs[k] - pos[k]) * (fs[k] - pos[k]) for k in range(1, 7) if k <= n]) as sse from ql join vo on len(fs) = n),
qr as (select *, row_number() over (partition by song_id, stem, bn order by round(-sse / (2 * 0.08e0 * 0.08e0) + prior, 9) desc, i) as rn from qc),
rd as (select qf.*, d, pos, n, b0 + pos[k] * bl as ps, case when k < n then b0 + pos[k + 1] * bl end as nxt from qf join qr using (song_id, stem, bn) where rn = 1 and sqrt(sse / n) <= 0.1),
rh as (select *, (least(e, coalesce(nx, 'infinity'::double)) - ps) / bl as avail from rd),
rw as (select *, coalesce(list_max([v for v in {W} if v <= least(avail, 8e0) + 1e-9]), 0) as held from rh),
rj as (select row_number() over () as note_id, song_id, stem, g, bn, bp, g as start_ms, e as end_ms from qf anti join rd on rd.song_id = qf.song_id and rd.stem = qf.stem and rd.g = qf.g),
rs as (with {HYP.replace("from notes", "from rj")} select * from simp),
rq as (select rj.*, round_even(round(bp * 4, 9), 0) / 4e0 as sp, round_even(round(bp * 4, 9), 0) / 4e0 + coalesce(rs.ms, end_ms - start_ms) / 480e0 as ep from rj left join rs using (note_id))""", f"""
select song_id, stem, round(g, 5) as group_ms, cast(bn as bigint) as beat_no, round(ps, 5) as page_start_ms,
  round(case when nxt is not null then nxt when d in (3, 6) or avail <= (b1 - ps) / bl or held * bl <= b1 - ps then b1 else ps + held * bl end, 5) as page_end_ms,
  d in (3, 6) as is_tuplet, cast(d as bigint) as subdivision, true as by_rhythm from rw
union all
select song_id, stem, round(g, 5), cast(bn as bigint), round({at_beat('sp')}, 5), round({at_beat('ep')}, 5), false, null, false from rq join bl using (song_id)""")
def q06(s, d):
    v = q.voice_rhythm(c.notes(s, d), c.beats(s, d), beat_ms=480.0)
    return v.select("song_id", "stem", F.round("group_ms", 5).alias("group_ms"), F.col("beat_no").cast("bigint").alias("beat_no"), F.round("page_start_ms", 5).alias("page_start_ms"),
                    F.round("page_end_ms", 5).alias("page_end_ms"), "is_tuplet", "subdivision", "by_rhythm")


@query("s01_note_contract", "notes", "x as (select *, case when note_id % 11 = 0 then start_ms - 5 else end_ms end as e2, case when note_id % 13 = 0 then pitch + 90 else pitch end as p2 from notes)", """
select note_id, round(greatest(0, least(1, confidence * 1.5)), 6) as confidence, case when e2 < start_ms then 'end before start' when p2 not between 0 and 127 then 'pitch out of range' else 'ok' end as reason from x""")
def s01(s, d):
    n = c.notes(s, d).withColumns({
        "end_ms": F.when(F.col("note_id") % 11 == 0, F.col("start_ms") - 5).otherwise(F.col("end_ms")),
        "pitch": F.when(F.col("note_id") % 13 == 0, F.col("pitch") + 90).otherwise(F.col("pitch")),
        "confidence": F.col("confidence") * 1.5})
    good, bad = f.split_valid(n)
    return good.withColumn("reason", F.lit("ok")).unionByName(bad).select("note_id", F.round("confidence", 6).alias("confidence"), "reason")


@query("s02_notes_from_events", "notes", "", """
select note_id, round(start_ms / 1000 * 1000, 6) as start_ms, cast(greatest(1, least(127, round_even(confidence * 127, 0))) as bigint) as velocity, confidence from notes""")
def s02(s, d):
    e = c.notes(s, d).select("note_id", (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"), "pitch", F.col("confidence").alias("amplitude"))
    return f.notes_from_events(e).select("note_id", F.round("start_ms", 6).alias("start_ms"), "velocity", "confidence")


F0 = """
fc as (select *, case when flatness / 10 < 0.9 and hz > 0 then cast(round_even(69 + 12 * log2(hz / 440), 0) as bigint) else -1 end as midi, lead(t_ms) over (partition by song_id order by frame_idx) as nt from frames),
fp as (select *, case when lag(midi) over (partition by song_id order by frame_idx) = midi then 0 else 1 end as b, lag(midi) over (partition by song_id order by frame_idx) as pm from fc),
fi as (select *, sum(b) over (partition by song_id order by frame_idx) as isl from fp)"""


@query("s03_f0_notes", "frames", F0, """
select song_id, midi as pitch, round(min(t_ms), 6) as start_ms, round(max(coalesce(nt, t_ms)), 6) as end_ms, round(avg(hz) filter (where nt is not null or pm is distinct from midi), 6) as f0_hz from fi where midi >= 0
group by song_id, isl, midi having max(coalesce(nt, t_ms)) - min(t_ms) >= 30""")
def s03(s, d):
    fr = c.frames(s, d).withColumn("conf", F.when(F.col("flatness") / 10 < 0.9, 0.9).otherwise(0.1))
    n = q.f0_notes(fr)
    return n.select("song_id", "pitch", F.round("start_ms", 6).alias("start_ms"), F.round("end_ms", 6).alias("end_ms"), F.round("f0_hz", 6).alias("f0_hz"))


@query("s04_posterior_lookup", "notes frames", "pg as (select song_id, frame_idx, 48 + frame_idx % 24 as pitch, rms as level from frames)", """
select note_id, coalesce(level, 0) as level from notes n left join pg on pg.song_id = n.song_id and pg.frame_idx = cast(trunc(n.start_ms / 23.22) as bigint) and pg.pitch = n.pitch""")
def s04(s, d):
    pg = c.frames(s, d).select("song_id", "frame_idx", (48 + F.col("frame_idx") % 24).alias("pitch"), F.col("rms").alias("level"))
    n = c.notes(s, d).withColumn("t_ms", F.col("start_ms"))
    return q.posterior_levels(n, pg, 23.22).select("note_id", "level")


@query("w04_octave_stacks", "notes", "nn as (select *, pitch + 12 * (note_id % 3) as p2 from notes)," + ANCH.format(w=400) + """,
gm as (select nn.*, (select max(g.t) from gr g where g.song_id = nn.song_id and g.t <= nn.start_ms) as grp from nn),
be as (select song_id, grp, p2, arg_min(note_id, [-confidence, start_ms, note_id]) as nid, max(confidence) as cf from gm group by song_id, grp, p2),
chn as (select song_id, grp, p2 % 12 as pc, count(*) as octaves, min(p2) as lo, max(p2) as hi from be group by all)""", """
select be.nid as note_id, p2 as pitch, octaves, lo as low, hi as high from be join chn on be.song_id = chn.song_id and be.grp = chn.grp and p2 % 12 = pc where octaves >= 3 and p2 > lo and p2 < hi and cf <= 0.9""")
def w04(s, d):
    n = c.notes(s, d).withColumn("pitch", F.col("pitch") + 12 * (F.col("note_id") % 3))
    return q.octave_stacks(n, 400.0).select("note_id", "pitch", "octaves", "low", "high")


@query("w06_x02_pitch_wobble", "notes frames", """
wn as (select *, row_number() over (partition by song_id, stem order by start_ms, note_id) as k from notes),
wm as (select song_id, stem, note_id, confidence, k, k * 90e0 + k // 12 * 100 as s, k * 90e0 + k // 12 * 100 + 80 as e, 60 + k % 2 + case when note_id % 17 = 0 then 5 else 0 end as p from wn),
-- one step per fragment: the open group's first fragment, anchor and pitch range
wr(song_id, stem, k, note_id, gid, ac, ap, lo, hi, p, e) as (
  select song_id, stem, k, note_id, note_id, confidence, p, p, p, p, e from wm where k = 1
  union all
  select song_id, stem, k, note_id, case when fits then gid else note_id end, case when fits then nc else confidence end, case when fits then na else p end,
    case when fits then nl else p end, case when fits then nh else p end, p, e
  from (select *, linked and greatest(na - nl, nh - na) <= 1.2 as fits
    from (select n.song_id, n.stem, n.k, n.note_id, n.confidence, n.p, n.e, w.gid, n.s - w.e between 0 and 30 and n.p <> w.p as linked, greatest(n.confidence, w.ac) as nc,
        case when n.confidence > w.ac then n.p else w.ap end as na, least(w.lo, n.p) as nl, greatest(w.hi, n.p) as nh
      from wr w join wm n on n.song_id = w.song_id and n.stem = w.stem and n.k = w.k + 1) a) b),
wd as (select wr.*, wm.s, p - lag(p) over v as d, lag(p) over v - lag(p, 2) over v as b from (select song_id, stem, k, note_id, gid, ac, ap, p, e from wr) wr join (select note_id, s from wm) wm using (note_id) window v as (partition by song_id, stem, gid order by k)),
wg as (select song_id, stem, gid, count(*) as members, abs(sum(d)) as net, sum(abs(d)) as way, avg(case when b is not null and d is not null then case when abs(d) + abs(b) > 0 then abs(d + b) / (abs(d) + abs(b)) else 1e0 end end) as local,
  min(s) as w0, max(e) as w1, arg_max(ap, k) as anchor from wd group by all having count(*) >= 2),
wf as (select * from wg where case when way > 0 then net / way else 1e0 end < 0.5 and coalesce(local < 0.8, true))""", """
select wf.song_id, stem, gid as first_id, cast(members as int) as members, anchor as anchor_pitch, count(*) as voiced, round(max(69 + 12 * log2((262 + rms) / 440)) - min(69 + 12 * log2((262 + rms) / 440)), 6) as spread
from wf join frames f on f.song_id = wf.song_id and hz > 0 and t_ms between w0 and w1 group by all having count(*) >= 2 and max(69 + 12 * log2((262 + rms) / 440)) - min(69 + 12 * log2((262 + rms) / 440)) <= 0.6""")
def w06(s, d):
    """Each stem's notes as fragments of 80 ms that flicker between two pitches, with pauses and leaps in between, over an f0 that stays."""
    at = scan(c.notes(s, d), ["song_id", "stem"], ["start_ms", "note_id"], {"k": row_no()})
    start = F.col("k") * 90.0 + F.floor(F.col("k") / 12) * 100.0
    pitch = 60 + F.col("k") % 2 + F.when(F.col("note_id") % 17 == 0, 5).otherwise(0)
    n = at.withColumns({"start_ms": start, "end_ms": start + 80.0, "pitch": pitch})
    steady = c.frames(s, d).withColumn("hz", F.when(F.col("hz") > 0, 262.0 + F.col("rms")).otherwise(0.0))
    return q.wobble_groups(n, steady, 60.0).withColumn("spread", F.round("spread", 6))


@query("w27_proportional_durations", "notes", ANCH.format(w=90) + """,
io as (select song_id, t, case when lead(t) over (partition by song_id order by t) is not null then greatest(1, lead(t) over (partition by song_id order by t) - t) end as ioi from gr),
fi as (select * from io where ioi is not null),
un as (select song_id, t, ioi, median(ioi) over (partition by song_id order by t rows between 9 preceding and 9 following) as unit from fi)""", f"""
select song_id, round(t, 6) as t_ms, round(unit, 5) as unit, round(list_min([[abs(v - ioi / greatest(unit, 1)), i, v] for v, i in [{', '.join(f'{v!r}e0' for v in q.READABLE)}]])[3], 6) as ratio from un""")
def w27(s, d):
    g = anchor_groups(c.notes(s, d).select("song_id", "start_ms", "note_id"), ["song_id"], "start_ms", "note_id", 90.0)
    p = q.proportional(g.select("song_id", F.col("group_ms").alias("t_ms")).distinct())
    return p.select("song_id", F.round("t_ms", 6).alias("t_ms"), F.round("unit", 5).alias("unit"), F.round("ratio", 6).alias("ratio"))


@query("w33_sustain_march", "notes frames", """
ce as (select *, coalesce(min(start_ms) over (partition by song_id, stem, pitch order by start_ms range between 0.000001 following and unbounded following), 1e300) - 10 as ceil_ms from notes),
st as (select note_id, k, end_ms + (k + 1) * 23.22e0 <= ceil_ms as fits, coalesce(f.rms, 0) >= 0.3 as loud from ce cross join range(18) q(k) left join frames f on f.song_id = ce.song_id and f.frame_idx = cast(trunc((end_ms + k * 23.22e0) / 23.22e0) as bigint)),
ms as (select note_id, coalesce(min(k) filter (where not fits or not loud), 18) as steps from st group by note_id)""", """
select note_id, round(steps * 23.22e0, 6) as march_ms from ms""")
def w33(s, d):
    fr = c.frames(s, d).select("song_id", "frame_idx", F.col("rms").alias("level"))
    e = q.sustain_extensions(c.notes(s, d), fr, 23.22, threshold=0.3)
    return e.select("note_id", F.round("march_ms", 6).alias("march_ms"))


@query("w34_bass_octaves", "notes frames", """
sp as (select note_id, pitch, count(*) as voiced, median(69 + 12 * log2(hz / 440)) as rd, quantile_cont(69 + 12 * log2(hz / 440), 0.9) - quantile_cont(69 + 12 * log2(hz / 440), 0.1) as spread
  from notes n join frames f on f.song_id = n.song_id and hz > 0 and f.t_ms between n.start_ms and n.end_ms group by note_id, pitch)""", """
select note_id, pitch, pitch + case when abs(rd - pitch - 12) <= 1.5 then 12 when abs(rd - pitch + 12) <= 1.5 then -12 when abs(rd - pitch - 24) <= 1.5 then 24 else -24 end as corrected_pitch, round(rd, 6) as reading
from sp where voiced >= 3 and spread <= 12 and abs(rd - pitch) > 1.5 and (abs(abs(rd - pitch) - 12) <= 1.5 or abs(abs(rd - pitch) - 24) <= 1.5)""")
def w34(s, d):
    r = q.bass_octaves(c.notes(s, d), c.frames(s, d), max_spread=12.0)
    return r.select("note_id", "pitch", "corrected_pitch", F.round("reading", 6).alias("reading"))


