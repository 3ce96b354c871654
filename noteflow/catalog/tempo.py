"""Tempo, meter, grids, groove, gates."""

from pyspark.sql import functions as F

from ..operators import tempo as t
from ..sources import corpus as c
from .registry import query, r6

REF = """
tw as (select *, confidence * weight as cw, row_number() over (partition by song_id order by confidence * weight desc, source) as rk, count(*) over (partition by song_id) as nw from tempo_witnesses),
an as (select song_id, tempo_bpm as ab, source as asrc, cw as acw, confidence as ac from tw where rk = 1),
fd as (select tw.*, ab, asrc, acw, ac, case when rk = 1 then 1e0 else
   (select r from (values (1e0, 0), (2e0, 1), (0.5e0, 2), (3e0, 3), (1e0/3e0, 4)) f(r, i) order by abs(tempo_bpm * r - ab), i limit 1) end as ratio from tw join an using (song_id)),
f2 as (select *, tempo_bpm * ratio as folded, abs(tempo_bpm * ratio - ab) <= ab * 0.08 as inc from fd),
rs as (select song_id, any_value(asrc) as asrc, any_value(ab) as ab, any_value(acw) as acw, any_value(ac) as ac, any_value(nw) as nw, sum(weight) as tot,
   coalesce(sum(weight) filter (where not inc), 0) as wout, sum(cw) filter (where inc) as icw,
   (coalesce(sum(cw * folded) filter (where inc and rk > 1), 0) + any_value(ab) * any_value(acw) * (1 + coalesce(sum(weight) filter (where not inc), 0) / sum(weight)))
   / (coalesce(sum(cw) filter (where inc and rk > 1), 0) + any_value(acw) * (1 + coalesce(sum(weight) filter (where not inc), 0) / sum(weight))) as wb,
   min(folded) filter (where inc) as lo, max(folded) filter (where inc) as hi, max(ratio <> 1) as fo from f2 group by song_id),
rt as (select song_id, asrc, case when nw = 1 then ab else round(wb, 9) end as raw, case when nw = 1 then ac else greatest(0.3, least(0.95, icw / tot)) end as conf,
   nw > 1 and (greatest(hi - wb, wb - lo) > 3 or wout > 0 or fo) as contention from rs),
res as (select song_id, asrc, case when abs(raw - round_even(raw, 0)) <= 1.5 then round_even(raw, 0) else raw end as bpm, conf, contention from rt)"""


@query("a07_tempo_referee", "tempo_witnesses", REF, """
select song_id, asrc as anchor_source, round(bpm + 1.37e-8, 6) as tempo_bpm, round(conf + 1.37e-8, 6) as confidence, contention from res""")
def a07(s, d):
    r = t.resolve_tempo(c.tempo_witnesses(s, d))
    return r.select("song_id", "anchor_source", r6("tempo_bpm").alias("tempo_bpm"), r6("confidence").alias("confidence"), "contention")


@query("a08_octave_arbiter", "tempo_witnesses", REF + """,
dw as (select song_id, bpm * (1.9e0 + (song_id % 4) / 10e0) as wb, 0.6e0 + (song_id % 5) / 10e0 as wc from res),
ad as (select res.*, wb, wc, wc >= 0.7 and wb <= 180 and abs(wb / bpm - 2) <= 0.15 as ok from res join dw using (song_id))""", """
select song_id, round(case when ok then case when abs(wb - round_even(wb, 0)) <= 1.5 then round_even(wb, 0) else wb end else bpm end + 1.37e-8, 6) as tempo_bpm,
  round(case when ok then greatest(conf, wc) else conf end + 1.37e-8, 6) as confidence, ok as corrected from ad""")
def a08(s, d):
    r = t.resolve_tempo(c.tempo_witnesses(s, d))
    w = r.select("song_id", (F.col("tempo_bpm") * (1.9 + (F.col("song_id") % 4) / 10.0)).alias("w_bpm"),
                 (0.6 + (F.col("song_id") % 5) / 10.0).alias("w_conf"))
    a = t.arbitrate_octave(r, w)
    return a.select("song_id", r6("tempo_bpm").alias("tempo_bpm"), r6("confidence").alias("confidence"), "corrected")


@query("x05_guided_overrides", "tempo_witnesses", REF, """
select song_id, round(case when song_id % 9 = 0 then 90e0 + song_id % 50 else bpm end + 1.37e-8, 6) as tempo_bpm,
  round(case when song_id % 9 = 0 then 1e0 else conf end + 1.37e-8, 6) as confidence, song_id % 9 = 0 as guided from res""")
def x05(s, d):
    r = t.resolve_tempo(c.tempo_witnesses(s, d))
    locks = c.table(s, d, "customer").filter("c_custkey % 9 = 0").select(
        F.col("c_custkey").alias("song_id"), (90.0 + F.col("c_custkey") % 50).alias("locked_bpm"))
    g = t.guided(r, locks)
    return g.select("song_id", r6("tempo_bpm").alias("tempo_bpm"), r6("confidence").alias("confidence"), "guided")


METERS = """
mc as (select song_id, source, cast([2, 3, 4, 6][cast((song_id + ascii(source)) % 4 as int) + 1] as int) as numerator, 4 as denominator, confidence, ascii(source) as seq from tempo_witnesses),
vt as (select song_id, numerator, denominator, sum(confidence) as v, count(*) as n, min(seq) as seq from mc group by all),
ct as (select *, sum(case when numerator % 3 = 0 then n else 0 end) over (partition by song_id) as tn, sum(n) over (partition by song_id) as an from vt),
el as (select * from ct where not (tn > 0 and an > tn and tn <> an - tn) or (numerator % 3 = 0) = (tn > an - tn)),
wi as (select *, sum(v) over (partition by song_id) as tot, row_number() over (partition by song_id order by round(v, 9) desc, seq) as rn from el)"""


def meters(s, d):
    seq = F.ascii("source")
    return c.tempo_witnesses(s, d).select(
        "song_id", F.get(F.array(*[F.lit(x) for x in (2, 3, 4, 6)]), ((F.col("song_id") + seq) % 4).cast("int")).alias("numerator"),
        F.lit(4).alias("denominator"), "confidence", seq.alias("seq"))


@query("a09_meter_vote", "tempo_witnesses", METERS, """
select song_id, numerator, denominator, round(case when an = 1 then v else greatest(0.3, least(0.95, v / tot)) end + 1.37e-8, 6) as confidence from wi where rn = 1""")
def a09(s, d):
    return t.resolve_meter(meters(s, d)).withColumn("confidence", r6("confidence"))


@query("a09_meter_vote_agreement", "tempo_witnesses", METERS, """
select song_id, numerator, denominator from (select *, row_number() over (partition by song_id order by n desc, round(v, 9) desc, seq) as k from vt) q where k = 1""")
def a09b(s, d):
    return t.meter_by_agreement(meters(s, d))


GAPS = """
bg as (select *, lead(t_ms) over (partition by song_id order by t_ms) - t_ms as gap, lead(t_ms) over (partition by song_id order by t_ms) as nx from beats)"""


@query("a10_ioi_regularity", "notes beats", GAPS, """
select song_id, round(case when count(*) < 3 then 0.3 else greatest(0.1, least(0.95, 1 - stddev_pop(gap) / avg(gap))) end + 1.37e-8, 6) as confidence,
  round(60000e0 * (count(*) - 1) / greatest(max(t_ms) - min(t_ms), 1) + 1.37e-8, 6) as summary_bpm from bg group by song_id""")
def a10(s, d):
    return t.regularity(c.beats(s, d)).select("song_id", r6("confidence").alias("confidence"), r6("summary_bpm").alias("summary_bpm"))


@query("a11_downbeat_mode", "notes beats", GAPS + """,
md as (select song_id, median(gap) as beat from bg group by song_id),
db as (select song_id, lead(t_ms) over (partition by song_id order by t_ms) - t_ms as gap from beats where beat_idx % (3 + song_id % 2) = 0),
bb as (select db.song_id, gap, round_even(gap / beat, 0) as bar from db join md using (song_id)),
cn as (select song_id, bar, count(*) as n, row_number() over (partition by song_id order by count(*) desc, bar) as rk from bb where bar > 0 group by song_id, bar),
st as (select song_id, count(*) as downs, stddev_pop(gap) / (avg(gap) + 1e-9) as cv from bb group by song_id),
tt as (select song_id, sum(n) as bars from cn group by song_id)""", """
select song_id, cast(bar as bigint) as beats_per_bar, round(greatest(0.3, least(0.92, (1 - 4 * cv) * n / bars)), 4) as confidence
from cn join st using (song_id) join tt using (song_id) where rk = 1 and downs >= 3""")
def a11(s, d):
    b = c.beats(s, d).withColumn("is_downbeat", F.col("beat_idx") % (3 + F.col("song_id") % 2) == 0)
    return t.downbeat_mode(b).withColumn("confidence", F.round("confidence", 4))


@query("a16_swing_ratio", "notes beats onsets", GAPS + """,
ig as (select b.song_id, beat_idx, (o.t_ms - b.t_ms) / gap as frac, row_number() over (partition by b.song_id, beat_idx order by abs(o.t_ms - (b.t_ms + 0.5 * gap)), o.t_ms) as rn
  from bg b join onsets o on o.song_id = b.song_id and o.t_ms > b.t_ms + 0.15 * gap and o.t_ms < nx - 0.05 * gap where gap > 0),
us as (select song_id, avg(frac) as m, count(*) as k from ig where rn = 1 group by song_id), nb as (select song_id, count(*) as n from beats group by song_id)""", """
select song_id, round(case when n < 2 or k is null then 0.5 else greatest(0.5, least(0.75, m)) end + 1.37e-8, 6) as swing_ratio,
  round(case when n < 2 then 0.1 when k is null then 0.2 else greatest(0.2, least(0.9, k / greatest(1, n - 1))) end + 1.37e-8, 6) as confidence from nb left join us using (song_id)""")
def a16(s, d):
    r = t.swing(c.onsets(s, d), c.beats(s, d))
    return r.select("song_id", r6("swing_ratio").alias("swing_ratio"), r6("confidence").alias("confidence"))


EVID = """
ev as (select song_id, frame_idx, least(1, flux) * (1 - flatness) as resonance, 1 - rms as void from frames),
ca as (select song_id, quantile_cont(resonance, 0.25) as ring_at, quantile_cont(resonance, 0.75) as hold_at, quantile_cont(void, 0.9) as void_at, count(*) as n from ev group by song_id)"""


def evidence(s, d):
    return c.frames(s, d).select("song_id", "frame_idx", (F.least(F.lit(1.0), F.col("flux")) * (1 - F.col("flatness"))).alias("resonance"),
                                 (1 - F.col("rms")).alias("void"))


@query("a18_resonance_calibration", "frames", EVID, """
select song_id, n < 30 as blind, round(case when n >= 30 then ring_at end, 6) as ring_at, round(case when n >= 30 then hold_at end, 6) as hold_at,
  round(case when n >= 30 then void_at end, 6) as void_at from ca""")
def a18(s, d):
    g = t.resonance_gate(evidence(s, d))
    return g.select("song_id", "blind", *[F.round(x, 6).alias(x) for x in ("ring_at", "hold_at", "void_at")])


@query("a18_gate_limits", "frames", EVID, """
select ev.song_id, frame_idx, case when n < 30 then 0.5e0 when void >= void_at then 0e0 when resonance >= hold_at then greatest(1e0, least(1.5e0, 2e0))
  when resonance >= ring_at then 1e0 else 0.5e0 end as reach from ev join ca using (song_id)""")
def a18b(s, d):
    e = evidence(s, d)
    j = e.join(t.resonance_gate(e), "song_id")
    lim = t.gate_limit(F.col("resonance"), F.col("void"), F.lit(0.5), F.lit(1.5), F.col("ring_at"), F.col("hold_at"), F.col("void_at"))
    return j.select("song_id", "frame_idx", lim.alias("reach"))


MAP = """
bi as (select song_id, t_ms, row_number() over w - 1 as i, coalesce(lead(t_ms) over w - t_ms, t_ms - lag(t_ms) over w) as gap,
   lead(t_ms) over w as nx, lag(t_ms) over w as pv from beats window w as (partition by song_id order by t_ms)),
pos as (select n.*, i + (n.start_ms - b.t_ms) / gap as beat_pos, gap as local_beat_ms from notes n join bi b on b.song_id = n.song_id
   and (n.start_ms >= b.t_ms or b.pv is null) and (n.start_ms < b.nx or b.nx is null))"""


@query("w25_tempo_map", "notes beats", MAP, """
select note_id, round(beat_pos, 6) as beat_pos, round(local_beat_ms, 6) as local_beat_ms, round(60000 / local_beat_ms, 6) as local_bpm from pos""")
def w25(s, d):
    p = t.tempo_map(c.notes(s, d), c.beats(s, d), "start_ms")
    return p.select("note_id", F.round("beat_pos", 6).alias("beat_pos"), F.round("local_beat_ms", 6).alias("local_beat_ms"),
                    F.round(60000 / F.col("local_beat_ms"), 6).alias("local_bpm"))


@query("w26_grid_reanchor", "notes beats", """
b0 as (select *, row_number() over (partition by song_id order by t_ms) - 1 as i, lead(t_ms) over (partition by song_id order by t_ms) as nx, count(*) over (partition by song_id) as n from beats),
ix as (select song_id, unnest(range(0, cast(floor((n - 1) * 1.5e0 + 1e-9) as bigint) + 1)) as j from (select distinct song_id, n from b0) q)""", """
select ix.song_id, j as new_idx, round(b.t_ms + case when nx is null then 0 else (j / 1.5e0 - i) * (nx - b.t_ms) end, 6) as t_ms
from ix join b0 b on b.song_id = ix.song_id and b.i = cast(floor(j / 1.5e0 + 1e-12) as bigint)""")
def w26(s, d):
    return t.re_anchor(c.beats(s, d), 1.5).select("song_id", "new_idx", F.round("t_ms", 6).alias("t_ms"))


@query("q07_blended_confidence", "tempo_witnesses", "", """
select song_id, source, round(0.3 * (song_id % 10) / 10e0 + 0.3 * weight + 0.4 * confidence, 6) as blended from tempo_witnesses""")
def q07(s, d):
    w = c.tempo_witnesses(s, d)
    return w.select("song_id", "source", F.round(0.3 * (F.col("song_id") % 10) / 10.0 + 0.3 * F.col("weight") + 0.4 * F.col("confidence"), 6).alias("blended"))


