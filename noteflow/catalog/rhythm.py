"""Onset grouping and rhythm estimators."""

from pyspark.sql import functions as F

from ..operators import rhythm as r
from ..operators import tempo as t
from ..plans.grouping import anchor_groups
from ..sources import corpus as c
from .registry import drawn, query, r6
from .tempo import REF

COMB = "co as (select distinct song_id, round_even(t_ms, 0) as t_ms from onsets)"
# anchored grouping as a recursive walk from each song's first onset
ANCH = """
st as (select distinct song_id, start_ms as t from notes),
gr(song_id, t) as (select song_id, min(t) from st group by song_id
  union all select g.song_id, (select min(s.t) from st s where s.song_id = g.song_id and s.t > g.t + {w}) from gr g
  where exists (select 1 from st s where s.song_id = g.song_id and s.t > g.t + {w}))"""


@query("r01_u01_combined_onsets", "notes onsets", COMB, "select song_id, t_ms from co")
def r01(s, d):
    return r.combined_onsets(c.onsets(s, d))


@query("u01_exclusive_onsets", "notes onsets", "", """
select song_id, round_even(t_ms, 0) as t_ms from onsets where witness = 'w1' except select song_id, round_even(t_ms, 0) from onsets where witness = 'w2'""")
def u01(s, d):
    o = c.onsets(s, d).select("song_id", F.bround("t_ms").alias("t_ms"), "witness")
    a, b = o.filter("witness = 'w1'").drop("witness"), o.filter("witness = 'w2'").drop("witness")
    return a.distinct().join(b, ["song_id", "t_ms"], "left_anti")


@query("w02_anchored_groups", "notes", ANCH.format(w=45), """
select n.note_id, round((select max(g.t) from gr g where g.song_id = n.song_id and g.t <= n.start_ms), 6) as group_ms from notes n""")
def w02(s, d):
    g = anchor_groups(c.notes(s, d).select("song_id", "start_ms", "note_id"), ["song_id"], "start_ms", "note_id", 45.0)
    return g.select("note_id", F.round("group_ms", 6).alias("group_ms"))


@query("r02_modal_ioi_tempo", "notes", ANCH.format(w=30) + """,
io as (select song_id, lead(t) over (partition by song_id order by t) - t as ioi from gr),
fi as (select * from io where ioi > 30 and ioi < 2000),
s0 as (select song_id, count(*) as n, stddev_samp(ioi) as sd, min(ioi) as lo, max(ioi) as hi from fi group by song_id having count(*) >= 6),
s1 as (select s0.*, power(n, -0.2) * sd as h from s0 where song_id in (select song_id from gr group by song_id having count(*) >= 8)),
de as (select f.song_id, g, any_value(lo + g * (hi - lo) / 399e0) as x, round(sum(exp(-0.5 * power((lo + g * (hi - lo) / 399e0 - ioi) / h, 2))), 9) as dn
  from fi f join s1 using (song_id) cross join range(400) q(g) where sd > 0 group by f.song_id, g),
pk as (select *, dn > lag(dn) over (partition by song_id order by g) and dn > lead(dn) over (partition by song_id order by g) as pk from de),
mo as (select song_id, coalesce(arg_min(x, [-dn, g]) filter (where pk), arg_min(x, [-dn, g])) as m from pk group by song_id),
rs as (select f.song_id, any_value(coalesce(m, lo)) as m, avg(case when abs(ioi - coalesce(m, lo)) < 15 then 1e0 else 0e0 end) as cc from fi f join s1 using (song_id) left join mo using (song_id) group by f.song_id)""", """
select song_id, round(m, 6) as modal_ms, round(case when 60000 / m > 300 then 60000 / m / power(2, ceil(log2(200 / m))) else 60000 / m end, 6) as tempo_bpm,
  round(least(0.85, 0.3 + cc * 1.2), 6) as confidence from rs""")
def r02(s, d):
    m = r.modal_tempo(c.notes(s, d))
    return m.select("song_id", F.round("modal_ms", 6).alias("modal_ms"), F.round("tempo_bpm", 6).alias("tempo_bpm"), F.round("confidence", 6).alias("confidence"))


FAMS = """
ii as (select song_id, t_ms, lead(t_ms) over (partition by song_id order by t_ms) - t_ms as ioi from co),
ij as (select *, lead(ioi, 1) over w as i1, lead(ioi, 2) over w as i2 from ii where ioi > 50 and ioi < 2000 window w as (partition by song_id order by t_ms)),
ra as (select song_id, i1 / ioi as ratio from ij where i1 is not null union all select song_id, i2 / ioi from ij where i2 is not null),
rf as (select * from ra where ratio > 0.4 and ratio < 2.6),
rh as (select song_id, 0.15 * stddev_samp(ratio) as h from rf group by song_id having count(*) >= 5 and stddev_samp(ratio) > 0),
rd as (select rf.song_id, g, 0.4e0 + g * 2.2e0 / 199e0 as x, round(sum(exp(-0.5 * power((0.4e0 + g * 2.2e0 / 199e0 - ratio) / h, 2))), 9) as dn from rf join rh using (song_id) cross join range(200) q(g) group by all),
rp as (select *, dn > lag(dn) over (partition by song_id order by g) and dn > lead(dn) over (partition by song_id order by g) as pk from rd),
fm as (select song_id, case when list_bool_or([abs(x - i) < 0.1 for i in [1, 2, 0.5, 4, 0.25]]) then 'binary' when list_bool_or([abs(x - i) < 0.1 for i in [1.3333, 0.6667, 0.3333, 2.6667]]) then 'ternary'
  when list_bool_or([abs(x - i) < 0.1 for i in [1.5, 0.6667, 3]]) then 'swing' when list_bool_or([abs(x - i) < 0.1 for i in [1.25, 0.8, 2.5]]) then 'quintuplet'
  when list_bool_or([abs(x - i) < 0.1 for i in [1.1429, 0.875, 2.2857]]) then 'septuplet' end as family, dn from rp where pk),
fs as (select song_id, family, sum(dn) as sc from fm where family is not null group by all),
sg as (select song_id, max(rh.h) as h from ij left join rh using (song_id) group by song_id),
fc as (select sg.song_id, f.family, f.o, case when h is null then 0.5e0 when sum(sc) over (partition by sg.song_id) > 0 then least(1, coalesce(sc, 0) / sum(sc) over (partition by sg.song_id)) else 0e0 end as score
  from sg cross join (values ('binary', 0), ('ternary', 1), ('swing', 2), ('quintuplet', 3), ('septuplet', 4)) f(family, o) left join fs on fs.song_id = sg.song_id and fs.family = f.family)"""


def families(s, d):
    return r.ratio_families(r.intervals(r.combined_onsets(c.onsets(s, d)), 50.0, 2000.0))


@query("r03_ratio_families", "notes onsets", COMB + "," + FAMS, "select song_id, family, round(score, 5) as score from fc")
def r03(s, d):
    return families(s, d).withColumn("score", F.round("score", 5))


LATT = COMB + "," + FAMS + """,
ev as (select song_id, t_ms / 1000 as t, case when lead(t_ms) over w - t_ms > 50 and lead(t_ms) over w - t_ms < 2000 then (lead(t_ms) over w) / 1000 - t_ms / 1000 end as ioi from co window w as (partition by song_id order by t_ms)),
oc as (select song_id, base from (select song_id, base, row_number() over (partition by song_id order by base) as rn from (select distinct song_id, round(ioi, 4) as base from ev where ioi is not null) q where base > 0.05) z where rn <= 20),
sy as (select distinct round(60e0 / (i / 2e0), 4) as base from range(40, 600) q(i)),
ok as (select song_id from ev group by song_id having count(ioi) >= 3 and count(*) >= 4),
pc as (select distinct song_id, round(base * m, 6) as period from (select song_id, base from oc union all select song_id, base from ok cross join sy) b cross join (values (1), (2), (3), (4), (6), (8)) mm(m)
   where round(base * m, 6) between 0.2 and 3.0 and song_id in (select song_id from ok)),
sa as (select p.song_id, period, avg(least(t % period, period - t % period)) as dd, stddev_pop((ioi % period) / period) as sd from pc p join ev on ev.song_id = p.song_id group by p.song_id, period),
fx as (select song_id, max(score) as rs from fc group by song_id),
sb as (select *, greatest(0, least(1, dd / (period / 2))) as error, least(1, sd * 2) as entropy from sa join fx using (song_id)),
bl as (select *, row_number() over (partition by song_id order by round((1 - error) * 0.4 + 0.2 + (1 - entropy) * 0.1 + rs * 0.1, 9) desc, period) as rn,
   greatest(0, least(1, (1 - error) * 0.3 + 0.15 + (1 - entropy) * 0.2 + rs * 0.2)) as conf from sb)"""


def lattice(s, d):
    return r.lattice(r.combined_onsets(c.onsets(s, d)), families(s, d))


@query("r04_lattice_search", "notes onsets", LATT, """
select song_id, round(period, 6) as period, round(error, 5) as error, round(entropy, 5) as entropy, round(conf, 5) as confidence from bl where rn = 1""")
def r04(s, d):
    lat = lattice(s, d)
    return lat.select("song_id", F.round("period", 6).alias("period"), *[F.round(x, 5).alias(x) for x in ("error", "entropy", "confidence")])


@query("r05_tactus", "notes onsets", LATT + """,
be as (select * from bl where rn = 1),
pr as (select ev.song_id, t % period as r, period from ev join be using (song_id)),
pl as (select song_id, min(r) as lo, max(r) as hi from pr group by song_id),
ph as (select song_id, any_value(period) as period, any_value(lo) as lo, any_value(hi) as hi, b, count(*) as n
  from (select pr.*, lo, hi, case when (hi - lo) / 20 > 0 then least(19, floor((r - lo) / ((hi - lo) / 20))) else 0 end as b from pr join pl using (song_id)) q group by song_id, b),
pc2 as (select song_id, (lo + (hi - lo) / 20 * (b + 0.5e0)) / period as phase from (select *, row_number() over (partition by song_id order by n desc, b) as rn from ph) q where rn = 1),
tc as (select be.song_id, conf, phase * period as ph, i, period * m as p from be join pc2 using (song_id) cross join (values (0, 1e0/8e0), (1, 1e0/6e0), (2, 0.25e0), (3, 1e0/3e0), (4, 0.5e0), (5, 1e0), (6, 2e0), (7, 3e0), (8, 4e0), (9, 6e0), (10, 8e0)) x(i, m)
  where 60 / (period * m) between 20 and 300),
ta as (select song_id, i, p, any_value(conf) as conf, avg(case when least(rem, p - rem) < p * 0.15e0 then 1e0 else 0e0 end) as align
  from (select tc.*, (((ev.t - ph) % p) + p) % p as rem from tc join ev using (song_id)) q group by song_id, i, p),
tb as (select *, row_number() over (partition by song_id order by round(align * 0.8e0 + exp(-0.5e0 * power(log2(60 / p / 110) / 0.9e0, 2)) * 0.2e0, 9) desc, i) as rn from ta)""", """
select song_id, 60 / p as tempo_bpm, greatest(0, least(1, conf * 0.5e0 + align * 0.5e0)) as confidence, 0.6e0 as weight from tb where rn = 1""")
def r05(s, d):
    return r.tactus(r.combined_onsets(c.onsets(s, d)), lattice(s, d))


PULSE = COMB + "," + REF + """,
hy as (select song_id, i, lv, 60000 / bpm / lv as period, conf / lv as prob from res cross join (values (0, 1e0), (1, 2e0), (2, 3e0), (3, 4e0), (4, 0.5e0), (5, 0.25e0)) l(i, lv) where 60000 / (60000 / bpm / lv) between 20 and 300),
hs as (select h.song_id, h.i, lv, period, any_value(prob) as prob, count(t_ms) as n, sqrt(power(avg(cos(t_ms % period / period * 2 * pi())), 2) + power(avg(sin(t_ms % period / period * 2 * pi())), 2)) as rl
  from hy h left join co on co.song_id = h.song_id group by all),
hp as (select *, case when n < 4 then prob else greatest(0.1, least(1, prob * 0.7 + rl * 0.3)) end as p0, row_number() over (partition by song_id order by round(abs(period - 480), 9), i) as near from hs),
hq as (select *, case when near = 1 then p0 * 0.7 + 0.6 * 0.3 else p0 end as p from hp),
hb as (select *, row_number() over (partition by song_id order by round(p, 9) desc, i) as rk from hq)"""


def pulse(s, d):
    return r.pulse_field(r.combined_onsets(c.onsets(s, d)), t.resolve_tempo(c.tempo_witnesses(s, d)), 480.0, 0.6)


@query("r06_pulse_hypotheses", "notes onsets tempo_witnesses", PULSE, """
select song_id, lv as level, round(period, 6) as period_ms, round(p, 6) as probability, rk = 1 as best from hb""")
def r06(s, d):
    return pulse(s, d).select("song_id", "level", F.round("period_ms", 6).alias("period_ms"), F.round("probability", 6).alias("probability"), "best")


@query("r07_phase_coherence", "notes onsets tempo_witnesses", PULSE + """,
cb as (select hb.song_id, period, count(t_ms) as n, avg(cos(t_ms % period / period * 2 * pi())) as cc, avg(sin(t_ms % period / period * 2 * pi())) as ss from hb join co on co.song_id = hb.song_id where rk = 1 group by all),
p0 as (select *, case when n < 3 then 0e0 else (case when atan2(ss, cc) < 0 then atan2(ss, cc) + 2 * pi() else atan2(ss, cc) end) / (2 * pi()) * period end as ph, case when n < 3 then 0e0 else sqrt(cc * cc + ss * ss) end as coh from cb),
pb as (select p0.*, k, ph + k * period as beat from p0 cross join range(-3, 4) q(k)),
nb as (select pb.song_id, k, co.t_ms - beat as off, row_number() over (partition by pb.song_id, k order by abs(co.t_ms - beat), co.t_ms) as rn from pb join co on co.song_id = pb.song_id and abs(co.t_ms - beat) < 50),
sh as (select song_id, median(off) as shift from nb where rn = 1 group by song_id)""", """
select song_id, round(period, 6) as period_ms, round(ph + coalesce(shift, 0), 4) as phase_ms, round(coh, 6) as coherence from p0 left join sh using (song_id)""")
def r07(s, d):
    p = r.phase(r.combined_onsets(c.onsets(s, d)), pulse(s, d).filter("best"))
    return p.select("song_id", F.round("period_ms", 6).alias("period_ms"), F.round("phase_ms", 4).alias("phase_ms"), F.round("coherence", 6).alias("coherence"))


@query("r09_beat_accents", "notes beats frames", """
fn as (select *, lead(t_ms) over (partition by song_id order by frame_idx) as nt, lead(flux) over (partition by song_id order by frame_idx) as nf, frame_idx = 0 as first from frames)""", """
select b.song_id, beat_idx, round(case when b.t_ms < f.t_ms then flux when nt is null then flux else flux + (b.t_ms - f.t_ms) / (nt - f.t_ms) * (nf - flux) end + 1.37e-8, 6) as accent
from beats b join fn f on f.song_id = b.song_id and (b.t_ms >= f.t_ms or f.first) and (b.t_ms < nt or nt is null)""")
def r09(s, d):
    return r.beat_accents(c.beats(s, d), c.frames(s, d)).select("song_id", "beat_idx", r6("accent").alias("accent"))


def accents(s, d):
    return r.with_count(c.frames(s, d).select("song_id", F.col("frame_idx").alias("beat_idx"), F.col("flux").alias("accent")))


@query("r10_downbeat_salience", "frames", """
ac as (select song_id, frame_idx as i, flux as a, count(*) over (partition by song_id) as n from frames),
fo as (select song_id, k, i % k as p, avg(a) as m from ac cross join (values (2), (3), (4), (5), (6), (7), (9), (12)) q(k) where n >= k * 3 and i < (n // k) * k group by all),
fg as (select song_id, k, arg_min(p, [-round(m, 9), p]) as phase, max(m) as top, (sum(m) - max(m)) / (k - 1) as oth from fo group by song_id, k)""", """
select song_id, k as numerator, phase, round(greatest(0, (top - oth) / (top + oth)), 6) as salience from fg""")
def r10(s, d):
    x = r.downbeat_salience(accents(s, d))
    return x.select("song_id", "numerator", "phase", F.round("salience", 6).alias("salience"))


@query("r11_time_signature", "notes beats frames", f"""
fn as (select *, lead(t_ms) over (partition by song_id order by frame_idx) as nt, lead(flux) over (partition by song_id order by frame_idx) as nf, frame_idx = 0 as first from frames),
ba as (select b.song_id, beat_idx as i, case when b.t_ms < f.t_ms then flux when nt is null then flux else flux + (b.t_ms - f.t_ms) / (nt - f.t_ms) * (nf - flux) end as a
  from beats b join fn f on f.song_id = b.song_id and (b.t_ms >= f.t_ms or f.first) and (b.t_ms < nt or nt is null)),
an as materialized (select *, count(*) over (partition by song_id) as n from ba),
tr as materialized (select song_id, a, n, trial, row_number() over (partition by song_id, trial order by {drawn('i * 1009 + trial', 7)}, i) - 1 as i from (select an.*, unnest(range(1, 101)) as trial from an) q),
al as (select song_id, 0 as trial, a, n, i from an union all select song_id, trial, a, n, i from tr),
ak as materialized (select al.*, unnest([2, 3, 4, 5, 6, 7, 9, 12]) as k from al),
fo as (select song_id, trial, k, i % k as p, avg(a) as m from ak where n >= k * 3 and i < (n // k) * k group by all),
fg as (select song_id, trial, k, arg_min(p, [-round(m, 9), p]) as phase, max(m) as top, (sum(m) - max(m)) / (k - 1) as oth from fo group by song_id, trial, k),
sl as (select song_id, trial, k, phase, case when top + oth > 0 then greatest(0, (top - oth) / (top + oth)) else 0e0 end as s from fg),
bs as (select song_id, k, avg(s) filter (where trial > 0) as base, quantile_cont(s, 0.95) filter (where trial > 0) as thr from sl group by song_id, k),
sc as (select song_id, k, phase, case when base >= 1 then 0e0 else greatest(0, least(1, (s - base) / (1 - base))) end as score, base < 1 and s > thr as sig from sl join bs using (song_id, k) where trial = 0),
bt as (select song_id, arg_min({{'k': k, 's': score, 'p': phase}}, [-round(score, 9), k]) as b from sc where sig group by song_id),
sg as (select song_id, count(*) as n from beats group by song_id)""", """
select song_id, cast(case when n >= 8 and b is not null then b.k else 4 end as int) as numerator, 4 as denominator, round(case when n >= 8 and b is not null then b.s else 0.3e0 end + 1.37e-8, 6) as confidence,
  cast(case when n >= 8 and b is not null and b.s >= 0.30 then b.p else 0 end as bigint) as phase from sg left join bt using (song_id)""")
def r11(s, d):
    """Chance-corrected meter of every song; accents are the beat-level onset strength."""
    a = r.with_count(r.beat_accents(c.beats(s, d), c.frames(s, d)).select("song_id", "beat_idx", "accent"))
    m = r.time_signature(c.beats(s, d), r.scored_meters(a))
    return m.select("song_id", F.col("numerator").cast("int").alias("numerator"), F.col("denominator").cast("int").alias("denominator"), r6("confidence").alias("confidence"), F.col("phase").cast("bigint").alias("phase"))


@query("r12_spectral_meter", "frames", """
ac as (select song_id, frame_idx as i, flux - avg(flux) over (partition by song_id) as x, count(*) over (partition by song_id) as n from frames),
tb as (select distinct song_id, n, k, cast(round_even(n / cast(k as double), 0) as bigint) as tgt from ac cross join (values (2), (3), (4), (5), (6), (7), (9), (12)) q(k) where n >= k * 3 and n >= 16),
bn as (select distinct song_id, n, tgt + o as b from tb cross join (values (-1), (0), (1)) oo(o) where tgt + o between 0 and n // 2),
pw as (select b.song_id, b.b, power(sum(x * cos(-2 * pi() * i * b / ac.n)), 2) + power(sum(x * sin(-2 * pi() * i * b / ac.n)), 2) as p from bn b join ac using (song_id) group by b.song_id, b.b),
tt as (select song_id, (any_value(n) * sum(x * x) + power(sum(x), 2) + case when any_value(n) % 2 = 0 then power(sum(x * case when i % 2 = 0 then 1 else -1 end), 2) else 0 end) / 2 + 1e-8 as tot from ac group by song_id),
sh as (select tb.song_id, k, sum(p) / any_value(tot) as share from tb join pw on pw.song_id = tb.song_id and abs(pw.b - tgt) <= 1 join tt on tt.song_id = tb.song_id where tgt between 1 and n // 2 group by tb.song_id, k),
bs as (select *, row_number() over (partition by song_id order by round(share, 9) desc, k) as rn from sh where share > 0)""", """
select song_id, k as numerator, round(share, 6) as share from bs where rn = 1""")
def r12(s, d):
    return r.spectral_meter(accents(s, d).drop("n")).withColumn("share", F.round("share", 6))


@query("r13_autocorrelation", "frames", "", """
select a.song_id, cast(b.frame_idx - a.frame_idx as bigint) as lag, round(sum(a.flux * b.flux), 5) as ac from frames a join frames b on a.song_id = b.song_id and b.frame_idx between a.frame_idx and a.frame_idx + 60 group by all""")
def r13a(s, d):
    return r.autocorrelation(c.frames(s, d), "flux", 60, 128).select("song_id", F.col("lag").cast("bigint").alias("lag"), F.round("ac", 5).alias("ac"))


def ac_at(bpm):
    """Autocorrelation at a tempo's lag, between two frames."""
    pos = f"(60e0 / ({bpm}) / 0.02322e0)"
    return (f"(case when floor{pos} < 1 or floor{pos} + 1 >= frames then 0e0 else greatest(0e0, coalesce(a[cast(floor{pos} as int) + 1] * (1 - ({pos} - floor{pos}))"
            f" + a[cast(floor{pos} as int) + 2] * ({pos} - floor{pos}), 0)) end)")


def ac_peak(k):
    return f"greatest(0e0, {ac_at(f'bpm * {k}')} - 0.5e0 * ({ac_at(f'bpm * ({k} + 0.5e0)')} + {ac_at(f'bpm * ({k} - 0.5e0)')}))"


@query("r13_octave_correction", "tempo_witnesses frames", REF + f""",
ra as (select a.song_id, b.frame_idx - a.frame_idx as lag, sum(a.flux * b.flux) as ac from frames a join frames b on a.song_id = b.song_id and b.frame_idx between a.frame_idx and a.frame_idx + 130 group by all),
al as (select song_id, list_transform(list(ac order by lag), lambda x: case when max(case when lag = 0 then ac end) > 0 then x / max(case when lag = 0 then ac end) else x end) as a from ra group by song_id),
fn as (select song_id, count(*) as frames from frames group by song_id),
cc as (select res.song_id, bpm as raw, conf, frames, a, i, bpm * n / d as bpm from res join al using (song_id) join fn using (song_id)
  cross join (values (0, 1e0, 1e0), (1, 1e0, 2e0), (2, 2e0, 1e0), (3, 1e0, 3e0), (4, 3e0, 1e0), (5, 2e0, 3e0), (6, 3e0, 2e0), (7, 3e0, 4e0), (8, 4e0, 3e0), (9, 5e0, 6e0), (10, 4e0, 5e0), (11, 5e0, 4e0)) x(i, n, d)),
ce as (select song_id, raw, conf, frames, i, bpm, exp(-0.5e0 * power(log2(bpm / 110) / 0.9e0, 2)) as prior, round(greatest(0e0, {ac_at('bpm')} - 0.3e0 * greatest({ac_at('bpm * 2')}, {ac_at('bpm * 3')})) * exp(-0.5e0 * power(log2(bpm / 110) / 0.9e0, 2)), 9) as eff,
  least({ac_peak(2)}, {ac_peak(3)}) as coh from cc where bpm between 20 and 300),
co2 as (select *, row_number() over (partition by song_id order by eff desc, i) as rn from ce),
bb as (select song_id, any_value(raw) as raw, any_value(conf) as conf, any_value(frames) as frames, arg_min({{'i': i, 'bpm': bpm, 'eff': eff, 'coh': coh}}, rn) as b,
  coalesce(arg_min({{'i': i, 'bpm': bpm, 'eff': eff, 'coh': coh}}, rn) filter (where i = 0), arg_min({{'i': i, 'bpm': bpm, 'eff': eff, 'coh': coh}}, rn)) as e from co2 group by song_id),
rb as (select *, case when b.i = 0 or b.eff - e.eff < 0.15e0 * (1 + greatest(0, least(1, conf))) then e else b end as r from bb),
sl as (select rb.song_id, arg_min(ce.bpm, [-ce.coh, cast(ce.i as double)]) as slow from rb join ce on ce.song_id = rb.song_id and ce.bpm < r.bpm and ce.coh >= 0.05 and ce.prior >= 0.4 and ce.coh >= r.coh + 0.04 group by rb.song_id)""", """
select song_id, round(case when frames >= 8 and raw > 0 then coalesce(slow, r.bpm) else raw end + 1.37e-8, 6) as tempo_bpm,
  case when not (frames >= 8 and raw > 0) then 'insufficient_evidence' when slow is not null then 'compound_tactus' when r.i = 0 then 'no_correction_needed' else 'related_ratio' end as reason from rb left join sl using (song_id)""")
def r13(s, d):
    x = r.correct_octave(t.resolve_tempo(c.tempo_witnesses(s, d)), c.frames(s, d), 23.22)
    return x.select("song_id", r6("tempo_bpm").alias("tempo_bpm"), "reason")


# frames four times as far apart, so that the songs of the tables hold several windows of 12 s
CURVE = REF + """,
fn as (select song_id, count(*) as n from frames group by song_id),
wx as (select f.song_id, w, list(flux order by frame_idx) as x from (select song_id, w from fn, range(0, 1000) q(w) where w * 32 < greatest(1, n - 129)) w join frames f on f.song_id = w.song_id and f.frame_idx >= w * 32 and f.frame_idx < w * 32 + 129 group by all),
we as (select wx.song_id, w, bpm, list_transform(x, lambda v: v - list_avg(x)) as e, len(x) as n from wx join res using (song_id)),
wl as (select *, least(cast(floor(60 / (0.09288e0 * (bpm * 0.75e0))) as int), n - 2) as l1, greatest(2, cast(floor(60 / (0.09288e0 * (bpm * 1.33e0))) as int)) as l0 from we where n >= 8),
wa as (select song_id, w, bpm, l0, l1, list_transform(range(0, l1 + 1), lambda l: list_dot_product(e[1:n - l], e[l + 1:n]) / list_dot_product(e, e)) as ac from wl where l1 > l0 and list_dot_product(e, e) > 0),
wk as (select *, l0 - 1 + list_position(ac[l0 + 1:l1], list_max(ac[l0 + 1:l1])) as k from wa),
wd as (select *, ac[k] - 2 * ac[k + 1] + ac[k + 2] as d from wk),
cu as (select song_id, w, bpm, 60 / (0.09288e0 * (k + greatest(-1, least(1, case when abs(d) > 1e-12 then 0.5e0 * (ac[k] - ac[k + 2]) / d else 0 end)))) as local_bpm from wd)"""


def curve(s, d):
    return r.local_tempo(c.frames(s, d), t.resolve_tempo(c.tempo_witnesses(s, d)).select("song_id", "tempo_bpm"), 92.88)


@query("r14_local_tempo_curve", "tempo_witnesses frames", CURVE, """
select song_id, w, round((w * 32 + 129 / 2e0) / (1000 / 92.88e0) + 1.37e-8, 6) as t_s, round(bpm + 1.37e-8, 6) as tempo_bpm, round(local_bpm + 1.37e-8, 6) as local_bpm from cu""")
def r14(s, d):
    return curve(s, d).select("song_id", "w", *[r6(x).alias(x) for x in ("t_s", "tempo_bpm", "local_bpm")])


@query("r15_drift_class", "tempo_witnesses frames", CURVE + """,
c1 as (select song_id, w, bpm, count(*) over (partition by song_id) as n, local_bpm as b, lag(local_bpm) over v as p1, lag(local_bpm, 2) over v as p2, lag(local_bpm, 3) over v as p3, lag(local_bpm, 4) over v as p4 from cu window v as (partition by song_id order by w)),
c2 as (select song_id, w, bpm, n, case when n >= 5 then (b + p1 + p2 + p3 + p4) / 5 else b end as sm from c1),
c3 as (select *, sm - lag(sm) over (partition by song_id order by w) as d from c2 where sm is not null),
c4 as (select song_id, any_value(n) as n, any_value(bpm) as ref, max(sm) - min(sm) as span, avg(case when d > 0 then 1e0 when d is not null then 0e0 end) as up, avg(case when d < 0 then 1e0 when d is not null then 0e0 end) as down,
  coalesce(max(abs(d)), 0) as biggest, median(abs(d)) as med from c3 group by song_id),
c5 as (select *, greatest(up, down) as mono, span / greatest(ref, 1) <= 0.06 as steady, biggest >= 0.10e0 * ref and biggest > 2.5e0 * (med + 1e-9) as step from c4)""", """
select song_id, case when n < 4 or steady then 'steady' when step then 'step_change' when mono >= 0.85 and up > down then 'accelerando' when mono >= 0.85 then 'ritardando' else 'steady' end as kind,
  round(span + 1.37e-8, 6) as span_bpm, round(case when n < 4 then 0e0 when steady then 0.9e0 when step then 0.7e0 when mono >= 0.85 then least(0.85e0, mono) else 0.5e0 end + 1.37e-8, 6) as confidence from c5""")
def r15(s, d):
    return r.drift_class(curve(s, d)).select("song_id", "kind", *[r6(x).alias(x) for x in ("span_bpm", "confidence")])
