"""Frames, regions, textures."""

from pyspark.sql import functions as F

from ..operators import annotations as an
from ..operators import frames as f
from ..operators import texture as tx
from ..plans.timeline import row_no, scan
from ..sources import corpus as c
from .registry import query, r6


def wide_frames(s, d):
    return c.frames(s, d).withColumns({"high_rms": F.col("rms") * F.col("flatness"), "low_rms": F.col("rms") * 0.5})


ACTIVITY = """
a0 as (select song_id, frame_idx, rms, flux, flatness, rms * flatness as hi, rms * 0.5e0 as lo, 20e0 * log10(greatest(rms, 1e-10)) as db from frames),
a1 as materialized (select song_id, quantile_cont(db, 0.95) as loud, quantile_cont(flux, 0.95) as busy, min(frame_idx) as lf, max(frame_idx) as rf from a0 group by song_id),
a2 as materialized (
  select song_id, frame_idx, rms, flux, flatness, hi, lo, db, loud, lf, rf, 0 as k, frame_idx as i, greatest(0e0, least(1e0, flux / greatest(busy, 1e0))) as norm from a0 join a1 using (song_id)
  union all select song_id, frame_idx, rms, flux, flatness, hi, lo, db, loud, lf, rf, k, frame_idx + k, greatest(0e0, least(1e0, flux / greatest(busy, 1e0)))
  from (select a0.*, loud, busy, lf, rf, unnest(case when frame_idx = lf then range(-51, 0) else [] end || case when frame_idx = rf then range(1, 52) else [] end) as k
    from a0 join a1 using (song_id) where frame_idx = lf or frame_idx = rf) e),
-- surroundings by a join on the position: moving quantiles as window functions fail on some builds
qa as materialized (select a.song_id, a.i, quantile_cont(b.db, 0.15) as low, quantile_cont(b.norm, 0.5) filter (where b.i between a.i - 16 and a.i + 15) as base
  from a2 a join a2 b on a.song_id = b.song_id and b.i between a.i - 43 and a.i + 42 where a.k = 0 or abs(a.k) = 1 group by a.song_id, a.i),
a3 as materialized (select a2.*, least(low, loud - 18e0) as fl, base,
  avg(db) over (partition by song_id order by i rows between 5 preceding and 5 following) as mean from a2 left join qa using (song_id, i)),
a4 as (select *, case when db < -60 then 0e0 else greatest(0e0, least(1e0, (db - fl) / 18e0)) end as level, lag(mean) over w as pm, lead(mean) over w as nm,
  greatest(0e0, least(1e0, (norm - base) / greatest(1e0 - base, 0.25e0))) as hit from a3 window w as (partition by song_id order by i)),
a5 as materialized (select *, greatest(0e0, least(1e0, ((case when lf = rf then 0e0 when i = lf then mean - nm when i = rf then pm - mean else (pm - nm) / 2e0 end) - 0.02e0) / 0.08e0)) as fall,
  greatest(0e0, least(1e0, level / 0.25e0)) as here from a4 where k = 0),
a6 as (select *, max(hit) over (partition by song_id order by i rows between 1 preceding and 1 following) as attack, rms * rms + 1e-8 as power from a5),
a7 as (select *, here * (1e0 - attack) * fall as rings from a6),
a8 as (select *, list_sort([1e0 - here, rings, here - rings]) as states from a7)"""
SCORES = {
    "energy_floor": "1e0 - level", "attack": "attack", "fall": "fall", "void": "1e0 - here", "resonance": "rings", "active": "here - rings",
    "cymbal": "here * greatest(0e0, least(1e0, hi * hi / power)) * fall * (1e0 - attack)", "pedal": "here * greatest(0e0, least(1e0, lo * lo / power)) * (1e0 - attack) * (1e0 - fall)",
    "harmonic": "1e0 - greatest(0e0, least(1e0, flatness))", "confidence": "greatest(0e0, least(1e0, states[3] - states[2]))",
}


@query("w21_frame_activity", "frames", ACTIVITY, "select song_id, frame_idx, " + ", ".join(f"round({x} + 1.37e-8, 6) as {n}" for n, x in SCORES.items()) + " from a8")
def w21(s, d):
    return f.activity(wide_frames(s, d), 23.22).select("song_id", "frame_idx", *[r6(n).alias(n) for n in f.FEATURES])


@query("w22_regions", "frames", """
hx as (select song_id, frame_idx, case when frame_idx - lag(frame_idx) over (partition by song_id order by frame_idx) - 1 < 2 then 0 else 1 end as b from frames where rms > 0.5),
hi as (select *, sum(b) over (partition by song_id order by frame_idx) as isl from hx),
rg as (select song_id, min(frame_idx) as a, max(frame_idx) as b from hi group by song_id, isl having max(frame_idx) - min(frame_idx) + 1 >= 2)""", """
select rg.song_id, a as first_frame, b as last_frame, round(avg(rms) + 1.37e-8, 6) as mean_score from rg join frames f on f.song_id = rg.song_id and f.frame_idx between a and b group by all""")
def w22(s, d):
    return f.regions(c.frames(s, d), "rms", 0.5, 2).select("song_id", "first_frame", "last_frame", r6("mean_score").alias("mean_score"))


@query("j20_recurrence_edges", "", """
bt as (select label as song_id, row_number() over (partition by label order by vec_id) - 1 as i, list_transform(embedding, lambda x: cast(x as double)) as f from embeddings),
nn as (select song_id, cast(2 * ceil(sqrt(greatest(count(*) - 5, 0))) as bigint) as k from bt group by song_id),
dd as (select a.song_id, a.i, b.i as j, round(1 - list_dot_product(a.f, b.f) / sqrt(list_dot_product(a.f, a.f) * list_dot_product(b.f, b.f)), 12) as d
  from bt a join bt b on a.song_id = b.song_id and abs(a.i - b.i) >= 3),
ne as (select * from (select dd.*, k, row_number() over (partition by dd.song_id, i order by d, j) as rn from dd join nn using (song_id)) q where rn <= k),
wd as (select song_id, median(d) as w from ne where rn = k group by song_id),
af as (select song_id, i, j, exp(-d / greatest(w, 1e-12)) as a from ne join wd using (song_id)),
sy as (select song_id, i, j, max(a) as affinity from (select * from af union all select song_id, j, i, a from af) q group by all),
st as (select song_id, i, list_sum(list_transform(list_zip(f, g), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as d
  from (select *, lead(f) over (partition by song_id order by i) as g from bt) q where g is not null),
sg as (select song_id, median(d) as s from st group by song_id),
p0 as (select song_id, i, i + 1 as j, exp(-d / (s + 1e-9)) as path from st join sg using (song_id)),
pa as (select * from p0 union all select song_id, j, i, path from p0),
ed as (select song_id, i, j, coalesce(affinity, 0) as affinity, coalesce(path, 0) as path from sy full join pa using (song_id, i, j)),
dg as (select song_id, i, sum(path) as p, sum(affinity) as r from ed group by song_id, i),
mu as (select song_id, sum(p * (p + r)) / (sum((p + r) * (p + r)) + 1e-9) as mu from dg group by song_id)""", """
select song_id, i, j, round(affinity + 1.37e-8, 6) as affinity, round(path + 1.37e-8, 6) as path, round(mu * affinity + (1 - mu) * path + 1.37e-8, 6) as weight from ed join mu using (song_id)""")
def j20(s, d):
    """Vectors of one label stand for the beats of one song, in order of their ids."""
    v = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("song_id"), "vec_id", F.col("embedding").alias("feat"))
    at = scan(v.withColumn("_at", F.col("vec_id").cast("double")), ["song_id"], ["_at"], {"rn": row_no()}, 10000.0)
    e = f.recurrence_edges(at.select("song_id", (F.col("rn") - 1).cast("bigint").alias("i"), "feat"))
    return e.select("song_id", "i", "j", *[r6(x).alias(x) for x in ("affinity", "path", "weight")])


def labelled(s, d):
    b = c.beats(s, d).withColumn("label", F.floor(F.col("beat_idx") / 7) % 3 + F.when(F.col("beat_idx") % 11 == 0, 1).otherwise(0))
    m = f.median_labels(b)
    from ..plans.timeline import nxt, scan

    t = scan(c.beats(s, d), ["song_id"], ["t_ms", "beat_idx"], {"next_ms": nxt("t_ms")})
    return t.withColumn("next_ms", F.coalesce("next_ms", F.col("t_ms") + 500.0)).join(m, ["song_id", "beat_idx"])


# labels smoothed by a median of nine, mirrored at the ends; then one run a step goes to a neighbour
SECTIONS = """
lb as (select song_id, beat_idx, t_ms, coalesce(lead(t_ms) over (partition by song_id order by t_ms, beat_idx), t_ms + 500e0) as nx,
  beat_idx // 7 % 3 + case when beat_idx % 11 = 0 then 1 else 0 end as l from beats),
lw as (select *, coalesce(list(l) over (partition by song_id order by beat_idx rows between 4 preceding and 1 preceding), []) as bf,
  coalesce(list(l) over (partition by song_id order by beat_idx rows between 1 following and 4 following), []) as af from lb),
lm as (select song_id, beat_idx, t_ms, nx, list_sort(bf || [l] || af || (([l] || af)[1:4 - len(bf)]) || (([l] || list_reverse(bf))[1:4 - len(af)])) as v from lw),
ls as (select song_id, beat_idx, t_ms, nx, v[len(v) // 2 + 1] as l from lm),
lr as (select *, case when l = lag(l) over (partition by song_id order by t_ms, beat_idx) then 0 else 1 end as b from ls),
li as (select *, sum(b) over (partition by song_id order by t_ms, beat_idx rows unbounded preceding) as isl from lr),
lg as (select song_id, isl, any_value(l) as l, min(t_ms) as a, max(nx) as b from li group by all),
sr(song_id, rs, go) as (
  select song_id, list({'l': l, 'a': a, 'b': b} order by a), true from lg group by song_id
  union all
  select song_id, case when stop then rs else list_filter(list_transform(range(1, len(rs) + 1),
      lambda i: case when i = k then null when i = host then {'l': rs[i].l, 'a': least(rs[i].a, rs[k].a), 'b': greatest(rs[i].b, rs[k].b)} else rs[i] end), lambda x: x is not null) end, not stop
  from (select *, case when k = 1 then 2 when k = len(rs) or rs[k - 1].l = rs[k].l then k - 1 when rs[k + 1].l = rs[k].l or rs[k - 1].b - rs[k - 1].a < rs[k + 1].b - rs[k + 1].a then k + 1 else k - 1 end as host
    from (select song_id, rs, m.i as k, len(rs) = 1 or m.d >= 2000e0 as stop
      from (select song_id, rs, list_sort(list_transform(range(1, len(rs) + 1), lambda i: {'d': rs[i].b - rs[i].a, 's': rs[i].a, 'i': i}))[1] as m from sr where go) x) y) z),
sf as (select song_id, unnest(rs) as r from sr where not go),
sg as (select song_id, r.l as l, r.a as a, r.b as b, case when r.l = lag(r.l) over (partition by song_id order by r.a) then 0 else 1 end as n from sf),
sh as (select *, sum(n) over (partition by song_id order by a rows unbounded preceding) as isl from sg),
sj as (select song_id, isl, any_value(l) as l, min(a) as a, max(b) as b from sh group by all),
sk as (select song_id, l, row_number() over (partition by song_id order by min(a)) as letter from sj group by song_id, l)"""


@query("w23_section_assembly", "notes beats", SECTIONS, """
select song_id, row_number() over (partition by song_id order by a) - 1 as idx, chr(cast(64 + letter as int)) as label, round(a, 6) as start_ms, round(b, 6) as end_ms from sj join sk using (song_id, l)""")
def w23(s, d):
    return f.assemble_sections(labelled(s, d), 2000.0).withColumns({x: F.round(x, 6) for x in ("start_ms", "end_ms")})


@query("w24_beat_clusters")
def w24(s, d):
    e = c.table(s, d, "embeddings").select(F.col("label").alias("song_id"), F.col("vec_id").alias("beat_idx"), F.col("embedding").alias("features"))
    return f.cluster_beats(e).select("song_id", "beat_idx", F.col("label").alias("cluster"))


DRUM = """
dv as (select song_id, case when stem = 'bass' then 'kick' when stem = 'drums' then 'snare' else 'closed_hihat' end as voice, t_ms, energy, energy * (cast(floor(t_ms) as bigint) % 3) / 2e0 as rival from onsets),
dq as (select song_id, voice, quantile_cont(energy, 0.9) as p90 from dv group by all),
dk as (select distinct song_id, voice, t_ms from dv join dq using (song_id, voice) where energy >= 0.25e0 * p90 and (voice <> 'kick' or energy >= 1.2e0 * rival)),
da(song_id, t) as (select song_id, min(t_ms) from dk group by song_id
  union all select * from (select a.song_id, (select min(k.t_ms) from dk k where k.song_id = a.song_id and k.t_ms - a.t > 35e0) as t from da a) q where t is not null),
dn as (select * from (values """ + ", ".join(f"('{v}', {pitch}, {float(ms)}e0)" for v, (pitch, ms) in f.DRUMS.items()) + """) q(voice, pitch, ms))"""


@query("w40_drum_assembly", "notes onsets", DRUM, """
select song_id, voice, pitch, round(t, 6) as start_ms, round(t + ms, 6) as end_ms, 0.7e0 as confidence from da cross join dn
where exists(select 1 from dk k where k.song_id = da.song_id and k.voice = dn.voice and abs(k.t_ms - t) <= 45)""")
def w40(s, d):
    v = F.when(F.col("stem") == "bass", "kick").when(F.col("stem") == "drums", "snare").otherwise("closed_hihat")
    o = c.onsets(s, d).select("song_id", v.alias("voice"), "t_ms", "energy", (F.col("energy") * (F.floor(F.col("t_ms")) % 3) / 2.0).alias("rival"))
    return f.drum_notes(o).withColumns({x: F.round(x, 6) for x in ("start_ms", "end_ms")})


def spectra(s, d):
    return c.frames(s, d).filter("hz > 0").select("song_id", "frame_idx", F.when(F.col("frame_idx") % 3 == 0, "piano").otherwise("bass").alias("stem"), "hz", F.col("flux").alias("mag"))


@query("j09_stem_attribution", "notes frames", """
sp as (select song_id, frame_idx, case when frame_idx % 3 = 0 then 'piano' else 'bass' end as stem, hz, flux as mag from frames where hz > 0),
nt as (select *, 440 * power(2, (pitch - 69) / 12e0) as f0, power(2, 0.6 / 12) as hw from notes),
en as (select n.song_id, n.note_id, s.stem, sum(mag) as energy from nt n join sp s on s.song_id = n.song_id and s.frame_idx between floor(n.start_ms / 23.22e0) and floor(greatest(n.end_ms, n.start_ms + 40) / 23.22e0)
  and (hz between f0 / hw and f0 * hw or hz between 2 * f0 / hw and 2 * f0 * hw or hz between 3 * f0 / hw and 3 * f0 * hw or hz between 4 * f0 / hw and 4 * f0 * hw) group by all),
rk as (select *, row_number() over (partition by note_id order by energy desc, stem) as r, sum(energy) over (partition by note_id) as t from en)""", """
select song_id, note_id, max(stem) filter (where r = 1) as stem, round(max(energy / t) filter (where r = 1), 6) as confidence,
  case when max(energy) filter (where r = 2) / max(energy) filter (where r = 1) >= 0.6 then max(stem) filter (where r = 2) end as contested_by from rk group by all""")
def j09(s, d):
    a = f.attribute_stems(c.notes(s, d).drop("stem"), spectra(s, d), 23.22)
    return a.select("song_id", "note_id", "stem", F.round("confidence", 6).alias("confidence"), "contested_by")


@query("j10_partial_matching", "notes frames", """
sp as (select song_id, cast(floor(hz / 10) as bigint) as bin, avg(flux) as mag from frames group by all),
fs as materialized (select song_id, unnest(range(0, 1101)) as bin from (select distinct song_id from frames) q),
fu as materialized (select fs.song_id, fs.bin, coalesce(mag, 0.01e0) as mag from fs left join sp on sp.song_id = fs.song_id and sp.bin = fs.bin),
hk as (select song_id, note_id, 440 * power(2, (pitch - 69) / 12e0) as f0, unnest(range(1, 9)) as k from notes),
ht as (select *, f0 * k as target, cast(ceil(f0 * k / 10 - 0.5e0) as bigint) as c from hk where f0 * k <= 11025),
hb as (select h.song_id, h.note_id, h.k, h.target, list({'m': -mag, 'b': bin} order by bin) filter (where abs(bin - c) <= 2) as near, list({'m': -mag, 'b': bin} order by bin) as bs
  from ht h join fu on fu.song_id = h.song_id and fu.bin between h.c - 3 and h.c + 3 group by all),
hm as (select *, list_sort(near)[1] as x from hb where near is not null),
hs as (select *, list_filter(bs, lambda v: v.b = x.b - 1)[1].m as lo, list_filter(bs, lambda v: v.b = x.b + 1)[1].m as hi from hm where 20 * log10(-x.m + 1e-8) >= -80),
hf as (select *, (x.b + coalesce(case when abs(-lo + 2 * x.m - hi) > 1e-12 then greatest(-1, least(1, 0.5e0 * (hi - lo) / (-lo + 2 * x.m - hi))) end, 0)) * 10 as freq from hs),
hc as (select *, case when k <= 3 then 30 when k <= 5 then 50 else 70 end as tol from hf where freq > 0),
hg as (select song_id, note_id, count(*) as partials, sum(abs(freq - target) / target / k) / sum(1e0 / k) as inh from hc where abs(1200 * log2(freq / target)) <= tol group by song_id, note_id having count(*) >= 2)""", """
select song_id, note_id, partials, round(inh + 1.37e-8, 6) as inharmonicity, round(greatest(0, least(1, partials / 8e0 * (1 - least(inh, 0.1e0) / 0.1e0))) + 1.37e-8, 6) as confidence from hg""")
def j10(s, d):
    sp = c.frames(s, d).withColumn("bin", F.floor(F.col("hz") / 10.0)).groupBy("song_id", "bin").agg(F.avg("flux").alias("mag"))
    songs = sp.select("song_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1100).cast("bigint"))))
    full = songs.join(sp, ["song_id", "bin"], "left").fillna(0.01, ["mag"])
    h = f.harmonic_series(c.notes(s, d), full, 10.0, 11025.0)
    return h.select("song_id", "note_id", "partials", r6("inharmonicity").alias("inharmonicity"), r6("confidence").alias("confidence"))


@query("a14_note_support", "notes", """
e as (select note_id, song_id, stem, velocity * confidence as energy from notes), m as (select song_id, stem, median(energy) filter (where energy > 0) as med from e group by all)""", """
select note_id, round(energy / (coalesce(med, 1e-9) + 1e-9), 6) as ratio, energy < 0.15 * coalesce(med, 1e-9) as weak, 'supported' as verdict from e join m using (song_id, stem)""")
def a14(s, d):
    n = c.notes(s, d).withColumn("energy", F.col("velocity") * F.col("confidence")).withColumn("active", F.lit(0.1))
    return f.note_support(n, width=1.0).select("note_id", F.round("ratio", 6).alias("ratio"), "weak", "verdict")


@query("a43_leak_report", "notes onsets frames", """
fr as (select song_id, case when frame_idx % 2 = 0 then 'piano' else 'bass' end as stem, sqrt(avg(rms * rms)) as rms, avg(case when 20 * log10(rms + 1e-12) < -20 then 1e0 else 0e0 end) as silent from (select song_id, frame_idx, rms / 5 as rms from frames) q group by all),
lk as (select song_id, stem, count(*) as onsets, avg(case when exists(select 1 from onsets x where x.song_id = o.song_id and x.stem = 'drums' and abs(x.t_ms - o.t_ms) <= 30) then 1e0 else 0e0 end) as onset_leak from onsets o where stem <> 'drums' group by all)""", """
select coalesce(fr.song_id, lk.song_id) as song_id, coalesce(fr.stem, lk.stem) as stem, round(rms, 6) as rms, onsets, round(onset_leak + 1.37e-8, 6) as onset_leak from fr full join lk on fr.song_id = lk.song_id and fr.stem = lk.stem""")
def a43(s, d):
    fr = c.frames(s, d).select("song_id", F.when(F.col("frame_idx") % 2 == 0, "piano").otherwise("bass").alias("stem"), (F.col("rms") / 5).alias("rms"))
    return f.leak_report(fr, c.onsets(s, d)).select("song_id", "stem", F.round("rms", 6).alias("rms"), "onsets", r6("onset_leak").alias("onset_leak"))


@query("a43_bleed_correlation", "frames", """
lv as (select song_id, frame_idx, unnest(['piano', 'bass', 'drums']) as stem, unnest([rms, flux, flatness + rms]) as level from frames)""", """
select a.song_id, a.stem as stem_a, b.stem as stem_b, count(*) as frames, round(corr(a.level, b.level) + 1.37e-8, 6) as correlation
from lv a join lv b on a.song_id = b.song_id and a.frame_idx = b.frame_idx and a.stem < b.stem group by all""")
def a43b(s, d):
    stems = F.array(*[F.struct(F.lit(n).alias("stem"), x.alias("level")) for n, x in (("piano", F.col("rms")), ("bass", F.col("flux")), ("drums", F.col("flatness") + F.col("rms")))])
    levels = c.frames(s, d).select("song_id", "frame_idx", F.explode(stems).alias("v")).select("song_id", "frame_idx", "v.*")
    return f.bleed(levels).withColumn("correlation", r6("correlation"))


@query("a44_solo_verdict", "frames", """
fx as (select song_id, frame_idx, flux as h, rms, flatness, flux - lag(flux) over (partition by song_id order by frame_idx) as dl from frames),
pc as (select song_id, quantile_cont(h, 0.4) as e40, quantile_cont(abs(dl), 0.9) as d90 from fx group by song_id),
hx as (select fx.*, e40, coalesce(dl > d90, false) as hit from fx join pc using (song_id)),
qx as (select *, not (hit or coalesce(lag(hit) over w, false) or coalesce(lag(hit, 2) over w, false)) as quiet from hx window w as (partition by song_id order by frame_idx)),
gx as (select song_id, sum(rms * flatness * 0.1) / sum(rms) as kit, sum(rms * 0.01) / sum(h + rms) as low, coalesce(count(*) filter (where dl is not null and h > e40 and quiet and dl > 0 and dl > 0.02 * greatest(h, 1e-9)) / count(*) filter (where dl is not null and h > e40 and quiet), 0) as swell from qx group by song_id)""", """
select song_id, round(kit, 6) as kit, round(low, 6) as low_share, round(swell + 1.37e-8, 6) as swell, case when kit > 0.045 then 'ensemble' when swell > 0.22 then 'ensemble' when low > 0.008 then 'solo_piano' else 'solo_guitar' end as verdict from gx""")
def a44(s, d):
    fr = c.frames(s, d).select("song_id", "frame_idx", F.col("flux").alias("harmonic"), F.col("rms").alias("percussive"), (F.col("rms") * F.col("flatness") * 0.1).alias("percussive_high"),
                               (F.col("rms") * 0.01).alias("low"), (F.col("flux") + F.col("rms")).alias("total"))
    v = f.solo_verdict(fr)
    return v.select("song_id", F.round("kit", 6).alias("kit"), F.round("low_share", 6).alias("low_share"), r6("swell").alias("swell"), "verdict")


def in_regions(s, d):
    n = an.section_lookup(c.notes(s, d), c.sections(s, d))
    return n.select("song_id", F.col("idx").alias("region"), "note_id", "start_ms", "end_ms", "pitch", F.col("stem").alias("family"), F.col("s_start").alias("r_start"), F.col("s_end").alias("r_end"))


def textured(s, d):
    return tx.texture(in_regions(s, d), 120.0)


TEXTURE = """
tr as (select n.song_id, s.idx as region, note_id, n.start_ms, n.end_ms, pitch, stem as family, s.start_ms as r0, s.end_ms as r1 from notes n join sections s on s.song_id = n.song_id and n.start_ms >= s.start_ms and n.start_ms < s.end_ms),
tm as (select song_id, region, median(pitch) as split, count(*) as n, bool_or(end_ms - start_ms >= 0.60e0 * greatest(1e0, r1 - r0)) as long_note from tr group by all),
tk as (select 'all' as part, tr.* from tr union all select case when pitch > split then 'top' else 'low' end, tr.* from tr join tm using (song_id, region)),
ta(part, song_id, region, t) as (select part, song_id, region, min(start_ms) from tk group by all
  union all select * from (select a.part, a.song_id, a.region, (select min(k.start_ms) from tk k where k.part = a.part and k.song_id = a.song_id and k.region = a.region and k.start_ms - a.t > 120e0) as t from ta a) q where t is not null),
tg as (select r.*, (select max(a.t) from ta a where a.part = 'all' and a.song_id = r.song_id and a.region = r.region and a.t <= r.start_ms) as g from tr r),
ts as (select song_id, region, g, list_sort(list(pitch)) as ps, count(*) as n from tg group by all),
tp as (select song_id, region, g, (ps[j] - ps[i]) % 12 as v from ts, range(1, 64) a(i), range(1, 64) b(j) where i < j and j <= len(ps)),
tl as (select song_id, region, g, (count(*) filter (where v in (3, 4, 5, 7, 8, 9)) - count(*) filter (where v in (1, 2))) / cast(count(*) as double) as l from tp group by all),
tt as (select song_id, region, avg(n) as mean_stack, sum(case when n > 1 then n else 0 end) as sync, count(*) as stacks, coalesce(avg(case when n > 1 then l end), 0) as chordness from ts left join tl using (song_id, region, g) group by all),
tf as (select song_id, region, count(*) filter (where c >= 3) as n_fam from (select song_id, region, family, count(*) as c from tr group by all) q group by all),
td as (select song_id, region, abs(pitch - lag(pitch) over (partition by song_id, region order by start_ms, note_id)) as d from tk where part = 'top'),
te as (select song_id, region, case when count(*) > 2 then coalesce(avg(case when d between 1 and 2 then 1e0 when d is not null then 0e0 end), 0e0) else 0e0 end as stepwise from td group by all),
tc as (select song_id, region, count(*) filter (where part = 'top') as top_n, count(*) filter (where part = 'low') as bot_n from ta group by all),
tx as (select song_id, region, tm.n, mean_stack, sync / tm.n as share, stacks, chordness, long_note, n_fam, coalesce(stepwise, 0) as stepwise, top_n / greatest(bot_n, 1) as active
  from tm join tt using (song_id, region) join tf using (song_id, region) join tc using (song_id, region) left join te using (song_id, region)),
tz as (select *, case when n < 12 then 'SPARSE' when mean_stack < 1.2e0 then 'MONOPHONIC' when share >= 0.55e0 and mean_stack >= 2.2e0 and chordness > 0.15e0 then 'CHORDAL'
  when long_note and stacks >= 4 then 'PEDAL_PLUS_ACTIVITY' when (n_fam >= 2 or stepwise > 0.35e0) and active >= 1.3e0 then 'MELODY_ACCOMP' when share <= 0.35e0 then 'COUNTERPOINT' else 'MELODY_ACCOMP' end as texture from tx)"""


@query("a35_texture_vector", "notes sections", TEXTURE + """,
va as (select song_id, region, n, split from tm where n >= 12),
vb as (select song_id, region, start_ms - lag(start_ms) over (partition by song_id, region order by start_ms, note_id) as g from tk where part = 'low'),
vc as (select song_id, region, case when count(*) > 2 and count(*) filter (where g > 1) >= 3 then greatest(0, least(1, 1 - stddev_pop(g) filter (where g > 1) / (avg(g) filter (where g > 1) + 1e-9))) else 0e0 end as regularity from vb group by all),
vd as (select a.song_id, a.region, 1 - avg(case when exists(select 1 from tk b where b.part = 'low' and b.song_id = a.song_id and b.region = a.region and abs(b.start_ms - a.start_ms) <= 120) then 1e0 else 0e0 end) as independence
  from tk a where a.part = 'top' group by all),
ve as (select song_id, region, sum(least(1e0, c * 0.25e0)) as sus from (select a.song_id, a.region, a.note_id, count(*) as c from tr a join tr b on b.song_id = a.song_id and b.region = a.region and b.start_ms > a.start_ms + 120 and b.start_ms < a.end_ms group by all) q group by all),
vf as (select song_id, region, list(cast(trunc((start_ms - r0) / greatest(1, r1 - r0) * 63) as int)) as i from tr where cast(trunc((start_ms - r0) / greatest(1, r1 - r0) * 63) as int) between 0 and 63 group by all),
vg as (select song_id, region, list_transform(range(0, 64), lambda b: len(list_filter(i, lambda x: x = b)) - len(i) / 64e0) as g from vf),
vh as (select song_id, region, case when list_dot_product(g, g) > 0 then greatest(0, least(1, list_max(list_transform(range(1, 64), lambda l: list_dot_product(g[1:64 - l], g[l + 1:64]))) / (list_dot_product(g, g) + 1e-9))) else 0e0 end as ost from vg)""", """
select song_id, region, va.n, round(greatest(0, least(1, sync / va.n * (0.5e0 + 0.5e0 * greatest(chordness, 0)))) + 1.37e-8, 6) as chordality, round(coalesce(stepwise, 0) + 1.37e-8, 6) as motion, round(coalesce(regularity, 0) + 1.37e-8, 6) as regularity,
  round(case when vc.song_id is not null then coalesce(independence, 0) else 0 end + 1.37e-8, 6) as independence, round(coalesce(sus, 0) / va.n + 1.37e-8, 6) as sustain, round(case when va.n > 8 then coalesce(ost, 0) else 0 end + 1.37e-8, 6) as ostinato
from va join tt using (song_id, region) left join te using (song_id, region) left join vc using (song_id, region) left join vd using (song_id, region) left join ve using (song_id, region) left join vh using (song_id, region)""")
def a35(s, d):
    v = tx.texture_vector(in_regions(s, d), 120.0)
    return v.select("song_id", "region", "n", *[r6(x).alias(x) for x in ("chordality", "motion", "regularity", "independence", "sustain", "ostinato")])


@query("a36_texture_class", "notes sections", TEXTURE, """
select song_id, region, n, round(mean_stack + 1.37e-8, 6) as mean_stack, round(share + 1.37e-8, 6) as sync_share, round(chordness + 1.37e-8, 6) as chordness, texture from tz""")
def a36(s, d):
    return textured(s, d).select("song_id", "region", "n", *[r6(v).alias(v) for v in ("mean_stack", "sync_share", "chordness")], "texture")


@query("w42_texture_null")
def w42(s, d):
    return tx.null_churn(in_regions(s, d), window_ms=120.0)


@query("a37_texture_churn", "notes sections", TEXTURE + """,
cr as (select song_id, region, texture, lag(texture) over (partition by song_id order by region) as p from tz where texture <> 'SPARSE'),
ck as (select song_id, sum(k * k) as k2 from (select song_id, texture, count(*) as k from cr group by all) q group by song_id)""", """
select song_id, round(count(*) filter (where p <> texture) / (count(*) - 1) + 1.37e-8, 6) as churn, round(1 - any_value(k2) / (count(*) * count(*)) + 1.37e-8, 6) as expected
from cr join ck using (song_id) group by song_id having count(*) >= 2""")
def a37(s, d):
    return tx.churn(textured(s, d)).select("song_id", r6("churn").alias("churn"), r6("expected").alias("expected"))
