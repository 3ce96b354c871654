"""Verdicts and projections."""

from pyspark.sql import functions as F

from ..functions import music as m
from ..operators import annotations as an
from ..operators import filters as f
from ..sources import corpus as c
from .registry import query

KINDS = ["onset_refinement", "sustain_extension"]
PIVOT = """
lat as (select note_id, arg_max(value, seq) filter (where kind = 'onset_refinement') as onset_refinement,
  arg_max(value, seq) filter (where kind = 'sustain_extension') as sustain_extension from annotations group by note_id)"""


@query("p01_confidence_tier", "notes", "", """
select note_id, case when confidence >= 1 then 'perfect' when confidence >= 0.8 then 'high'
  when confidence >= 0.5 then 'medium' when confidence >= 0.25 then 'low' else 'hallucination' end as tier
from notes""")
def p01(s, d):
    return c.notes(s, d).select("note_id", m.confidence_tier("confidence").alias("tier"))


@query("p02_micro_note_legitimacy", "notes", "", """
select note_id, case when end_ms - start_ms < 60 and
   (case when note_id % 3 = 0 then confidence < 0.15 else confidence < 0.35 and (note_id % 10) / 10e0 < 0.5 end)
   then 'purge_candidate' else 'legitimate' end as verdict from notes""")
def p02(s, d):
    ratio = F.when(F.col("note_id") % 3 != 0, (F.col("note_id") % 10) / 10.0)
    n = c.notes(s, d)
    return n.select("note_id", f.legitimacy(F.col("end_ms") - F.col("start_ms"), F.col("confidence"), ratio).alias("verdict"))


@query("p03_stem_range", "notes", "", """
select note_id, stem, pitch, case when pitch < lo then 'below' else 'above' end as place
from notes join (values ('bass', 23, 67), ('vocals', 36, 88)) b(stem, lo, hi) using (stem) where pitch not between lo and hi""")
def p03(s, d):
    return f.range_offenders(c.notes(s, d)).select("note_id", "stem", "pitch", "place")


@query("p03_stem_range_counts", "notes", "", """
select stem, count(*) as offenders from notes join (values ('bass', 23, 67), ('vocals', 36, 88)) b(stem, lo, hi)
using (stem) where pitch not between lo and hi group by stem""")
def p03b(s, d):
    return f.range_offenders(c.notes(s, d)).groupBy("stem").agg(F.count(F.lit(1)).alias("offenders"))


KEY_NAMES = [*m.MAJOR_KEYS, *m.MINOR_KEYS]
KEY_LIST = "[" + ", ".join(f"'{k}'" for k in KEY_NAMES) + "]"


@query("p04_key_fit", "notes", f"""
k as (select *, ({KEY_LIST})[cast(song_id % 24 as int) + 1] as key, 0.4e0 + (song_id % 7) / 10e0 as kc from notes),
r as (select *, (list_position(['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B'],
    replace(replace(replace(rtrim(key, 'm'), 'C#', 'Db'), 'D#', 'Eb'), 'G#', 'Ab')) - 1
    + case when key like '%m' then 3 else 0 end) % 12 as root from k),
i as (select *, list_contains([0,2,4,5,7,9,11], (pitch - root + 120) % 12) as inside from r)""", """
select note_id, key, kc < 0.5 or inside as in_key,
  case when kc < 0.5 then 1e0 when inside then 1.05e0 when kc > 0.8 then 0.9e0 when kc > 0.65 then 0.95e0 else 0.98e0 end as factor
from i""")
def p04(s, d):
    names = F.array(*[F.lit(k) for k in KEY_NAMES])
    n = c.notes(s, d).withColumn("key", F.get(names, (F.col("song_id") % 24).cast("int")))
    ok, factor = f.key_fit(F.col("pitch"), F.col("key"), 0.4 + (F.col("song_id") % 7) / 10.0)
    return n.select("note_id", "key", ok.alias("in_key"), factor.alias("factor"))


@query("p05_export_drop", "notes", """
bad as (select note_id from notes where end_ms - start_ms < 60 and confidence < 0.15
  union select note_id from notes where stem = 'bass' and pitch not between 23 and 67
  union select note_id from notes where stem = 'vocals' and pitch not between 36 and 88)""", """
select note_id, stem from notes where note_id not in (select note_id from bad)""")
def p05(s, d):
    n = c.notes(s, d)
    micro = n.select("note_id", F.lit("legitimacy_verdict").alias("kind"),
                     f.legitimacy(F.col("end_ms") - F.col("start_ms"), F.col("confidence"), F.lit(None).cast("double")).alias("verdict"))
    rng = f.range_offenders(n).select("note_id", F.lit("range_plausibility").alias("kind"), F.lit("implausible").alias("verdict"))
    return f.drop_for_export(n, micro.unionByName(rng)).select("note_id", "stem")


@query("p06_page_pitch", "notes", "", """
select note_id, case when stem = 'bass' and note_id % 4 = 0 then pitch - 12 else pitch end as page_pitch from notes""")
def p06(s, d):
    n = c.notes(s, d)
    fixes = n.filter("stem = 'bass' and note_id % 4 = 0").select(
        "note_id", F.lit("bass_octave").alias("kind"), F.col("note_id").alias("seq"), (F.col("pitch") - 12).alias("value"))
    return an.with_latest(n, fixes, ["bass_octave"]).select("note_id", F.coalesce("bass_octave", "pitch").alias("page_pitch"))


@query("p07_page_timing", "notes annotations", PIVOT + """,
t as (select n.note_id, coalesce(onset_refinement, start_ms) as s, greatest(end_ms, coalesce(sustain_extension, end_ms)) as e,
  end_ms - start_ms as dur from notes n left join lat using (note_id))""", """
select note_id, round(s, 6) as page_start, round(case when s >= e then s + greatest(1, dur) else e end, 6) as page_end from t""")
def p07(s, d):
    n = an.with_latest(c.notes(s, d), c.annotations(s, d), KINDS)
    nothing = F.lit(None).cast("double")
    a, b = f.page_timing(F.col("start_ms"), F.col("end_ms"), F.col("onset_refinement"), F.col("sustain_extension"), nothing, nothing)
    return n.select("note_id", F.round(a, 6).alias("page_start"), F.round(b, 6).alias("page_end"))


@query("p08_export_timing", "notes annotations", PIVOT, """
select note_id, mode, round(case mode when 'raw' then coalesce(onset_refinement, start_ms) else round(start_ms / 120) * 120 end, 6) as out_start,
  round(case mode when 'raw' then end_ms else greatest(end_ms, coalesce(sustain_extension, end_ms)) end, 6) as out_end
from notes left join lat using (note_id), (values ('raw'), ('quantized')) v(mode)""")
def p08(s, d):
    n = an.with_latest(c.notes(s, d), c.annotations(s, d), KINDS)
    n = n.withColumn("mode", F.explode(F.array(F.lit("raw"), F.lit("quantized"))))
    raw = F.col("mode") == "raw"
    start = F.when(raw, F.coalesce("onset_refinement", "start_ms")).otherwise(F.bround(F.col("start_ms") / 120) * 120.0)
    end = F.when(raw, F.col("end_ms")).otherwise(F.greatest("end_ms", "sustain_extension"))
    return n.select("note_id", "mode", F.round(start, 6).alias("out_start"), F.round(end, 6).alias("out_end"))


@query("p10_family_choice", "notes", "", """
select note_id, case when note_id % 6 = 0 then 'brass' else stem end as family from notes""")
def p10(s, d):
    n = c.notes(s, d)
    a = n.filter("note_id % 6 = 0").select("note_id", F.lit("instrument_family").alias("kind"),
                                          F.col("note_id").alias("seq"), F.lit("brass").alias("value"))
    return an.with_latest(n, a, ["instrument_family"]).select("note_id", F.coalesce("instrument_family", "stem").alias("family"))


@query("p11_subdivisions", "tempo_witnesses", """
m as (select song_id, source, cast([3,4,6,9,12,5][cast(song_id % 6 as int) + 1] as int) as num,
  case when [3,4,6,9,12,5][cast(song_id % 6 as int) + 1] in (6, 9, 12) and source like '1%' then 8 else 4 end as den from tempo_witnesses)""", """
select song_id, source, num, den, case when den = 8 and num in (6, 9, 12) then 3 else 4 end as subdivisions from m""")
def p11(s, d):
    w = c.tempo_witnesses(s, d)
    num = F.get(F.array(*[F.lit(x) for x in (3, 4, 6, 9, 12, 5)]), (F.col("song_id") % 6).cast("int"))
    w = w.withColumn("num", num).withColumn(
        "den", f.denominator_for(F.col("num"), F.when(F.col("source").startswith("1"), "ternary").otherwise("binary")))
    return w.select("song_id", "source", "num", "den", f.subdivisions_per_beat(F.col("num"), F.col("den")).alias("subdivisions"))


@query("p12_p13_region_and_penalty", "frames", """
p as (select song_id, frame_idx, 1 - rms as v, least(1, flux) * (1 - flatness) as r, rms * flatness as a from frames),
t as (select *, greatest(v, r, a) as top, list_sort([v, r, a])[2] as second from p),
l as (select *, case when top > 0 and top - second >= 0.1 then
  case when v = top then 'silent' when r = top then 'resonant' else 'active' end else 'uncertain' end as region from t)""", """
select song_id, frame_idx, region, case region when 'silent' then least(0.8e0, v * 0.9e0) when 'resonant' then least(0.4e0, r * 0.5e0) else 0e0 end as penalty from l""")
def p12(s, d):
    fr = c.frames(s, d)
    v, r, a = 1 - F.col("rms"), F.least(F.lit(1.0), F.col("flux")) * (1 - F.col("flatness")), F.col("rms") * F.col("flatness")
    fr = fr.select("song_id", "frame_idx", v.alias("v"), r.alias("r"), a.alias("a"))
    fr = fr.withColumn("region", f.region_type(F.col("v"), F.col("r"), F.col("a")))
    return fr.select("song_id", "frame_idx", "region",
                     f.confidence_penalty(F.col("region"), F.col("v"), F.col("r")).alias("penalty"))


@query("p14_harmonic_verdict", "notes", """
x as (select note_id, stem, confidence, note_id % 3 <> 0 as has, (note_id % 11) / 10e0 as mt, (note_id % 8) / 100e0 as inh,
  (note_id % 7) / 10e0 as hps, (velocity % 60) / 100e0 as on_z, (note_id % 50) / 100e0 as su_z,
  ['tonal','percussive','uncertain'][cast(note_id % 3 as int) + 1] as retro from notes),
z as (select *, case when on_z > 0.35 and su_z < 0.35 * 0.6 then 'percussive' when on_z > 0.35 and su_z > 0.35 then 'noise'
  when on_z < 0.35 and su_z < 0.35 then 'tonal' else 'uncertain' end as zcr from x)""", """
select note_id, case when zcr = 'noise' then 'noise'
  when has then case when mt >= 0.7 and inh < 0.05 then case when hps >= 0.4 or zcr = 'percussive' then 'tonal' else 'uncertain' end
    when zcr = 'percussive' and retro <> 'tonal' then 'percussion' else 'uncertain' end
  when zcr = 'percussive' then case when retro = 'tonal' then 'uncertain' else 'percussion' end
  when stem = 'drums' or retro = 'percussive' then 'percussion'
  when confidence < 0.5 then 'hallucination' else 'noise' end as verdict from z""")
def p14(s, d):
    n, i = c.notes(s, d), F.col("note_id")
    zcr = f.zcr_class((F.col("velocity") % 60) / 100.0, (i % 50) / 100.0)
    retro = F.get(F.array(F.lit("tonal"), F.lit("percussive"), F.lit("uncertain")), (i % 3).cast("int"))
    v = f.harmonic_verdict(i % 3 != 0, (i % 11) / 10.0, (i % 8) / 100.0, (i % 7) / 10.0, zcr, retro,
                           F.col("stem") == "drums", F.col("confidence"))
    return n.select("note_id", v.alias("verdict"))


@query("p15_family_ladder", "notes", """
x as (select note_id, 1 + note_id % 6 as n, case when note_id % 7 <> 0 then (note_id % 9) * 2.5e-5 end as b, (note_id % 13) / 10e0 - 0.9e0 as sl,
  case when note_id % 4 <> 0 then (note_id % 31) * 1e0 end as vib, (note_id % 30) / 100e0 as att, (note_id % 10) / 10e0 as eo,
  0e0 - (note_id % 20) as br from notes)""", """
select note_id, case when n < 3 then 'mid_body'
  when b > 1e-5 and sl < -0.3 and (vib is null or vib < 6) then case when b >= 1.5e-4 then 'piano' when att >= 0.15 then 'guitar' else 'mid_body' end
  when b <= 1e-5 and vib >= 20 then 'vibrato_lead' when b <= 1e-5 and eo < 0.4 then 'clarinet_like'
  when b <= 1e-5 and br > -10 and abs(sl) < 0.3 and (vib is null or vib < 20) then 'brass' else 'mid_body' end as family from x""")
def p15(s, d):
    i = F.col("note_id")
    lad = f.family_ladder(1 + i % 6, F.when(i % 7 != 0, (i % 9) * 2.5e-5), (i % 13) / 10.0 - 0.9,
                          F.when(i % 4 != 0, (i % 31) * 1.0), (i % 30) / 100.0, (i % 10) / 10.0, 0.0 - (i % 20))
    return c.notes(s, d).select("note_id", lad["family"].alias("family"))


@query("p17_position_level", "notes", """
x as (select note_id, cast(floor(start_ms / 5e0) as bigint) as ticks, [4, 3, 6, 5][cast(song_id % 4 as int) + 1] as num,
  case when song_id % 4 = 2 then 8 else 4 end as den from notes), y as (select *, ticks % (num * 96) as p from x)""", """
select note_id, case when p = 0 then 0 when den = 8 and num in (6, 9, 12) and p % 288 = 0 then 1
  when not (den = 8 and num in (6, 9, 12)) and num % 2 = 0 and num >= 4 and p * 2 = num * 96 then 1
  when p % 96 = 0 then 2 else 3 end as lvl from y""")
def p17(s, d):
    num = F.get(F.array(*[F.lit(x) for x in (4, 3, 6, 5)]), (F.col("song_id") % 4).cast("int"))
    den = F.when(F.col("song_id") % 4 == 2, 8).otherwise(4)
    ticks = F.floor(F.col("start_ms") / 5.0)
    return c.notes(s, d).select("note_id", f.position_level(ticks, num, den).alias("lvl"))


@query("p18_grid_snap", "notes", """
x as (select note_id, start_ms / 480e0 as q from notes)""", """
select note_id, round_even(q * 2, 0) / 2e0 as capped,
  case when abs(q - round_even(q * 3, 0) / 3e0) + 1e-4 < abs(q - round_even(q * 4, 0) / 4e0)
    then round(round_even(q * 3, 0) / 3e0, 6) else round_even(q * 4, 0) / 4e0 end as full_grid from x""")
def p18(s, d):
    q = F.col("start_ms") / 480.0
    return c.notes(s, d).select(
        "note_id", f.snap_quarters(q).alias("capped"),
        F.round(f.snap_quarters(q, cap=None, triplet=F.lit(True)), 6).alias("full_grid"))
