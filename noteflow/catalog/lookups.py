"""Annotation lookups, nearest, range and overlap joins, consolidation."""

from pyspark.sql import functions as F

from ..operators import annotations as an
from ..operators import corpus_stats as cs
from ..plans import joins
from ..sources import corpus as c
from .filters import KINDS, PIVOT
from .registry import half6, query, r6

RUNS = """
att as (select n.*, exists(select 1 from onsets o where o.song_id = n.song_id and o.stem = n.stem
    and o.t_ms between n.start_ms - 50 and n.start_ms + 50) as attack from notes n),
reach as (select *, max(end_ms) over (partition by song_id, stem, pitch order by start_ms, note_id
    rows between unbounded preceding and 1 preceding) as reach from att),
brk as (select *, case when reach is null or not (start_ms - reach <= 60 and (start_ms - reach < 20 or not attack)) then 1 else 0 end as b from reach),
isl as (select *, sum(b) over (partition by song_id, stem, pitch order by start_ms, note_id) as isl from brk),
runs as (select *, first_value(note_id) over (partition by song_id, stem, pitch, isl order by start_ms, note_id) as run_note from isl)"""
TEMPO = """
tempo as (select song_id, min(t_ms) as first_beat_ms, 480e0 as beat_ms, 4 as numerator from beats group by song_id)"""
LOG_LAT = "select note_id, kind, arg_max(value, seq) as value, max(seq) as seq from annotations group by note_id, kind"


def runs(s, d):
    return an.consolidate(c.notes(s, d), c.onsets(s, d))


def tempo(s, d):
    return c.beats(s, d).groupBy("song_id").agg(F.min("t_ms").alias("first_beat_ms")).withColumns(
        {"beat_ms": F.lit(480.0), "numerator": F.lit(4)})


@query("flagship_trouble_after_consolidation", "notes onsets beats", RUNS + "," + TEMPO + """,
m as (select song_id, stem, pitch, run_note, min(start_ms) as start_ms, arg_min(confidence, start_ms) as confidence from runs group by all),
x as (select m.*, greatest(0, cast(trunc((start_ms - first_beat_ms) / 1920e0) as bigint)) as measure from m join tempo using (song_id))""", """
select song_id, measure, count(*) as n_notes, round(avg(confidence) + 1.37e-8, 6) as avg_confidence, round(count(*) / 4e0, 6) as notes_per_beat,
  concat_ws(',', case when avg(confidence) < 0.25 then 'low_confidence' end, case when count(*) / 4e0 > 6 then 'fragmented' end) as reasons
from x group by song_id, measure having avg(confidence) < 0.25 or count(*) / 4e0 > 6""")
def flagship(s, d):
    t = cs.trouble_map(an.merged(runs(s, d)), tempo(s, d))
    return t.select("song_id", "measure", "n_notes", r6("avg_confidence").alias("avg_confidence"),
                    F.round("notes_per_beat", 6).alias("notes_per_beat"), F.concat_ws(",", "reasons").alias("reasons"))


@query("a01_trouble_map", "notes beats", TEMPO + """,
x as (select n.*, greatest(0, cast(trunc((start_ms - first_beat_ms) / 1920e0) as bigint)) as measure, first_beat_ms from notes n join tempo using (song_id))""", """
select song_id, measure, round(min(first_beat_ms) + measure * 1920e0, 6) as start_ms, round(avg(confidence) + 1.37e-8, 6) as avg_confidence,
  concat_ws(',', case when avg(confidence) < 0.25 then 'low_confidence' end, case when count(*) / 4e0 > 6 then 'fragmented' end) as reasons
from x group by song_id, measure having avg(confidence) < 0.25 or count(*) / 4e0 > 6""")
def a01(s, d):
    t = cs.trouble_map(c.notes(s, d), tempo(s, d))
    return t.select("song_id", "measure", half6("start_ms").alias("start_ms"),
                    r6("avg_confidence").alias("avg_confidence"), F.concat_ws(",", "reasons").alias("reasons"))


@query("w01_consolidation", "notes onsets", RUNS + """,
g as (select run_note, max(end_ms) as run_end_ms, count(*) - 1 as absorbed, arg_max(note_id, [end_ms, -start_ms, -note_id]) as last_note_id
  from runs group by run_note having count(*) > 1)""", """
select r.song_id, r.note_id, case when r.note_id = g.run_note then 'primary' else 'absorbed' end as role,
  case when r.note_id = g.run_note then round(run_end_ms, 6) end as run_end_ms, case when r.note_id = g.run_note then absorbed end as absorbed,
  case when r.note_id = g.run_note then last_note_id end as last_note_id, case when r.note_id <> g.run_note then g.run_note end as into_id
from runs r join g using (run_note)""")
def w01(s, d):
    return an.consolidation_rows(runs(s, d)).withColumn("run_end_ms", F.round("run_end_ms", 6)).withColumnRenamed("into", "into_id")


@query("p09_consolidated_end", "notes onsets", RUNS + """,
g as (select run_note, max(end_ms) as run_end_ms, arg_max(note_id, [end_ms, -start_ms, -note_id]) as last_note_id from runs group by run_note having count(*) > 1)""", """
select g.run_note as note_id, round(greatest(n.end_ms, coalesce(case when l.note_id % 2 = 0 then l.end_ms + l.note_id % 90 end, run_end_ms)), 6) as page_end
from g join notes n on n.note_id = g.run_note join notes l on l.note_id = g.last_note_id""")
def p09(s, d):
    """The last fragment's timing on the drawn timeline decides the run's end."""
    rows = an.consolidation_rows(runs(s, d)).filter("role = 'primary'")
    timing = c.annotations(s, d).filter("kind = 'sustain_extension'")
    last = an.latest(timing).select(F.col("note_id").alias("last_note_id"), F.col("value").alias("last_end"))
    j = rows.join(last, "last_note_id", "left").join(c.notes(s, d).select("note_id", "end_ms"), "note_id")
    end = F.greatest("end_ms", F.coalesce("last_end", "run_end_ms"))
    return j.select("note_id", F.round(end, 6).alias("page_end"))


@query("j01_latest_annotation", "annotations", "", f"select note_id, kind, round(value, 6) as value, seq from ({LOG_LAT}) l")
def j01(s, d):
    return an.latest(c.annotations(s, d)).select("note_id", "kind", F.round("value", 6).alias("value"), "seq")


@query("j01_pivot_latest", "notes annotations", PIVOT, """
select n.note_id, round(onset_refinement, 6) as onset_refinement, round(sustain_extension, 6) as sustain_extension
from notes n left join lat using (note_id)""")
def j01b(s, d):
    return an.with_latest(c.notes(s, d), c.annotations(s, d), KINDS).select("note_id", *[F.round(k, 6).alias(k) for k in KINDS])


@query("j02_annotation_history", "annotations", "", """
select note_id, seq, round(value, 6) as value, row_number() over (partition by note_id order by seq) as version from annotations where kind = 'onset_refinement'""")
def j02(s, d):
    h = an.history(c.annotations(s, d), "onset_refinement")
    return h.select("note_id", "seq", F.round("value", 6).alias("value"), F.col("version").cast("bigint").alias("version"))


NEAR_KICK = """
p as (select b.song_id, b.note_id, b.start_ms - k.start_ms as delta, row_number() over (partition by b.note_id order by abs(b.start_ms - k.start_ms), k.start_ms) as rn
  from notes b join notes k on b.song_id = k.song_id and b.stem = 'bass' and k.stem = 'drums' and abs(b.start_ms - k.start_ms) <= 500),
dl as (select song_id, note_id, delta from p where rn = 1)"""


@query("j03_nearest_kick", "notes", NEAR_KICK, "select song_id, note_id, round(delta, 6) as delta_ms from dl")
def j03(s, d):
    n = c.notes(s, d)
    return cs.phase_deltas(n.filter("stem = 'bass'"), n.filter("stem = 'drums'")).select(
        "song_id", "note_id", F.round("delta_ms", 6).alias("delta_ms"))


@query("j03_a17_groove_class", "notes", NEAR_KICK + """,
g as (select song_id, count(*) as n, avg(delta) as a, stddev_pop(delta) as sd, 1 / (1 + var_pop(delta) / 100) as c from dl group by song_id)""", """
select song_id, n, round(a, 6) as average_ms, round(sd, 6) as std_ms, round(c, 6) as consistency,
  case when n < 2 then 'erratic' when sd between 2 and 6 and c > 0.5 and abs(a) < 8 then 'dilla_pocket'
    when abs(a) > 8 and c > 0.6 then 'wide_swing' when abs(a) < 2 and c > 0.8 then 'tight_pocket'
    when a > 0 then 'laid_back' when a < 0 then 'rushed' when c < 0.3 then 'erratic' else 'fluid' end as groove from g""")
def a17(s, d):
    n = c.notes(s, d)
    g = cs.groove(cs.phase_deltas(n.filter("stem = 'bass'"), n.filter("stem = 'drums'")))
    return g.select("song_id", "n", *[F.round(x, 6).alias(x) for x in ("average_ms", "std_ms", "consistency")], "groove")


WIT = """
cand as (select n.note_id, o.witness, o.t_ms, row_number() over (partition by n.note_id, o.witness order by abs(o.t_ms - n.start_ms), o.t_ms) as rn
  from notes n join onsets o on n.song_id = o.song_id and n.stem = o.stem and abs(o.t_ms - n.start_ms) <= 60),
w as (select note_id, max(t_ms) filter (where witness = 'w1') as a, max(t_ms) filter (where witness = 'w2') as b from cand where rn = 1 group by note_id),
ref as (select n.*, case when a is not null and b is not null then 0.5e0 * a + 0.5e0 * b else coalesce(a, b) end as resolved,
  case when a is not null and b is not null then least(1, abs(a - b) / 60) else 0e0 end as dis from notes n left join w using (note_id))"""


@query("j04_two_witness_onset", "notes onsets", WIT, """
select note_id, round(resolved, 6) as resolved_ms, round(dis, 6) as disagreement from ref""")
def j04(s, d):
    r = an.refine_onsets(c.notes(s, d), c.onsets(s, d))
    return r.select("note_id", F.round("resolved_ms", 6).alias("resolved_ms"), F.round("disagreement", 6).alias("disagreement"))


@query("j05_onset_refinement", "notes onsets", WIT, """
select note_id, round(resolved - start_ms, 6) as shift_ms, round(confidence * (1 - dis), 6) as refined_confidence from ref
where resolved is not null and dis <= 0.5 and abs(resolved - start_ms) >= 5 and resolved < end_ms""")
def j05(s, d):
    r = an.accepted_refinements(an.refine_onsets(c.notes(s, d), c.onsets(s, d)))
    return r.select("note_id", F.round("shift_ms", 6).alias("shift_ms"), F.round("refined_confidence", 6).alias("refined_confidence"))


SECT = """
sx as (select *, row_number() over (partition by song_id, label order by idx) - 1 as instance, count(*) over (partition by song_id, label) >= 2 as repeats from sections),
ns as (select n.*, s.label, s.idx, s.instance, s.repeats from notes n join sx s on n.song_id = s.song_id and n.start_ms >= s.start_ms and n.start_ms < s.end_ms)"""


@query("j06_section_lookup", "notes sections", SECT, "select note_id, label, idx, instance, repeats from ns")
def j06(s, d):
    return an.section_lookup(c.notes(s, d), c.sections(s, d)).select(
        "note_id", "label", "idx", F.col("instance").cast("bigint").alias("instance"), "repeats")


@query("a15_repeat_consistency", "notes sections", SECT + """,
h as (select song_id, label, instance, pitch % 12 as pc, sum(greatest(1, end_ms - start_ms)) as w from ns where stem <> 'drums' group by all),
u as (select *, w / sqrt(sum(w * w) over (partition by song_id, label, instance)) as v from h),
i as (select distinct song_id, label, instance from u),
pr as (select a.song_id, a.label, a.instance as x, b.instance as y from i a join i b on a.song_id = b.song_id and a.label = b.label and a.instance <> b.instance),
sm as (select p.song_id, p.label, p.x, p.y, coalesce(sum(a.v * b.v), 0) as s from pr p left join u a on a.song_id = p.song_id and a.label = p.label and a.instance = p.x
   left join u b on b.song_id = p.song_id and b.label = p.label and b.instance = p.y and a.pc = b.pc group by all),
mi as (select song_id, label, x, avg(s) as m from sm group by all),
g as (select song_id, label, count(*) as instances, avg(m) as c, arg_min(x, [round(m, 9), x]) as odd, min(m) as om from mi group by all)""", """
select song_id, label, instances, round(c, 6) as consistency, cast(case when instances >= 3 and c < 0.92 then odd end as bigint) as drift_instance,
  case when instances >= 3 and c < 0.92 then round(om, 6) end as drift_similarity from g""")
def a15(s, d):
    r = cs.repeat_consistency(an.section_lookup(c.notes(s, d), c.sections(s, d)))
    return r.select("song_id", "label", "instances", F.round("consistency", 6).alias("consistency"),
                    F.col("drift_instance").cast("bigint").alias("drift_instance"), F.round("drift_similarity", 6).alias("drift_similarity"))


@query("j07_note_frame_mean", "notes frames", "", """
select note_id, coalesce(round(avg(f.rms) + 1.37e-8, 6), 0) as rms, coalesce(round(avg(f.flux) + 1.37e-8, 6), 0) as flux, coalesce(round(avg(f.flatness) + 1.37e-8, 6), 0) as flatness, count(f.t_ms) as n_frames
from notes n left join frames f on n.song_id = f.song_id and f.t_ms between n.start_ms and n.end_ms group by note_id""")
def j07(s, d):
    n = c.notes(s, d).select("note_id", "song_id", "start_ms", "end_ms")
    p = joins.points_in(n, c.frames(s, d), ["song_id"], "start_ms", "end_ms", "t_ms")
    g = p.groupBy("note_id").agg(*[F.avg(x).alias(x) for x in ("rms", "flux", "flatness")], F.count(F.lit(1)).alias("n_frames"))
    zero = F.lit(0.0)
    return n.select("note_id").join(g, "note_id", "left").select(
        "note_id", *[F.coalesce(r6(x), zero).alias(x) for x in ("rms", "flux", "flatness")],
        F.coalesce("n_frames", F.lit(0).cast("bigint")).alias("n_frames"))


@query("j08_f0_span_sample", "notes frames", "", """
select note_id, count(*) as voiced, round(min(hz), 6) as hz_min, round(median(hz), 6) as hz_median from notes n
join frames f on n.song_id = f.song_id and f.t_ms between n.start_ms and n.end_ms and hz > 0 group by note_id""")
def j08(s, d):
    n = c.notes(s, d).select("note_id", "song_id", "start_ms", "end_ms")
    voiced = c.frames(s, d).select("song_id", "t_ms", "hz").filter("hz > 0")
    p = joins.points_in(n, voiced, ["song_id"], "start_ms", "end_ms", "t_ms")
    return p.groupBy("note_id").agg(F.count(F.lit(1)).alias("voiced"), F.round(F.min("hz"), 6).alias("hz_min"),
                                    F.round(F.percentile("hz", F.lit(0.5)), 6).alias("hz_median"))


@query("j11_overlapping_notes", "notes", "", """
select a.note_id, b.note_id as other_id, round(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms), 6) as shared_ms
from notes a join notes b on a.song_id = b.song_id and a.stem = b.stem and a.note_id <> b.note_id
and least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 20""")
def j11(s, d):
    n = c.notes(s, d)
    a = n.select("song_id", "stem", "note_id", F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"))
    b = n.select("song_id", "stem", F.col("note_id").alias("other_id"), F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    o = joins.overlaps(a, b, ["song_id", "stem"], 20.0).filter("note_id <> other_id")
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return o.select("note_id", "other_id", F.round(shared, 6).alias("shared_ms"))


@query("j12_attack_at_boundary", "notes onsets", RUNS, "select note_id, attack from att")
def j12(s, d):
    return an.attacked(c.notes(s, d), c.onsets(s, d)).select("note_id", "attack")


@query("j13_near_beat", "notes beats", "", """
select note_id, exists(select 1 from beats b where b.song_id = n.song_id and abs(b.t_ms - n.start_ms) <= 30) as near_beat from notes n""")
def j13(s, d):
    j = joins.nearest(c.notes(s, d), c.beats(s, d), ["song_id"], "start_ms", "t_ms", 30.0, {"beat": F.col("t_ms")})
    return j.select("note_id", F.col("beat").isNotNull().alias("near_beat"))


TIES = """
nx as (select *, lead(pitch) over w as p2, lead(start_ms) over w as s2, lead(confidence) over w as c2, lead(note_id) over w as id2 from notes where stem <> 'drums'
  window w as (partition by song_id, stem order by start_ms, note_id)),
tc as (select song_id, note_id as first_id, id2 as second_id, s2 - end_ms as gap, (end_ms + s2) / 2 as mid from nx
  where p2 = pitch and s2 - end_ms between 0 and 900 and c2 <= confidence),
ties as (select * from tc where exists(select 1 from beats b where b.song_id = tc.song_id and abs(b.t_ms - mid) <= 120))"""


def ties(s, d):
    return an.tie_candidates(c.notes(s, d), c.beats(s, d), proximity_ms=120.0, max_gap_ms=900.0)


@query("w05_tie_candidates", "notes beats", TIES, "select first_id, second_id, round(gap, 6) as gap_ms from ties")
def w05(s, d):
    return ties(s, d).select("first_id", "second_id", F.round("gap_ms", 6).alias("gap_ms"))


@query("j14_tie_flags", "notes beats", TIES + """,
tt as (select note_id as first_id, note_id + 1 as second_id from notes where note_id % 7 = 0 union select first_id, second_id from ties),
al as (select note_id from notes where confidence >= 0.02), ok as (select * from tt where first_id in (select note_id from al) and second_id in (select note_id from al))""", """
select note_id, note_id in (select first_id from ok) as tie_start, note_id in (select second_id from ok) as tie_stop from al""")
def j14(s, d):
    n = c.notes(s, d)
    t = n.filter("note_id % 7 = 0").select(F.col("note_id").alias("first_id"), (F.col("note_id") + 1).alias("second_id"))
    t = t.unionByName(ties(s, d).select("first_id", "second_id")).distinct()
    return an.tie_flags(n.filter("confidence >= 0.02"), t).select("note_id", "tie_start", "tie_stop")


@query("j15_run_comparison", "notes", """
l as (select stem as name, cast(count(*) as double) as value, case when count(*) > 1500 then 'PASS' else 'FAIL' end as status from notes where note_id % 2 = 0 and stem <> 'bass' group by stem),
r as (select stem as name, cast(count(*) as double) as value, case when count(*) > 1500 then 'PASS' else 'FAIL' end as status from notes where note_id % 2 = 1 and stem <> 'piano' group by stem)""", """
select coalesce(l.name, r.name) as name, l.value as left_value, r.value as right_value, l.value is distinct from r.value as changed, r.value - l.value as numeric_delta,
  coalesce(l.status, 'INFO') as status_left, coalesce(r.status, 'INFO') as status_right from l full join r on l.name = r.name""")
def j15(s, d):
    def checks(rows):
        n = F.count(F.lit(1))
        return rows.groupBy(F.col("stem").alias("name")).agg(
            n.cast("double").alias("value"), F.when(n > 1500, "PASS").otherwise("FAIL").alias("status"))

    n = c.notes(s, d)
    return an.compare_runs(checks(n.filter("note_id % 2 = 0 and stem <> 'bass'")), checks(n.filter("note_id % 2 = 1 and stem <> 'piano'")))


@query("j16_recoverable_share", "notes", "", """
select song_id, count(*) as reference_notes, round(avg(case when exists(select 1 from notes o where o.note_id % 2 = 1 and o.song_id = n.song_id and o.pitch = n.pitch
   and abs(o.start_ms - n.start_ms) <= 750) then 1e0 else 0e0 end), 6) as recoverable from notes n where note_id % 2 = 0 group by song_id""")
def j16(s, d):
    n = c.notes(s, d)
    hit = joins.nearest(n.filter("note_id % 2 = 0"), n.filter("note_id % 2 = 1"), ["song_id", "pitch"], "start_ms", "start_ms", 750.0,
                        {"hit": F.col("start_ms")})
    return hit.groupBy("song_id").agg(F.count(F.lit(1)).alias("reference_notes"),
                                      F.round(F.avg(F.col("hit").isNotNull().cast("double")), 6).alias("recoverable"))


@query("j17_stage_survival", "notes annotations onsets", RUNS + "," + PIVOT + """,
st as (select 0 as stage, song_id, pitch, start_ms as t from notes
 union all select 1, song_id, pitch, coalesce(onset_refinement, start_ms) from notes left join lat using (note_id)
 union all select 2, song_id, pitch, coalesce(onset_refinement, start_ms) from runs left join lat using (note_id) where note_id = run_note
 union all select 3, song_id, pitch, coalesce(onset_refinement, start_ms) from runs left join lat using (note_id) where note_id = run_note and not (end_ms - start_ms < 60 and confidence < 0.15)
 union all select 4, song_id, pitch, round_even(coalesce(onset_refinement, start_ms) / 120, 0) * 120 from runs left join lat using (note_id) where note_id = run_note and not (end_ms - start_ms < 60 and confidence < 0.15)),
ref as (select song_id, pitch, start_ms + (note_id % 60) as t, note_id from notes where note_id % 3 <> 1),
sc as (select v.stage, avg(case when exists(select 1 from st where st.stage = v.stage and st.song_id = r.song_id and st.pitch = r.pitch and abs(st.t - r.t) <= 750) then 1e0 else 0e0 end) as share
  from ref r, (values (0), (1), (2), (3), (4)) v(stage) group by v.stage)""", """
select stage, round(share, 6) as recoverable, round(share - lag(share) over (order by stage), 6) as delta, coalesce(share - lag(share) over (order by stage) <= -0.05, false) as flagged from sc""")
def j17(s, d):
    from ..operators.evaluation import stage_survival

    n = an.with_latest(runs(s, d), c.annotations(s, d), KINDS)
    onset = F.coalesce("onset_refinement", "start_ms")
    single, legit = F.col("note_id") == F.col("run_note"), ~((F.col("end_ms") - F.col("start_ms") < 60) & (F.col("confidence") < 0.15))
    grid = F.bround(onset / 120) * 120.0
    steps = [(F.col("start_ms"), F.lit(True)), (onset, F.lit(True)), (onset, single), (onset, single & legit), (grid, single & legit)]
    ref = c.notes(s, d).filter("note_id % 3 <> 1").withColumn("ref_ms", F.col("start_ms") + F.col("note_id") % 60)
    return stage_survival(n, ref, steps).select(
        "stage", F.round("share", 6).alias("recoverable"), F.round("delta", 6).alias("delta"), "flagged")
