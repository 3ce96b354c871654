"""Scoring."""

from pyspark.sql import functions as F

from ..operators import annotations as an
from ..operators import evaluation as e
from ..plans import joins
from ..sources import corpus as c
from .lookups import SECT
from .registry import drawn, query, r6
from .rhythm import ANCH

MATCH = """
rf as (select song_id, pitch, note_id as rid, start_ms + note_id % 90 as t from notes where note_id % 2 = 0),
cd as (select song_id, pitch, note_id as cid, start_ms as t from notes where note_id % 3 <> 0),
-- greedy claims: walk each song-pitch's references in time order, carrying the used candidates
rr as (select *, row_number() over (partition by song_id, pitch order by t, rid) as k from rf),
gm(song_id, pitch, k, rid, cid, used, err) as (
  select song_id, pitch, 0, cast(null as bigint), cast(null as bigint), cast([] as bigint[]), cast(null as double) from (select distinct song_id, pitch from rf) q
  union all
  select song_id, pitch, k, rid, b.cid, case when b.cid is null then used else list_append(used, b.cid) end, b.t - rt from (
    select g.song_id, g.pitch, r.k, r.rid, r.t as rt, g.used, (select arg_min({'cid': c.cid, 't': c.t}, [abs(c.t - r.t), c.t, c.cid]) from cd c where c.song_id = r.song_id and c.pitch = r.pitch and abs(c.t - r.t) < 2000 and not list_contains(g.used, c.cid)) as b
    from gm g join rr r on r.song_id = g.song_id and r.pitch = g.pitch and r.k = g.k + 1) z),
ma as (select * from gm where k > 0)"""


def pair(s, d):
    n = c.notes(s, d)
    ref = n.filter("note_id % 2 = 0").select("song_id", "pitch", F.col("note_id").alias("ref_id"), (F.col("start_ms") + F.col("note_id") % 90).alias("t"))
    can = n.filter("note_id % 3 <> 0").select("song_id", "pitch", F.col("note_id").alias("cand_id"), F.col("start_ms").alias("t"))
    return ref, can


@query("j18_claim_once_match", "notes", MATCH, "select rid as ref_id, cid as cand_id, round(err, 6) as error from ma")
def j18(s, d):
    return e.claim_once(*pair(s, d), 2000.0).select("ref_id", "cand_id", F.round("error", 6).alias("error"))


@query("a28_timing_moments", "notes", MATCH, """
select song_id, round(avg(err), 6) as delta, round(stddev_pop(err), 6) as sigma, round(sqrt(avg(err * err)), 6) as rmse from ma where err is not null group by song_id""")
def a28(s, d):
    m = e.timing_moments(e.claim_once(*pair(s, d), 2000.0))
    return m.select("song_id", *[F.round(x, 6).alias(x) for x in ("delta", "sigma", "rmse")])


@query("a29_soft_recall", "notes", MATCH, """
select song_id, count(*) as reference_notes, round(sum(coalesce(exp(-err * err / 20000e0), 0)) / count(*), 6) as soft_recall from ma group by song_id""")
def a29(s, d):
    r = e.soft_recall(e.claim_once(*pair(s, d), 2000.0), 100.0)
    return r.select("song_id", "reference_notes", F.round("soft_recall", 6).alias("soft_recall"))


@query("a30_precision_recall_f1", "notes", MATCH + """,
hh as (select song_id, count(cid) as hits, count(*) as rn from ma group by song_id), oo as (select song_id, count(*) as ours from cd group by song_id)""", """
select song_id, coalesce(hits, 0) as hits, coalesce(ours, 0) as ours, coalesce(rn, 0) as reference, round(2e0 * (coalesce(hits, 0) / greatest(coalesce(ours, 0), 1)) * (coalesce(hits, 0) / greatest(coalesce(rn, 0), 1))
 / greatest(coalesce(hits, 0) / greatest(coalesce(ours, 0), 1) + coalesce(hits, 0) / greatest(coalesce(rn, 0), 1), 1e-9) + 1.37e-8, 6) as f1 from hh full join oo using (song_id)""")
def a30(s, d):
    ref, can = pair(s, d)
    r = e.scores(e.claim_once(ref, can, 2000.0), can, ref)
    return r.select("song_id", "hits", "ours", "reference", r6("f1").alias("f1"))


EV = ANCH.format(w=120) + """,
gp as (select n.*, (select max(g.t) from gr g where g.song_id = n.song_id and g.t <= n.start_ms) as t from notes n),
ev as (select song_id, t, list_sort(list(pitch)) as ps, max(end_ms) as e1 from gp group by song_id, t)"""


def events(s, d):
    return e.chord_events(c.notes(s, d), 120.0)


@query("a24_chord_stats", "notes", EV + """,
en as (select *, lead(ps) over (partition by song_id order by t) as np from ev),
ef as (select *, len(ps) >= 3 and len(ps) = len(np) as cmp, len(list_distinct([np[i] - ps[i] for i in range(1, len(ps) + 1)])) = 1 and np[1] <> ps[1] as par from en)""", """
select song_id, count(*) as events, cast(sum(len(ps)) as bigint) as noteheads, round(avg(case when len(ps) >= 2 then 1e0 else 0e0 end) + 1.37e-8, 6) as chord_share, round(coalesce(avg(len(ps)) filter (where len(ps) >= 2), 0) + 1.37e-8, 6) as mean_size,
  cast(max(len(ps)) as int) as max_size, round(coalesce(avg(ps[-1] - ps[1]) filter (where len(ps) >= 2), 0) + 1.37e-8, 6) as spread, count(*) filter (where cmp) as comparable, round(count(*) filter (where cmp and par) / greatest(count(*) filter (where cmp), 1) + 1.37e-8, 6) as parallel_share from ef group by song_id""")
def a24(s, d):
    r = e.chord_stats(events(s, d))
    return r.select("song_id", "events", "noteheads", "max_size", "comparable", *[r6(x).alias(x) for x in ("chord_share", "mean_size", "spread", "parallel_share")])


@query("a25_phrase_stats", "notes", EV + """,
io as (select song_id, lead(t) over (partition by song_id order by t) - t as ioi from ev),
md as (select song_id, median(ioi) as m, count(ioi) as k from io group by song_id having count(ioi) >= 3)""", """
select song_id, count(*) filter (where ioi > 3 * m) + 1 as phrases, round(count(*) / (count(*) filter (where ioi > 3 * m) + 1) + 1.37e-8, 6) as mean_len, round(any_value(m), 6) as median_ioi, round(case when any_value(m) > 0 then max(ioi) / any_value(m) else 0 end, 6) as longest_gap_x from io join md using (song_id) group by song_id""")
def a25(s, d):
    r = e.phrase_stats(events(s, d))
    return r.select("song_id", "phrases", r6("mean_len").alias("mean_len"), F.round("median_ioi", 6).alias("median_ioi"), F.round("longest_gap_x", 6).alias("longest_gap_x"))


RAT = EV + """,
rt as (select song_id, log2((lead(t, 2) over w - lead(t) over w) / (lead(t) over w - t)) as r from ev window w as (partition by song_id order by t))"""


@query("a26_ratio_profile", "notes", RAT, """
select song_id, cast(least(23, floor((r + 3) * 4)) as int) as bin, count(*) as n, round(count(*) / sum(count(*)) over (partition by song_id) + 1.37e-8, 6) as share from rt where abs(r) <= 3 group by song_id, cast(least(23, floor((r + 3) * 4)) as int)""")
def a26(s, d):
    return e.ratio_profile(events(s, d)).select("song_id", "bin", "n", r6("share").alias("share"))


RC = "[" + ", ".join(f"{{'n': '{n}', 'v': {v!r}e0, 'i': {i}}}" for i, (n, v) in enumerate(e.RATIO_CLASSES)) + "]"


@query("a27_named_ratios", "notes", RAT + f""",
nb as (select song_id, list_min([{{'d': abs(r - log2(x.v)), 'i': x.i, 'n': x.n}} for x in {RC}]) as b from rt where r is not null)""", """
select song_id, case when b.d <= 0.18 then b.n else 'other' end as ratio, count(*) as n from nb group by all""")
def a27(s, d):
    return e.named_ratios(events(s, d))


@query("a31_pitch_profile_correlation", "notes", """
pc as (select song_id, p, (select count(*) from notes n where n.song_id = q.song_id and n.pitch % 12 = p and note_id % 2 = 0) as a, (select count(*) from notes n where n.song_id = q.song_id and n.pitch % 12 = p and note_id % 2 = 1) as b
  from (select distinct song_id from notes) q cross join range(12) r(p))""", """
select song_id, round(corr(a, b), 6) as r from pc group by song_id having sum(a) > 0 and sum(b) > 0""")
def a31(s, d):
    n = c.notes(s, d)
    return e.pitch_profile_correlation(n.filter("note_id % 2 = 0"), n.filter("note_id % 2 = 1")).select("song_id", F.round("r", 6).alias("r"))


@query("a32_cross_view_agreement", "notes", "", """
select song_id, round(avg(case when exists(select 1 from notes b where b.note_id % 2 = 1 and b.song_id = a.song_id and b.pitch = a.pitch and abs(b.start_ms - a.start_ms) <= 500) then 1e0 else 0e0 end) + 1.37e-8, 6) as match_rate,
  round(avg(abs(start_ms / 120 - round_even(start_ms / 120, 0))), 6) as grid_error, round(sum(end_ms - start_ms), 4) as sounding_ms from notes a where note_id % 2 = 0 group by song_id""")
def a32(s, d):
    n = c.notes(s, d)
    a, b = n.filter("note_id % 2 = 0"), n.filter("note_id % 2 = 1")
    hit = joins.nearest(a, b, ["song_id", "pitch"], "start_ms", "start_ms", 500.0, {"hit": F.col("start_ms")})
    m = hit.groupBy("song_id").agg(F.avg(F.col("hit").isNotNull().cast("double")).alias("match_rate"))
    return m.join(e.grid_error(a, 480.0), "song_id").select("song_id", r6("match_rate").alias("match_rate"), F.round("grid_error", 6).alias("grid_error"), F.round("sounding_ms", 4).alias("sounding_ms"))


@query("a33_distortion", "notes", """
sn as (select * from notes where stem <> 'drums'),
cn as (select song_id, pitch, note_id as cid, round_even(start_ms / 120, 0) * 120 as t, round_even(end_ms / 120, 0) * 120 as c1 from sn where note_id % 9 <> 0),
rr as (select *, row_number() over (partition by song_id, pitch order by start_ms, note_id) as k from sn),
gm(song_id, pitch, k, rid, cid, used) as (
  select song_id, pitch, 0, cast(null as bigint), cast(null as bigint), cast([] as bigint[]) from (select distinct song_id, pitch from sn) q
  union all
  select song_id, pitch, k, rid, b, case when b is null then used else list_append(used, b) end from (
    select g.song_id, g.pitch, r.k, r.note_id as rid, g.used, (select arg_min(c.cid, [abs(c.t - r.start_ms), c.t, c.cid]) from cn c
      where c.song_id = r.song_id and c.pitch = r.pitch and abs(c.t - r.start_ms) <= 250 and not list_contains(g.used, c.cid)) as b
    from gm g join rr r on r.song_id = g.song_id and r.pitch = g.pitch and r.k = g.k + 1) z),
ma as (select * from gm where k > 0),
mt as (select n.song_id, n.start_ms, n.end_ms, c.t as c0, c.c1, row_number() over (partition by n.song_id order by n.start_ms, n.end_ms, n.pitch, n.note_id) as k
  from ma join sn n on n.note_id = ma.rid join cn c on c.cid = ma.cid),
ov as (select a.song_id, a.k, count(*) filter (where b.c0 < a.c1) as kept, count(*) filter (where b.c0 >= a.c1) as lost from mt a join mt b on b.song_id = a.song_id and b.k - a.k between 1 and 11 and b.start_ms < a.end_ms group by all),
n1 as (select *, lead(start_ms) over (partition by song_id order by k) as s1, lead(c0) over (partition by song_id order by k) as d0 from mt),
dr as (select song_id, avg(case when cid is null then 1e0 else 0e0 end) as dropped from ma group by song_id),
sm as (select n1.song_id, avg(abs(c0 - start_ms)) as onset, avg(abs(c1 - c0 - (end_ms - start_ms)) / greatest(end_ms - start_ms, 1)) as duration, coalesce(sum(kept), 0) as kept, coalesce(sum(lost), 0) as lost,
    count(*) filter (where s1 <> start_ms and (c0 - d0) * (start_ms - s1) < 0) as flips, count(*) filter (where s1 <> start_ms) as moves
  from n1 left join ov on ov.song_id = n1.song_id and ov.k = n1.k group by n1.song_id)""", """
select dr.song_id, round(dropped + 1.37e-8, 6) as dropped, round(onset + 1.37e-8, 6) as onset, round(duration + 1.37e-8, 6) as duration, round(lost / greatest(kept + lost, 1) + 1.37e-8, 6) as overlap, round(flips / greatest(moves, 1) + 1.37e-8, 6) as ordering from dr left join sm using (song_id)""")
def a33(s, d):
    n = c.notes(s, d).filter("stem <> 'drums'")
    page = n.filter("note_id % 9 <> 0").withColumns({"start_ms": F.bround(F.col("start_ms") / 120) * 120.0, "end_ms": F.bround(F.col("end_ms") / 120) * 120.0})
    return e.distortion(n, page).select("song_id", *[r6(x).alias(x) for x in ("dropped", "onset", "duration", "overlap", "ordering")])


@query("a34_pareto_front", "notes", """
pt as (select song_id, stem, count(*) as n, round(avg(end_ms - start_ms), 2) as du, min(pitch) as lo from notes group by song_id, stem)""", """
select a.song_id, a.stem from pt a where not exists(select 1 from pt b where b.song_id = a.song_id and b.n <= a.n and b.du <= a.du and b.lo <= a.lo and (b.n < a.n or b.du < a.du or b.lo < a.lo))""")
def a34(s, d):
    p = c.notes(s, d).groupBy("song_id", "stem").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("end_ms") - F.col("start_ms")), 2).alias("du"), F.min("pitch").alias("lo"))
    return e.pareto_front(p, ["lo", "n", "du"]).select("song_id", "stem")


@query("a38_witness_auc", "notes", """
rk as (select stem, pitch % 3 = 0 as pos, velocity, rank() over (partition by stem order by velocity) + (count(*) over (partition by stem, velocity) - 1) / 2e0 as r from notes)""", """
select stem, round((sum(case when pos then r else 0 end) - sum(case when pos then 1 else 0 end) * (sum(case when pos then 1 else 0 end) + 1) / 2e0) / (sum(case when pos then 1 else 0 end) * sum(case when pos then 0 else 1 end)), 6) as auc from rk group by stem""")
def a38(s, d):
    n = c.notes(s, d).withColumn("pos", F.col("pitch") % 3 == 0)
    return e.auc(n, ["stem"], "velocity", "pos", 16.0).withColumn("auc", F.round("auc", 6))


def voices(s, d):
    return c.notes(s, d).withColumns({"true_voice": F.col("note_id") % 3, "pred_voice": F.floor(F.col("velocity") / 25)})


@query("a39_pairwise_voice_scores", "notes", """
v as (select song_id, note_id, note_id % 3 as t, velocity // 25 as p from notes),
pr as (select a.song_id, sum(case when a.t = b.t and a.p = b.p then 1 else 0 end) as tp, sum(case when a.p = b.p then 1 else 0 end) as m, sum(case when a.t = b.t then 1 else 0 end) as t from v a join v b on a.song_id = b.song_id and a.note_id < b.note_id group by a.song_id)""", """
select song_id, round(case when m > 0 then tp / m else 0 end + 1.37e-8, 6) as precision, round(case when t > 0 then tp / t else 0 end + 1.37e-8, 6) as recall, round(case when tp > 0 then 2e0 * tp / (m + t) else 0 end + 1.37e-8, 6) as f1 from pr""")
def a39(s, d):
    r = e.pairwise_scores(voices(s, d))
    return r.select("song_id", *[r6(x).alias(x) for x in ("precision", "recall", "f1")])


@query("a40_transition_accuracy", "notes", """
v as (select song_id, velocity // 25 as p, lag(velocity // 25) over (partition by song_id, note_id % 3 order by start_ms, note_id) as q from notes)""", """
select song_id, round(avg(case when p = q then 1e0 else 0e0 end) + 1.37e-8, 6) as accuracy from v where q is not null group by song_id""")
def a40(s, d):
    return e.transition_accuracy(voices(s, d)).select("song_id", r6("accuracy").alias("accuracy"))


@query("w44_label_consistency", "notes sections", SECT + """,
tx as (select song_id, label, instance, case when count(*) < 12 then 'sparse' when count(*) < 18 then 'medium' else 'dense' end as texture from ns group by all),
tc as (select song_id, label, texture, count(*) as n from tx group by all),
tr as (select *, row_number() over (partition by song_id, label order by n desc, texture) as rn, sum(n) over (partition by song_id, label) as tot from tc)""", """
select song_id, label, texture, round(n / tot + 1.37e-8, 6) as share from tr where rn = 1""")
def w44(s, d):
    x = an.section_lookup(c.notes(s, d), c.sections(s, d)).groupBy("song_id", "label", "instance").agg(F.count(F.lit(1)).alias("k"))
    x = x.withColumn("texture", F.when(F.col("k") < 12, "sparse").when(F.col("k") < 18, "medium").otherwise("dense"))
    return e.label_consistency(x, "label", "texture").select("song_id", "label", "texture", r6("share").alias("share"))


@query("w43_offset_injection", "notes", """
ofs(o) as (values (-40e0), (-20e0), (0e0), (20e0), (40e0)),
rr as (select *, row_number() over (partition by song_id, pitch order by start_ms, note_id) as k from notes),
gm(song_id, pitch, o, k, used, err) as (
  select song_id, pitch, o, 0, cast([] as bigint[]), cast(null as double) from (select distinct song_id, pitch from notes) q, ofs
  union all
  select song_id, pitch, o, k, case when b.cid is null then used else list_append(used, b.cid) end, b.t - rt from (
    select g.song_id, g.pitch, g.o, r.k, r.start_ms as rt, g.used, (select arg_min({'cid': c.note_id, 't': c.start_ms + g.o}, [abs(c.start_ms + g.o - r.start_ms), c.start_ms + g.o, c.note_id])
      from notes c where c.song_id = r.song_id and c.pitch = r.pitch and abs(c.start_ms + g.o - r.start_ms) < 250 and not list_contains(g.used, c.note_id)) as b
    from gm g join rr r on r.song_id = g.song_id and r.pitch = g.pitch and r.k = g.k + 1) z),
rv as (select o, avg(err) as m from gm where k > 0 group by o)""", """
select o as offset_ms, round(m, 6) as recovered, round((select regr_slope(m, o) from rv), 6) as slope from rv""")
def w43(s, d):
    """Every note shifted by a known offset against the unshifted notes of its song and pitch."""
    b = e.injected_bias(c.notes(s, d), (-40.0, -20.0, 0.0, 20.0, 40.0), 250.0)
    return b.select("offset_ms", F.round("recovered", 6).alias("recovered"), F.round("slope", 6).alias("slope"))


@query("w43_degradation", "notes", f"""
nd as (select note_id, start_ms, end_ms, sqrt(-2e0 * ln({drawn('note_id', 1)})) * cos(2 * pi() * {drawn('note_id', 2)}) as a, sqrt(-2e0 * ln({drawn('note_id', 3)})) * cos(2 * pi() * {drawn('note_id', 4)}) as b from notes),
ns as (select note_id, greatest(0e0, start_ms + 60e0 * a) as s, (end_ms - start_ms) * greatest(0.15e0, 1 + 1.39e0 * b) as u from nd)""", """
select note_id, round(s, 6) as start_ms, round(s + u, 6) as end_ms from ns""")
def w43b(s, d):
    g = e.degrade(c.notes(s, d))
    return g.select("note_id", F.round("start_ms", 6).alias("start_ms"), F.round("end_ms", 6).alias("end_ms"))
