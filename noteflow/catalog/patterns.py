"""Melodic and harmonic figures."""

from pyspark.sql import functions as F

from ..functions.music import chord_masks
from ..operators import patterns as p
from ..plans.timeline import prev, scan, settle
from ..sources import corpus as c
from .registry import ORACLES, query

STREAM = "st as (select song_id, stem, note_id, start_ms, end_ms, confidence, {pitch} as pitch, row_number() over (partition by song_id, stem order by start_ms, note_id) - 1 as pos from notes)"
MASKS = "[" + ", ".join(map(str, chord_masks())) + "]"
# greedy walk over candidate matches mt(song_id, stem, pos, adv): recursion per stream
WALK = """
ma as (select * from mt where adv is not null),
wk(song_id, stem, pos, adv) as (select song_id, stem, min(pos), arg_min(adv, pos) from ma group by song_id, stem
  union all select n.song_id, n.stem, n.pos, n.adv from (select w.song_id, w.stem, (select min(m.pos) from ma m where m.song_id = w.song_id and m.stem = w.stem and m.pos >= w.pos + w.adv) as np from wk w) q
  join ma n on n.song_id = q.song_id and n.stem = q.stem and n.pos = q.np)"""


def lead(k):
    return f"lead(pitch, {k}) over w as p{k}"


def dense(s, d, pitch):
    """Notes with their pitches folded onto a few values, so that figures occur."""
    return c.notes(s, d).withColumn("pitch", pitch)


def small(n, base=60):
    return (F.lit(base) + (F.col("velocity") - 1) % n).cast("bigint")


def chordal():
    return F.get(F.array(F.lit(48), F.lit(52), F.lit(55), F.lit(60)), ((F.col("velocity") - 1) % 4).cast("int")).cast("bigint")


def triad():
    return F.get(F.array(F.lit(48), F.lit(52), F.lit(55)), ((F.col("velocity") - 1) % 3).cast("int")).cast("bigint")


def report(obs):
    return obs.select("song_id", "stem", "pos0", "pos1", "size", F.round("confidence", 6).alias("confidence"))


@query("w09_scale_runs", "notes", STREAM.format(pitch="60 + (velocity - 1) % 5") + """,
iv as (select *, pitch - lag(pitch) over w as iv from st window w as (partition by song_id, stem order by pos)),
dd as (select *, case when abs(iv) between 1 and 2 then sign(iv) end as d from iv),
bb as (select *, case when d = lag(d) over w then 0 else 1 end as b from dd window w as (partition by song_id, stem order by pos)),
ii as (select *, sum(b) over w as isl from bb window w as (partition by song_id, stem order by pos))""", """
select song_id, stem, min(pos) - 1 as pos0, max(pos) as pos1, count(*) + 1 as size, round(least(0.95e0, 0.55e0 + 0.05e0 * (count(*) + 1)), 6) as confidence from ii where d is not null group by song_id, stem, isl having count(*) >= 3""")
def w09(s, d):
    return report(p.scale_runs(dense(s, d, small(5)), 480.0))


@query("w10_arpeggios", "notes", STREAM.format(pitch="([48, 52, 55, 60])[cast((velocity - 1) % 4 as int) + 1]") + """,
pv as (select *, lag(pitch) over w as pp from st window w as (partition by song_id, stem order by pos)),
lp as (select *, coalesce(abs(pitch - pp) between 3 and 12, false) as leap from pv),
bb as (select *, case when leap and coalesce(lag(leap) over w, false) then 0 else 1 end as b from lp window w as (partition by song_id, stem order by pos)),
ii as (select *, sum(b) over w as isl from bb window w as (partition by song_id, stem order by pos)),
sf as (select *, bit_or((1 << cast(pitch % 12 as int)) | (1 << cast(pp % 12 as int))) over x as mask, sum(case when pitch > pp then 1 else 0 end) over x as ups, count(*) over x as e, max(pos) over x as last from ii where leap
  window x as (partition by song_id, stem, isl order by pos desc rows between unbounded preceding and current row)),
ok as (select song_id, stem, isl, min(pos) as a, max(last) as b from sf where e >= 3 and greatest(ups, e - ups) / e >= 0.75 and list_contains(""" + MASKS + """, mask) group by all)""", """
select song_id, stem, a - 1 as pos0, b as pos1, b - a + 2 as size, round(least(0.9e0, 0.5e0 + 0.08e0 * (b - a + 2)), 6) as confidence from ok""")
def w10(s, d):
    return report(p.arpeggios(dense(s, d, chordal()), 480.0))


@query("w11_sequences", "notes", STREAM.format(pitch="60 + (velocity - 1) % 4") + f""",
ld as (select *, {', '.join(lead(k) for k in range(1, 10))} from st window w as (partition by song_id, stem order by pos)),
mt as (select song_id, stem, pos, case
  when abs(p5 - pitch) <= 12 and p5 <> pitch and p6 - p1 = p5 - pitch and p7 - p2 = p5 - pitch and p8 - p3 = p5 - pitch and p9 - p4 = p5 - pitch then 10
  when abs(p4 - pitch) <= 12 and p4 <> pitch and p5 - p1 = p4 - pitch and p6 - p2 = p4 - pitch and p7 - p3 = p4 - pitch then 8
  when abs(p3 - pitch) <= 12 and p3 <> pitch and p4 - p1 = p3 - pitch and p5 - p2 = p3 - pitch then 6 end as adv from ld),
""" + WALK, "select song_id, stem, pos as pos0, pos + adv - 1 as pos1, cast(adv as bigint) as size, 0.8e0 as confidence from wk")
def w11(s, d):
    return report(p.sequences(dense(s, d, small(4)), 480.0))


def _rep(c_):
    return f"(min(case when e{c_} then null else pos end) over (partition by song_id, stem order by pos rows between current row and unbounded following) - pos) // {c_} + 1 as r{c_}"


@query("w12_ostinati", "notes", STREAM.format(pitch="60 + (velocity - 1) % 2") + f""",
ee as (select *, {', '.join(f'coalesce(pitch = lead(pitch, {k}) over w, false) as e{k}' for k in (2, 3, 4, 5))} from st window w as (partition by song_id, stem order by pos)),
rr as (select *, {', '.join(_rep(k) for k in (2, 3, 4, 5))} from ee),
mt as (select song_id, stem, pos, case when r5 >= 3 then 5 * r5 when r4 >= 3 then 4 * r4 when r3 >= 3 then 3 * r3 when r2 >= 3 then 2 * r2 end as adv,
  case when r5 >= 3 then r5 when r4 >= 3 then r4 when r3 >= 3 then r3 when r2 >= 3 then r2 end as reps from rr),
""" + WALK, """
select wk.song_id, wk.stem, wk.pos as pos0, wk.pos + wk.adv - 1 as pos1, wk.adv as size, round(least(0.92e0, 0.6e0 + 0.08e0 * reps), 6) as confidence from wk join ma using (song_id, stem, pos)""")
def w12(s, d):
    return report(p.ostinati(dense(s, d, small(2)), 480.0))


EQ = """
bb as (select *, case when pitch = lag(pitch) over w and start_ms - lag(start_ms) over w <= {ioi} then 0 else 1 end as b from st window w as (partition by song_id, stem order by pos)),
ii as (select *, sum(b) over w as isl from bb window w as (partition by song_id, stem order by pos))"""


@query("w13_pedal_points", "notes", STREAM.format(pitch="60 + (velocity - 1) % 2") + "," + EQ.format(ioi="1e300"), """
select song_id, stem, min(pos) as pos0, max(pos) as pos1, count(*) as size, 0.75e0 as confidence from ii group by song_id, stem, isl having count(*) >= 3 and (arg_max(end_ms, pos) - min(start_ms)) / 480 >= 2""")
def w13(s, d):
    return report(p.pedals(dense(s, d, small(2)), 480.0))


@query("w14_rearticulations", "notes", STREAM.format(pitch="60 + (velocity - 1) % 2") + "," + EQ.format(ioi="0.3 * 1600"), """
select song_id, stem, min(pos) as pos0, max(pos) as pos1, count(*) as size, 0.7e0 as confidence from ii group by song_id, stem, isl having count(*) >= 3""")
def w14(s, d):
    return report(p.rearticulations(dense(s, d, small(2)), 1600.0))


@query("w15_alberti_figures", "notes", STREAM.format(pitch="([48, 52, 55])[cast((velocity - 1) % 3 as int) + 1]") + f""",
ee as (select *, {', '.join(lead(k) for k in (1, 2, 3))}, coalesce(pitch = lead(pitch, 4) over w, false) as e4 from st window w as (partition by song_id, stem order by pos)),
rr as (select *, {_rep(4)} from ee),
mt as (select song_id, stem, pos, 4 * r4 as adv from rr where r4 >= 2 and pitch < p2 and p2 < p1 and p3 = p1 and list_contains({MASKS}, (1 << cast(pitch % 12 as int)) | (1 << cast(p1 % 12 as int)) | (1 << cast(p2 % 12 as int)))),
""" + WALK, "select song_id, stem, pos as pos0, pos + adv - 1 as pos1, adv as size, 0.85e0 as confidence from wk")
def w15(s, d):
    return report(p.alberti(dense(s, d, triad()), 480.0))


@query("w16_neighbor_tones", "notes", STREAM.format(pitch="60 + (velocity - 1) % 5") + f""",
ld as (select *, {', '.join(lead(k) for k in range(1, 5))} from st window w as (partition by song_id, stem order by pos)),
mt as (select song_id, stem, pos, case when coalesce(p4 = pitch and abs(p3 - pitch) between 1 and 2 and (p3 - pitch) * (p1 - pitch) < 0, false) then 4 else 2 end as adv from ld where p2 = pitch and abs(p1 - pitch) between 1 and 2),
""" + WALK, "select song_id, stem, pos as pos0, pos + adv as pos1, cast(adv + 1 as bigint) as size, case when adv = 4 then 0.85e0 else 0.75e0 end as confidence from wk")
def w16(s, d):
    return report(p.neighbor_tones(dense(s, d, small(5)), 480.0))


@query("w17_gap_fills", "notes", STREAM.format(pitch="60 + (velocity - 1) % 7") + """,
ld as (select *, lead(pitch) over w - pitch as iv from st window w as (partition by song_id, stem order by pos)),
sd as (select *, case when abs(iv) between 1 and 2 then sign(iv) else 0 end as d from ld),
nx as (select *, min(case when d <> 1 then pos end) over f as nu, min(case when d <> -1 then pos end) over f as nd from sd window f as (partition by song_id, stem order by pos rows between 1 following and unbounded following)),
mt as (select song_id, stem, pos, case when iv < 0 then nu else nd end - pos as adv from nx where abs(iv) between 4 and 12 and case when iv < 0 then nu else nd end - pos - 1 >= 2),
""" + WALK, "select song_id, stem, pos as pos0, pos + adv as pos1, adv + 1 as size, round(least(0.9e0, 0.6e0 + 0.07e0 * (adv - 1)), 6) as confidence from wk")
def w17(s, d):
    return report(p.gap_fills(dense(s, d, small(7)), 480.0))


@query("w18_c06_chord_figures", "notes", STREAM.format(pitch="([48, 52, 55, 60])[cast((velocity - 1) % 4 as int) + 1]") + """,
gr(song_id, stem, t) as (select song_id, stem, min(start_ms) from st group by song_id, stem
  union all select * from (select g.song_id, g.stem, (select min(s.start_ms) from st s where s.song_id = g.song_id and s.stem = g.stem and s.start_ms > g.t + 400) as t from gr g) q where t is not null),
gm as (select st.*, (select max(g.t) from gr g where g.song_id = st.song_id and g.stem = st.stem and g.t <= st.start_ms) as grp from st)""", f"""
select song_id, stem, min(pos) as pos0, max(pos) as pos1, count(*) as size, 0.8e0 as confidence from gm group by song_id, stem, grp having count(*) >= 3 and list_contains({MASKS}, bit_or(1 << cast(pitch % 12 as int)))""")
def w18(s, d):
    return report(p.chords(dense(s, d, chordal()), 480.0, window_ms=400.0))


MOTIF = STREAM.format(pitch="60 + (velocity - 1) % 3") + """,
mb as (select *, case when pitch = lag(pitch) over w and start_ms - lag(end_ms) over w < 250 then 0 else 1 end as b from st where stem <> 'drums' window w as (partition by song_id, stem order by pos)),
mi as (select *, sum(b) over w as isl from mb window w as (partition by song_id, stem order by pos)),
mq as (select song_id, stem, isl, min(pitch) as pitch, min(start_ms) as start_ms, row_number() over (partition by song_id, stem order by isl) as i, count(*) over (partition by song_id, stem) as n from mi group by song_id, stem, isl),
md as (select *, lead(pitch) over w - pitch as iv from mq window w as (partition by song_id, stem order by i)),
mg as (select a.song_id, a.stem, a.start_ms, l, (select string_agg(cast(b.iv as int), ',' order by b.i) from md b where b.song_id = a.song_id and b.stem = a.stem and b.i >= a.i and b.i < a.i + l) as gram,
   (select max(abs(b.iv)) from md b where b.song_id = a.song_id and b.stem = a.stem and b.i >= a.i and b.i < a.i + l) as mx
  from md a cross join (values (4), (5), (6)) q(l) where a.i <= n - 1 - l and n >= 8),
mo as (select song_id, stem, gram, l, count(*) as cnt, min(start_ms) as first_ms from mg where mx > 0 group by all having count(*) >= 3)"""


@query("w07_motifs", "notes", MOTIF, "select song_id, stem, gram, cnt as count, round(first_ms, 6) as first_ms from mo")
def w07(s, d):
    m = p.motifs(p.motif_occurrences(dense(s, d, small(3))))
    return m.select("song_id", "stem", F.concat_ws(",", F.transform("gram", lambda x: x.cast("string"))).alias("gram"), "count", F.round("first_ms", 6).alias("first_ms"))


@query("w08_motif_hits", "notes", MOTIF + """,
ml as (select *, list_transform(string_split(gram, ','), lambda x: cast(x as int)) as g from mo),
mr as (select *, row_number() over (partition by song_id order by cnt desc, l desc, stem, first_ms, g) - 1 as motif from ml)""", """
select song_id, note_id, motif, least(1e0, cnt / 5e0) as confidence
from mr join mg using (song_id, stem, gram, l) join st using (song_id, stem, start_ms) where mx > 0""")
def w08(s, d):
    n = dense(s, d, small(3))
    hits = p.motif_hits(n, settle(p.motif_occurrences(n)))
    return hits.select("song_id", "note_id", F.col("motif").cast("bigint").alias("motif"), "confidence")


@query("a42_pattern_coverage", "notes", STREAM.format(pitch="60 + (velocity - 1) % 2") + "," + EQ.format(ioi="1e300") + """,
pp as (select song_id, stem, isl from ii group by song_id, stem, isl having count(*) >= 3 and (arg_max(end_ms, pos) - min(start_ms)) / 480 >= 2)""", """
select 'pedal_point' as pattern, count(*) as covered, (select count(*) from notes) as studied, round(count(*) / (select count(*) from notes), 6) as coverage from ii join pp using (song_id, stem, isl)""")
def a42(s, d):
    n = dense(s, d, small(2))
    return p.coverage(p.pedals(n, 480.0), n, p.KEYS).withColumn("coverage", F.round("coverage", 6))


@query("c05_contour_monotonicity", "notes", STREAM.format(pitch="pitch") + """,
iv as (select *, pitch - lag(pitch) over (partition by song_id, stem order by pos) as iv from st)""", """
select song_id, stem, round(case when sum(abs(iv)) > 0 then abs(sum(iv)) / sum(abs(iv)) else 1 end, 6) as monotonicity from iv group by song_id, stem""")
def c05(s, d):
    n = scan(c.notes(s, d), ["song_id", "stem"], ["start_ms", "note_id"], {"q": prev("pitch")})
    iv = F.col("pitch") - F.col("q")
    g = n.groupBy("song_id", "stem").agg(F.sum(F.abs(iv)).alias("t"), F.abs(F.sum(iv)).alias("m"))
    return g.select("song_id", "stem", F.round(F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(1.0), 6).alias("monotonicity"))


def detector_counts():
    """The detectors' own statements, counted, all over pitches folded onto five values at one beat."""
    folds = ["60 + (velocity - 1) % 4", "60 + (velocity - 1) % 2", "60 + (velocity - 1) % 7", "([48, 52, 55, 60])[cast((velocity - 1) % 4 as int) + 1]",
             "([48, 52, 55])[cast((velocity - 1) % 3 as int) + 1]"]
    names = ("w09_scale_runs", "w10_arpeggios", "w11_sequences", "w12_ostinati", "w13_pedal_points", "w14_rearticulations", "w15_alberti_figures",
             "w16_neighbor_tones", "w17_gap_fills", "w18_c06_chord_figures")
    parts = []
    for detector, name in zip(p.DETECTORS, names):
        sql = ORACLES[name].replace("0.3 * 1600", "0.3 * 480")
        for fold in folds:
            sql = sql.replace(fold, "60 + (velocity - 1) % 5")
        parts.append(f"select '{detector}' as pattern, '{p.tier(detector)}' as tier, (select count(*) from ({sql}) q) as observations")
    return " union all ".join(parts)


@query("x01_detector_registry", "", "", detector_counts())
def x01(s, d):
    """Every registered detector over every stem, with its tier."""
    n = dense(s, d, small(5))
    out = None
    for name, fn in p.DETECTORS.items():
        o = fn(n, 480.0, p.KEYS).groupBy("pattern").agg(F.count(F.lit(1)).alias("observations")).withColumn("tier", F.lit(p.tier(name)))
        out = o if out is None else out.unionByName(o)
    # a detector that finds nothing still has its row
    names = s.createDataFrame([(n, p.tier(n)) for n in p.DETECTORS], "pattern string, tier string")
    return names.join(out.drop("tier"), "pattern", "left").fillna(0, ["observations"])


@query("w41_null_model")
def w41(s, d):
    return p.null_model(dense(s, d, small(5)), 480.0, list(p.DETECTORS))
