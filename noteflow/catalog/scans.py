"""Page scans, catalogs, text."""

from pyspark.sql import functions as F

from ..functions import music as m
from ..operators import patterns as pt
from ..sources import corpus as c
from ..sources import musicxml as mx
from ..sources import tables as tb
from .patterns import EQ, STREAM, dense, small
from .registry import query, r6

NAMES = ("C", "D", "E", "F", "G", "A", "B")


def xml_measures(s, d):
    """Every note of the corpus as MusicXML text, one row per (song, stem, 1920 ms measure)."""
    n = c.notes(s, d).withColumn("measure", F.floor(F.col("start_ms") / 1920))
    i = F.col("note_id")
    step = F.get(F.array(*[F.lit(x) for x in NAMES]), (i % 7).cast("int"))
    body = F.concat(
        F.when(i % 6 == 0, F.lit("<chord/>")).otherwise(""),
        F.when(i % 5 == 0, F.lit("<rest/>")).otherwise(F.concat(F.lit("<pitch><step>"), step, F.lit("</step><octave>"), (3 + i % 3).cast("string"), F.lit("</octave></pitch>"))),
        F.lit("<duration>"), (1 + i % 4).cast("string"), F.lit("</duration><voice>"), (1 + i % 2).cast("string"), F.lit("</voice><type>"),
        F.when(i % 8 == 0, "32nd").otherwise("quarter"), F.lit("</type>"))
    tag = F.concat(F.lit("<note>"), body, F.lit("</note>"))
    g = n.groupBy("song_id", F.col("stem").alias("part"), "measure").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note_id", tag.alias("x")))), lambda v: v["x"]), "").alias("x"))
    return g.select("song_id", "part", "measure", F.concat(F.lit("<measure number=\"1\"><attributes><divisions>2</divisions></attributes>"), "x", F.lit("</measure>")).alias("text"))


XML = """
xn as (select note_id, song_id, stem as part, cast(floor(start_ms / 1920) as bigint) as measure, note_id % 6 = 0 as ch, note_id % 5 = 0 as rest, (1 + note_id % 4) / 2e0 as dq, 1 + note_id % 2 as voice,
  (3 + note_id % 3 + 1) * 12 + [0, 2, 4, 5, 7, 9, 11][cast(note_id % 7 as int) + 1] as pitch from notes),
xc as (select *, sum(case when ch then 0 else dq end) over w as cur from xn window w as (partition by song_id, part, measure, voice order by note_id)),
xo as (select *, coalesce(last_value(case when not ch then cur - dq end ignore nulls) over (partition by song_id, part, measure, voice order by note_id rows between unbounded preceding and current row), 0) as onset from xc),
xl as (select song_id, part, measure, case when coalesce(max(case when not rest then cur end), 0) > 0 then max(case when not rest then cur end) else 4e0 end as len from xo group by all),
xa as (select *, sum(len) over (partition by song_id, part order by measure) - len as at0 from xl)"""


def parsed(s, d):
    x = xml_measures(s, d)
    return mx.page_notes(x.select("song_id", "part", "measure", F.from_xml("text", mx.MEASURE, {"rowTag": "measure"}).alias("m")))


@query("s05_musicxml_notes", "notes", XML, """
select song_id, part, round((at0 + onset) * 0.5, 6) as start_s, round((at0 + onset + dq) * 0.5, 6) as end_s, cast(pitch as int) as pitch from xo join xa using (song_id, part, measure) where not rest""")
def s05(s, d):
    n = mx.sounding(parsed(s, d))
    return n.select("song_id", "part", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), F.col("pitch").cast("int").alias("pitch"))


@query("s06_answer_key", "notes", XML, """
select song_id, round(max(at0 + onset + dq), 6) as length_q, count(*) filter (where not rest) as notes from xo join xa using (song_id, part, measure) group by song_id""")
def s06(s, d):
    notes, length = mx.answer_key(parsed(s, d))
    k = notes.groupBy("song_id").agg(F.count(F.lit(1)).alias("notes"))
    return length.join(k, "song_id", "left").select("song_id", F.round("length_q", 6).alias("length_q"), F.coalesce("notes", F.lit(0).cast("bigint")).alias("notes"))


@query("s07_page_profile", "notes", XML, """
select song_id, count(*) as notes, count(distinct (part, measure)) as measures, round(count(*) filter (where rest) / count(*) + 1.37e-8, 6) as rest_per_note, round(count(*) filter (where ch) / count(*) + 1.37e-8, 6) as chord_per_note,
  round(100e0 * count(*) filter (where note_id % 8 = 0) / count(*) + 1.37e-8, 6) as sub32_pct from xn group by song_id""")
def s07(s, d):
    p = mx.profile(xml_measures(s, d).select("song_id", "text"))
    return p.select("song_id", "notes", "measures", *[r6(x).alias(x) for x in ("rest_per_note", "chord_per_note", "sub32_pct")])


@query("s08_run_catalog", "notes beats", "", """
select song_id as run_id, count(*) as notes, max(start_ms) as modified, string_agg(distinct stem, ',' order by stem) as stems, song_id in (select song_id from beats where song_id % 3 <> 0) as reproducible from notes group by song_id""")
def s08(s, d):
    n = c.notes(s, d).withColumnRenamed("song_id", "run_id")
    runs = n.groupBy("run_id").agg(F.max("start_ms").alias("modified"))
    r = tb.list_runs(runs, n, c.beats(s, d).filter("song_id % 3 <> 0").withColumnRenamed("song_id", "run_id"))
    return r.select("run_id", "notes", "modified", F.array_join(F.map_keys("stems"), ",").alias("stems"), "reproducible")


@query("s12_corpus_documents", "notes", STREAM.format(pitch="60 + (velocity - 1) % 2") + "," + EQ.format(ioi="1e300") + """,
ob as (select song_id, stem, min(start_ms) as start_ms, arg_max(end_ms, pos) as end_ms from ii group by song_id, stem, isl having count(*) >= 3 and (arg_max(end_ms, pos) - min(start_ms)) / 480 >= 2),
dc as (select *, cast(floor(start_ms / 60000) as bigint) as page, row_number() over (partition by song_id, floor(start_ms / 60000) order by start_ms, stem) as r from ob)""", """
select song_id, page, (r - 1) // 1000 as part, count(*) as observations, '[' || string_agg('{"_r":' || r || ',"pattern":"pedal_point","stem":"' || stem || '","start_ms":' || round(start_ms, 1) || ',"end_ms":' || round(end_ms, 1) || ',"confidence":0.75}', ',' order by r) || ']' as list
from dc group by song_id, page, (r - 1) // 1000""")
def s12(s, d):
    n = dense(s, d, small(2))
    o = pt.with_notes(pt.pedals(n, 480.0), n)
    return tb.corpus_documents(o).select("song_id", "page", "part", "observations", F.to_json("list").alias("list"))


@query("c03_json_safe_payload", "notes", "", """
select song_id, cast(floor(start_ms / 1920) as bigint) as measure, case when count(*) > 6 then '<sequence length=' || count(*) || '>' else '[' || string_agg(pitch, ',' order by note_id) || ']' end as payload from notes group by all""")
def c03(s, d):
    g = c.notes(s, d).groupBy("song_id", F.floor(F.col("start_ms") / 1920).alias("measure")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("note_id", "pitch"))), lambda x: x["pitch"]).alias("ps"))
    return g.select("song_id", "measure", tb.json_safe(F.col("ps"), 6).alias("payload"))


@query("c04_elapsed_text", "notes", "x as (select note_id, cast(note_id * 7 as bigint) as s from notes)", """
select note_id, case when s >= 3600 then format('{}h {:02d}m {:02d}s', s // 3600, s % 3600 // 60, s % 60) else format('{}m {:02d}s', s // 60, s % 60) end as elapsed from x""")
def c04(s, d):
    return c.notes(s, d).select("note_id", m.elapsed_text(F.col("note_id") * 7).alias("elapsed"))
