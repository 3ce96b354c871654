"""Tables and streams written below the shared folder and read again."""

from pyspark.sql import functions as F

from ..session import scratch
from ..sources import corpus as c
from ..sources import tables as tb
from ..streaming import telemetry as t
from .lines import VOICES
from .registry import query, r6


MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def events_as_files(s, d):
    """The telemetry as JSON lines in several files, as a stream."""
    path = scratch(s, "events")
    c.telemetry(s, d).withColumns({"ms": F.lit(0.0), "t_wall": F.col("t_wall").cast("timestamp")}).repartition(6).write.option("timestampFormat", MICROS).json(path)
    return t.read_stream(s, path, time_format=MICROS)


def drained(df, tag):
    """All rows a stream gives for the files that are there, by way of a Parquet sink."""
    spark = df.sparkSession
    path, notes = scratch(spark, tag), scratch(spark, f"{tag}-state")
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", notes).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("s10_decision_ledger", "telemetry", "", "select session, seq, decision_type, stage from telemetry where type = 'decision'")
def s10(s, d):
    """Two appends to the ledger, read back in log order."""
    path = scratch(s, "ledger")
    e = c.telemetry(s, d).filter("type = 'decision'").select("session", "seq", "stage", "decision_type")
    for part in (0, 1):
        tb.append_decisions(e.filter(F.col("seq") % 2 == part), path)
    return tb.query_decisions(s.read.json(path)).select("session", "seq", "decision_type", "stage")


@query("s11_telemetry_stream", "telemetry", "", "select session, seq, stage, type, decision_type from telemetry")
def s11(s, d):
    return drained(t.deduplicated(events_as_files(s, d), "60 days"), "dedupe").select("session", "seq", "stage", "type", "decision_type")


@query("l02_stage_timing_stream", "telemetry", """
x as (select *, last_value(case when type = 'stage_start' then seq end ignore nulls) over w as ss, last_value(case when type = 'stage_start' then t_wall end ignore nulls) over w as st from telemetry where type <> 'decision'
  window w as (partition by session, stage order by seq rows between unbounded preceding and current row))""", """
select session, stage, ss as start_seq, seq as end_seq, round((epoch_us(t_wall) - epoch_us(st)) / 1000e0, 3) as elapsed_ms from x where type = 'stage_end' and ss is not null""")
def l02s(s, d):
    x = drained(t.stage_timings_stream(events_as_files(s, d), "60 days"), "timing")
    return x.withColumn("elapsed_ms", F.round("elapsed_ms", 3))


@query("l06_ledger_tee", "telemetry", "", """
select session, seq, case when type = 'decision' then 'both' else 'live' end as place from telemetry""")
def l06(s, d):
    ledger, live = scratch(s, "tee-ledger"), scratch(s, "tee-live")
    t.tee(events_as_files(s, d), ledger, live, scratch(s, "tee-state")).trigger(availableNow=True).start().awaitTermination()
    in_ledger = s.read.json(ledger).select("session", "seq", F.lit(True).alias("l"))
    return s.read.parquet(live).select("session", "seq").join(in_ledger, ["session", "seq"], "full_outer").select("session", "seq", F.when(F.col("l"), "both").otherwise("live").alias("place"))


@query("s14_run_snapshot", "notes beats annotations", """
n as (select song_id, count(*) as notes, sum(velocity) as v from notes group by song_id), b as (select song_id, count(*) as beats from beats group by song_id),
a as (select song_id, count(*) as annotations from annotations join notes using (note_id) group by song_id)""", """
select song_id as run_id, notes, cast(v as bigint) as velocity, beats, annotations from n join b using (song_id) join a using (song_id)""")
def s14(s, d):
    n, b = c.notes(s, d), c.beats(s, d)
    a = c.annotations(s, d).join(n.select("note_id", "song_id"), "note_id")
    tables = {k: v.withColumnRenamed("song_id", "run_id") for k, v in {"notes": n, "beats": b, "annotations": a, "runs": n.select("song_id").distinct()}.items()}
    path = scratch(s, "snapshot")
    tb.write_snapshot(tables, path, 8)
    r = tb.read_snapshot(s, path)
    one = F.count(F.lit(1))
    out = r["runs"].join(r["notes"].groupBy("run_id").agg(one.alias("notes"), F.sum("velocity").cast("bigint").alias("velocity")), "run_id")
    return out.join(r["beats"].groupBy("run_id").agg(one.alias("beats")), "run_id").join(r["annotations"].groupBy("run_id").agg(one.alias("annotations")), "run_id")


@query("s15_notation_table", "notes", "", "select song_id, note_id, pitch, round(start_ms / 480e0, 6) as offset_beats from notes")
def s15(s, d):
    path = scratch(s, "notation")
    tb.write_notation(c.notes(s, d).select("song_id", "note_id", "pitch", F.round(F.col("start_ms") / 480.0, 6).alias("offset_beats")), path, 8)
    return s.read.parquet(path).drop("bucket")


@query("s13_telemetry_replay", "telemetry", "", "select session, seq, stage, type, decision_type from telemetry where session = (select min(session) from telemetry)")
def s13(s, d):
    path = scratch(s, "replay")
    e = c.telemetry(s, d).select("session", "seq", "stage", "type", "decision_type")
    tb.write_replay(e, e.agg(F.min("session")).first()[0], path)
    return s.read.json(path).select("session", "seq", "stage", "type", "decision_type")


def notes_as_files(s, d):
    """The notes in files by time, as a stream with event time ``at``; one note far ahead lets the last of the others settle."""
    path = scratch(s, "notes")
    n = c.notes(s, d).withColumn("at", F.timestamp_millis(F.floor("start_ms") + 1))  # an event at the epoch counts as late
    n.repartitionByRange(4, "at").write.parquet(path)
    far = n.limit(1).withColumns({"song_id": F.lit(-1).cast("bigint"), "note_id": F.lit(-1).cast("bigint"), "start_ms": F.lit(1e12), "end_ms": F.lit(1e12), "at": F.timestamp_millis(F.lit(10**12))})
    far.write.mode("append").parquet(path)
    return s.readStream.schema(n.schema).parquet(path)


@query("l07_voice_line_stream", "notes", VOICES, "select song_id, stem, unnest(ids) as note_id, unnest(lines) as line_id from vl")
def l07(s, d):
    return drained(t.voice_line_stream(notes_as_files(s, d), "60 seconds"), "lines").filter("song_id >= 0")


@query("l08_trouble_stream", "notes", """
m as (select song_id, cast(floor(start_ms / 1920) as bigint) * 1920 as start_ms, avg(confidence) as a, count(*) as n from notes group by all)""", """
select song_id, start_ms, round(a + 1.37e-8, 6) as avg_confidence, n as n_notes, concat_ws(',', case when a < 0.25 then 'low_confidence' end, case when n / 4e0 > 6 then 'fragmented' end) as reasons from m where a < 0.25 or n / 4e0 > 6""")
def l08(s, d):
    x = drained(t.trouble_stream(notes_as_files(s, d).withColumn("at", F.timestamp_millis(F.floor("start_ms"))), 1920, 4, "60 seconds"), "trouble").filter("song_id >= 0")
    return x.select("song_id", "start_ms", r6("avg_confidence").alias("avg_confidence"), "n_notes", F.array_join("reasons", ",").alias("reasons"))
