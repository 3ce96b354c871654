"""Files in, files out, and live telemetry against its batch forms."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from noteflow.sources import corpus as c
from noteflow.sources import musicxml as mx
from noteflow.sources import tables as tb
from noteflow.streaming import telemetry as t

PAGE = """<score-partwise><part id="P1"><measure number="1"><attributes><divisions>2</divisions><time><beats>4</beats><beat-type>4</beat-type></time></attributes>
<note><pitch><step>C</step><octave>4</octave></pitch><duration>2</duration><voice>1</voice><type>quarter</type></note>
<note><chord/><pitch><step>E</step><octave>4</octave></pitch><duration>2</duration><voice>1</voice><type>quarter</type></note>
<note><rest/><duration>2</duration><voice>1</voice><type>quarter</type></note>
<note><pitch><step>G</step><alter>1</alter><octave>3</octave></pitch><duration>8</duration><voice>2</voice><type>whole</type></note></measure>
<measure number="2"><note><pitch><step>A</step><octave>4</octave></pitch><duration>1</duration><voice>1</voice><type>eighth</type></note></measure></part></score-partwise>"""


def test_musicxml_file(spark, tmp_path):
    (tmp_path / "song.musicxml").write_text(PAGE)
    rows = mx.page_notes(mx.measures(mx.read_parts(spark, str(tmp_path))))
    got = sorted((x.start_s, x.end_s, x.pitch) for x in mx.sounding(rows).collect())
    assert got == [(0.0, 0.5, 60), (0.0, 0.5, 64), (0.0, 2.0, 56), (2.0, 2.25, 69)]
    key, length = mx.answer_key(rows)
    assert key.count() == 4 and length.first().length_q == 4.5
    x = mx.page_profiles(spark, str(tmp_path)).first()
    assert x.song_id == "song" and x.notes == 5 and x.measures == 2 and abs(x.rest_per_note - 0.2) < 1e-9


def test_stem_catalog(spark, tmp_path):
    for name in ("a/bass.wav", "a/noise.wav", "b/piano.wav"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert {(x.song, x.stem) for x in tb.stem_files(spark, str(tmp_path)).collect()} == {("a", "bass"), ("b", "piano")}


def test_tables_round_trip(spark, sf, tmp_path):
    n = c.notes(spark, sf)
    runs = n.select(F.col("song_id").alias("run_id")).distinct()
    notes = n.withColumn("run_id", F.col("song_id"))
    ann = c.annotations(spark, sf).join(notes.select("note_id", "run_id"), "note_id")
    tb.write_snapshot({"notes": notes, "annotations": ann, "beats": c.beats(spark, sf).withColumn("run_id", F.col("song_id")), "runs": runs.withColumn("x", F.lit(1))}, str(tmp_path / "snap"))
    back = tb.read_snapshot(spark, str(tmp_path / "snap"))
    assert back["notes"].count() == n.count() and back["annotations"].count() == ann.count()
    tb.write_notation(n, str(tmp_path / "page"), 4)
    assert spark.read.parquet(str(tmp_path / "page")).count() == n.count()
    d = c.telemetry(spark, sf)
    tb.append_decisions(d.filter("type = 'decision'"), str(tmp_path / "ledger"))
    tb.append_decisions(d.filter("type = 'decision'"), str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 2 * d.filter("type = 'decision'").count()
    tb.write_replay(d, 3, str(tmp_path / "replay"))
    assert spark.read.json(str(tmp_path / "replay")).count() == d.filter("session = 3").count()


def events():
    t0 = datetime(2024, 1, 1)
    rows = []
    for s in (1, 2):
        for i in range(12):
            kind = "run_end" if i == 11 and s == 1 else ("stage_start", "decision", "stage_end")[i % 3]
            rows.append({"session": s, "seq": i, "t_wall": (t0 + timedelta(seconds=5 * i)).isoformat(), "ms": 5000.0 * i, "stage": f"g{i // 3}", "type": kind, "decision_type": f"d{i % 5}"})
    return rows


def feed(tmp_path):
    rows = events()
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps(r) for r in rows[:13]) + "\n{broken")
    (src / "2.json").write_text("\n".join(json.dumps(r) for r in rows[10:]))
    return str(src)


def drain(df, name, mode, tmp_path, **trigger):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(**(trigger or {"availableNow": True})).start()
    assert q.awaitTermination(90)
    return df.sparkSession.table(name)


def test_stream_dedupe_and_timing(spark, tmp_path):
    src = feed(tmp_path)
    got = drain(t.deduplicated(t.read_stream(spark, src, 1)), "dedup", "append", tmp_path)
    assert got.count() == 24 and got.select("session", "seq").distinct().count() == 24
    batch = spark.read.schema(t.EVENT).json(src).filter("session is not null").dropDuplicates(["session", "seq"])
    want = {(x.session, x.stage, x.elapsed_ms) for x in t.stage_timings(batch).collect()}
    live = drain(t.stage_timings_stream(t.read_stream(spark, src)), "timing", "append", tmp_path)
    assert {(x.session, x.stage, x.elapsed_ms) for x in live.collect()} == want and want


def test_stream_timing_takes_the_last_start(spark, tmp_path):
    """A stage that runs twice, files in the wrong order, a repeat, and a number that never arrives."""
    t0 = datetime(2024, 1, 1)
    kinds = ["stage_start", "stage_end", "decision", "stage_start", "stage_start", "stage_end", "stage_end"]
    rows = [{"session": 5, "seq": i, "t_wall": (t0 + timedelta(hours=3 * i)).isoformat(), "ms": 0.0, "stage": "g", "type": k, "decision_type": None} for i, k in enumerate(kinds)]
    src = tmp_path / "twice"
    src.mkdir()
    for name, part in (("1", rows[3:5]), ("2", rows[:3] + rows[3:4]), ("3", rows[5:])):
        (src / f"{name}.json").write_text("\n".join(map(json.dumps, part)))
    live = drain(t.stage_timings_stream(t.read_stream(spark, str(src), 1), "30 days"), "twice", "append", tmp_path)
    assert sorted((x.start_seq, x.end_seq) for x in live.collect()) == [(0, 1), (4, 5), (4, 6)]


def test_stream_progress_equals_batch(spark, tmp_path):
    src = feed(tmp_path)
    marks = ["g0:d1", "g1:d4", "g2:d2", "g3:d0"]
    batch = spark.read.schema(t.EVENT).json(src).filter("session is not null").dropDuplicates(["session", "seq"])
    want = {x.session: (x.current_stage, x.decisions, x.milestones, x.fraction) for x in t.progress(batch, marks, ()).collect()}
    # quiet timers re-arm for ever on an unfinished session, so this query runs one batch
    live = drain(t.progress_stream(t.deduplicated(t.read_stream(spark, src)), marks, ()), "progress", "update", tmp_path, once=True)
    last = {}
    for x in live.collect():
        if x.session not in last or x.decisions >= last[x.session][1]:
            last[x.session] = (x.current_stage, x.decisions, x.milestones, x.fraction)
    assert last == want and want[1][3] == 1.0


def test_tee_is_idempotent(spark, tmp_path):
    q = t.tee(t.read_stream(spark, feed(tmp_path)), str(tmp_path / "ledger"), str(tmp_path / "live"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "live")).count() == 27
    assert spark.read.json(str(tmp_path / "ledger")).filter("type <> 'decision'").count() == 0


def note_files(spark, sf, tmp_path):
    n = c.notes(spark, sf).filter("song_id < 4").withColumn("at", F.timestamp_millis(F.floor("start_ms")))
    src = str(tmp_path / "notes")
    n.repartitionByRange(3, "at").sortWithinPartitions("at").write.parquet(src)
    # far-future notes of another song push the watermark past the end
    far = n.limit(1).withColumns({"song_id": F.lit(99).cast("bigint"), "note_id": F.lit(10**9).cast("bigint"), "at": F.timestamp_millis(F.lit(10**8)), "start_ms": F.lit(1e8)})
    far.write.mode("append").parquet(src)
    return n, spark.readStream.schema(n.schema).option("maxFilesPerTrigger", 10).parquet(src)


def test_stream_voice_lines_equal_batch(spark, sf, tmp_path):
    from noteflow.operators.lines import voice_lines

    n, live = note_files(spark, sf, tmp_path)
    got = drain(t.voice_line_stream(live), "lines", "append", tmp_path).filter("song_id <> 99")
    want = {x.note_id: x.line_id for x in voice_lines(n).collect()}
    assert {x.note_id: x.line_id for x in got.collect()} == want


def test_stream_trouble_map_equals_batch(spark, sf, tmp_path):
    n, live = note_files(spark, sf, tmp_path)
    got = drain(t.trouble_stream(live, 1920, 4), "trouble", "append", tmp_path).filter("song_id <> 99")
    g = n.groupBy("song_id", F.floor(F.col("start_ms") / 1920).alias("m")).agg(F.avg("confidence").alias("a"), F.count(F.lit(1)).alias("k"))
    want = {(x.song_id, x.m * 1920) for x in g.filter("a < 0.25 or k / 4 > 6").collect()}
    assert {(x.song_id, x.start_ms) for x in got.collect()} == want and want


def test_stream_voice_lines_share_states_over_many_batches(spark, tmp_path):
    from noteflow.operators.lines import voice_lines

    rnd = random.Random(4)
    schema = "song_id long, stem string, note_id long, pitch long, start_ms double, end_ms double"
    at = F.timestamp_millis(F.floor("start_ms") + 1)  # an event at the epoch counts as late
    rows = [(i % 7, "ab"[i % 2], i, 60 + rnd.randrange(9), 20.0 * i + rnd.random(), 20.0 * i + 40.0 + 300.0 * rnd.random()) for i in range(300)]
    # a line that ends 290 ms before a chord which still waits when the watermark passes the line's 300 ms
    rows += [(8, "a", 1000, 60, 600.0, 690.0), (8, "a", 1001, 60, 980.0, 1050.0), (9, "a", 1002, 60, 1000.0, 1010.0)]
    far = [(99, "a", 2000, 60, 1e8, 1e8)]
    src = str(tmp_path / "cut")
    cuts = ([r for r in rows if r[4] <= 1000.0], [r for r in rows if 1000.0 < r[4] < 3000.0], [r for r in rows if r[4] >= 3000.0], far)
    for part in cuts:
        spark.createDataFrame(part, schema).withColumn("at", at).coalesce(1).write.mode("append").parquet(src)
    live = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = drain(t.voice_line_stream(live, "0 seconds", buckets=3), "shared", "append", tmp_path)
    n = spark.createDataFrame(rows, schema)
    want = {x.note_id: x.line_id for x in voice_lines(n).collect()}
    assert {x.note_id: x.line_id for x in got.collect() if x.song_id != 99} == want and want[1001] == 1000
