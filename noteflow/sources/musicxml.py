"""MusicXML pages as note rows: cursors per voice, measure offsets, page profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.timeline import fill, run_sum, scan, settle

NOTE = ("struct<chord:string,rest:string,pitch:struct<step:string,alter:int,octave:int>,duration:long,voice:string,type:string,"
        "`time-modification`:struct<`actual-notes`:int,`normal-notes`:int>>")
MEASURE = f"struct<_number:string,attributes:struct<divisions:int,time:struct<beats:int,`beat-type`:int>>,note:array<{NOTE}>>"
PART = f"_id string, measure array<{MEASURE}>"
# Semitones of the note letters.
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """One row per part with its measures; the file name is the song."""
    x = spark.read.format("xml").option("rowTag", "part").schema(PART).load(path)
    return x.select(F.regexp_extract("_metadata.file_name", r"([^/]+?)\.(?:musicxml|xml)$", 1).alias("song_id"), F.col("_id").alias("part"), "measure")


def measures(parts: DataFrame) -> DataFrame:
    return parts.select("song_id", "part", F.posexplode("measure").alias("measure", "m"))


def midi_of(pitch: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])
    return (pitch["octave"] + 1) * 12 + F.try_element_at(table, pitch["step"]) + F.coalesce(pitch["alter"], F.lit(0))


def page_notes(measured: DataFrame) -> DataFrame:
    """Notes and rests of (song_id, part, measure, m) with onsets in quarters from the part's start.

    A voice's cursor runs inside its measure; a measure is as long as its longest
    voice with a pitched note (four quarters when it has none); part offsets come
    from a two-level running sum over measures.
    """
    keys = ["song_id", "part"]
    d = scan(measured.withColumn("_d", F.col("m.attributes.divisions")), keys, ["measure"], {"div": fill("_d")}, 512.0)
    n = d.select(*keys, "measure", F.coalesce("div", F.lit(1)).alias("div"), F.posexplode_outer("m.note").alias("i", "n"))
    n = n.withColumn("voice", F.coalesce("n.voice", F.lit("1"))).withColumn("dq", F.coalesce("n.duration", F.lit(0)) / F.col("div"))
    chord = F.col("n.chord").isNotNull()
    own = F.when(chord, 0.0).otherwise(F.col("dq"))
    w = Window.partitionBy(*keys, "measure", "voice").orderBy("i")
    n = n.withColumn("_cur", F.sum(own).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = n.withColumn("_on", F.last(F.when(~chord, F.col("_cur") - F.col("dq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = settle(n.withColumn("onset", F.coalesce("_on", F.lit(0.0))).withColumn("pitch", F.when(F.col("n.rest").isNull(), midi_of(F.col("n.pitch")))))
    longest = F.max(F.when(F.col("pitch").isNotNull(), F.col("_cur")))
    length = n.groupBy(*keys, "measure").agg(F.when(longest > 0, longest).otherwise(4.0).alias("len"))
    length = scan(length, keys, ["measure"], {"_cum": run_sum("len")}, 512.0).withColumn("at", F.col("_cum") - F.col("len"))
    j = n.filter("n is not null").join(length.select(*keys, "measure", "at"), [*keys, "measure"])
    return j.select(*keys, "measure", "voice", F.col("n.type").alias("type"), "pitch", (F.col("at") + F.col("onset")).alias("start_q"),
                    (F.col("at") + F.col("onset") + F.col("dq")).alias("end_q"), F.col("n").getField("time-modification").alias("tuplet"))


def sounding(rows: DataFrame, tempo: Column | None = None, drum_parts: DataFrame | None = None) -> DataFrame:
    """Pitched notes in seconds; drum parts are skipped."""
    r = rows.filter("pitch is not null")
    if drum_parts is not None:
        r = r.join(drum_parts, ["song_id", "part"], "left_anti")
    q = 60.0 / (F.lit(120.0) if tempo is None else tempo)
    return r.select("song_id", "part", (F.col("start_q") * q).alias("start_s"), (F.col("end_q") * q).alias("end_s"), "pitch")


def answer_key(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pitched notes in quarters, total length per song)."""
    k = rows.filter("pitch is not null").select("song_id", F.col("start_q"), "end_q", "pitch")
    return k, rows.groupBy("song_id").agg(F.max("end_q").alias("length_q"))


def profile(texts: DataFrame) -> DataFrame:
    """Tag census of pages (song_id, text) by pattern counts; texts may be pieces of a page, counts add up."""
    def n(pattern):
        return F.regexp_count("text", F.lit(pattern))

    pairs = F.regexp_extract_all("text", F.lit(r"<normal-notes>(\d+)</normal-notes>"), F.lit(1))
    junk = F.size(F.filter(pairs, lambda x: ~x.isin("1", "2", "3", "4", "6", "8", "12", "16")))
    t = texts.select("song_id", n(r"<note[ >]").alias("notes"), n(r"<rest\s*/?>").alias("rests"), n(r'<tie type="start"').alias("ties"),
                     n(r"<chord\s*/?>").alias("chords"), F.size(pairs).alias("tuplets"), junk.alias("junk"),
                     n(r"<type>(32nd|64th|128th)</type>").alias("fine"), n(r"<type>\w+</type>").alias("typed"), n(r"<measure\b").alias("measures"))
    g = t.groupBy("song_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in t.columns[1:]])
    k = F.greatest(F.col("notes"), F.lit(1))
    return g.select("song_id", "notes", "measures", "junk", (F.col("rests") / k).alias("rest_per_note"), (F.col("ties") / k).alias("tie_per_note"),
                    (F.col("chords") / k).alias("chord_per_note"), (100.0 * F.col("tuplets") / k).alias("tuplet_pct"), (100.0 * F.col("fine") / k).alias("sub32_pct"))


def page_profiles(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.text(path, wholetext=True)
    return profile(x.select(F.regexp_extract("_metadata.file_name", r"([^/]+?)\.(?:musicxml|xml)$", 1).alias("song_id"), F.col("value").alias("text")))
