"""Adapter: the driver's star-schema tables seen as a note-event corpus.

Each function returns one input table of the library (FIXTURES.md, section 2).
Only the columns an operator asks for reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.timeline import row_no, scan

EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return table(spark, sf_dir, "events").withColumn(
        "k", F.get_json_object("props", "$.k").cast("bigint")
    ).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = (
        F.when(F.col("event_type") == "click", "piano")
        .when(F.col("event_type") == "view", "vocals")
        .when(F.col("event_type") == "purchase", "bass")
        .when(F.col("event_type") == "signup", "guitar")
        .otherwise("drums")
    )
    start = F.col("us") / F.lit(150000000.0)
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("note_id"),
        F.col("user_id").alias("song_id"),
        stem.alias("stem"),
        (F.lit(48) + F.col("k") % 24).alias("pitch"),
        start.alias("start_ms"),
        (start + 20.0 + F.col("value") * 6.0).alias("end_ms"),
        (F.lit(1) + F.col("k")).alias("velocity"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("confidence"),
    )


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = notes(spark, sf_dir).groupBy("song_id").agg(
        F.min("start_ms").alias("t0"), F.max("end_ms").alias("t1")
    )
    last = F.floor((F.col("t1") - F.col("t0")) / 480.0) + 1
    return span.select("song_id", "t0", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("beat_idx")).select(
        "song_id",
        "beat_idx",
        (F.col("t0") + F.col("beat_idx") * 480.0 + (F.col("song_id") * 7 + F.col("beat_idx") * 13) % 40).alias("t_ms"),
    )


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).filter("note_id % 3 <> 0").select(
        "song_id",
        "stem",
        F.when(F.col("note_id") % 2 == 0, "w1").otherwise("w2").alias("witness"),
        F.greatest(F.lit(0.0), F.col("start_ms") + (F.col("note_id") * 37) % 50 - 25).alias("t_ms"),
        F.col("confidence").alias("energy"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append log with rewrites; every note yields its rows in one pass over the scan."""
    n = notes(spark, sf_dir)

    def row(kind: str, seq, value):
        return F.struct(F.lit(kind).alias("kind"), seq.alias("seq"), value.alias("value"))

    note_id = F.col("note_id")
    rows = F.array_compact(
        F.array(
            row("onset_refinement", note_id, F.col("start_ms") - note_id % 30),
            F.when(note_id % 5 == 0, row("onset_refinement", note_id + 1000000000, F.col("start_ms") + note_id % 7)),
            F.when(note_id % 2 == 0, row("sustain_extension", note_id, F.col("end_ms") + note_id % 90)),
        )
    )
    return n.select("note_id", F.explode(rows).alias("a")).select("note_id", "a.kind", "a.seq", "a.value")


def tempo_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("song_id"), p.alias("source"))
        .agg(F.sum("o_orderkey").alias("s"), F.max("o_orderkey").alias("m"))
        .select(
            "song_id",
            "source",
            (F.lit(60.0) + (F.col("s") % 1200).cast("double") / 10.0).alias("tempo_bpm"),
            (F.lit(0.3) + (F.col("m") % 60).cast("double") / 100.0).alias("confidence"),
            F.when(F.col("source") == "1-URGENT", 1.0)
            .when(F.col("source") == "2-HIGH", 0.8)
            .when(F.col("source") == "3-MEDIUM", 0.7)
            .otherwise(0.6)
            .alias("weight"),
        )
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.floor(F.col("start_ms") / 4000.0)
    return (
        notes(spark, sf_dir)
        .select("song_id", i.alias("idx"))
        .distinct()
        .select(
            "song_id",
            "idx",
            F.substring(F.lit("ABC"), (F.col("idx") * F.col("idx") % 3 + 1).cast("int"), F.lit(1)).alias("label"),
            (F.col("idx") * 4000.0).alias("start_ms"),
            (F.col("idx") * 4000.0 + 4000.0).alias("end_ms"),
        )
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame features; positions come from a two-level count, not a window per supplier."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    order = ["_day", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(86400000000.0)).alias("_day"),
    )
    numbered = scan(li, ["l_suppkey"], order, {"rn": row_no()}, chunk_ms=120.0)
    return numbered.select(
        F.col("l_suppkey").alias("song_id"),
        (F.col("rn") - 1).cast("bigint").alias("frame_idx"),
        ((F.col("rn") - 1) * 23.22).alias("t_ms"),
        (F.col("l_quantity") / 50.0).alias("rms"),
        (F.col("l_extendedprice") / 100000.0).alias("flux"),
        (F.col("l_discount") * 10.0).alias("flatness"),
        F.when(F.col("l_linenumber") % 4 == 0, 0.0)
        .otherwise(110.0 * F.pow(F.lit(2.0), (F.col("l_partkey") % 24) / 12.0))
        .alias("hz"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("_h", F.col("us") / F.lit(3600000000.0))
    e = scan(e, ["user_id"], ["_h", "event_id"], {"seq": row_no()}, chunk_ms=24.0)
    return e.select(
        F.col("user_id").alias("session"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("ts").alias("t_wall"),
        F.col("event_type").alias("stage"),
        F.when(F.col("k") < 10, "stage_start").when(F.col("k") < 20, "stage_end").otherwise("decision").alias("type"),
        F.concat(F.lit("d"), (F.col("k") % 31).cast("string")).alias("decision_type"),
    )
