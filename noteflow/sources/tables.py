"""Run catalogs, ledgers, snapshots and other tables on storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEMS = ("drums", "bass", "vocals", "other", "guitar", "piano", "brass")


def list_runs(runs: DataFrame, notes: DataFrame, beats: DataFrame) -> DataFrame:
    """One row per run, newest first: scalars, counts per stem, and whether its beat grid was kept."""
    per = notes.groupBy("run_id", "stem").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stem", "n")))).alias("stems"), F.sum("n").alias("notes"))
    grid = beats.select("run_id").distinct().withColumn("reproducible", F.lit(True))
    return runs.join(per, "run_id", "left").join(grid, "run_id", "left").withColumn(
        "reproducible", F.coalesce("reproducible", F.lit(False))).orderBy(F.desc("modified"), "run_id")


def stem_files(spark: SparkSession, path: str) -> DataFrame:
    """Catalog of <song>/<stem>.wav files of known stems (names only, no content is read)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select("path", "length", "modificationTime")
    return f.withColumn("song", F.regexp_extract("path", r"([^/]+)/[^/]+\.wav$", 1)).withColumn(
        "stem", F.regexp_extract("path", r"([^/]+)\.wav$", 1)).filter(F.col("stem").isin(*STEMS))


def json_safe(value: Column, limit: int = 100) -> Column:
    """JSON text of an array, or a placeholder when it is longer than the limit."""
    return F.when(F.size(value) > limit, F.format_string("<sequence length=%d>", F.size(value))).otherwise(F.to_json(value))


def append_decisions(decisions: DataFrame, path: str) -> None:
    """Append-only ledger, partitioned by stage."""
    decisions.write.mode("append").partitionBy("stage").json(path)


def query_decisions(ledger: DataFrame, decision: str | None = None, stage: str | None = None, limit: int | None = None) -> DataFrame:
    """Ledger rows in log order, optionally of one decision or stage."""
    q = ledger
    if decision is not None:
        q = q.filter(F.col("decision_type") == decision)
    if stage is not None:
        q = q.filter(F.col("stage") == stage)
    q = q.orderBy("session", "seq")
    return q.limit(limit) if limit is not None else q


def corpus_documents(observations: DataFrame) -> DataFrame:
    """One document per (song, pattern page): times to 0.1 ms, confidence to 3 places.

    Observations of a song are paged by thousands, so a document stays small
    however many figures a song holds.
    """
    w = Window.partitionBy("song_id", F.floor(F.col("start_ms") / 60000.0)).orderBy("start_ms", "pattern", "stem")
    o = observations.withColumn("page", F.floor(F.col("start_ms") / 60000.0)).withColumn("_r", F.row_number().over(w))
    o = o.withColumn("part", F.floor((F.col("_r") - 1) / 1000))
    row = F.struct("_r", "pattern", "stem", F.round("start_ms", 1).alias("start_ms"), F.round("end_ms", 1).alias("end_ms"), F.round("confidence", 3).alias("confidence"))
    return o.groupBy("song_id", "page", "part").agg(F.count(F.lit(1)).alias("observations"), F.array_sort(F.collect_list(row)).alias("list"))


def write_corpus(observations: DataFrame, path: str) -> None:
    corpus_documents(observations).write.mode("overwrite").partitionBy("page").json(path)


def write_replay(events: DataFrame, session: int | str, path: str) -> None:
    """Events of one session in order."""
    events.filter(F.col("session") == session).repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").json(path)


SNAPSHOT = ("notes", "annotations", "beats", "runs")


def write_snapshot(tables: dict[str, DataFrame], path: str, buckets: int = 256) -> None:
    """Tables a page can be rebuilt from, in a bounded number of run buckets."""
    missing = set(SNAPSHOT) - set(tables)
    if missing:
        raise ValueError(f"a snapshot needs {sorted(missing)}")
    for name, df in tables.items():
        bucket = F.pmod(F.xxhash64("run_id"), F.lit(buckets))
        df.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}").drop("bucket") for n in SNAPSHOT}


def write_notation(rows: DataFrame, path: str, buckets: int = 256) -> None:
    """Notation rows in a bounded number of song buckets (a directory per song would not scale)."""
    rows.withColumn("bucket", F.pmod(F.xxhash64("song_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)
