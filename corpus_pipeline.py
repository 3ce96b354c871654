"""A corpus pipeline of five operators: language, toxicity, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, with the columns
of ``documents``; its result is written as Parquet and read again for the next one.  The last
returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteflow.llm import byte_cnn, ftrl, harmonic_packing, mixing, order_minhash
from noteflow.llm.queries import language_model, table, tokenizer_path, toxicity_model
from noteflow.llm.storage import fresh, small_batches, store

MIN_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, hold no letter, or whose language the network cannot tell.

    The network learns from the documents given; with no labelled text at all nothing can be
    told and only null texts and texts without a letter go.
    """
    net = language_model(docs)
    small_batches(spark)
    found = fresh(docs, "found")
    told = docs.withColumn(found, byte_cnn.detector(net)(F.col("text").cast("string")))
    if net is None:
        return told.filter(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))).drop(found)
    sure = (F.col(f"{found}.lang") != byte_cnn.UND) & (F.col(f"{found}.score") >= MIN_LANGUAGE_SCORE)
    return told.filter(sure).drop(found)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that score 0.5 or more; learns from the labels of the documents given.

    Without a labelled document no text is rejected.
    """
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    if not len(model.index) and model.bias == 0:
        return docs
    small_batches(spark)
    score = fresh(docs, "score")
    return docs.withColumn(score, ftrl.scorer(model)(F.col("text").cast("string"))).filter(F.col(score) < 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of exact and near copies: a row with the smallest doc_id."""
    names = docs.columns
    kept = order_minhash.near_duplicates(docs).filter("kept").select(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), "key").alias("name"))
    key = F.coalesce(F.md5(F.encode(F.col("text").cast("string"), "UTF-8")), F.lit("none"))
    named = docs.select(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), key.alias("key")).alias("name"), F.struct(*names).alias("doc"))
    # repeated rows share name and text: one of them stays
    return named.join(kept, "name", "left_semi").dropDuplicates(["name"]).select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the source mix takes them: one row per document and pass."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in training sequences, as digests of their token ids."""
    # executors still hold what earlier stages needed, so the word memory is small here
    pieces = harmonic_packing.tokenize(docs, "doc_id", "text", tokenizer_path(), remember=60_000, keep=False)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return harmonic_packing.place(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Trained models, sketches and token ids have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
