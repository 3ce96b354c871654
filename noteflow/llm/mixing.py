"""Mixing sources to target weights with token blocks and index permutations.

Every source's documents form one stream of words (documents in pseudorandom order), cut into
blocks of a fixed number of words; only a source's last block may be shorter.  A source's
target decides how many slots it fills: whole passes over its blocks, then part of one more.
Every slot is thrown into an output shard, so the counts of a source over the shards are one
multinomial draw whose total is exact.  Slot ``j`` of a pass reads the block that a
pseudorandom permutation of the source's block numbers gives it, and slots meet blocks in an
equi-join on (source, block).

Everything is DataFrame expressions.  Hot sources are dealt by (source, bucket) and
(source, block); nothing is grouped by source alone except sums with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import number_rows, store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def source_key(source: str) -> Column:
    """A never-null key that tells a null source from any text."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def permuted(x: Column, n: Column, *seeds: Column, rounds: int = 20) -> Column:
    """Where a pseudorandom permutation of 0..n-1 sends ``x``.

    Swap-or-not rounds: each pairs i with (k - i) mod n and swaps the pair or not by a hash
    bit of the pair, so every round is a bijection for any n and no value is retried.
    """

    def one(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*seeds, r), n) - at, n)
        bit = F.pmod(F.xxhash64(*seeds, r, F.greatest(at, partner)), F.lit(2))
        return F.when(bit == 0, at).otherwise(partner)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, one)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per source: key, source_size and target.

    Sources in code point order (null last) weigh ``weights`` in turn and share ``share`` of all
    sizes; a target stops at ``most`` times its source's size and the excess is shared anew by
    weight.  The level of the sources below their limit is found by a few one-row sums, each
    with partial aggregation, so the number of sources may be large.
    """
    totals = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    ranked = number_rows(totals, [F.col("source").asc_nulls_last()], "rank")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    t = ranked.select("key", "source", "source_size", F.get(turn, (F.col("rank") % len(weights)).cast("int")).alias("weight"),
                      (F.col("source_size") * F.lit(float(most))).alias("limit"))
    budget = (t.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:  # the level only rises, and each turn stops at least one more source
        full = F.col("weight") * F.lit(level) >= F.col("limit")
        used, open_weight = t.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        raised = (budget - (used or 0.0)) / open_weight
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("weight") * F.lit(level), F.col("limit"))
    return t.select("key", "source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 256,
        shards: int = 64, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = 17,
        buckets: int = 1024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix all documents; returns (documents, slots, pieces).

    documents: row, id, size, source_size, target.  ``row`` numbers the given rows, so repeated
    rows count as documents of their own.
    slots: key, block, pass, shard, draw, words - one row per block an output shard reads
    (its first ``words`` words), in the order of ``draw`` inside the shard.
    pieces: row, id, key, block, at, from_word, words - the part of a document in a block.

    A null or empty text has size 0 and is never taken.  An empty table gives three empty
    ones.  Targets are met to the word; no document is taken more than ``most`` (rounded up)
    times.  Other columns of ``docs`` are not read.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    sizes = store(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
                  .withColumn("row", F.monotonically_increasing_id()).withColumn("key", source_key("source")), "sizes")
    targets = store(source_targets(sizes, share, most, weights), "targets")

    # where each document lies in its source's stream: bucket sums first, then rows inside a bucket
    spot = sizes.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id", "row"), F.lit(buckets)))
    sums = spot.groupBy("key", "bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("key", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = spot.filter("size > 0").withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["key", "bucket"])
    start = F.col("_base") + F.col("_in")
    cut = placed.select("row", "id", "key", "size", start.alias("start")).select(
        "*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = cut.select("row", "id", "key", "block", (first - F.col("block") * block).alias("at"),
                        (first - F.col("start")).alias("from_word"), (last - first).alias("words"))

    # slots: whole passes, then a part; hot sources are unfolded from many rows of `fold` slots each
    fold = 4096
    s = targets.filter("source_size > 0").select(
        "key", "source_size", F.round("target").cast("long").alias("want"), F.expr(f"source_size div {block}").alias("whole"))
    s = s.select("*", F.expr("want div source_size").alias("passes"), F.expr("want % source_size").alias("rest"),
                 F.expr(f"whole + cast(source_size % {block} > 0 as int)").alias("n"))
    s = s.withColumn("slots", F.expr(f"passes * n + (rest + {block - 1}) div {block}"))
    s = s.filter("slots > 0").withColumn("_fold", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {fold}"))))
    # a fixed number of partitions: their bytes are few before the slots are unfolded, and would be merged
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = s.repartition(tasks, "key", "_fold").withColumn("j", F.explode(F.sequence(
        F.col("_fold") * fold, F.least(F.col("slots"), (F.col("_fold") + 1) * fold) - 1)))
    s = s.withColumn("pass", F.expr("j div n")).withColumn("x", F.expr("j % n")).withColumn("h", F.xxhash64("key"))
    dealt = F.when(F.col("x") < F.col("whole"), permuted(F.col("x"), F.col("whole"), F.lit(seed), F.col("h"), F.col("pass"))).otherwise(F.col("x"))
    whole_pass = F.least(F.lit(block), F.col("source_size") - F.col("x") * block)
    part_pass = F.least(F.lit(block), F.col("rest") - F.col("x") * block)
    draw = F.xxhash64(F.lit(seed + 1), "h", "j")
    slots = s.select("key", dealt.cast("long").alias("block"), "pass", F.pmod(F.xxhash64(F.lit(seed + 2), "h", "j"), F.lit(shards)).cast("int").alias("shard"),
                     draw.alias("draw"), F.when(F.col("pass") < F.col("passes"), whole_pass).otherwise(part_pass).alias("words"))
    documents = sizes.join(targets.select("key", "source_size", "target"), "key").select("row", "id", "size", "source_size", "target")
    return documents, slots, pieces


def taken_pieces(slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """Blocks joined by index: one row per document piece that a slot takes.

    Columns shard, draw, pass, row, id, block, from_word, words.
    """
    p = pieces.withColumnRenamed("words", "_len")
    took = F.least(F.col("at") + F.col("_len"), F.col("words")) - F.col("at")
    # the slots are unfolded from one row per source, which a planner takes for a small table
    return slots.hint("merge").join(p, ["key", "block"]).withColumn("words", took).filter("words > 0").select(
        "shard", "draw", "pass", "row", "id", "block", "from_word", "words")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mixture as rows with the columns of ``docs``: one row per document and pass.

    A pass that takes all words of a document keeps its text as it is; otherwise the text is
    the taken words, in order, joined by spaces, and ``chars_col`` (if there) its length.
    Documents of which no word is taken, and texts without words, do not appear.
    """
    names = docs.columns
    kept = store(docs.select(F.struct(*names).alias("doc"), F.monotonically_increasing_id().alias("row_id")), "mixed")
    flat = kept.select("row_id", F.col(f"doc.{text_col}").alias("text"), F.col(f"doc.{source_col}").alias("source"))
    documents, slots, pieces = mix(flat, "row_id", "text", "source", **options)
    took = taken_pieces(slots, pieces).groupBy(F.col("id").alias("row_id"), "pass").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "words"))).alias("ranges"), F.sum("words").alias("words"))
    sizes = documents.select(F.col("id").alias("row_id"), "size")
    rows = kept.join(took.join(sizes, "row_id"), "row_id")
    words = F.regexp_extract_all(F.col(f"doc.{text_col}").cast("string"), F.lit(WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(words, r["from_word"].cast("int") + 1, r["words"].cast("int")))), " ")
    text = F.when(F.col("words") == F.col("size"), F.col(f"doc.{text_col}")).otherwise(part)
    rows = rows.withColumn("new_text", text)
    kind = dict(docs.dtypes)
    return rows.select(*[F.col("new_text").alias(c) if c == text_col
                         else F.length("new_text").cast(kind[c]).alias(c) if c == chars_col
                         else F.col("doc").getField(c).alias(c) for c in names])
