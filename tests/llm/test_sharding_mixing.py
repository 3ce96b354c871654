from collections import Counter, defaultdict

import numpy as np
import pytest
from noteflow.llm import hilbert_sharding, mixing, queries
from pyspark.sql import functions as F


@pytest.mark.parametrize("bits,d", [(1, 2), (3, 2), (2, 3), (2, 4)])
def test_curve_visits_every_cell_by_unit_steps(bits, d):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), axis=-1).reshape(-1, d)
    at = hilbert_sharding.curve_index(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(at)], axis=0))
    assert (steps.sum(axis=1) == 1).all()


def check_slots(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    return {k: len(v) for k, v in by.items()}


def test_op1_law(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op1(spark, sf).collect()
    sizes = check_slots(rows)
    assert len(rows) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) <= set(range(40))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    import zlib

    for r in rows:
        b = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 16, zlib.crc32(b), "rows", None)


def test_shards_are_cut_along_the_curve_and_prune(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", F.length("text").cast("long").alias("size"))
    out = hilbert_sharding.shard(docs, ["source", "lang", "size"], "doc_id", "size", shards=16)
    order = [r["shard"] for r in out.orderBy("curve", F.xxhash64("doc_id")).collect()]
    assert order == sorted(order)
    table = hilbert_sharding.pruning_table(out, ["lang", "size"]).collect()
    assert sum(r["rows"] for r in table) == docs.count()
    english = sum(r["min_lang"] <= "de" <= r["max_lang"] for r in table)
    assert english < 16  # a filter on a language skips files


def test_bytes_law(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", F.length("text").cast("long").alias("size"))
    rows = hilbert_sharding.shard(docs, ["lang", "size"], "doc_id", "size", shards=5, law="bytes").collect()
    check_slots(rows)
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    assert max(total.values()) - min(total.values()) <= 2 * max(r["size"] for r in rows)


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding_awkward_and_empty(awkward, empty_docs, law):
    for docs in (awkward, empty_docs):
        sized = docs.withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
        rows = hilbert_sharding.shard(sized, ["lang", "source", "size"], "doc_id", "size", shards=4, law=law).collect()
        check_slots(rows)
        assert len(rows) == docs.count()


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 100, 257):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), F.lit(9).cast("long"))).collect()
        assert sorted(r[0] for r in got) == list(range(n))
    got = [r[0] for r in spark.range(100).select(mixing.permuted(F.col("id"), F.lit(100).cast("long"), F.lit(5))).collect()]
    assert got != list(range(100))


def plain_targets(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()) * 1.5, {}, set(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return target


def check_mix(docs, rows):
    words = [len([w for w in (r["text"] or "").replace("\t", " ").replace("\n", " ").split(" ") if w]) for r in docs]
    sizes = Counter()
    for r, n in zip(docs, words):
        sizes[r["source"]] += n
    want = plain_targets(sizes)
    assert sorted(r["size"] for r in rows) == sorted(words)
    source = {r["doc_id"]: r["source"] for r in docs}
    taken = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 * max(1, r["target"])
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_op10_meets_targets_and_repeats(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.op10(spark, sf).collect()
    check_mix(docs, rows)
    again = queries.op10(spark, sf).collect()
    key = lambda r: tuple(r)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_slots_follow_their_shards(spark, sf):
    _, slots, _ = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), block=64, shards=8)
    rows = slots.collect()
    assert len({r["shard"] for r in rows}) == 8
    seen = Counter((r["key"], r["pass"], r["block"]) for r in rows)
    assert set(seen.values()) == {1}  # a pass reads a block once


def test_mixing_awkward_and_empty(awkward, empty_docs):
    documents, slots, pieces = mixing.mix(awkward, block=16)
    taken = mixing.taken_pieces(slots, pieces).groupBy("row").agg(F.sum("words").alias("taken"))
    rows = documents.join(taken, "row", "left").fillna(0, ["taken"]).withColumnRenamed("id", "doc_id").collect()
    check_mix(awkward.collect(), rows)
    assert mixing.mix(empty_docs)[0].count() == 0
    assert mixing.mixed_documents(empty_docs).count() == 0


def test_mixed_documents_hold_the_taken_words(awkward):
    out = mixing.mixed_documents(awkward, block=16)
    assert out.columns == awkward.columns and out.dtypes == awkward.dtypes
    rows, given = out.collect(), {(r["doc_id"], r["text"]) for r in awkward.collect()}
    sizes = Counter()
    for r in awkward.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    want, taken = plain_targets(sizes), Counter()
    whole = 0
    for r in rows:
        taken[r["source"]] += len(r["text"].split())
        whole += (r["doc_id"], r["text"]) in given
        assert r["n_chars"] == len(r["text"]) and any(d == r["doc_id"] for d, _ in given)
    assert whole > len(rows) / 2 and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
