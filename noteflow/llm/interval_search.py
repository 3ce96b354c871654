"""Ranked lexical search with range-maximum tables over posting lists.

Documents are dealt into blocks.  Inside a block every posting list of a query term has a sparse
table that tells the posting of largest impact in any range.  A query starts with the block as
one interval whose bound is the sum of its terms' range maxima; the intervals of largest bound
are opened first, split at the document of the largest impact (which is scored), and small ones are
scored whole.  Intervals bound below the k-th score found are never opened.

Documents of a block lie by length, so impacts, which fall with it, are alike in an interval.
The answers of the blocks are merged by a ranked window.  All scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import number_rows, small_batches, store

#: ASCII letters and digits and all bytes of other characters stay, A-Z becomes a-z, the rest separates terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_in(text: bytes | None, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time so that a very long text is never one list."""
    text = (text or b"").translate(FOLD)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + piece)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def count_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """row, id, n (terms of the text), terms (numbers in ``vocabulary``) and tfs of every row."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            n, ends, terms, tfs = [], [0], [], []
            for text in batch.column("text").to_pylist():
                total, found = 0, Counter()
                for words in terms_in(text):
                    total += len(words)
                    found.update(map(number, words))
                found.pop(None, None)
                n.append(total)
                terms.extend(found.keys())
                tfs.extend(found.values())
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["row", "id", "n", "terms", "tfs"])

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(counted, f"row bigint, id {kind}, n bigint, terms array<int>, tfs array<bigint>")


class Block:
    """Posting lists of some documents, each with a sparse table of range maxima."""

    def __init__(self, n: np.ndarray, by_id: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weight: np.ndarray, docs: int, length: int) -> None:
        """``by_id``: place of each document in the order of ties; ``weight``: of each term; ``docs`` and ``length``: of the whole table."""
        self.order = np.lexsort((by_id, n))  # document at each position
        self.n, self.by_id = n[self.order], by_id[self.order]
        self.width = len(n) + 1
        place = np.empty(len(n), np.int64)
        place[self.order] = np.arange(len(n))
        owner = np.repeat(np.arange(len(n)), np.diff(ends))
        m = 50 + (50 * n * docs) // max(length, 1)
        impact = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[owner]))
        key = terms.astype(np.int64) * self.width + place[owner]
        at = np.argsort(key)
        self.key, self.impact, self.position = key[at], impact[at], place[owner][at]
        longest = int(np.bincount(terms).max()) if len(terms) else 0
        # table[j][i]: the posting of largest impact (the first of equals) among the 2^j from i on
        self.table = [np.arange(len(at), dtype=np.int32)]
        while 2 << len(self.table) - 1 <= longest:
            last, half = self.table[-1], 1 << len(self.table) - 1
            right = np.concatenate([last[half:], last[len(last) - half:]])
            self.table.append(np.where(self.impact[right] > self.impact[last], right, last))

    def largest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The posting of largest impact in each range a..b - 1, -1 where it is empty."""
        out = np.full(a.shape, -1, np.int64)
        size = b - a
        level = np.frexp(np.maximum(size, 1))[1] - 1
        for j in np.unique(level[size > 0]):
            here = (level == j) & (size > 0)
            x, y = self.table[j][a[here]], self.table[j][b[here] - (1 << int(j))]
            out[here] = np.where(self.impact[y] > self.impact[x], y, x)
        return out

    def search(self, terms: np.ndarray, k: int, leaf: int = 256, at_once: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the best ``k`` documents with a score above 0, best first, ties by ``by_id``."""
        first = np.searchsorted(self.key, terms * self.width)
        last = np.searchsorted(self.key, (terms + 1) * self.width)
        some = last > first
        terms, first, last = terms[some], first[some], last[some]
        best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return best_at, best

        def bound(a, b):
            top = self.largest(a, b)
            value = np.where(top >= 0, self.impact[top], 0)
            lead = value.argmax(axis=1)
            return value.sum(axis=1), self.position[top[np.arange(len(top)), lead]]

        lo, hi = np.zeros(1, np.int64), np.full(1, self.width - 1, np.int64)
        a, b = first[None], last[None]
        high, cut = bound(a, b)
        while len(lo):
            # an interval that could only repeat the k-th score counts if it may hold a document before the k-th
            if len(best) == k:
                tied = (high == best[-1]) & ((self.n[lo] != self.n[hi - 1]) | (self.by_id[lo] < self.by_id[best_at[-1]]))
                useful = (high > best[-1]) | tied
            else:
                useful = high > 0
            lo, hi, a, b, high, cut = (x[useful] for x in (lo, hi, a, b, high, cut))
            if not len(lo):
                break
            pick = np.argsort(-high, kind="stable")[:at_once]
            rest = np.ones(len(lo), bool)
            rest[pick] = False
            small = pick[hi[pick] - lo[pick] <= leaf]
            large = pick[hi[pick] - lo[pick] > leaf]
            found_at, found = [best_at], [best]
            if len(small):
                fa, fb = a[small].ravel(), b[small].ravel()
                size = fb - fa
                postings = np.repeat(fa - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                where, slot = np.unique(self.position[postings], return_inverse=True)
                score = np.zeros(len(where), np.int64)
                np.add.at(score, slot, self.impact[postings])
                found_at.append(where)
                found.append(score)
            keep = [(lo[rest], hi[rest], a[rest], b[rest], high[rest], cut[rest])]
            if len(large):
                d = cut[large]
                p = np.searchsorted(self.key, terms[None] * self.width + d[:, None])
                inside = np.minimum(p, len(self.key) - 1)
                hit = (self.key[inside] == terms[None] * self.width + d[:, None]) & (p < len(self.key))
                found_at.append(d)
                found.append(np.where(hit, self.impact[inside], 0).sum(axis=1))
                for l2, h2, a2, b2 in ((lo[large], d, a[large], p), (d + 1, hi[large], p + hit, b[large])):
                    some = h2 > l2
                    if some.any():
                        v, c = bound(a2[some], b2[some])
                        keep.append((l2[some], h2[some], a2[some], b2[some], v, c))
            best_at, best = np.concatenate(found_at), np.concatenate(found)
            order = np.lexsort((self.by_id[best_at], -best))[:k]
            best_at, best = best_at[order], best[order]
            lo, hi, a, b, high, cut = (np.concatenate(x) for x in zip(*keep))
        return best_at, best


def answer(docs: pa.Table, items: pa.Table, weight: np.ndarray, n_docs: int, length: int, k: int) -> pa.Table:
    """item, id, score: each item's best documents of one block."""
    ids = docs.column("id").combine_chunks()
    by_id = np.empty(len(ids), np.int64)
    by_id[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    lists, tfs = docs.column("terms").combine_chunks(), docs.column("tfs").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
    block = Block(docs.column("n").to_numpy(), by_id, ends, lists.flatten().to_numpy(), tfs.flatten().to_numpy(), weight, n_docs, length)
    out_items, out_at, out_scores = [], [], []
    for item, terms in zip(items.column("item").to_pylist(), items.column("terms").to_pylist()):
        at, scores = block.search(np.array(terms, np.int64), k)
        out_items.append(np.full(len(at), item, np.int64))
        out_at.append(block.order[at])
        out_scores.append(scores)
    taken = np.concatenate([np.zeros(0, np.int64), *out_at]).astype(np.int64)
    return pa.table({"item": np.concatenate([np.zeros(0, np.int64), *out_items]).astype(np.int64), "id": ids.take(pa.array(taken)),
                     "score": np.concatenate([np.zeros(0, np.int64), *out_scores]).astype(np.int64)})


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", k: int = 50,
           block_bytes: int = 8 << 20, block_docs: int = 1 << 14, block_postings: int = 1 << 20) -> DataFrame:
    """item_col, rank, id_col, score: each item's ``k`` documents of highest score above 0, ties by id (null last).

    Items come in blocks of at most ``block_bytes`` of text (and one text more), so the vocabulary
    that the Python workers hold is bounded; each block is one pass over the documents.  Documents are dealt
    at random into blocks of about ``block_docs`` documents or ``block_postings`` postings.

    Null and empty texts have no term: such documents are not counted and never found, such
    items have no answer.  Rows of items that agree in id and text are one item; other rows of one id
    are answered one by one.  Repeated documents are documents of their own.  Empty tables give
    an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").distinct()
    asked = number_rows(asked.withColumn("size", F.octet_length("text")), [F.col("id"), F.col("text")], "item", "size", "before")
    asked = store(asked.select("item", "id", "text", F.floor(F.col("before") / block_bytes).cast("int").alias("part")), "items")
    parts = asked.agg(F.max("part")).first()[0]
    found = None
    for part in range(0 if parts is None else parts + 1):
        one = _search_part(docs, asked.filter(F.col("part") == part), id_col, text_col, kind, k, block_docs, block_postings)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], f"item bigint, id {kind}, score bigint")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    names = asked.select("item", F.col("id").alias("asked"))
    return best.join(names, "item").select(F.col("asked").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_part(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, kind: str, k: int, block_docs: int, block_postings: int) -> DataFrame:
    spark = docs.sparkSession

    @F.udf("array<binary>", useArrow=False)
    def words(text):
        return list({w for some in terms_in(text) for w in some})

    split = store(items.select("item", words(F.col("text").cast("binary")).alias("words")), "words")
    vocabulary = {bytes(r[0]): i for i, r in enumerate(sorted(split.select(F.explode("words")).distinct().collect()))}
    known = spark.sparkContext.broadcast(vocabulary)
    counted = store(count_terms(docs, id_col, text_col, vocabulary), "counted")
    total = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n"), F.sum(F.size("terms")), F.count(F.when(F.size("terms") > 0, 1))).first()
    n_docs, length, postings, some = (v or 0 for v in total)
    weight = np.zeros(len(vocabulary) + 1, np.int64)
    # one row per term of the bounded vocabulary
    for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    blocks = max(1, math.ceil(some / block_docs), math.ceil(postings / block_postings))

    @F.udf("array<int>", useArrow=False)
    def numbers(found):
        return [known.value[bytes(w)] for w in found]

    dealt = counted.filter(F.size("terms") > 0).select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "id", "n", "terms", "tfs")
    # the stated query set meets every block
    every = split.select("item", numbers("words").alias("terms")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        return answer(left, right, weight, n_docs, length, k)

    return dealt.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(work, f"item bigint, id {kind}, score bigint")
