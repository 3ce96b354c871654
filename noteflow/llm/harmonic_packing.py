"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Pieces are sorted into classes by the reciprocal of the capacity C: class k holds lengths from
C/(k+1) (not included) up to C/k, and every sequence of class k takes exactly k pieces.  Which
sequence a piece goes to follows from its number within the class alone, and the number is the
count of the class's pieces on earlier workers plus its number on its own worker, so workers
fill sequences independently.

A length just above C/(k+1) would waste up to 1/(k+1) of its sequence, so documents are cut:
while a rest wastes more than ``waste`` of its share, its first C/k tokens (k from rounding up)
become a piece of their own.  What each class leaves in its one unfilled sequence, at most
k - 1 pieces a class whatever the input, is packed together at the end.
"""

from __future__ import annotations

import array
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import small_batches, store

END = 1
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
SIGNS = re.compile(r"[!-&(-/:-@\[-`{-~]+$")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class CachedEncoder:
    """Token ids of texts as little-endian 32-bit bytes, with a memory of words.

    The vocabulary's rules never join ids across ASCII white space, and split ASCII words
    further into letters, digits and signs, so those parts are encoded once and remembered.
    Texts with other white space or the special tokens' strings are encoded as a whole.
    """

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.words, self.parts, self.most = Tokenizer.from_file(path), {}, {}, most
        # the same vocabulary and merges for parts that are cut and lower-cased already
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        levels = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        rules |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, levels]}}
        self.merger = Tokenizer.from_str(json.dumps(rules))
        self.old_words, self.old_parts = {}, {}  # full memories are kept until the new ones are full
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that close a part
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def line(self, parts: list[str], merger=None) -> list[bytes]:
        """Ids of many parts by one call: a part's last id tells where it ends.  ``merger`` takes parts as ``split`` makes them."""
        lines = [" ".join(parts[i:i + 64]) for i in range(0, len(parts), 64)]
        ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in (merger or self.tokenizer).encode_batch_fast(lines, add_special_tokens=False)]])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(parts):  # a part that is split further
            return self.direct(parts)
        packed, at = ids.tobytes(), [0, *(stops * 4).tolist()]
        return [packed[a:b] for a, b in zip(at, at[1:])]

    @classmethod
    def split(cls, word: str) -> list[str]:
        """Parts of a word between white space that no rule joins."""
        if word.isascii():
            return [word.lower()] if word.isalpha() else PARTS.findall(word.lower())
        return [cls.lower(word)] if word.isalpha() else cls.without_signs(word)

    @staticmethod
    def lower(part: str) -> str:
        """A part in lower case, if it is of letters that have one character each in it."""
        return part.lower() if LATIN.fullmatch(part) else part

    @staticmethod
    def without_signs(word: str) -> list[str]:
        """A word and the ASCII signs behind its last letter, which are a part of their own."""
        m = SIGNS.search(word)
        if m and m.start() and (last := word[m.start() - 1]).isalpha() and len(last.lower()) == 1:
            return [CachedEncoder.lower(word[:m.start()]), m[0]]
        return [word]  # a letter whose lower case ends in a mark takes the signs with it

    def learn(self, words: list[str]) -> None:
        if len(self.words) > self.most:
            self.old_words, self.words = self.words, {}
        if len(self.parts) > self.most:
            self.old_parts, self.parts = self.parts, {}
        words_known, parts_known, old_words, old_parts = self.words, self.parts, self.old_words, self.old_parts
        words_known.update([(w, old_words[w]) for w in words if w in old_words])
        # most new words are one part, and few of those are met again in another case
        one = [w for w in words if w not in words_known and LATIN.fullmatch(w)]
        words_known.update(zip(one, self.line([w.lower() for w in one], self.merger)))
        split = {w: self.split(w) for w in words if w not in words_known}
        new = {p for parts in split.values() for p in parts}.difference(parts_known)
        parts_known.update((p, old_parts[p]) for p in new if p in old_parts)
        new = new.difference(old_parts)
        cut = [p for p in new if p.isascii() or LATIN.fullmatch(p)]
        parts_known.update(zip(cut, self.line(cut, self.merger)))
        new = new.difference(cut)
        plain = [p for p in new if p.isalpha()]
        parts_known.update(zip(plain, self.line(plain)))
        rest = list(new.difference(plain))
        parts_known.update(zip(rest, self.direct(rest)))
        words_known.update((w, b"".join([parts_known[p] for p in parts])) for w, parts in split.items())

    def encode(self, texts: list[str], at_once: int = 64) -> Iterator[bytes]:
        """Ids of each text; the words of some texts are looked up, and new ones encoded, together."""
        for i in range(0, len(texts), at_once):
            some = texts[i:i + at_once]
            words = [None if "<|" in t or ODD_SPACE.search(t) else t.split() for t in some]
            distinct = set().union(*[w for w in words if w])
            if missing := distinct.difference(self.words):
                # a memory that is full is replaced, and then lacks all words of these texts
                self.learn(list(distinct if len(self.words) > self.most else missing))
            known = self.words
            for t, w in zip(some, words):
                yield self.direct([t])[0] if w is None else b"".join([known[x] for x in w])


_kept: dict[tuple[str, int], CachedEncoder] = {}


def encoder(path: str, remember: int, keep: bool) -> CachedEncoder:
    """A new encoder, or with ``keep`` the one this process already has."""
    if not keep:
        return CachedEncoder(path, remember)
    if (path, remember) not in _kept:
        _kept[path, remember] = CachedEncoder(path, remember)
    return _kept[path, remember]


def cuts(length: int, capacity: int, waste: float = 0.02, floor: int = 16) -> list[tuple[int, int]]:
    """Pieces (length, class) of a document of ``length`` tokens, in order.

    A rest is kept whole once it fills all but ``waste`` of its share of a sequence or is below
    capacity / floor, where the class bounds lie so close that little can be wasted.
    """
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if rest * k >= capacity * (1 - waste) or rest * floor < capacity:
            out.append((rest, k))
            break
        out.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return out


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The first bin with room for each length, in order, and the offset there; a tree of the largest room finds it."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        at = 1
        while at < leaves:
            at = 2 * at if room[2 * at] >= n else 2 * at + 1
        bins.append(at - leaves)
        offsets.append(capacity - room[at])
        room[at] -= n
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins, offsets


def tokenize(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = 2048, remember: int = 200_000, keep: bool = True,
             digest: bool = False) -> DataFrame:
    """Pieces of every document: row, id_col, start, length, ids (little-endian 32-bit), doc_tokens, class.

    With ``digest`` the unsigned CRC-32 of the ids is given as ids_crc32 in place of the ids.

    ``row`` tells repeated rows apart.  A null or empty text is the end token alone.  A worker
    holds the ids of about twice ``remember`` words, with ``keep`` for its later tasks too; more
    memory saves time, the ids are the same.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    given, given_type = ("ids_crc32", "bigint") if digest else ("ids", "binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, end = encoder(tokenizer, remember, keep), array.array("I", [END]).tobytes()
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("row", "id", "start", "length", given, "doc_tokens", "class")}
            for row, i, ids in zip(b["row"].tolist(), b["id"].tolist(), known.encode([t or "" for t in b["text"]])):
                ids += end
                at, total = 0, len(ids) // 4
                for n, k in cuts(total, capacity):
                    piece = ids[at * 4:(at + n) * 4]
                    for c, v in zip(out, (row, i, at, n, crc(piece) if digest else piece, total, k)):
                        out[c].append(v)
                    at += n
            for at in range(0, len(out["row"]), 2000):
                yield pd.DataFrame({c: v[at:at + 2000] for c, v in out.items()})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    pieces = rows.mapInPandas(run, f"row bigint, id {kind}, start bigint, length bigint, {given} {given_type}, doc_tokens bigint, class bigint")
    return pieces.withColumnRenamed("id", id_col)


def place(pieces: DataFrame, capacity: int = 2048, order: tuple = ("row", "start")) -> DataFrame:
    """Add sequence_id and offset to pieces (columns length, class and ``order``); ``ids`` and others are kept.

    The pieces are written once.  A piece's number in its class is the class's count on earlier
    workers (counts per worker and class, a few rows each) plus its number on its own.  Only the
    unfilled last sequence of each class, together fewer pieces than the class numbers' sum,
    is gathered: those go into shared sequences by first fit, longest first.
    """
    made = store(pieces.withColumn("_worker", F.spark_partition_id()), "pieces")
    light = [c for c in made.columns if c not in ("_worker", "class", "ids")]
    narrow = made.select("_worker", "class", *light)
    counts = narrow.groupBy("class", "_worker").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("class").orderBy("_worker").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("class")
    offsets = counts.select("class", "_worker", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.sum("_n").over(whole).alias("_all"))
    # sequences of a class follow those of smaller classes; one row per class
    bases = counts.groupBy("class").agg(F.sum("_n").alias("_all")).select(
        "class", F.coalesce(F.sum(F.expr("_all div class")).over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    offsets = offsets.join(F.broadcast(bases), "class")
    inside = Window.partitionBy("class", "_worker").orderBy(*order)
    at = F.col("_n0") + F.row_number().over(inside) - 1
    spot = narrow.join(offsets, ["class", "_worker"]).withColumn("_at", at)
    full = F.col("_at") < F.expr("_all div class") * F.col("class")
    spot = spot.withColumn("_full", full)
    grouped = Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    done = spot.filter("_full").withColumn("sequence_id", F.col("_base") + F.expr("_at div class")).withColumn(
        "offset", F.coalesce(F.sum("length").over(grouped), F.lit(0)))
    tail = spot.filter("not _full").select(*light)
    kinds = dict(tail.dtypes)

    def fit(_: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["length", *order], ascending=[False] + [True] * len(order)).reset_index(drop=True)
        t["k"], t["offset"] = first_fit(t["length"].tolist(), capacity)
        return t[[*order, "k", "offset"]]

    rest = tail.select("length", *order).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fit, ", ".join(f"{c} {kinds[c]}" for c in order) + ", k bigint, offset bigint")
    filled = counts.groupBy("class").agg(F.sum("_n").alias("_all")).agg(F.coalesce(F.sum(F.expr("_all div class")), F.lit(0)).cast("long").alias("_end"))
    rest = rest.crossJoin(F.broadcast(filled)).select(*order, (F.col("_end") + F.col("k")).alias("sequence_id"), "offset")  # one row
    placed = done.select(*light, "sequence_id", "offset").unionByName(tail.join(rest, list(order)).select(*light, "sequence_id", "offset"))
    if "ids" not in made.columns:
        return placed
    # only the ids were left behind
    return made.select(*order, "ids").join(placed, list(order)).select(*[c for c in made.columns if c not in ("_worker", "class")], "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048) -> DataFrame:
    """Every token of every document in exactly one piece, every piece in one sequence.

    Columns row, id_col, start, length, ids, doc_tokens, sequence_id, offset.  Null and empty
    texts are the end token; long texts fill whole sequences; repeated rows are packed as rows
    of their own; an empty table gives no piece.  Other columns of ``docs`` are not read.
    """
    return place(tokenize(docs, id_col, text_col, tokenizer, capacity), capacity)


def sequences(packed: DataFrame, capacity: int = 2048, pad: int = 0) -> DataFrame:
    """Training rows: sequence_id and ``tokens``, its pieces' ids in order padded to the capacity (binary, 32-bit)."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # at most `capacity` ids

    @F.pandas_udf("binary")
    def joined(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fill = np.array([pad], "<u4").tobytes()
        for part in parts:
            ids = [b"".join(bytes(x["ids"]) for x in p) for p in part]
            yield pd.Series([i + fill * (capacity - len(i) // 4) for i in ids])

    return rows.select("sequence_id", joined("p").alias("tokens"))


def crc(ids: bytes) -> int:
    """Unsigned CRC-32 of packed ids."""
    return zlib.crc32(ids)
