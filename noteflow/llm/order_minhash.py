"""Near-duplicate documents by Order MinHash and banded alignment.

A document's words give k-mers, each labelled with how often it occurred before in the
document.  A sketch is the ``order`` labelled k-mers of smallest hash, kept in text order, so
documents agree in a sketch when they share k-mers in the same order: what an edit-similar
copy does.  A banded alignment of their words decides about documents that agree in a sketch.

Exact copies are first folded into one document.  Of the documents that agree in a sketch each
first meets the smallest one only, so a group of n near copies costs n alignments.  Where a sketch then
still holds several classes, as that of a common passage does, its documents are filed again under two sketches at
a time and meet one document of each of those.  Where it holds several classes even then, every two
documents of different classes meet.  Pairs that their lengths or a bitmap of
their words hold apart are passed over, which loses no link, and the others are aligned.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import discard, small_batches, store

WORDS = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None, known: dict[str, int] | None = None, most: int = 50_000) -> np.ndarray:
    """32-bit hashes of the lower-case words of a text; ``known`` remembers about ``most`` of them."""
    found = WORDS.findall((text or "").lower())
    known = {} if known is None else known
    if len(known) > most:
        known.clear()
    for w in set(found).difference(known):
        known[w] = zlib.crc32(w.encode("utf-8", "replace"))
    return np.fromiter(map(known.__getitem__, found), np.uint32, len(found))


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit value per k-mer and occurrence number; fewer than k words are one k-mer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ words[i:i + n].astype(np.uint64)) * MIX
            h ^= h >> np.uint64(29)
        order = np.argsort(h, kind="stable")
        run = h[order]
        new = np.concatenate([[True], run[1:] != run[:-1]])
        nth = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = nth
        h = (h + occurrence * np.uint64(0xC2B2AE3D27D4EB4F)) * MIX
        return h ^ (h >> np.uint64(32))


def sketch(kmers: np.ndarray, sketches: int, order: int, seed: int = 7) -> np.ndarray:
    """Per sketch, a 64-bit hash of its number and the ``order`` smallest labelled k-mers in text order."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 2**63, sketches, dtype=np.uint64)
    factor = rng.integers(0, 2**63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(sketches, np.uint64)
    if not len(kmers):
        return out
    block = max(1, 2_000_000 // len(kmers))
    with np.errstate(over="ignore"):
        for i in range(0, sketches, block):
            h = (kmers[None] ^ flip[i:i + block, None]) * factor[i:i + block, None]
            rows = np.arange(len(h))
            at = []
            for _ in range(min(order, len(kmers))):
                best = h.argmin(axis=1)
                h[rows, best] = np.uint64(2**64 - 1)
                at.append(best)
            value = np.arange(i, i + len(h), dtype=np.uint64) * MIX + np.uint64(len(at))
            for p in np.sort(np.stack(at), axis=0):
                value = (value ^ kmers[p]) * MIX
                value ^= value >> np.uint64(31)
            out[i:i + block] = value
    return out


def word_bits(words: np.ndarray, longs: int = 8) -> np.ndarray:
    """Bitmap of the words labelled by occurrence: bits one text has and another lacks each cost an edit."""
    bits = np.zeros(longs * 64, np.uint8)
    bits[labelled_kmers(words, 1) % np.uint64(longs * 64)] = 1
    return np.packbits(bits).view(np.int64)


def wide_bits(words: np.ndarray) -> bytes:
    """A bitmap as ``word_bits``, of at least two bits a word: the smallest such power of two."""
    size = max(512, 1 << (2 * len(words) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[labelled_kmers(words, 1) % np.uint64(size)] = 1
    return np.packbits(bits).tobytes()


def wide_lacking(a: bytes, b: bytes) -> int:
    """Bits of the one bitmap that the other lacks, the greater count of both; a longer one is folded to the shorter's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] | y[len(y) // 2:]
    x, y = x.view(np.uint64), y.view(np.uint64)
    return max(int(np.bitwise_count(x & ~y).sum()), int(np.bitwise_count(y & ~x).sum()))


def _places(words: np.ndarray) -> tuple[dict[int, int], dict[int, list[int]]]:
    """Where words are: a bitmap for frequent ones (few, so long texts stay bounded), positions for the rest."""
    masks: dict[int, int] = {}
    places: dict[int, list[int]] = {}
    if len(words) <= 4096:
        for i, w in enumerate(words.tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        return masks, places
    order = np.argsort(words, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(words[order].astype(np.int64)) != 0])
    often = max(16, len(words) // 2048)
    for lo, hi in zip(start.tolist(), np.append(start[1:], len(words)).tolist()):
        at, w = order[lo:hi], int(words[order[lo]])
        if hi - lo > often:
            bits = np.zeros(int(at[-1]) + 1, np.uint8)
            bits[at] = 1
            masks[w] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        else:
            places[w] = at.tolist()
    return masks, places


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences if it is at most ``most``, else ``most`` + 1.

    Bit-parallel dynamic programming over the diagonals -most..most: a column is a pair of
    integers whose bits say where a cell is one above or below the cell over it, and cells
    outside the band count as larger, which cannot change a distance within it.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not len(a) or not len(b):
        return max(len(a), len(b))
    masks, places = _places(a)
    # bit x of the window of column j stands for row j - most + x (row 1 is a[0])
    width = 2 * most + 1
    mask = (1 << width) - 1
    up = mask & ~((1 << (most + 1)) - 1)  # column 0: rows 1..most each one more than the row above
    down = 0
    at_end = most  # value of the window's last cell, row `most` of column 0
    for j, w in enumerate(b.tolist(), 1):
        up, down = up >> 1 | 1 << (width - 1), down >> 1  # the window moves down by a row
        shift = j - most - 1
        if w in masks:
            same = masks[w]
            same = (same >> shift if shift >= 0 else same << -shift) & mask
        else:
            same = 0
            held = places.get(w, ())
            for i in range(bisect_left(held, shift), bisect_right(held, shift + width - 1)):
                same |= 1 << held[i] - shift
        diagonal = (((same & up) + up) ^ up | same | down) & mask
        right_up = down | mask & ~(diagonal | up)
        right_down = diagonal & up
        at_end += not diagonal >> (width - 1) & 1
        right_up = (right_up << 1 | 1) & mask
        right_down = right_down << 1 & mask
        up = right_down | mask & ~(diagonal | right_up)
        down = diagonal & right_up
    # from the last cell of the last column back up to row len(a)
    over = len(b) + most - len(a)
    rows = mask & ~((1 << (width - over)) - 1) if over else 0
    d = at_end - (up & rows).bit_count() + (down & rows).bit_count()
    return min(d, most + 1)


def similarity_at_least(a: np.ndarray, b: np.ndarray, least: float) -> float | None:
    """1 - edit distance / words of the longer text, if at least ``least``; the band widens as needed."""
    longer = max(len(a), len(b))
    if not longer:
        return None
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return None
    sa, sb = np.sort(a), np.sort(b)  # words of one text that the other lacks each cost an edit
    lacking = len(sa) - int((np.minimum(*_counts(sa, sb))).sum())
    if lacking > most:
        return None
    band = min(most, max(8, 2 * lacking))
    while True:
        d = banded_distance(a, b, band)
        if d <= band:
            return 1 - d / longer
        if band == most:
            return None
        band = min(most, band * 4)


def _counts(sa: np.ndarray, sb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each distinct word of sorted ``sa`` is in ``sa`` and in sorted ``sb``."""
    values, counts = np.unique(sa, return_counts=True)
    return counts, np.searchsorted(sb, values, "right") - np.searchsorted(sb, values, "left")


def sketches_of(words: np.ndarray, k: int, sketches: int, order: int, short: int = 6, short_sketches: int = 12) -> np.ndarray:
    """Sketches of a text; one of at most ``short`` words, where an edit may touch most k-mers, also has some of single words."""
    long = sketch(labelled_kmers(words, k), sketches, order)
    if len(words) > short:
        return long
    return np.concatenate([long, sketch(labelled_kmers(words, 1), short_sketches, order, seed=13)])


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, k: int, sketches: int, order: int) -> DataFrame:
    """row, doc_id, key (of the exact text), sketches, bits, words (packed hashes) and n_words of every row."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<sketches:array<bigint>,bits:array<bigint>,words:binary,n_words:int>")
    def sketched(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for texts in parts:
            words = [word_hashes(t, known) for t in texts]
            # the top bit of an unsigned hash is a sign here
            yield pd.DataFrame({"sketches": [sketches_of(w, k, sketches, order).view(np.int64) for w in words], "bits": [word_bits(w) for w in words],
                                "words": [w.tobytes() for w in words], "n_words": [len(w) for w in words]})

    text = F.col(text_col).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("none")).alias("key"), sketched(text).alias("s"))
    return rows.select("row", "doc_id", "key", "s.sketches", "s.bits", "s.words", "s.n_words")


BITS = tuple(f"bits{i}" for i in range(16))


def with_bits(rows: DataFrame, longs: int = 8) -> DataFrame:
    """The bitmap in plain columns, half the bytes of an array in a shuffle."""
    return rows.select(*[c for c in rows.columns if c != "bits"], *[F.get("bits", F.lit(i)).alias(b) for i, b in enumerate(BITS[:longs])])


def room(a: str, b: str, least: float, longs: int = 8) -> Column:
    """Whether lengths and word bitmaps of two texts (columns with the prefixes ``a`` and ``b``) leave room for an alignment of ``least``."""
    longer = F.greatest(f"{a}n_words", f"{b}n_words")
    most = F.floor(F.lit(1 - least) * longer + 1e-9)

    def lacking(x, y):
        return sum((F.bit_count(F.col(x + c).bitwiseAND(F.bitwise_not(F.col(y + c)))) for c in BITS[:longs]), F.lit(0))

    return (F.abs(F.col(f"{a}n_words") - F.col(f"{b}n_words")) <= most) & (lacking(a, b) <= most) & (lacking(b, a) <= most)


def agreed(n_words: Column, long: int) -> Column:
    """In how many sketches two texts must agree: texts of over ``long`` words have so many in common at 0.8 that one alone is chance."""
    return F.when(n_words > long, 2).otherwise(1)


def second_hubs(met: DataFrame, sketched: DataFrame, reach: int = 8) -> DataFrame:
    """row, other: texts of different components that agree in two sketches with a text ``other``.

    ``met`` has value, row and component of the sketches that several components share, ``sketched`` row and
    sketches.  A text is filed under every two such sketches at most ``reach`` places apart.  Texts that agree in
    two are seldom unlike, each pair of sketches has a hub of its own (the smallest mixed hash), and
    a text meets the hubs only, so the pairs grow with the texts and not with the square of a group.
    """
    own = met.groupBy("row").agg(F.collect_set("value").alias("open"), F.first("component").alias("component"))
    rows = own.join(sketched, "row").select("row", "component", F.transform("sketches", lambda x: F.when(F.array_contains("open", x), x)).alias("s"))
    n = F.size("s")
    twos = F.flatten(F.transform("s", lambda x, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(reach), n - 1)), lambda d: F.struct(x.alias("a"), F.get("s", (i + d) % n).alias("b")))))
    filed = rows.select("row", "component", F.explode(F.filter(twos, lambda t: t["a"].isNotNull() & t["b"].isNotNull())).alias("t"))
    filed = filed.select("row", "component", F.xxhash64("t.a", "t.b").alias("key"))
    hubs = filed.groupBy("key").agg(F.min_by(F.struct("row", "component"), F.xxhash64("row", "key")).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    hubs = hubs.filter("lo < hi").select("key", F.col("hub.row").alias("other"), F.col("hub.component").alias("other_component"))
    return filed.join(hubs, "key").filter("component <> other_component").select("row", "other").distinct()


def rare_words(rows: DataFrame, least: float, known: int = 50_000) -> DataFrame:
    """row, key: of every text (row, words) the rarest fifth of its words, at ``least`` 0.8, and one more.

    Texts of n words or more with an alignment of ``least`` share n less the edits allowed, so with their
    words in one order, whatever it is, they share one of these.  The order is rare before frequent over ``rows``,
    of the ``known`` most frequent words; others count as equally rare and are ordered by hash.
    """
    @F.pandas_udf("array<bigint>")
    def labelled(words: pd.Series) -> pd.Series:
        return pd.Series([labelled_kmers(np.frombuffer(w, np.uint32), 1).view(np.int64) for w in words])

    counts = rows.select(F.explode(labelled("words")).alias("word")).groupBy("word").count()
    often = counts.filter("count > 1").orderBy(F.desc("count"), "word").limit(known).collect()  # bounded by ``known``
    often = np.array(sorted((r["word"], r["count"]) for r in often), np.int64).reshape(-1, 2)
    shared = rows.sparkSession.sparkContext.broadcast((often[:, 0].copy(), often[:, 1].copy()))

    @F.pandas_udf("array<bigint>")
    def rarest(words: pd.Series) -> pd.Series:
        values, n = shared.value
        out = []
        for w in words:
            own = labelled_kmers(np.frombuffer(w, np.uint32), 1).view(np.int64)
            count = np.zeros(len(own), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                count = np.where(values[at] == own, n[at], 0)
            out.append(own[np.lexsort((own, count))[:int((1 - least) * len(own) + 1e-9) + 1]])
        return pd.Series(out)

    return rows.select("row", F.explode(rarest("words")).alias("key"))


def across(filed: DataFrame, made: DataFrame, least: float, side: int = 2048) -> DataFrame:
    """row, other: every two texts of one key whose components differ and that have ``room`` for an alignment.

    ``filed`` has key, row and component, ``made`` row, n_words and words.  The texts of a key are cut into blocks of about ``side``, each of which meets all
    texts of the key, so no task holds a whole key; a large component has blocks of its own, which its own texts pass by.
    """
    held = filed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    several = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    filed = store(filed.join(several, "key"), "filed")
    need = filed.select("row").distinct()

    @F.pandas_udf("struct<bits:array<bigint>,wide:binary>")
    def bitmaps(words: pd.Series) -> pd.DataFrame:
        words = [np.frombuffer(w, np.uint32) for w in words]
        return pd.DataFrame({"bits": [word_bits(w, len(BITS)) for w in words], "wide": [wide_bits(w) for w in words]})

    # longer bitmaps than the hubs' ones, as most pairs are unlike here
    maps = store(made.select("row", "n_words", "words").join(need, "row").select("row", "n_words", bitmaps("words").alias("b")).select("row", "n_words", "b.bits", "b.wide"), "maps")
    texts = with_bits(maps.select("row", "n_words", "bits"), len(BITS))
    held = filed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    held = held.select("key", "component", F.when(F.col("n") >= side // 8, F.col("component")).otherwise(-1).alias("owner"), "n")
    parts = held.groupBy("key", "owner").agg(F.ceil(F.sum("n") / side).alias("parts"))
    left = filed.join(held.join(parts, ["key", "owner"]).select("key", "component", "owner", "parts"), ["key", "component"])
    left = left.withColumn("part", F.pmod(F.xxhash64("row"), "parts")).drop("parts").join(texts, "row")
    blocks = parts.select("key", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = filed.join(blocks, "key").filter("owner <> component").join(texts, "row")
    right = right.select("key", "owner", "part", *[F.col(c).alias("other" if c == "row" else f"o_{c}") for c in ["component", *texts.columns]])
    met = left.join(right, ["key", "owner", "part"]).filter("row < other and component <> o_component")
    roomy = store(met.filter(room("", "o_", least, len(BITS))).select("row", "other").distinct(), "roomy")

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([wide_lacking(x, y) <= int((1 - least) * max(i, j) + 1e-9) for x, y, i, j in zip(a, b, n, m)], dtype=bool)

    wide = maps.select("row", "n_words", "wide")
    both = roomy.join(wide, "row").join(wide.select(*[F.col(c).alias("other" if c == "row" else f"o_{c}") for c in wide.columns]), "other")
    out = store(both.filter(near("wide", "o_wide", "n_words", "o_n_words")).select("row", "other"), "across")
    discard(filed, maps, roomy)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, least: float = 0.8, sketches: int = 48, order: int = 2,
                    long: int = 64, group: int = 16_384) -> DataFrame:
    """doc_id, key, class_id, kept for every row.

    class_id is the smallest id of the row's class: rows joined by equal texts or by candidate
    pairs whose words align with a similarity of ``least`` or more.  ``kept`` holds for one row
    of each class: one with the smallest id (an id before null).  ``key`` tells texts apart.
    A text is compared with the smallest one of each sketch (of over ``long`` words: if they agree in two such
    sketches), and where that leaves several classes in a sketch, with one text of every two sketches it shares with
    others.  Where several classes are left even then, all texts of different ones are compared: those of one sketch, or
    in sketches of over ``group`` texts those that share one of their rarest words, as every two alike do.  So
    texts that agree in any sketch are in one class if they align.  Two texts with an alignment of 0.8 agree in a sketch
    with a probability of over 0.99, also if their edits are spread evenly.

    Null texts form one class, empty ones another; a text without words is only like its exact
    copies, one with fewer than ``k`` words is one k-mer.  Repeated rows are exact copies, one
    of which is kept.  An empty table gives an empty result; other columns are not read.
    """
    made = store(sketch_documents(docs, id_col, text_col, k, sketches, order), "sketches")
    plain = made.select("row", "doc_id", "key", "n_words")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    copies = store(plain.groupBy("key").agg(F.min(first).alias("first"), F.max("n_words").alias("n_words")).select(
        "key", F.col("first.row").alias("row"), "first", "n_words"), "copies")
    some = copies.filter("n_words > 0").select("row", "n_words")
    # one row per text and sketch; sketches met once go before the join
    met = made.select("row", "sketches").join(some, "row").select("row", F.explode("sketches").alias("value"))
    least_row = met.groupBy("value").agg(F.min("row").alias("least"), F.max("row").alias("most")).filter("least < most").drop("most")
    shared = store(met.join(least_row, "value"), "shared")
    texts = with_bits(made.select("row", "n_words", "bits"))
    others = texts.select(*[F.col(c).alias("other" if c == "row" else f"o_{c}") for c in texts.columns])
    hubs = shared.filter("row <> least").groupBy("row", F.col("least").alias("other")).agg(F.count(F.lit(1)).alias("agree")).join(texts, "row")
    hubs = hubs.filter(F.col("agree") >= agreed(F.col("n_words"), long)).join(others, "other")
    pairs = store(hubs.filter(room("", "o_", least)).select("row", "other"), "pairs")

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity_at_least(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) for x, y in zip(a, b)], dtype=float)

    def linked(pairs: DataFrame) -> DataFrame:
        """row, other of the pairs whose words align."""
        # the same plan at every size: pairs are few in a small table, but not in a large one
        words = made.select("row", "words").hint("merge")
        both = pairs.join(words, "row").join(words.select(F.col("row").alias("other"), F.col("words").alias("other_words")), "other")
        links = both.select("row", "other", similarity("words", "other_words").alias("similarity")).filter("similarity is not null and not isnan(similarity)")
        return store(links.select("row", "other"), "links")

    def merged(at: DataFrame, links: DataFrame) -> DataFrame:
        """The components of texts once ``links`` join them."""
        component = at.select("row", "component")
        ends = links.join(component, "row").join(component.select(F.col("row").alias("other"), F.col("component").alias("to")), "other").select("component", "to")
        joined = components(ends, "component", "to").select(F.col("node").alias("component"), F.col("component").alias("whole"))
        return store(component.join(joined, "component", "left").select("row", F.coalesce("whole", "component").alias("component")), "texts")

    links = linked(pairs)
    classes = components(links, "row", "other").withColumnRenamed("node", "row")
    at = store(some.join(classes, "row", "left").withColumn("component", F.coalesce("component", "row")), "texts")
    # texts whose hub was unlike them meet the hubs of two sketches
    met = shared.select("value", "row").join(at.select("row", "component"), "row")
    mixed = met.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("value")
    mixed = store(met.join(mixed, "value"), "mixed")
    discard(shared, pairs, links)
    again = second_hubs(mixed, made.select("row", "sketches")).join(texts, "row").join(others, "other")
    near = store(again.filter(room("", "o_", least)).select("row", "other"), "near")
    rest = linked(near)
    first_at, at = at, merged(at, rest)
    # what is left of those sketches is compared without hubs
    met = mixed.select("value", "row").join(at.select("row", "component"), "row")
    sizes = met.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("value", "n")
    met = store(met.join(sizes, "value"), "open")
    discard(mixed)
    filed = met.filter(F.col("n") <= group).select(F.col("value").alias("key"), "row", "component")
    crowd = met.filter(F.col("n") > group).select("row", "component").distinct()
    if not crowd.isEmpty():
        rare = rare_words(made.select("row", "words").join(crowd.select("row"), "row"), least)
        filed = filed.union(rare.join(crowd, "row").select("key", "row", "component"))
    wide = across(filed, made, least)
    last = linked(wide)
    classes = merged(at, last)
    # the first row of every text finds its class, the class its first row, then texts hand both to their copies
    classed = copies.join(classes, "row", "left").withColumn("component", F.coalesce("component", "row"))
    heads = classed.groupBy("component").agg(F.min("first").alias("head"))
    classed = classed.select("key", "component").join(heads, "component").select("key", "head")
    out = plain.join(classed, "key").select("doc_id", "key", F.col("head.doc_id").alias("class_id"), (F.col("row") == F.col("head.row")).alias("kept"))
    out = store(out, "classes")
    discard(made, copies, first_at, at, near, rest, met, wide, last, classes)
    return out
