"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, word pairs, word triples and pairs with
one word between.  The learner keeps two sums per coordinate; a coordinate's rate falls with
its own gradients and the L1 term holds it at zero until its evidence is large enough, so the
model is a short list of (coordinate, weight).
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

BITS = 20
WORDS = re.compile(r"\w+")
MULT = np.uint64(0x9E3779B97F4A7C15)  # odd multipliers that keep the four kinds apart
ODD = [np.uint64(k) for k in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class Hasher:
    """Word hashes with a memory of recent words, emptied when it grows large."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        known, found = self.known, WORDS.findall(text.lower())
        if len(known) > 50_000:
            known.clear()
        for w in set(found).difference(known):
            b = w.encode("utf-8", "replace")
            known[w] = zlib.crc32(b) | (zlib.adler32(b) & 0x7FFFFFFF) << 32
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def features(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Coordinates of words, pairs, triples and skip pairs of a word-hash sequence, with repeats."""
    shift = np.uint64(64 - bits)
    kinds = [h * MULT]
    with np.errstate(over="ignore"):
        if len(h) > 1:
            kinds.append((h[:-1] * ODD[0] + h[1:]) * MULT)
        if len(h) > 2:
            kinds.append(((h[:-2] * ODD[1] + h[1:-1]) * ODD[0] + h[2:]) * MULT)
            kinds.append((h[:-2] * ODD[2] + h[2:]) * MULT)
    return (np.concatenate(kinds) >> shift).astype(np.int32)


@dataclass
class Weights:
    """The non-zero coordinates of a model."""

    index: np.ndarray
    value: np.ndarray
    bias: float
    bits: int = BITS

    def table(self) -> np.ndarray:
        t = np.zeros(1 << self.bits, np.float32)
        t[self.index] = self.value
        return t


def fit(rows: list[np.ndarray], labels: np.ndarray, passes: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 1.0,
        positive: float = 1.0, bits: int = BITS, seed: int = 11) -> Weights:
    """FTRL-proximal over the given feature rows, in a shuffled order per pass; label 1 counts ``positive`` times."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)

    def weight(zi, ni):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) > l1, w, 0.0)

    def bias() -> float:  # without L1
        return -zb / ((beta + nb**0.5) / alpha + 1e-3)

    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            zi, ni = z[x], n[x]
            w = weight(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias(), -30, 30)))
            g = (p - labels[i]) * (positive if labels[i] else 1.0)
            grown = ni + g * g
            z[x] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[x] = grown
            b = bias()
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    w = weight(z, n)
    index = np.flatnonzero(w)
    return Weights(index.astype(np.int32), w[index].astype(np.float32), float(bias()), bits)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = 9_000, **options) -> Weights:
    """Fit on a bounded sample of ``labels``: about ``max_rows`` rows, a third of them at most with label 1, whole texts.

    Of each label the rows with the smallest hash of the id are taken, and the bias is shifted
    back by the two rates.  The sample of ids (never over twice ``max_rows``) is broadcast to the documents, whose texts
    are hashed to coordinates where they lie.  Rows with a null id, text or label are not used;
    without any row the model has no weight and a zero bias.
    """
    small_batches(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("id"), (F.col(label_col).cast("int") > 0).cast("int").alias("y")).filter("id is not null and y is not null")
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    space = 1 << 20
    most = {1: max_rows // 3, 0: max_rows - max_rows // 3}
    cut = {y: min(space, int(space * most[y] / n) + 1) for y, n in counts.items()}
    taken = F.coalesce(*[F.when(F.col("y") == y, F.lit(c)) for y, c in cut.items()]) if cut else F.lit(0)
    marks = marks.filter(F.pmod(F.xxhash64("id"), F.lit(space)) < taken).limit(2 * max_rows)

    @F.pandas_udf("binary")
    def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for texts in parts:
            yield pd.Series([np.unique(features(hasher.words(t))).tobytes() for t in texts], dtype=object)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(marks), "id").select("id", "y", hashed("text").alias("x")).limit(4 * max_rows)
    got = rows.collect()
    got.sort(key=lambda r: (r["id"], r["y"], len(r["x"])))
    model = fit([np.frombuffer(r["x"], np.int32) for r in got], np.array([r["y"] for r in got]), **options)
    if len(cut) == 2:  # the labels were drawn at two rates: shift the odds back
        model.bias += math.log(cut[0] / cut[1])
    return model


def score_texts(texts: pd.Series, table: np.ndarray, bias: float, bits: int, hasher: Hasher) -> np.ndarray:
    """Probability of the label for each text; null counts as empty."""
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        x = features(hasher.words(t), bits) if t else np.zeros(0, np.int32)
        x = x[table[x] != 0]
        out[i] = table[np.unique(x)].sum(dtype=np.float64) + bias
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def scorer(model: Weights):
    """Column function text -> score in 0..1, over whole texts."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, hasher = model.table(), Hasher()
        for texts in parts:
            yield pd.Series(score_texts(texts, table, model.bias, model.bits, hasher))

    return scored


def score(docs: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score of every row.

    A null or empty text has the score of the bias alone.  Repeated rows give equal rows, an
    empty table an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), scorer(model)(F.col(text_col).cast("string")).alias("score"))
