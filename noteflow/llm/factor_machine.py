"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

A text's features are the hashes of its distinct words, one bin per structure statistic (shares of
capitals, symbols, repeated lines ...) and the given metadata.  Each feature has a weight and a
short vector; two features add the product of their vectors, all pairs of a text together in linear
time: half of (sum of vectors)^2 - (sum of squared vectors).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .interval_search import terms_in
from .storage import small_batches

WORDS = 1 << 16  # coordinates of hashed words
BINS = 32
STATISTICS = 14
METADATA = 1 << 10
SIZE = WORDS + STATISTICS * BINS + METADATA
SYMBOLS = b"#$%&*@|~^_=+<>{}[]\\/"
KINDS = [np.array([chr(c).isupper() and c < 128 for c in range(256)]), np.array([97 <= c <= 122 for c in range(256)]), np.array([48 <= c <= 57 for c in range(256)]),
         np.array([c in b" \t\r\x0b\x0c" for c in range(256)]), np.array([c == 10 for c in range(256)]), np.array([c in SYMBOLS for c in range(256)]),
         np.array([c in b"!?" for c in range(256)]), np.array([c in b".,;:'\"()-" for c in range(256)]), np.arange(256) >= 128]


def structure(text: bytes, words: Counter) -> np.ndarray:
    """The bin of each structure statistic of a whole text."""
    seen = np.zeros(256, np.int64)
    for i in range(0, len(text), 1 << 20):
        seen += np.bincount(np.frombuffer(text[i:i + (1 << 20)], np.uint8), minlength=256)
    upper, lower, digits, blanks, breaks, symbols, cries, marks, high = (int(seen[k].sum()) for k in KINDS)
    n, total = max(len(text), 1), max(words.total(), 1)
    lines = Counter(zlib.crc32(line) for line in text.split(b"\n"))
    shares = [upper / max(upper + lower, 1), digits / n, blanks / n, symbols / n, cries / n, marks / n, high / n, len(words) / total,
              max(words.values(), default=0) / total, 1 - len(lines) / lines.total(), 20 * min(breaks / n, 0.05)]
    sizes = [np.log2(len(text) + 1), 3 * np.log2(words.total() / max(lines.total(), 1) + 1), 6 * np.log2(sum(map(len, words)) / max(len(words), 1) + 1)]
    return np.minimum(np.concatenate([np.sqrt(np.clip(shares, 0, 1)) * BINS, sizes]).astype(np.int64), BINS - 1)


def features(text: bytes | None, metadata: Sequence[str] = (), max_words: int | None = None) -> np.ndarray:
    """Coordinates of a text: statistics, metadata, then distinct words (with ``max_words``: those of the smallest mixed hashes)."""
    text, words = text or b"", Counter()
    for some in terms_in(text):
        words.update(some)
    index = WORDS + np.arange(STATISTICS) * BINS + structure(text, words)
    given = [WORDS + STATISTICS * BINS + zlib.crc32(f"{i}={m}".encode("utf-8", "replace")) % METADATA for i, m in enumerate(metadata)]
    hashed = np.unique(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS)
    if max_words is not None and len(hashed) > max_words:
        hashed = hashed[np.argsort(hashed * 0x9E3779B1 % (1 << 32))[:max_words]]
    return np.concatenate([index, np.unique(np.array(given, np.int64)), hashed]).astype(np.int32)


def values(index: np.ndarray) -> np.ndarray:
    """Statistics and metadata count a half each, all words of a text together as much as two of them."""
    word = index < WORDS
    return np.where(word, 0.7 / max(np.sqrt(word.sum()), 1), 0.5).astype(np.float32)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # SIZE
    vectors: np.ndarray  # SIZE x rank

    def logit(self, index: np.ndarray) -> float:
        """In time linear in the features, by the sum-of-squares identity."""
        x = values(index)
        vx = self.vectors[index] * x[:, None]
        total = vx.sum(axis=0, dtype=np.float64)
        return self.bias + float(self.weight[index] @ x) + 0.5 * float((total**2).sum() - (vx.astype(np.float64)**2).sum())


def gradients(machine: Machine, index: np.ndarray, x: np.ndarray, start: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of the log loss summed over a batch: bias, the distinct coordinates, their weights, their vectors."""
    v = machine.vectors[index]
    vx = v * x[:, None]
    total = np.add.reduceat(vx, start)
    z = machine.bias + np.add.reduceat(machine.weight[index] * x, start) + 0.5 * (total**2 - np.add.reduceat(vx**2, start)).sum(axis=1)
    g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
    row = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(index))))
    gx = g[row] * x
    at = np.argsort(index, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(index[at]) != 0])
    by_vector = gx[:, None] * (total[row] - vx)
    return float(g.sum()), index[at][first], np.add.reduceat(gx[at], first), np.add.reduceat(by_vector[at], first)


def fit(rows: list[np.ndarray], labels: np.ndarray, rank: int = 8, passes: int = 8, batch: int = 32, rate: float = 0.15, l2: float = 1e-4, seed: int = 17) -> Machine:
    """AdaGrad over mini-batches in a shuffled order per pass; without both labels only the bias is set."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, rank)).astype(np.float32))
    if not len(rows) or len(set(labels.tolist())) < 2:
        machine.vectors[:] = 0
        machine.bias = 0.0 if not len(rows) else 5.0 if labels[0] else -5.0
        return machine
    mean = labels.mean()
    machine.bias = float(np.log(mean / (1 - mean)))
    gone_w, gone_v, gone_b = np.full(SIZE, 1e-2, np.float32), np.full((SIZE, rank), 1e-2, np.float32), 1.0
    held = [values(r) for r in rows]
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            take = order[i:i + batch]
            size = np.array([len(rows[j]) for j in take])
            gb, at, gw, gv = gradients(machine, np.concatenate([rows[j] for j in take]), np.concatenate([held[j] for j in take]), np.cumsum(size) - size, labels[take])
            gw, gv = gw + l2 * machine.weight[at], gv + l2 * machine.vectors[at]
            gone_b += gb * gb
            gone_w[at] += gw * gw
            gone_v[at] += gv * gv
            machine.bias -= rate * gb / gone_b**0.5
            machine.weight[at] -= rate * gw / np.sqrt(gone_w[at])
            machine.vectors[at] -= rate * gv / np.sqrt(gone_v[at])
    return machine


def described(metadata: Sequence[Column]) -> Column:
    return F.array(*[F.coalesce(m.cast("string"), F.lit("")) for m in metadata]) if metadata else F.array().cast("array<string>")


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, metadata: Sequence[Column] = (), max_rows: int = 6_000,
          max_words: int = 2_048, **options) -> Machine:
    """Fit on about ``max_rows`` labelled rows, those with the smallest hash of the id.

    The sample of ids (never over twice ``max_rows``) is broadcast to the documents, whose texts become
    coordinates where they lie.  Of a text in the sample at most ``max_words`` hashed words are learnt from,
    so the driver gets at most ``max_rows`` x ``max_words`` x 8 numbers; its statistics cover the whole
    text.  Rows with a null id, text or label are not used; without any row every score is 0.5.
    """
    small_batches(docs.sparkSession)
    marks = labels.select(F.col(id_col).alias("id"), (F.col(label_col).cast("int") > 0).cast("int").alias("y")).filter("id is not null and y is not null")
    n, space = marks.count(), 1 << 20
    marks = marks.filter(F.pmod(F.xxhash64("id"), F.lit(space)) <= int(space * max_rows / max(n, 1))).limit(2 * max_rows)

    @F.pandas_udf("binary")
    def hashed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, given in parts:
            yield pd.Series([features(t, m, max_words).tobytes() for t, m in zip(texts, given)], dtype=object)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), described(metadata).alias("meta")).filter("text is not null")
    got = texts.join(F.broadcast(marks), "id").select("id", "y", hashed("text", "meta").alias("x")).limit(4 * max_rows).collect()
    got.sort(key=lambda r: (r["id"], r["y"], bytes(r["x"])))
    return fit([np.frombuffer(r["x"], np.int32) for r in got], np.array([r["y"] for r in got], np.float32), **options)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata: Sequence[Column] = ()) -> DataFrame:
    """id_col and score (0 to 1, higher: label 1 likelier) of every row, from its whole text.

    A null text counts as empty; empty texts are scored by their statistics and metadata, null
    metadata as an empty string.  Repeated rows give equal rows, an empty table an empty one;
    other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = spark.sparkContext.broadcast(machine)  # SIZE x (rank + 1) numbers, whatever the input

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, given in parts:
            z = np.array([known.value.logit(features(t, m)) for t, m in zip(texts, given)])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.select(F.col(id_col), scored(F.col(text_col).cast("string").cast("binary"), described(metadata)).alias("score"))
