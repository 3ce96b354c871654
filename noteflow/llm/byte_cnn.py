"""Language identification with a small byte convolutional network, in numpy.

Bytes are embedded, filters of several widths run over a window of fixed length, every
filter's greatest response is kept, and a softmax layer reads those.  A text is cut into
windows that cover all its bytes; the windows' log-probabilities, weighted by their bytes, are
averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

UND = "und"
WINDOW = 192
WIDTHS = (2, 3, 4)
PAD = 256  # byte value of the places behind a text's end


@dataclass
class Network:
    """Parameters; small enough to travel with the task (some tens of kilobytes)."""

    classes: list[str]
    embed: np.ndarray  # (257, e)
    filters: list[np.ndarray]  # per width: (width * e, f)
    bias: list[np.ndarray]
    out: np.ndarray  # (sum f, classes)
    out_bias: np.ndarray

    @staticmethod
    def start(classes: list[str], rng: np.random.Generator, e: int = 8, f: int = 24, widths: tuple = WIDTHS) -> Network:
        embed = rng.normal(0, 0.5, (257, e)).astype(np.float32)
        embed[PAD] = 0
        return Network(classes, embed, [rng.normal(0, (2 / (w * e)) ** 0.5, (w * e, f)).astype(np.float32) for w in widths],
                       [np.zeros(f, np.float32) for _ in widths],
                       rng.normal(0, (1 / (f * len(widths))) ** 0.5, (f * len(widths), len(classes))).astype(np.float32), np.zeros(len(classes), np.float32))

    def pooled(self, x: np.ndarray, keep: bool = False):
        """Greatest response of each filter over each row of bytes ``x`` (n, length)."""
        n, length = x.shape
        e = self.embed.shape[1]
        emb = self.embed[x]
        parts, where, cols = [], [], []
        for w, b in zip(self.filters, self.bias):
            width = len(w) // e
            # windows of `width` embedded bytes as one strided view: no copy before the product
            view = np.lib.stride_tricks.as_strided(emb, (n, length - width + 1, width * e), emb.strides)
            r = view.reshape(-1, width * e) @ w
            r = r.reshape(n, length - width + 1, -1)
            if keep:
                at = r.argmax(axis=1)
                where.append(at)
                cols.append(view)
                best = np.take_along_axis(r, at[:, None, :], axis=1)[:, 0, :]
            else:
                best = r.max(axis=1)
            parts.append(np.maximum(best + b, 0))
        h = np.concatenate(parts, axis=1)
        return (h, where, cols) if keep else h

    def log_prob(self, x: np.ndarray, slab: int = 256) -> np.ndarray:
        """Log-probabilities of the classes for each row of bytes, a slab at a time."""
        out = np.empty((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), slab):
            z = self.pooled(x[i:i + slab]) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out[i:i + slab] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, e = len(x), self.embed.shape[1]
        h, where, cols = self.pooled(x, keep=True)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), y] -= 1
        z /= n
        d_out, d_out_bias, d_h = h.T @ z, z.sum(axis=0), (z @ self.out.T) * (h > 0)
        d_embed = np.zeros_like(self.embed)
        d_filters, d_bias, at_f = [], [], 0
        rows = np.arange(n)[:, None]
        for w, at, view in zip(self.filters, where, cols):
            f, width = w.shape[1], len(w) // e
            d = d_h[:, at_f:at_f + f]
            at_f += f
            d_filters.append(np.einsum("nfk,nf->kf", view[rows, at], d))
            d_bias.append(d.sum(axis=0))
            back = d[:, :, None] * w.T[None]  # (n, f, width * e)
            for k in range(width):
                np.add.at(d_embed, x[rows, at + k], back[:, :, k * e:(k + 1) * e])
        d_embed[PAD] = 0
        return [d_embed, *d_filters, *d_bias, d_out, d_out_bias]


def windows_of(texts: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: bytes (n, length), the text of each, and how many bytes it holds."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // length)
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = np.full(int(counts.sum()) * length, PAD, np.int16)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) * length if len(texts) else np.zeros(0, np.int64)
    for t, s in zip(texts, starts):
        flat[s:s + len(t)] = np.frombuffer(t, np.uint8)
    held = np.full(len(owner), length, np.int64)
    ends = np.cumsum(counts) - 1
    last = counts > 0
    held[ends[last]] = sizes[last] - (counts[last] - 1) * length
    return flat.reshape(-1, length), owner, held


def fit(texts: list[bytes], labels: list[str], steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network | None:
    """Train by Adam on windows of the given texts; classes are drawn evenly.  None without a label."""
    classes = sorted(set(labels))
    if not classes:
        return None
    rng = np.random.default_rng(seed)
    net = Network.start(classes, rng)
    x, owner, held = windows_of(texts)
    y = np.array([classes.index(v) for v in labels])[owner] if len(owner) else np.zeros(0, int)
    by_class = [np.flatnonzero(y == k) for k in range(len(classes))]
    by_class = [b for b in by_class if len(b)]
    if len(by_class) < 2:
        return net
    first, second = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by_class[k]) for k in rng.integers(0, len(by_class), batch)])
        part = x[pick].copy()
        # short texts occur too: cut some windows to a random number of their bytes
        keep = np.where(rng.random(batch) < 0.4, rng.integers(8, WINDOW, batch), WINDOW)
        part[np.arange(WINDOW)[None] >= np.maximum(np.minimum(keep, held[pick]), 1)[:, None]] = PAD
        now = rate * (1 - step / (steps + 1)) + 1e-4
        for p, g, m, v in zip(net.params(), net.gradients(part, y[pick]), first, second):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def train(labelled: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int = 1500, chars: int = 384, steps: int = 500) -> Network | None:
    """Fit on a bounded sample of labelled rows: about ``per_class`` rows of every label.

    The rows are those with the smallest share of hash values of the id (and text length), by
    the label's count over all rows; of each, ``chars`` characters from a hashed place are read,
    so what reaches the driver is bounded by labels * per_class * chars.  Rows with a null
    label or text, or no letter, are not used.  None if nothing is left.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row per label
    if not counts:
        return None
    space = 1 << 20
    cut = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(space, int(space * per_class / n) + 1))) for k, n in sorted(counts.items())])
    picked = rows.filter(F.pmod(F.xxhash64("id", F.length("text")), F.lit(space)) < cut)
    at = F.pmod(F.xxhash64(F.lit(3), "id"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    picked = picked.select("label", F.substring("text", at, F.lit(chars)).alias("text")).limit(2 * per_class * len(counts))
    got = sorted((r["label"], r["text"]) for r in picked.collect())
    return fit([t.encode("utf-8", "replace") for _, t in got], [k for k, _ in got], steps)


def detect(texts: pd.Series, net: Network | None) -> pd.DataFrame:
    """Language and its probability for each text; no letter, null or no network gives ``und`` and 0."""
    lang, score = np.full(len(texts), UND, object), np.zeros(len(texts))
    have = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if net else []
    for k in range(0, len(have), 64):
        some = have[k:k + 64]
        x, owner, held = windows_of([texts.iloc[i].encode("utf-8", "replace") for i in some])
        weighted = net.log_prob(x) * held[:, None]
        total = np.zeros((len(some), len(net.classes)))
        np.add.at(total, owner, weighted)
        total /= np.bincount(owner, held, len(some))[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        lang[some], score[some] = np.array(net.classes, object)[best], p[np.arange(len(some)), best]
    return pd.DataFrame({"lang": lang, "score": score})


def detector(net: Network | None):
    """Column function text -> struct(lang, score); all bytes of every text are read."""

    @F.pandas_udf("struct<lang:string,score:double>")
    def detected(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield detect(texts, net)

    return detected


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score of every row.

    Null texts, texts without a letter and an untrained network give ``und`` with score 0.
    Repeated rows give equal rows, an empty table an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), detector(net)(F.col(text_col).cast("string")).alias("d")).select(id_col, F.col("d.lang").alias("lang_pred"), F.col("d.score").alias("score"))
