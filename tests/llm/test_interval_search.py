import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from noteflow.llm import interval_search, queries

from .conftest import awkward_rows, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=50):
    """(item_id, rank, doc_id, score) by scoring every document."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for doc, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if w in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_terms_of_bytes():
    text = "Ünder THE_sky, it's 4·5 \x7fßÉ x"
    assert [w.decode() for some in interval_search.terms_in(text.encode(), piece=3) for w in some] == terms(text)
    assert list(interval_search.terms_in(None)) == list(interval_search.terms_in(b"")) == []


@pytest.fixture(scope="module")
def rng():
    return random.Random(5)


def test_range_maxima_and_search_equal_plain_scoring(rng):
    for trial in range(25):
        n = np.array([rng.choice([3, 3, 3, 40]) for _ in range(rng.randint(1, 60))], np.int64)
        held = [sorted(rng.sample(range(12), rng.randint(0, 6))) for _ in n]
        tfs = np.array([rng.choice([1, 1, 2, 5]) for t in held for _ in t], np.int64)
        ends = np.concatenate([[0], np.cumsum([len(t) for t in held])]).astype(np.int64)
        flat = np.array([x for t in held for x in t], np.int32)
        by_id = np.array(rng.sample(range(len(n)), len(n)), np.int64)
        weight = np.array([rng.choice([0, 1, 700, 2000]) for _ in range(12)], np.int64)
        block = interval_search.Block(n, by_id, ends, flat, tfs, weight, 100, 1000)
        for _ in range(40):
            a = rng.randint(0, len(flat))
            t = flat[np.argsort(flat, kind="stable")]
            stop = int(np.searchsorted(t, t[a], "right")) if a < len(flat) else a
            b = rng.randint(a, stop)
            got = int(block.largest(np.array([a]), np.array([b]))[0])
            assert got == (a + int(block.impact[a:b].argmax()) if b > a else -1)
        asked = np.array(sorted(rng.sample(range(14), 5)), np.int64)
        scores = np.zeros(len(n), np.int64)
        m = 50 + (50 * n * 100) // 1000
        for d, (x, y) in enumerate(zip(ends[:-1], ends[1:])):
            for t, tf in zip(flat[x:y], tfs[x:y]):
                scores[d] += weight[t] * ((10**9 * tf) // (1000 * tf + 20 * m[d])) if t in asked else 0
        want = sorted((-s, by_id[d], d) for d, s in enumerate(scores) if s > 0)[:7]
        at, got = block.search(asked, 7, leaf=2, at_once=2)
        assert [(-s, by_id[block.order[p]], block.order[p]) for p, s in zip(at, got)] == want


def test_long_equal_runs_are_left_early(rng):
    n = 20_000  # copies of one document: all scores are equal, only the first by id matter
    block = interval_search.Block(np.full(n, 5, np.int64), np.arange(n)[::-1].copy(), np.arange(n + 1), np.zeros(n, np.int32), np.ones(n, np.int64), np.array([9]), n, 5 * n)
    seen = []
    largest = block.largest
    block.largest = lambda a, b: seen.append(len(a)) or largest(a, b)
    at, _ = block.search(np.array([0]), 50)
    assert list(block.order[at]) == list(range(n - 1, n - 51, -1)) and sum(seen) < 2000


@pytest.mark.parametrize("sizes", [{}, {"block_docs": 7, "block_bytes": 300}])
def test_search_equals_plain_scoring(spark, awkward, rng, sizes):
    held = [(r[0], r[1]) for r in awkward_rows()]
    items = [(i, prose(rng, 8)) for i in range(6)] + [(7, None), (8, ""), (9, "?!"), (1, prose(rng, 3)), (None, "W1 w2 w1"), (4, "a text without an id"), (4, "a text without an id")]
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, rank int, score string").repartition(2)
    got = interval_search.search(awkward, asked, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert rows_of(got) == plain(held, items)


def test_empty_tables(spark, awkward, empty_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "w1 w2")], "item_id bigint, text string")
    assert interval_search.search(awkward, none).count() == 0
    assert interval_search.search(empty_docs, some).count() == 0


def test_registered_query_equals_plain_scoring(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert rows_of(queries.QUERIES["op13_interval_search"](spark, sf)) == want
