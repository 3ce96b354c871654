import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from noteflow.llm import conversation_trie, factor_machine, queries
from pyspark.sql import functions as F

from .conftest import prose

# ---- factorisation machine


def small_machine(rng):
    return factor_machine.Machine(0.3, rng.normal(0, 0.3, factor_machine.SIZE), rng.normal(0, 0.3, (factor_machine.SIZE, 3)))


def test_linear_time_score_equals_all_pairs():
    rng = np.random.default_rng(1)
    machine = small_machine(rng)
    index = factor_machine.features("Some words, some MORE words!\nsome words".encode(), ["7", ""])
    x = factor_machine.values(index)
    pairs = sum(float(machine.vectors[i] @ machine.vectors[j]) * float(a) * float(b) for (i, a), (j, b) in combinations(zip(index, x), 2))
    assert abs(machine.logit(index) - (0.3 + float(machine.weight[index] @ x) + pairs)) < 1e-4
    assert len(set(index.tolist())) == len(index) and index.max() < factor_machine.SIZE


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    machine = small_machine(rng)
    rows = [rng.choice(50, rng.integers(2, 9), replace=False) for _ in range(6)]
    size = np.array([len(r) for r in rows])
    index, start, y = np.concatenate(rows), np.cumsum(size) - size, rng.integers(0, 2, 6).astype(float)
    x = rng.random(len(index))

    def loss():
        total = 0.0
        for s, n, t in zip(start, size, y):
            i, v = index[s:s + n], x[s:s + n]
            vx = machine.vectors[i] * v[:, None]
            z = machine.bias + machine.weight[i] @ v + 0.5 * (vx.sum(0)**2 - (vx**2).sum(0)).sum()
            total += np.log1p(np.exp(z)) - t * z
        return total

    gb, at, gw, gv = factor_machine.gradients(machine, index, x, start, y)
    for array, grad in ((machine.weight, lambda k, _: gw[k]), (machine.vectors, lambda k, f: gv[k, f])):
        for k in rng.choice(len(at), 8):
            f = int(rng.integers(0, 3))
            spot = at[k] if array.ndim == 1 else (at[k], f)
            old = array[spot]
            array[spot] = old + 1e-5
            up = loss()
            array[spot] = old - 1e-5
            down = loss()
            array[spot] = old
            assert abs((up - down) / 2e-5 - grad(k, f)) < 1e-5
    machine.bias += 1e-5
    up = loss()
    machine.bias -= 2e-5
    assert abs((up - loss()) / 2e-5 - gb) < 1e-5


def test_pairs_of_words_are_learnt():
    """Whether two words come together decides, neither alone: no linear model can tell."""
    rng = random.Random(3)
    rows, labels = [], []
    for _ in range(800):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(factor_machine.features(f"{'left' if a else 'west'} {'right' if b else 'east'}".encode()))
        labels.append(float(a == b))
    machine = factor_machine.fit(rows, np.array(labels, np.float32), passes=20)
    told = [machine.logit(r) > 0 for r in rows]
    assert np.mean([t == bool(y) for t, y in zip(told, labels)]) > 0.98


def test_quality_edges(spark, awkward, empty_docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None, "x") for i in range(40)] + [(None, 1, 1, "y"), (51, None, 0, "z"), (50, 0, 0, "n")], "doc_id bigint, quality int, score int, text string")
    meta = [F.col("lang"), F.floor(F.log2(F.col("n_chars")))]
    machine = factor_machine.train(awkward, labels, "doc_id", "text", "quality", meta, passes=2)
    got = factor_machine.score(awkward, machine, metadata=meta).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    same = {}
    for r in got:
        same.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(s) == 1 for s in same.values())  # repeated rows score alike
    assert factor_machine.score(empty_docs, machine).count() == 0
    blank = factor_machine.train(empty_docs, labels, "doc_id", "text", "quality")
    assert {r["score"] for r in factor_machine.score(awkward, blank).collect()} == {0.5}
    # a long text is read to its end
    assert set(factor_machine.features(b"a " * 2_000_000 + b"zebra")) != set(factor_machine.features(b"a " * 2_000_001))


def test_quality_on_held_out_documents(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = queries.QUERIES["op12_factor_machine"](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.93


# ---- conversation trie


def plain_trie(conversations):
    """Nodes as dictionaries of whole turn sequences, from the rows (conv, turn, role, text)."""
    held = {}
    for c, turn, role, text in conversations:
        if c is not None:
            held.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16], role or "", text or ""))
    held = {c: [(r, t) for *_, r, t in sorted(rows)] for c, rows in held.items()}
    built = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = held.get(c - c % 100, [])[:h] + own[h:]
    members, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(children[q] == 0 for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(rows, **sizes):
    placed, lengths = conversation_trie.place_turns(rows, "conv_id", "turn", "role", "text")
    got = conversation_trie.prefix_trie(*conversation_trie.share_openings(placed, lengths), **sizes)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def made_up(rng):
    """Conversations from few different turns, copies, gaps in the ids, ties, nulls and a very long one."""
    rows = []
    for c in [*range(0, 60, 2), 100, 103, 104, 199, 201, 205]:
        text = rng.choice(["yes", "no", "peréra\U0001f600"])
        rows += [(c, t, rng.choice(["user", "user", "bot"]), text if rng.random() < 0.8 else rng.choice(["yes", "no"])) for t in range(rng.randint(1, 11))]
    rows += [(c, t, "user", "same") for c in range(400, 440) for t in range(7)]
    rows += [(500, t, "user", f"long {t % 3}") for t in range(90)] + [(501, t, "user", f"long {t % 3}") for t in range(70)]
    rows += [(7, None, "user", "first"), (7, None, None, "first"), (7, 1, None, None), (7, 1, None, None), (None, 1, "user", "nobody"), (8, 1, "", "")]
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    rows = made_up(random.Random(4))
    extra = "conv string, at string, block string, node string, length string"
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], f"conv_id bigint, turn bigint, role string, text string, {extra}").repartition(3)
    return df, plain_trie(rows)


@pytest.mark.parametrize("sizes", [{}, {"width": 3, "chunk": 2}])
def test_trie_equals_plain_prefixes(conversations, sizes):
    df, want = conversations
    assert trie_of(df, **sizes) == want


def test_trie_of_nothing(spark):
    assert trie_of(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")) == []
    assert trie_of(spark.createDataFrame([(None, 1, "a", "b")], "conv_id bigint, turn bigint, role string, text string")) == []


def test_very_long_texts_and_large_groups_of_copies(spark):
    long = prose(random.Random(1), 200_000)
    rows = [(c, 0, "user", long) for c in range(2)] + [(c, t, "user", f"turn {t}") for c in range(1000, 4000) for t in range(2)]
    got = trie_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4))
    want = plain_trie(rows)
    assert got == want and max(r[3] for r in got) > 2000


def test_registered_trie_equals_plain_prefixes(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op11_conversation_trie"](spark, sf).select(COLUMNS).collect())
    assert got == plain_trie(rows)
