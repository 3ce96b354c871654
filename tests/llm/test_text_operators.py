import random
import zlib

import numpy as np
import pandas as pd
import pytest
from noteflow.llm import byte_cnn, ftrl, license_templates, queries

DE = "der die und nicht ein eine über größe straße müde können".split()
EN = "the and not a one over size street tired can where".split()


def texts(n, words, rng, lo=5, hi=60):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(lo, hi))) for _ in range(n)]


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    de, en = texts(150, DE, rng), texts(150, EN, rng)
    return byte_cnn.fit([t.encode() for t in de + en], ["de"] * 150 + ["en"] * 150, steps=150)


def test_network_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = byte_cnn.Network.start(["a", "b", "c"], rng, e=3, f=4, widths=(2, 3))
    for name in ("embed", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(float))
    net.filters, net.bias = [f.astype(float) for f in net.filters], [b.astype(float) + 0.1 for b in net.bias]
    x, y = rng.integers(0, 256, (6, 12)), rng.integers(0, 3, 6)

    def loss():
        h = net.pooled(x)
        z = h @ net.out + net.out_bias
        z -= z.max(axis=1, keepdims=True)
        return -(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(6), y].mean()

    for p, g in zip(net.params(), net.gradients(x, y)):
        spots = [tuple(rng.integers(0, s) for s in p.shape) for _ in range(12)]
        for s in spots:
            old = p[s]
            p[s] = old + 1e-5
            up = loss()
            p[s] = old - 1e-5
            down = loss()
            p[s] = old
            assert abs((up - down) / 2e-5 - g[s]) < 1e-4


def test_windows_cover_all_bytes():
    given = [b"", b"x" * 5, bytes(range(200)) * 3, b"y" * byte_cnn.WINDOW]
    x, owner, held = byte_cnn.windows_of(given)
    for i, t in enumerate(given):
        assert bytes(x[owner == i][x[owner == i] != byte_cnn.PAD].astype(np.uint8)) == t and held[owner == i].sum() == len(t)


def test_language_edges(net, spark, awkward, empty_docs):
    rng = random.Random(2)
    got = byte_cnn.detect(pd.Series(["über die straße", "the street", None, "", "123 ?!", texts(1, DE, rng, 50_000, 50_001)[0]]), net)
    assert list(got.lang) == ["de", "en", "und", "und", "und", "de"] and list(got.score[2:5]) == [0, 0, 0] and got.score.between(0, 1).all()
    rows = byte_cnn.identify(awkward, net).collect()
    assert len(rows) == awkward.count() and byte_cnn.identify(empty_docs, net).count() == 0
    assert byte_cnn.train(empty_docs, "doc_id", "text", "lang") is None
    assert {r["lang_pred"] for r in byte_cnn.identify(awkward, None).collect()} == {"und"}


def test_op3_held_out_accuracy(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op3(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert all(rows[d["doc_id"]]["held_out"] for d in held) and sum(r["held_out"] for r in rows.values()) == len(held)
    right = sum(rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held if d["lang"])
    assert right >= 0.95 * len(held)


def test_ftrl_learns_words_and_pairs():
    rng = random.Random(4)
    h = ftrl.Hasher()
    clean, bad = texts(300, EN, rng), [f"{t} vile {u}" for t, u in zip(texts(60, EN, rng), texts(60, EN, rng))]
    rows = [np.unique(ftrl.features(h.words(t))) for t in clean + bad]
    model = ftrl.fit(rows, np.array([0] * 300 + [1] * 60))
    got = ftrl.score_texts(pd.Series(["Vile street", "the street", "", None, " ".join(EN * 3000) + " vile"]), model.table(), model.bias, model.bits, h)
    assert got[0] > 0.5 > got[1] and got[2] == got[3] < 0.5 and got[4] > 0.5  # one word in a long text counts as much
    assert len(model.index) < 2000  # L1 keeps few of the coordinates


def test_features_tell_kinds_apart():
    h = ftrl.Hasher()
    a, b = (set(ftrl.features(h.words(t)).tolist()) for t in ("one two three", "three two one"))
    assert len(a) == 3 + 2 + 1 + 1 and len(a & b) == 3


def test_op4_scores(spark, sf, awkward, empty_docs):
    rows = queries.op4(spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id bigint, toxic int")
    model = ftrl.train(awkward, labels, "doc_id", "text", "toxic")
    assert ftrl.score(awkward, model).count() == awkward.count() and ftrl.score(empty_docs, model).count() == 0
    none = ftrl.train(empty_docs, labels.limit(0), "doc_id", "text", "toxic")
    assert len(none.index) == 0 and none.bias == 0


def test_op4_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in queries.op4(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    toxic, clean = [r for r in labels if r["toxic"]], [r for r in labels if not r["toxic"]]
    assert sum(rows[r["doc_id"]]["predicted"] for r in toxic) >= 0.75 * len(toxic)
    assert sum(rows[r["doc_id"]]["predicted"] for r in clean) <= 0.01 * len(clean)


def test_templates():
    scan = license_templates.Scanner(license_templates.TEMPLATES, license_templates.PHRASES).scan
    labels = lambda t: sorted({s[0] for s in scan(t)[2]})
    assert labels("x. This work is licensed under the GNU General Public License, version 3. y") == ["gpl-3"]
    assert labels("Licensed under the terms of the Apache License, Version 2.0.") == ["apache-2"]
    assert labels("Licensed under Apache License 2.0") == ["apache-2"]
    assert labels("provided under CC BY-NC 4.0") == ["cc-by-nc"]
    assert labels("provided under the MIT-License") == ["mit-notice"]
    for no in ("the mit license", "licensed under the apache license version 3 0", "licensed under gnu public license version 3", "licensed under cc by 9 0"):
        assert labels(no) == []
    n, base, spans = scan("a MIT License b Released under the MIT License")
    assert n == 9 and base == [("mit", 1, 3), ("mit", 7, 9)] and spans == [("mit-notice", 4, 9)]
    assert scan(None) == (0, [], []) and scan("") == (0, [], [])


def test_template_markup_errors():
    for bad in ("[[a", "a]] b", "[[a]]"):
        with pytest.raises(ValueError):
            license_templates.compile_template(bad)
    a = license_templates.compile_template("a [[b [[c]]]] {{x:[0-9]+}} d")

    def accepts(text):
        states = a.closure({0})
        for w in text.split():
            states = a.step(states, w)
        return a.end in states

    assert [accepts(t) for t in ("a 1 d", "a b 22 d", "a b c 3 d", "a c 1 d", "a b d", "a 1 d d")] == [True, True, True, False, False, False]


def test_licenses_awkward(awkward, empty_docs):
    rows = license_templates.license_summary(license_templates.scan_licenses(awkward)).collect()
    assert len(rows) == awkward.count() and all(r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" and r["score"] == 0 for r in rows)
    assert max(r["n_words"] for r in rows) == 150_000
    assert license_templates.license_summary(license_templates.scan_licenses(empty_docs)).count() == 0
