import random
from itertools import combinations

import numpy as np
import pytest
from noteflow.llm import order_minhash, queries, url_rules
from pyspark.sql import functions as F

from .conftest import DOCS, prose


def plain_distance(a, b):
    """Edit distance by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_banded_distance_equals_the_full_table():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 14))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8] + [9] * rng.randint(0, 2)
        want = plain_distance(a, b)
        for most in (0, 1, 2, 5, 20):
            got = order_minhash.banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), most)
            assert got == min(want, most + 1), (a, b, most, got, want)


def test_similarity_threshold():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(30) for _ in range(rng.randint(1, 60))]
        b = [x if rng.random() > rng.choice((0.05, 0.2, 0.3)) else rng.randrange(30) for x in a]
        want = 1 - plain_distance(a, b) / max(len(a), len(b))
        got = order_minhash.similarity_at_least(np.array(a, np.uint32), np.array(b, np.uint32), 0.8)
        assert (got is None) == (want < 0.8 - 1e-9) and (got is None or abs(got - want) < 1e-12)
    none = np.zeros(0, np.uint32)
    assert order_minhash.similarity_at_least(none, none, 0.8) is None


def test_kmers_are_labelled_by_occurrence_and_sketches_by_order():
    a = order_minhash.labelled_kmers(order_minhash.word_hashes("x " * 20), 5)
    assert len(a) == len(set(a.tolist())) == 16
    w = order_minhash.word_hashes(" ".join(f"a{i}" for i in range(200)))
    turned = np.concatenate([w[100:], w[:100]])
    s, t = (order_minhash.sketch(order_minhash.labelled_kmers(v, 5), 64, 2) for v in (w, turned))
    assert 0.3 < (s == t).mean() < 0.7  # the same k-mers but half of the pairs in the other order


def classes(rows):
    return {r["doc_id"]: r["class_id"] for r in rows}


def corpus(rng):
    """Documents with exact and near copies, shared passages, and texts around the threshold; truth by alignment."""
    base = [prose(rng, rng.randint(60, 200), 3000).split() for _ in range(30)]
    out = [list(b) for b in base]
    for b in base[:12]:
        for _ in range(3):
            out.append([w if rng.random() > 0.02 else f"n{rng.randrange(99)}" for w in b if rng.random() > 0.01])
    passage = prose(rng, 60, 3000).split()
    out += [prose(rng, 120, 3000).split() + passage for _ in range(10)]
    out += [list(base[20]), list(base[21]), "one two three".split(), "one two three".split(), "one two four".split()]
    return [" ".join(w) for w in out]


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    label = list(range(len(texts)))
    words = [t.split() for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        a, b = words[i], words[j]
        if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and len(set(a) & set(b)) > 0.5 * len(set(a)) and 1 - plain_distance(a, b) / max(len(a), len(b)) >= 0.8:
            lo, hi = sorted((label[i], label[j]))
            label = [lo if x == hi else x for x in label]
    rows = order_minhash.near_duplicates(docs).collect()
    assert classes(rows) == dict(enumerate(label))
    assert sorted(r["doc_id"] for r in rows if r["kept"]) == sorted(set(label))


def test_large_group_of_near_copies_and_common_passage(spark):
    rng = random.Random(6)
    base, passage = prose(rng, 120, 5000).split(), prose(rng, 80, 5000).split()
    group = [[w if rng.random() > 0.01 else f"n{rng.randrange(999)}" for w in base] for _ in range(400)]
    clean = [prose(rng, 150, 5000).split() + passage for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(group + clean)], "doc_id bigint, text string").repartition(4)
    got = classes(order_minhash.near_duplicates(docs).collect())
    assert all(got[i] == 0 for i in range(400)) and all(got[i] == i for i in range(400, 700))


def test_links_hidden_behind_a_foreign_hub(spark):
    """Two alike texts whose every common sketch also occurs in an earlier, dissimilar text."""
    rng = random.Random(8)
    base = prose(rng, 200, 5000).split()
    hubs = [prose(rng, 30, 5000).split() + base + prose(rng, 30, 5000).split() for _ in range(14)]
    alike = [[f"n{j}" if j % 25 == 7 + i else w for j, w in enumerate(base)] for i in range(3)]
    passages = [prose(rng, 25, 5000).split() for _ in range(30)]
    drawn = [sum(rng.sample(passages, 6), []) for _ in range(80)]
    texts = [" ".join(t) for t in [*hubs, base, *alike, *drawn]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    label, words = list(range(len(texts))), [order_minhash.word_hashes(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        if order_minhash.similarity_at_least(words[i], words[j], 0.8) is not None:
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert classes(order_minhash.near_duplicates(docs).collect()) == dict(enumerate(label))


def test_links_hidden_behind_a_crowd_of_hubs(spark):
    """Texts alike by a common passage alone, in a crowd of longer ones that are unlike by the same passage."""
    rng = random.Random(21)
    texts, pairs = [], []
    for p in range(3):
        passage = prose(rng, 60, 5000).split()
        texts += [passage + [f"c{p}_{i}_{j}" for j in range(25)] for i in range(1500)]
        pairs.append((len(texts), len(texts) + 1))
        texts += [passage + [f"a{p}_{i}_{j}" for j in range(10)] for i in range(2)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    want = {i: i for i in range(len(texts))} | {j: i for i, j in pairs}
    assert classes(order_minhash.near_duplicates(docs).collect()) == want
    assert classes(order_minhash.near_duplicates(docs, group=256).collect()) == want


def test_texts_across_components_meet_in_blocks(spark):
    rng = random.Random(22)
    base = [prose(rng, 40, 400).split() for _ in range(6)]
    texts = [[w if rng.random() > 0.15 else f"n{rng.randrange(50)}" for w in base[rng.randrange(6)]] for _ in range(160)]
    words = [order_minhash.word_hashes(" ".join(t)) for t in texts]
    component = [rng.choice([0, 1, i]) for i in range(160)]  # two large ones and many of one text
    rows = [(i, component[i], bytearray(w.tobytes()), len(w)) for i, w in enumerate(words)]
    made = spark.createDataFrame(rows, "row bigint, component bigint, words binary, n_words int")
    alike = {(i, j) for i, j in combinations(range(160), 2) if component[i] != component[j] and order_minhash.similarity_at_least(words[i], words[j], 0.8) is not None}
    rare = order_minhash.rare_words(made.select("row", "words"), 0.8, known=20).join(made.select("row", "component"), "row")
    for filed in (made.select(F.lit(1).cast("bigint").alias("key"), "row", "component"), rare):
        for side in (16, 2048):
            got = [(r["row"], r["other"]) for r in order_minhash.across(filed, made, 0.8, side).collect()]
            assert len(got) == len(set(got)) and alike <= set(got)
            assert all(i < j and component[i] != component[j] for i, j in got)
    assert alike
    for a, b in combinations([np.array([rng.randrange(900) for _ in range(n)], np.uint32) for n in (0, 1, 100, 250, 260, 300, 900)], 2):
        lacks = max((np.isin(order_minhash.labelled_kmers(x, 1), order_minhash.labelled_kmers(y, 1), invert=True)).sum() for x, y in ((a, b), (b, a)))
        assert order_minhash.wide_lacking(order_minhash.wide_bits(a), order_minhash.wide_bits(b)) <= lacks


def test_pairs_at_the_threshold_meet(spark):
    rng = random.Random(9)
    pairs = []
    for n in [5, 6, 9, 12, 14, 20, 40, 80, 150, 300] * 15:
        a = prose(rng, n, 20_000).split()
        edits = set(rng.sample(range(n), n // 5))
        pairs += [" ".join(a), " ".join("e" + w if i in edits else w for i, w in enumerate(a))]
        if n % 5 == 0:  # every fifth word
            pairs += [" ".join(a + ["z%d" % len(pairs)]), " ".join(["f" + w if i % 5 == 2 else w for i, w in enumerate(a)] + ["z%d" % len(pairs)])]
    docs = spark.createDataFrame(list(enumerate(pairs)), "doc_id bigint, text string").repartition(4)
    got = classes(order_minhash.near_duplicates(docs).collect())
    assert sum(got[i] == got[i + 1] for i in range(0, len(pairs), 2)) >= 0.99 * len(pairs) / 2


def test_duplicates_awkward_and_empty(awkward, empty_docs):
    rows = order_minhash.near_duplicates(awkward).collect()
    got = classes(rows)
    assert len(rows) == awkward.count() and sum(r["kept"] for r in rows) == len({r["key"] for r in rows})
    assert all(got[i] == i for i in (50, 51, 52, 53, 54)) and got[None] is None
    assert order_minhash.near_duplicates(empty_docs).count() == 0


def test_op9_catches_copies(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9(spark, sf).collect()
    got = classes(rows)
    assert set(got) == set(docs)
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    assert all(got[i] == got[first[docs[i]]] <= i for i in docs)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)


URLS = [("http://Www.Example.NET/en/1?x=1#y", "www.example.net", "/en/1", "example.net/en/", "allow"), ("https://a.net", "a.net", "", None, "allow"),
        ("https://a.net/", "a.net", "/", "net/", "block"), ("x://example.com/de/a/b?c", "example.com", "/de/a/b", "example.com/de/", "block"),
        ("x://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("http://u.org/fr/?q", "u.org", "/fr/", "org/fr/", "allow"),
        ("no scheme/en", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow")]


def labelled_urls():
    rng = random.Random(7)
    rows = []
    for i in range(600):
        spam = rng.random() < 0.1
        host = rng.choice(("casino-win", "bets")) if spam else rng.choice("abcdefgh")
        rows.append((f"http://{host}.example.com/{rng.choice(('en', 'fr'))}/{i}", int(spam or rng.random() < 0.02)))
    return rows


def test_url_parts_and_base_rules(spark):
    pages = spark.createDataFrame([(i, u[0], 0, "x") for i, u in enumerate(URLS)], "page_id bigint, url string, set int, tokens string")
    rules = url_rules.mine(spark.createDataFrame([], "url string, bad int"))
    got = url_rules.judge(pages, rules).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [u[1:] for u in URLS]
    assert url_rules.judge(pages.limit(0), rules).count() == 0


def plain_rules(rows, support=5, confidence=0.5, odds=2.0, length=3):
    n, bad = len(rows), sum(b for _, b in rows)
    sets, hits = {}, {}
    for tokens, b in rows:
        for k in range(1, length + 1):
            for c in combinations(sorted(tokens), k):
                sets[c] = sets.get(c, 0) + 1
                hits[c] = hits.get(c, 0) + b
    good = {c: h / sets[c] for c, h in hits.items() if h >= support and h / sets[c] >= confidence and h * (n - bad) >= odds * (sets[c] - h) * bad}
    return {c: v for c, v in good.items() if not any(good.get(p, -1) >= v for k in range(1, len(c)) for p in combinations(c, k))}


def test_mined_rules_and_verdicts_equal_brute_force(spark):
    rows = labelled_urls()
    df = spark.createDataFrame(rows + [(None, 1), ("http://x.com/", None)], "url string, bad int")
    tokens = [r["t"] for r in spark.createDataFrame(rows, "url string, bad int").select(url_rules.url_tokens(F.col("url")).alias("t")).collect()]
    want = plain_rules([(t, b) for t, (_, b) in zip(tokens, rows)])
    mined = url_rules.mine(df)
    got = {tuple(sorted(r["rule"])): r["confidence"] for r in mined.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and any("casino" in " ".join(k) for k in got)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id bigint, url string")
    for r in url_rules.judge(pages, mined).collect():
        blocked = any(set(k) <= set(tokens[r["page_id"]]) for k in want)
        assert r["rule"] is None and r["verdict"] == ("block" if blocked else "allow")


def test_rules_where_most_urls_are_bad(spark):
    rows = [(f"http://bad{i % 20}.com/x", 1) for i in range(800)] + [(f"http://good{i % 20}.net/x", 0) for i in range(400)]
    mined = url_rules.mine(spark.createDataFrame(rows, "url string, bad int"))
    verdicts = {r["host"]: r["verdict"] for r in url_rules.judge(spark.createDataFrame(list(enumerate(u for u, _ in rows)), "page_id int, url string"), mined, base=()).collect()}
    assert all((v == "block") == h.startswith("bad") for h, v in verdicts.items())
    assert url_rules.mine(spark.createDataFrame(rows[:800], "url string, bad int")).count() == 0


def test_tokens_that_always_come_together_are_one_item(spark):
    host = "a1.b2.c3.d4.e5.shop-online.com"
    rows = [(f"https://{host}/one/two/three/four?q{i % 3}=1&session={i}#top", 1) for i in range(400)] + [(f"https://w{i}.org/one/{i}", 0) for i in range(400)]
    mined = url_rules.mine(spark.createDataFrame(rows, "url string, bad int")).collect()
    assert any(r["rule"] == ["s:" + host] for r in mined) and all(len(r["rule"]) == 1 for r in mined if "s:com" in r["rule"])


def test_long_urls_and_ties_between_rules(spark):
    rules = spark.createDataFrame([(["w:b"], "w:b", 0.1, 0.9, 3.0), (["w:a"], "w:a", 0.1, 0.9, 3.0), (["w:c"], "w:c", 0.1, 0.8, 3.0)], url_rules_schema())
    deep = ".".join(f"x{i}" for i in range(150)) + ".end"
    pages = [(1, "http://c-b-a.com/"), (2, "http://" + deep + "/" + "p/" * 2000 + "?" + "k&" * 2000)]
    got = {r["page_id"]: r for r in url_rules.judge(spark.createDataFrame(pages, "page_id int, url string"), rules).collect()}
    assert got[1]["mined"] == "w:a" and got[1]["confidence"] == 0.9 and got[2]["verdict"] == "allow"
    suffixes = [t for t in spark.createDataFrame(pages[1:], "page_id int, url string").select(F.explode(url_rules.url_tokens(F.col("url"))).alias("t")).filter("t like 's:%'").toPandas()["t"]]
    assert "s:" + deep in suffixes and len(suffixes) == 151


def url_rules_schema():
    return "rule array<string>, key string, support double, confidence double, odds double"


def test_op2_registered(spark, sf):
    rows = queries.op2(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r["verdict"] in ("allow", "block") for r in rows)


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


def plain_pipeline(spark, sf, pipeline):
    """The stages in plain Python: the same models, then alignments of all pairs, exact targets, and token counts."""
    from noteflow.llm import byte_cnn, ftrl

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    net = queries.language_model(frame)
    docs = frame.toPandas()
    found = byte_cnn.detect(docs["text"], net)
    docs = docs[(found["lang"] != "und").to_numpy() & (found["score"] >= pipeline.MIN_LANGUAGE_SCORE).to_numpy()]
    model = queries.toxicity_model(spark.createDataFrame(docs), spark.read.parquet(f"{sf}/labels.parquet"))
    docs = docs[ftrl.score_texts(docs["text"], model.table(), model.bias, model.bits, ftrl.Hasher()) < 0.5].sort_values("doc_id", ignore_index=True)
    words = [order_minhash.word_hashes(t) for t in docs["text"]]
    label = list(range(len(docs)))
    for i, j in combinations(range(len(docs)), 2):
        if label[i] != label[j] and (docs["text"][i] == docs["text"][j] or order_minhash.similarity_at_least(words[i], words[j], 0.8) is not None):
            lo, hi = sorted((label[i], label[j]))
            label = [lo if x == hi else x for x in label]
    return docs.iloc[sorted(set(label))]


def test_pipeline_equals_brute_force(spark, sf, pipeline):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:3]:
        docs = queries_store(stage(spark, docs, sf))
    want = plain_pipeline(spark, sf, pipeline)
    assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(want["doc_id"])
    mixed = queries_store(pipeline.mix(spark, docs, sf))
    assert mixed.columns == docs.columns
    from .test_sharding_mixing import plain_targets

    sizes, taken = {}, {}
    for t, s in zip(want["text"], want["source"]):
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    target = plain_targets(sizes)
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in sizes)
    packed = pipeline.pack(spark, mixed, sf).collect()
    from noteflow.llm.harmonic_packing import CachedEncoder

    e = CachedEncoder(queries.tokenizer_path())
    assert sum(r["length"] for r in packed) == sum(len(ids) // 4 + 1 for ids in e.encode([r["text"] for r in mixed.collect()]))
    assert sorted({r["doc_id"] for r in packed}) == sorted({r["doc_id"] for r in mixed.collect()})
    run = pipeline.run(spark, sf).collect()
    digest = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert digest(run) == digest(packed)


def queries_store(df):
    from noteflow.llm.storage import store

    return store(df, "test")


def test_stages_on_awkward_and_empty_tables(spark, sf, pipeline, awkward, empty_docs):
    names = awkward.columns
    for given in (awkward, empty_docs):
        docs = given
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert (out.columns == names) == (name != "pack"), name
            docs = queries_store(out)
        assert docs.count() > 0 or given is empty_docs
    kept = pipeline.near_duplicates(spark, awkward, sf).collect()
    assert len(kept) == 46 and sum(r["doc_id"] is None for r in kept) == 1
    told = pipeline.language(spark, awkward, sf).collect()
    assert not {50, 51, 52, 53} & {r["doc_id"] for r in told} and 54 in {r["doc_id"] for r in told}
    assert DOCS.count(",") == len(names) - 1
