import array
import random
import zlib
from collections import defaultdict

from noteflow.llm import harmonic_packing, queries


def test_cuts_keep_lengths_and_classes():
    rng = random.Random(1)
    for n in [*range(1, 400), *(rng.randint(1, 9000) for _ in range(500))]:
        pieces = harmonic_packing.cuts(n, 2048)
        assert sum(p for p, _ in pieces) == n
        assert all(2048 // (k + 1) < p <= 2048 // k for p, k in pieces)


def test_encoder_equals_the_tokenizer():
    e = harmonic_packing.CachedEncoder(queries.tokenizer_path(), most=50)
    rng = random.Random(2)
    letters = "abAB'sStTlLdDmMrRveE019 _-.,\n\tßéÉΣσ́ <|>😀日« ªºµÀÿİıŉſŁ²½"
    given = ["it's IT'S 12ab x́ <|endoftext|> a\x1cb", "", "a b", "tête, «tête», größe."]
    given += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    assert list(e.encode(given)) == e.direct(given)


def check(rows, texts):
    """Every id once, offsets gapless, sequences within the capacity; returns sequences and tokens."""
    e = harmonic_packing.CachedEncoder(queries.tokenizer_path())
    want = sorted(zlib.crc32(e.direct([t or ""])[0] + array.array("I", [1]).tobytes()) for t in texts)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["row"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in docs.values():
        pieces.sort(key=lambda r: r["start"])
        at = 0
        for r in pieces:
            assert r["start"] == at and r["doc_tokens"] == pieces[0]["doc_tokens"]
            at += r["length"]
        assert at == pieces[0]["doc_tokens"]
    assert sorted(zlib.crc32(b"".join(bytes(r["ids"]) for r in p)) for p in docs.values()) == want
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    return len(sequences), sum(r["length"] for r in rows)


def test_pack_whole_table_with_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    rows = harmonic_packing.pack(docs, queries.tokenizer_path()).collect()
    n, tokens = check(rows, [r["text"] for r in docs.collect()])
    assert n * 2048 - tokens <= 0.02 * n * 2048 + 2 * 2048
    packed = queries.op5(spark, sf).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted((r["doc_id"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in rows)


def test_pack_awkward_and_empty(awkward, empty_docs):
    rows = harmonic_packing.pack(awkward, queries.tokenizer_path())
    check(rows.collect(), [r["text"] for r in awkward.collect()])
    made = harmonic_packing.sequences(rows).collect()
    assert all(len(r["tokens"]) == 2048 * 4 for r in made)
    assert harmonic_packing.pack(empty_docs, queries.tokenizer_path()).count() == 0


def test_first_fit_equals_the_scan_over_bins():
    import random

    rng = random.Random(6)
    for _ in range(50):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 60))]
        bins, offsets, used = [], [], []
        for n in lengths:
            k = next((i for i, u in enumerate(used) if u + n <= 40), len(used))
            if k == len(used):
                used.append(0)
            bins.append(k)
            offsets.append(used[k])
            used[k] += n
        assert harmonic_packing.first_fit(lengths, 40) == (bins, offsets)


def test_cut_parts_skip_the_pattern_and_keep_their_ids():
    e = harmonic_packing.CachedEncoder(queries.tokenizer_path())
    words = ["Été", "déjà", "ÀÉÎ", "straße", "don't", "x86-64", "naïve!!", "Ünï—cödé", "ẞ", "İx", "ΣΑΣ", "áb", "''s", "A1b2"]
    whole = [" ".join(words), *words]
    assert list(e.encode(whole)) == e.direct(whole)
    slow = []
    e = harmonic_packing.CachedEncoder(queries.tokenizer_path())
    e.direct = lambda texts: slow.extend(texts) or []
    assert list(e.encode(["Ofreingerha Étréeux, esmiosción andthedeand"])) and not slow
    assert e.line(["étréeux", "esmiosción"], e.merger) == e.line(["étréeux", "esmiosción"])
