import random

import pytest

# a row of every awkward kind; the extra columns clash with names the operators use inside
EXTRA = "row bigint, key string, score double, shard int, class int, found int, curve int, name string, doc string"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def awkward_rows():
    """Null in every column, empty and white texts, ties, repeated rows, one very long text."""
    rng = random.Random(3)
    extra = (1, "k", 0.5, 2, 3, 4, 5, "n", "d")
    rows = [(i, prose(rng, 30 + i % 7), "en" if i % 3 else "de", f"s{i % 4}", 10, *extra) for i in range(40)]
    rows += [(50, None, "en", "s0", None, *extra), (51, "", "en", "s0", 0, *extra), (52, "  \t\n ", None, None, 4, *extra), (53, "?!", "en", None, 2, *extra),
             (None, "a text without an id", "en", "s1", 5, *[None] * 9), (54, prose(rng, 150_000, 30_000), "en", "s1", 9, *extra)]
    rows += [rows[3], rows[3], rows[40]]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
