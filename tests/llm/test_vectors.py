import numpy as np
import pytest
from noteflow.llm import components, cover_tree, queries, stable_ann
from noteflow.llm.vectors import usable

VECS = "vec_id bigint, embedding array<float>, label int, vec string, cell int, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "y") for i, v in rows], VECS).repartition(3)


@pytest.fixture(scope="module")
def clouds():
    """Random points, groups of near copies of sizes up to 300, exact ties, and a chain of links."""
    rng = np.random.default_rng(1)
    x = [rng.normal(size=16) for _ in range(500)]
    for size in (2, 5, 30, 300):
        c = rng.normal(size=16)
        x += [c + rng.normal(size=16) * 0.05 for _ in range(size)]
    x += [x[0], x[0] * 3]
    a, b = np.eye(16)[0], np.eye(16)[1]
    x += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 1.5, 0.25)]
    return np.array(x, np.float32)


def awkward_rows(x):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [float("inf")] + [1.0] * 15), (9005, [None] + [1.0] * 15),
           (9006, [1.0, 2.0]), (9100, None), (None, [1.0] * 16)]
    return rows + odd + [rows[7], rows[7]]


def plain_links(x, least=0.95):
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    linked = u @ u.T >= least
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(linked, label[None], len(x)).min(axis=1))
        if (new == label).all():
            return linked.sum(axis=1), label
        label = new


@pytest.mark.parametrize("block_rows", [8192, 100])
def test_cover_tree_equals_all_pairs(spark, clouds, block_rows):
    rows = {}
    for r in cover_tree.near_duplicates(frame(spark, awkward_rows(clouds)), block_rows=block_rows).collect():
        assert rows.setdefault(r["vec_id"], r) == r
    links, label = plain_links(clouds)
    assert [rows[i]["n_links"] for i in range(len(clouds))] == links.tolist()
    assert [rows[i]["component_id"] for i in range(len(clouds))] == label.tolist()
    assert all(rows[i]["kept"] == (label[i] == i) for i in range(len(clouds)))
    for i in (9001, 9002, 9003, 9004, 9005, 9006, 9100):
        assert (rows[i]["n_links"], rows[i]["component_id"], rows[i]["kept"]) == (0, i, True)
    assert (rows[None]["n_links"], rows[None]["component_id"], rows[None]["kept"]) == (0, None, False)


def test_tree_covers_its_rows(clouds):
    x = clouds / np.sqrt((clouds * clouds).sum(axis=1))[:, None]

    def walk(node):
        assert (cover_tree.distances(x[node.rows], node.centre[None]) <= node.radius + 1e-6).all()
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            for c in node.children:
                walk(c)

    walk(cover_tree.build(x, np.arange(len(x)), 2.0, 0.04, leaf=20))


def test_op8_registered(spark, sf):
    got = queries.op8(spark, sf)
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()])
    links, label = plain_links(x)
    assert [(r["n_links"], r["component_id"]) for r in got.orderBy("vec_id").collect()] == list(zip(links.tolist(), label.tolist()))


@pytest.mark.parametrize("operator", [cover_tree.near_duplicates, stable_ann.search])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], VECS)).count() == 0


def nearest(x, q, k):
    d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
    d[q] = np.inf
    top = np.lexsort((np.arange(len(x)), d))[:k]
    return top.tolist(), d[top]


@pytest.mark.parametrize("cell_rows", [8192, 64])
def test_search_recall_scores_and_order(spark, clouds, cell_rows):
    rows = stable_ann.search(frame(spark, awkward_rows(clouds)), cell_rows=cell_rows, query_rows=5).orderBy("query_id", "rank").collect()
    queries_ = [i for i in range(0, len(clouds), 100)]
    assert sorted({r["query_id"] for r in rows}) == queries_
    hits = 0
    for q in queries_:
        got = [r for r in rows if r["query_id"] == q]
        ids, d = nearest(clouds, q, 10)
        assert [r["rank"] for r in got] == list(range(1, 11)) and q not in [r["vec_id"] for r in got]
        assert [(r["score"], r["vec_id"]) for r in got] == sorted((r["score"], r["vec_id"]) for r in got)
        for r in got:
            exact = np.sqrt(((clouds[q].astype(float) - clouds[r["vec_id"]].astype(float)) ** 2).sum())
            assert abs(exact - r["score"]) < 1e-9
        hits += len({r["vec_id"] for r in got} & set(ids))
    assert hits >= 0.9 * 10 * len(queries_)


def test_search_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in data], np.array([r["embedding"] for r in data])
    got = {}
    for r in queries.op7(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = [i for i, v in enumerate(ids) if v % 100 == 0]
    assert set(got) == {ids[i] for i in asked}
    hits = sum(len(got[ids[i]] & {ids[j] for j in nearest(x, i, 10)[0]}) for i in asked)
    assert hits >= 0.9 * 10 * len(asked)


def test_search_with_few_candidates(spark):
    rows = stable_ann.search(frame(spark, [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (100, [1.0, 1.0])])).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 1, 1.0), (0, 2, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 1, 2**0.5)]


def test_chi_square_quantile():
    assert abs(stable_ann.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(stable_ann.chi_square_quantile(0.5, 2) - 1.38629) < 1e-4


def test_usable_rules(spark, clouds):
    got = usable(frame(spark, awkward_rows(clouds)), "vec_id", "embedding").collect()
    assert sorted(r["id"] for r in got) == list(range(len(clouds)))


def test_components_of_chains_stars_and_pairs(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1400)]
    rows = chain + star + [(2000, 2001), (2001, 2000), (2002, 2002)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(rows, "a bigint, b bigint"), "a", "b").collect()}
    assert set(got.values()) == {0, 1000, 2000, 2002} and len(got) == 301 + 400 + 3
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1400)) and got[2001] == 2000


def test_copies_whose_projections_differ_by_rounding_all_count():
    import pandas as pd

    vec, proj = np.ones(4), np.arange(1.0, 9.0)
    n = 640
    ids = np.arange(n)[::-1].copy()
    projs = np.tile(proj, (n, 1))
    projs[300:] += np.spacing(projs[300:])  # the smaller ids
    ask = pd.DataFrame({"q_id": [-1], "q_vec": [vec], "q_proj": [proj], "q_bound": [np.inf]})
    got = stable_ann.search_block(np.tile(vec, (n, 1)), projs, ids, ask, 10, stable_ann.chi_square_quantile(0.98, 8))
    assert sorted(got["vec_id"]) == list(range(10)) and not got["score"].any()
