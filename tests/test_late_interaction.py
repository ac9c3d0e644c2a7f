"""Late interaction by centroids against all products; kNN in blocks and with a condition."""

import numpy as np
import pytest

from placeloom.operators import late_interaction, search


def made(seed=3, docs=120, themes=12, dim=8):
    rng = np.random.default_rng(seed)
    theme = rng.normal(size=(themes, dim))
    rows = []
    for d in range(docs):
        mine = rng.choice(themes, 2, replace=False)
        rows += [(d, (theme[rng.choice(mine)] + 0.35 * rng.normal(size=dim)).tolist()) for _ in range(int(rng.integers(1, 12)))]
    queries = [(q, t, (theme[(q + t) % themes] + 0.3 * rng.normal(size=dim)).tolist()) for q in range(30) for t in range(3)]
    return rows, queries


def brute(rows, queries, top):
    by_doc, by_query = {}, {}
    for d, v in rows:
        by_doc.setdefault(d, []).append(v)
    for q, _, v in queries:
        by_query.setdefault(q, []).append(v)
    out = {}
    for q, tokens in by_query.items():
        s = {d: float((np.array(tokens) @ np.array(v).T).max(axis=1).sum()) for d, v in by_doc.items()}
        out[q] = sorted(s, key=lambda d: (-round(s[d], 9), d))[:top]
    return out


@pytest.mark.parametrize(("k", "probes"), [(1, 1), (12, 1), (40, 2)])
def test_exact_search_equals_all_products(spark, k, probes):
    rows, queries = made()
    docs = spark.createDataFrame(rows + [(999, None)], "doc long, v array<double>").repartition(3)
    asked = spark.createDataFrame(queries + [(77, 0, None)], "query_id long, token int, q array<double>")
    at = late_interaction.centroids(docs, k)
    table = late_interaction.index(docs, at)
    got = {}
    for r in late_interaction.search(table, at, asked, 5, probes).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.doc
    assert {q: [x[i] for i in sorted(x)] for q, x in got.items()} == brute(rows, queries, 5)
    assert late_interaction.search(table, at, asked.limit(0), 5).count() == 0


def test_recall_without_bounds(spark):
    rows, queries = made(5, 400)
    docs = spark.createDataFrame(rows, "doc long, v array<double>")
    at = late_interaction.centroids(docs, 24)
    found = late_interaction.search(late_interaction.index(docs, at), at, spark.createDataFrame(queries, "query_id long, token int, q array<double>"), 10, 2, exact=False).collect()
    want = brute(rows, queries, 10)
    recall = sum(r.doc in want[r.query_id] for r in found) / sum(map(len, want.values()))
    assert recall >= 0.9


def test_centroids_of_few_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "doc long, v array<double>")
    at = late_interaction.centroids(docs)
    assert at.tolist() == [[1.0, 2.0]]
    assert late_interaction.centroids(docs.limit(0)).shape == (0, 0)


def test_knn_with_a_condition_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "SCORES", 50)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(90, 6))
    rows = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, v array<double>, kind int").repartition(3)
    q = rows.filter("vec_id < 20").selectExpr("vec_id AS query_id", "v AS q")
    got = {}
    for r in search.knn(rows, q, 4, rows["kind"] == 1).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(20):
        s = unit @ unit[i]
        assert [got[i][k] for k in (1, 2, 3, 4)] == sorted((k for k in range(90) if k % 3 == 1), key=lambda k: -s[k])[:4]
