"""Searches of the stored index against scoring every document."""

import math
import random
from collections import Counter

import pytest

from placeloom.operators import text_index

FIELDS = ["title", "context", "description"]
SCHEMA = "doc long, title array<string>, context array<string>, description array<string>, term string"


def brute(docs, queries, weights, top):
    rows = [(i, f, w) for i, *fields in docs for f, w in zip(FIELDS, fields) if f in weights and w]
    n = Counter(f for _, f, _ in rows)
    mean = {f: sum(len(w) for _, g, w in rows if g == f) / n[f] for f in n}
    df = Counter((f, t) for _, f, w in rows for t in set(w))
    out = {}
    for q, words in queries:
        best = {}
        for i, f, w in rows:
            tf = Counter(w)
            s = weights[f] * sum(math.log(1 + (n[f] - df[f, t] + 0.5) / (df[f, t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / mean[f])) for t in set(words or []) if tf[t])
            if any(tf[t] for t in words or []):
                best[i] = max(best.get(i, 0.0), s)
        for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:top], 1):
            out[q, r] = round(s, 7)
    return out


@pytest.mark.parametrize("first_ranges", [1, 4])
def test_search_equals_scoring_everything(spark, tmp_path, first_ranges):
    rng = random.Random(6)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    pick = lambda n: [rng.choice(common if rng.random() < 0.7 else rare) for _ in range(n)]
    docs = [(i, pick(rng.randint(0, 4)), pick(rng.randint(1, 40)), pick(rng.randint(0, 9)) or None) for i in range(400)] + [(900, None, None, None), (901, [], [], [])]
    path = str(tmp_path / "index")
    text_index.build(spark.createDataFrame([(*d, "x") for d in docs], SCHEMA).repartition(3), FIELDS, path, range_docs=16)
    queries = [(q, pick(rng.randint(1, 6))) for q in range(25)] + [(90, ["nowhere"]), (91, []), (92, None), (93, ["c1", "c1", "r5"])]
    asked = spark.createDataFrame(queries, "query_id long, words array<string>")
    for weights in ({"title": 3.0, "context": 2.0, "description": 1.0}, {"context": 1.0}):
        got = text_index.search(spark, path, asked, 5, weights, first_ranges).collect()
        assert {(r.query_id, r["rank"]): round(r.score, 7) for r in got} == brute(docs, queries, weights, 5)
    # a rare word's few ranges suffice: most others are bounded below the fifth document
    one = text_index.search(spark, path, spark.createDataFrame([(1, ["r5", "c1"])], "query_id long, words array<string>"), 1, None, first_ranges).collect()
    assert len(one) == 1


def test_common_words_are_cut_into_ranges(spark, tmp_path):
    docs = spark.range(1000).selectExpr("id AS doc", "array('all') AS title", "array('all', concat('w', id)) AS context", "CAST(NULL AS array<string>) AS description")
    text_index.build(docs, FIELDS, str(tmp_path / "i"), range_docs=50)
    p = spark.read.parquet(f"{tmp_path}/i/postings").filter("term = 'all' AND field = 'title'").selectExpr("size(docs) AS n").collect()
    assert len(p) == 20 and sum(r.n for r in p) == 1000 and max(r.n for r in p) < 100
    text_index.build(docs.limit(0), FIELDS, str(tmp_path / "e"))
    assert text_index.search(spark, str(tmp_path / "e"), spark.createDataFrame([(1, ["all"])], "query_id long, words array<string>"), 3).count() == 0
