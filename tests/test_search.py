from placeloom.functions import text
from placeloom.operators import curation, evidence, ranking, search
from placeloom.operators.search import fuzzy


def test_fuzzy_finds_all_that_the_rule_allows(spark):
    terms = ["ho chi minh", "saigon", "hue", "thanh pho ho chi minh", "da nang", "hai phong", "nha trang city", ""]
    words = ["xo chi minj", "seigon", "saigom", "hue", "xhanh pho ho chx minj", "o chi min", "xho chi minhx", "hxi phonk", "ha trang citz", "dx nang", ""]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    most = lambda w: 0 if len(w) < 5 else 1 if len(w) <= 8 else 2 if len(w) <= 14 else 3
    want = {(w, t, edits(w, t)) for w in words for t in terms if edits(w, t) <= most(w)}
    assert ("xo chi minj", "ho chi minh", 2) in want
    got = fuzzy(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(list(enumerate(words)), "query_id int, word string"), text.edit_allowance)
    assert {(r.word, r.term, r.edits) for r in got.collect()} == want


def test_knn_and_blocks_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v[5] = 0
    v[7] = v[8]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "vec_id long, v array<double>").repartition(3)
    q = rows.filter("vec_id % 6 = 0").selectExpr("vec_id AS query_id", "v AS q")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    got = {}
    for r in search.knn(rows, q, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for i in range(0, 60, 6):
        s = unit @ unit[i]
        assert [x for _, x in sorted(got[i])] == sorted(range(60), key=lambda k: (-round(s[k], 12), k))[:4]
    assert search.in_blocks(q, "query_id", lambda some: some, 3).count() == 10
    assert search.knn(rows, q.limit(0), 4).count() == 0


def test_autocomplete_and_same_entities(spark):
    p = spark.createDataFrame([(1, ["pho ha", "quan pho"], 10.0, 105.0), (2, ["pho ha noi"], 10.02, 105.0), (3, ["bun"], None, None)], "place_id long, names array<string>, lat double, lon double")
    q = spark.createDataFrame([(1, "pho h", 10.0, 105.0), (2, "quan", None, None), (3, "zz", None, None), (4, "", None, None)], "query_id long, prefix string, lat double, lon double")
    got = [(r.query_id, r.place_id, round(r.score, 3), r["rank"]) for r in search.autocomplete(p, q, 5).orderBy("query_id", "rank").collect()]
    assert got[0] == (1, 1, 4.5, 1) and got[1][:2] == (1, 2) and 1.8 < got[1][2] < 2.0 and got[2:] == [(2, 1, 1.0, 1)]
    same = "xa cong vien nuoc dam sen moi"
    c = spark.createDataFrame([(1, i, n, "12 le loi quan 1", None, None, None, None) for i, n in enumerate([same, "z" + same[1:-1] + "z", "bun"])], "query_id long, candidate long, name string, address string, phone string, domain string, lat double, lon double")
    assert {r.candidate: r.entity for r in curation.same_entities(c).collect()} == {0: 0, 1: 0, 2: 2}  # edits at both ends


def test_pairs_and_support_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 80)}" for _ in range(40)] for _ in range(12)]
    texts = [t for b in base for t in (b, b[:38] + ["x", "y"], b[:20] + b[22:], b)] + [["a"], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, w array<string>")
    grams = [frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    first = [min(j for j in range(len(texts)) if grams[j] == g) for g in grams]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if first[i] == i and first[j] == j and grams[i] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    assert want and {(r.a, r.b) for r in evidence.shingle_pairs(docs, "k", "w").collect()} == want
    c = spark.createDataFrame([(i, rng.sample(sorted({w for b in base for w in b}), rng.randint(1, 7))) for i in range(30)] + [(50, [])], "claim_id long, words array<string>")
    claims, found = {r.claim_id: set(r.words) for r in c.collect()}, docs.selectExpr("k AS source_id", "w AS words")
    want = {(i, j): len(ws & set(t)) / len(ws) for i, ws in claims.items() if ws for j, t in enumerate(texts) if len(ws & set(t)) / len(ws) >= 0.5}
    assert {(r.claim_id, r.source_id): r.overlap for r in evidence.claim_support(c, found, 0.5).collect()} == want


def test_place_components(spark):
    row = spark.createDataFrame([(1, 5, 2.0, None, "food", ["retail"], None, 0.5, 9, None, None, 0, None), (1, 6, 4.0, 0.0, "food", ["food"], 1.0, 1.0, 3, "open", 5.0, 1000, True)], "q long, k long, text_score double, distance_m double, wanted string, categories array<string>, confidence double, freshness double, source_count long, status string, rating double, review_count long, open_now boolean")
    a, b = (r.components.asDict() for r in ranking.rank_places(row, "q", "k", 5).orderBy("k").collect())
    assert a == {"text": 0.5, "distance": 0.5, "category": 0.6, "confidence": 0.0, "freshness": 0.5, "sources": 1.0, "status": 0.6, "rating_quality": 0.7, "popularity": 0.0, "open_now_boost": 0.5}
    assert b["text"] == b["distance"] == b["category"] == b["open_now_boost"] == 1.0 and 0.99 < b["rating_quality"] < 1 and b["popularity"] > 0.999
    assert [r.k for r in ranking.rank_places(row, "q", "k", 1, "popularity").collect()] == [6]
