"""Inputs on which queries and operators differed from their SQL or did not scale, in small."""

import json
import math
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from placeloom.functions import text, web
from placeloom.llm import kneser_ney
from placeloom.operators import curation, evidence, golden, lookup, places, ranking, search
from placeloom.sources import sinks
from placeloom.streaming import circuits


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables of a data folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_large_places_of_one_spot_are_not_suspicious(spark, folder):
    """Records of one place at one spot, more than merge_audit's size; the SQL of c2_places looks at the span only."""
    d = folder(customer=spark.range(1, 30).filter("id % 17 <> 0 and id % 19 <> 0").select((F.col("id") * 3000).alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")))
    assert max(spark.read.parquet(f"{d}/customer.parquet").count(), 9) > 9
    assert {r.suspicious for r in entry.queries()["c2_places"](spark, d).collect()} == {None}


@pytest.mark.parametrize(("page", "shown"), [("<p>ver&amp</p>", "ver&amp"), ("a&amp;&amp b &lt;", "a&&amp b <"), ("&amp;lt;b &amp;lt c", "<b &lt c"), ("x & y &#65 &#65;", "x & y &#65 A")])
def test_open_references_stay(page, shown):
    assert web._read(page, None)[0] == shown


def test_links_keep_open_references(spark):
    assert web._read('<a href="/p?a=1&copy=2&amp;b=3">x</a>', "https://a.vn/")[1] == ["https://a.vn/p?a=1&copy=2&b=3"]


def test_text_after_a_first_json_value_is_no_json(spark):
    texts = ["12 monkeys", "1,2", "1],[2", '1},{"y":2', '{"a": 1}', " [1] ", "8", "plain", '"x" "y"', '1,"y":2']
    rows = sinks.dead_letters(spark.createDataFrame([(t, t) for t in texts], "t string, payload string"), "payload").collect()
    assert {r.t for r in rows if r.payload == r.t} == {'{"a": 1}', " [1] ", "8"}
    assert all(json.loads(r.payload) == {"raw": r.t} for r in rows if r.payload != r.t)


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_fuzzy_loses_none_where_pieces_are_common(spark):
    """All words and terms share their first letters: these meet by forms, and no task makes all pairs of the common piece."""
    rng = random.Random(3)
    number = lambda: f"000{rng.randrange(10**6):06d}"
    words = sorted({number() for _ in range(150)} | {"00000000a", "aaaaa", "quan pho bat dan gia truyen"})
    terms = sorted({number() for _ in range(150)} | {w[:4] + w[5:] for w in words} | {w[:5] + "x" + w[5:-1] for w in words} | {"quan po batt dan gia truyenn"})
    got = search.fuzzy(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(list(enumerate(words)), "query_id int, word string"), text.edit_allowance)
    allowed = lambda n: 0 if n < 5 else 1 if n <= 8 else 2 if n <= 14 else 3
    want = {(i, t, d) for i, w in enumerate(words) for t in terms if (d := brute_edits(w, t)) <= allowed(len(w))}
    assert {(r.query_id, r.term, r.edits) for r in got.collect()} == want and len(want) > 150


@pytest.mark.parametrize("common", [1, 3, 1000])
def test_common_words_of_names_change_nothing(spark, common):
    rng = random.Random(7)
    stock = ["pho", "quan", "restaurant", "cafe", "giang", "rsstaurant", "thin", "huong"]
    names = [" ".join(rng.choice(stock) for _ in range(rng.randint(1, 3))) for _ in range(80)] + ["pho pho", "", None]
    asked = ["quan pho", "restaurant", "rastaurant cafe", "pho", "huong giang", "giangg huong pho", "quan", ""]
    allowed = lambda n: 0 if n < 5 else 1 if n <= 8 else 2 if n <= 14 else 3

    def score(name, q):
        qw, pw = list(dict.fromkeys(q.split())), set(name.split())
        typo = sum(w not in pw and any(w[0] == x[0] and brute_edits(w, x) <= allowed(len(w)) for x in pw) for w in qw)
        return 8.0 * (name == q) + 4.0 * (f" {q} " in f" {name} ") + 3 * sum(w in pw for w in qw) / len(qw) + 2 * typo / len(qw)

    want = {}
    for i, q in enumerate(asked):
        ranked = sorted((-round(s, 9), k) for k, n in enumerate(names) if q and n and (s := score(n, q)) > 0)[:4]
        want |= {(i, k): (-s, r) for r, (s, k) in enumerate(ranked, 1)}
    got = curation.place_text_search(spark.createDataFrame(list(enumerate(names)), "place_id long, name string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, name string"), 4, common)
    assert {(r.query_id, r.place_id): (round(r.score, 9), r["rank"]) for r in got.collect()} == want


def test_equal_candidates_meet_as_one(spark):
    """1,200 equal candidates of a query made 720,000 pairs; candidates without anything to be the same by stay apart."""
    rows = [(1, i, "pho bat dan", "so 1 pho hue", None, "a.vn", 21.0, 105.8) for i in range(1200)] + [(1, 2000 + i, "", "", None, "a.vn", 21.0, 105.8) for i in range(3)]
    rows += [(1, 3000 + i, "", "", "+849", None, None, None) for i in range(3)] + [(2, 4000 + i, "com", "", None, None, None, None) for i in range(3)] + [(1, 5000, "pho bat dann", "so 1 pho hue", None, None, None, None)]
    c = spark.createDataFrame(rows, "query_id long, candidate long, name string, address string, phone string, domain string, lat double, lon double")
    got = {r.candidate: r.entity for r in curation.same_entities(c).collect()}
    assert got == {i: 0 for i in range(1200)} | {2000 + i: 2000 + i for i in range(3)} | {3000 + i: 3000 for i in range(3)} | {4000 + i: 4000 + i for i in range(3)} | {5000: 0}


def test_autocomplete_equals_all_hits(spark):
    rng = random.Random(2)
    point = lambda: (None, None) if rng.random() < 0.1 else (10 + rng.randrange(4) * 0.05, 105 + rng.randrange(3) * 0.05)
    places_ = [(i, [f"pho ha {rng.randrange(30)}", "quan pho"] if i % 3 else [f"pho hue {i % 7}"], *point()) for i in range(300)]
    asked = [(i, rng.choice(["pho", "pho h", "pho ha 1", "quan", "x"]), *point()) for i in range(40)] + [(90, "pho", 20.0, 100.0), (91, "pho", 60.0, 179.9999), (92, "pho", 60.0, 179.9999)]
    places_ += [(900, ["pho xa"], 60.0, -179.9999)]

    def metres(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        return 2 * 6371000 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2))

    want = set()
    for i, prefix, y, x in asked:
        hits = []
        for k, names, la, lo in places_:
            h = max((4.5 if j == 0 else 1.0) * n.startswith(prefix) for j, n in enumerate(names))
            if h:
                hits.append((-round(h * (1.0 if y is None or la is None else 0.5 ** ((metres(y, x, la, lo) / 2000) ** 2)), 9), k))
        want |= {(i, k, r) for r, (_, k) in enumerate(sorted(hits)[:5], 1)}
    p = spark.createDataFrame(places_, "place_id long, names array<string>, lat double, lon double")
    got = search.autocomplete(p, spark.createDataFrame(asked, "query_id long, prefix string, lat double, lon double"), 5)
    assert {(r.query_id, r.place_id, r["rank"]) for r in got.collect()} == want


def test_nearest_within_equals_the_nearest_of_all(spark):
    rng = random.Random(4)
    p = spark.createDataFrame([(i, 10 + rng.randrange(5) * 0.01, 105 + rng.randrange(5) * 0.01) for i in range(400)] + [(999, None, 105.0)], "place_id long, lat double, lon double")
    q = p.filter("place_id % 7 = 0").withColumnRenamed("place_id", "query_id")
    old = places.nearest(places.within_radius(q, p, 2500.0).withColumn("dist_m", F.round("dist_m", 3)), 5)
    new = places.nearest_within(q, p, 2500.0, 5)
    rows = lambda df: sorted((r.query_id, r["rank"], r.place_id, r.dist_m) for r in df.collect())
    assert rows(new) == rows(old)


def test_known_place_takes_the_smallest_of_equal_names(spark):
    c = spark.createDataFrame([(1, 0, "quan pho so 1"), (2, 1, "qan pho so 1"), (3, 0, "quan pho so 1")], "candidate_id long, province int, name string")
    p = spark.createDataFrame([(i, i % 2, "quan pho so 1") for i in range(10, 40)], "place_id long, province int, name string")
    assert sorted((r.candidate_id, r.place_id, r.edits) for r in lookup.known_place(c, p).collect()) == [(1, 10, 0), (2, 11, 1), (3, 10, 0)]


@pytest.mark.parametrize("broadcast_ids", [10, 500_000])
def test_every_trusted_document_trains_the_model(spark, monkeypatch, broadcast_ids):
    """Of 20,050 trusted documents, a model of at most 20,000 left 50 out."""
    seen = []
    train = kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda docs, text_col="text": (seen.append(docs.count()), train(docs.limit(50), text_col))[1])
    docs = spark.range(20_050).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("ab").alias("text"))
    kneser_ney.classify(docs, docs.select("doc_id"), broadcast_ids=broadcast_ids)
    assert seen == [20_050]


@pytest.mark.parametrize("place", [None, "f07 x", "hue"])
def test_forms_that_cannot_be_shown_change_no_variant(spark, place):
    forms = sorted([f"f{i:02d}" for i in range(60)] + ["f03 ", " f05", "an pho"])
    q = spark.createDataFrame([(1, "an pho hue x", place)], "query_id long, query string, locality string")
    out = lookup.expand_queries(q, spark.createDataFrame([("pho", f) for f in forms] + [("hue", f) for f in forms], "canon string, form string"), 8)
    n = "an pho hue x"
    base = [n] + [f" {n} ".replace(f" {c} ", f" {f} ").strip(" ") for c in ("hue", "pho") for f in forms]
    near = [v if not place or place in v else f"{v} {place}" for v in base]
    assert [r.variant for r in sorted(out.collect(), key=lambda r: r.i)] == list(dict.fromkeys([n] + near + base))[:8]


def exchanged(df):
    """The keys by which rows of df are shuffled, without the numbers of columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def test_expanded_terms_are_not_shuffled(spark):
    """A query's forms are many times its terms; queries of the same terms have them from one list."""
    terms = spark.createDataFrame([(i, x) for i in range(300) for x in ("phở", "nhà" if i % 2 else "")], "query_id long, term string")
    synonyms = spark.createDataFrame([("phở", f"pho {i}") for i in range(20)], "canon string, form string")
    got = lookup.expand_synonyms(terms, synonyms)
    assert exchanged(got) == []
    forms = {"phở"} | {f"pho {i}" for i in range(20)}
    assert {(r.query_id, r.term) for r in got.collect()} == {(i, x) for i in range(300) for x in forms | ({"nhà"} if i % 2 else set())}
    assert got.count() == 300 * 21 + 150


def test_a_documents_words_are_shuffled_once(spark):
    """Postings meet queries where the document is: no rows of (query, document) or (document, term) are shuffled."""
    docs = spark.createDataFrame([(i, [f"w{i % 7}", "all", "all"]) for i in range(60)], "doc long, words array<string>")
    asked = spark.createDataFrame([(q, [f"w{q}", "all", "all"]) for q in range(5)], "query_id long, words array<string>")
    count = lambda df, key, w: search.inverted(df, key, "words").select(key, "term", F.col("tf").cast("double").alias(w))
    found = search.sparse_search(count(docs, "doc", "w"), count(asked, "query_id", "qw"), 3)
    for df in (found, search.bm25(docs, asked, 3)):
        assert set(exchanged(df)) <= {"doc", "query_id", "term"}
        assert {(r.query_id, r["rank"], r.doc) for r in df.collect()} == {(q, i + 1, q + 7 * i) for q in range(5) for i in range(3)}
    assert {r.score for r in found.collect()} == {5.0}


def test_sources_are_counted_where_they_are(spark):
    """Claims do not carry sources' words about, and rows of one source add up, as in the SQL of j19_claim_support."""
    c = spark.createDataFrame([(1, ["a", "b", "c", "d"])], "claim_id long, words array<string>")
    s = spark.createDataFrame([(7, ["a"]), (7, ["b", "x"]), (8, ["c"]), (9, ["a", "b", "c", "d", "a"])], "source_id long, words array<string>")
    got = evidence.claim_support(c, s, 0.5)
    assert exchanged(got) == ["source_id"]
    assert {(r.source_id, r.overlap) for r in got.collect()} == {(7, 0.5), (9, 1.0)}


def test_counts_of_domains_hold_no_query_in_one_task(spark):
    rows = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3), ("q", None, 4), ("r", "a", 5), (None, "a", 6), (None, "b", 7)], "q string, d string, i int")
    got = ranking.domain_share_penalty(rows, "q", "d")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.i: round(r.diversity, 6) for r in got.collect()} == {1: 0.15, 2: 0.15, 3: 0.075, 4: 0.075, 5: 0.0, 6: 0.15, 7: 0.15}


def test_best_of_a_query_holds_no_query_in_one_task(spark):
    lists = spark.createDataFrame([(1, "s", i, i, 0.5) for i in range(1, 9)] + [(1, "t", 3, 1, 0.5)], "q int, sub string, k int, rank int, relevance double")
    got = golden.multi_query_rerank(lists, "q", "k", spark.createDataFrame([(3, 1.0)], "k int, authority double"), 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "max(fused" not in plan[: plan.index("Filter")] and len(re.findall(r"\bWindow \[", plan.split("Initial Plan")[0])) == 1
    assert [(r.k, r["rank"]) for r in got.orderBy("rank").collect()] == [(3, 1), (1, 2)]


def test_only_the_best_rows_get_vectors(spark):
    rows = spark.createDataFrame([(q, "lexical", i + 1, f"u{i}", f"d{i}", 0.5, 0.5, 0.5) for q in (1, 2) for i in range(40)], "query_id int, provider string, position int, url string, domain string, authority double, freshness double, geo double")
    seen = []
    add = lambda best: (seen.append(best.count()), best.withColumn("semantic", F.lit(0.5)))[1]
    late = ranking.rank_search(rows, 3, semantic=add).collect()
    assert seen == [12]
    assert sorted(late) == sorted(ranking.rank_search(rows.withColumn("semantic", F.lit(0.5)), 3).collect())


def test_cached_hits_meet_as_matrices(spark):
    rng = random.Random(3)
    v = [(i, i % 3 or None, i // 2, [rng.uniform(-1, 1) for _ in range(4)] if i % 11 else [0.0] * 4) for i in range(200)] + [(900, 1, 5, None)]
    cached = spark.createDataFrame(v, "hit long, scope int, stored_at long, v array<double>")
    asked = cached.filter("hit % 5 = 0").toDF("query_id", "scope", "at", "q")
    got = curation.cached_hits(asked, cached, 0.6)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b) or 1)
    want = {}
    for q, s, at, a in v:
        hits = [(t, h, cos(a, b)) for h, z, t, b in v if a and b and s is not None and z == s and t < at and cos(a, b) >= 0.6]
        if q % 5 == 0 and hits:
            want[q] = min(hits)
    assert want and {r.query_id: (r.hit, round(r.score, 9)) for r in got.collect()} == {q: (h, round(c, 9)) for q, (_, h, c) in want.items()}


def test_addresses_are_parsed_by_many_tasks(spark, folder):
    """Records come from a file of few bytes, but parsing takes long."""
    d = folder(customer=spark.range(60).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")).coalesce(1))
    assert "REPARTITION_BY_NUM" in entry.queries()["f12_address_parts"](spark, d)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("common", "threshold"), [(30, 0.62), (3, 0.62), (3, 0.7), (0, 0.55)])
def test_records_of_one_crowded_cell_meet_as_classes(spark, monkeypatch, common, threshold):
    """records of one spot or unit that share common words only; all pairs of them were scored."""
    from test_places import brute_components, records

    monkeypatch.setattr(places, "COMMON", common)
    rng = random.Random(12)
    rows = []
    for i in range(500):
        name = rng.choice(["pho ha {}", "pho ha", "ha pho", "cua hang pho ha {}", "pho {}", "pho pho"]).format(rng.choice([i, i // 5]))
        spot = rng.choice([None, (10.0, 105.0), (10.0 + rng.randint(0, 3) * 0.0006, 105.0), (10.004, 105.0)])
        rows.append((i, name, rng.choice([None, f"+84{rng.randint(0, 200)}"]), rng.choice([None, "a.vn", f"b{i // 4}.vn"]), rng.choice([None, "food", "shop"]), rng.choice([1, 2, None]), *(spot or (None, None))))
    r = records(spark, rows)
    assert {x.record_id: x.place_id for x in places.resolve(r, threshold).collect()} == brute_components(spark, r, threshold)
    crowd = records(spark, [(i, f"pho ha {i}", None if i % 3 else f"+84{i}", None if i % 5 else f"{i}.vn", "food", 1, *((10.0, 105.0) if i % 2 else (None, None))) for i in range(600)])
    if common:  # at 0 each word is common, and each record a class
        assert places.candidate_pairs(crowd).count() < 5 * 600


def test_pages_are_read_in_pieces(spark):
    """of a batch of pages only PAGES at a time are Python strings."""
    n = 2 * web.PAGES + 7
    pages = [(i, None if i % 5 == 0 else f"<p>page {i}</p><a href='/x{i}'>l</a>", None if i % 7 == 0 else "https://a.vn/") for i in range(n)]
    got = spark.createDataFrame(pages, "id long, html string, url string").coalesce(1).select("id", web.page_parts(F.col("html"), F.col("url")).alias("p")).collect()
    assert {r.id: (r.p.text, r.p.links) for r in got} == {i: web._read(h, u) for i, h, u in pages}


@pytest.mark.parametrize("settings", [{}, {"frequent": 0}, {"frequent": 3, "tile": 500}])
def test_sets_of_near_copies_go_to_groups_of_pairs(spark, monkeypatch, settings):
    """a set went along with each of its pairs, and every shingle was moved with its set's key."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 5000)}"
    base, common = [word() for _ in range(120)], [word() for _ in range(20)]
    near = [base[:k] + ["x", word()] + base[k + 2 :] for k in rng.sample(range(110), 40)]
    texts = near + near[:5] + [[word() for _ in range(30)] + common for _ in range(30)] + [["a"], common]
    grams = [frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in texts]
    first = [i for i, g in enumerate(grams) if g and grams.index(g) == i]
    want = {(i, j): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in first for j in first if i < j and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    moved, compared = [], evidence._compared

    def seen(pairs, sets, least):
        moved.append((pairs.count(), sets.count()))
        return compared(pairs, sets, least)

    monkeypatch.setattr(evidence, "_compared", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, w array<string>")
    assert {(r.a, r.b): r.jaccard for r in evidence.shingle_pairs(docs, "k", "w", **settings).collect()} == want
    (pairs, sets), = moved
    assert len(want) <= pairs <= len(first) ** 2 / 2 and (settings.get("tile") or sets < pairs)


def test_a_circuit_is_read_and_written_once_a_batch():
    """a key's state was asked for in four messages and its calls were written one by one, with DataFrames made of each key."""
    asked = []

    class State:
        value = None

        def exists(self):
            asked.append("exists")
            return self.value is not None

        def get(self):
            asked.append("get")
            return self.value

        def update(self, value):
            asked.append("update")
            self.value = value

        def put(self, values):
            asked.append("put")

    class Handle:
        made = State()
        getValueState = getListState = lambda self, *a: self.made
        registerTimer = deleteTimer = lambda self, at: asked.append("timer")

    rules, rng = circuits.Rules(window=5, seconds=40.0), random.Random(2)
    made = circuits.Circuit(rules)
    made.init(Handle())
    call = Row("t", "event_id", "outcome", "ms", "results")
    log = [call(float(rng.randrange(300)), i, rng.choice([*circuits.QUALITY, "other"]), float(rng.randrange(6000)), rng.randrange(9)) for i in range(200)]
    window = []
    for k in range(0, 200, 20):  # a batch's calls are later or earlier than those of the batches before
        before = len(asked)
        rows = list(made.handleInputRows(("p",), iter(log[k : k + 20]), None))
        assert [a for a in asked[before:] if a != "timer"] == ["get", "update"]
        for r, c in zip(rows, sorted(log[k : k + 20]), strict=True):
            window = [w for w in [*window, c] if w.t >= c.t - 40.0][-5:]
            n, middle = len(window), sorted(w.ms for w in window)[round(0.5 * (len(window) - 1))]
            fast = 1.0 if middle <= 3000.0 else 3000.0 / middle
            good = sum(circuits.QUALITY.get(w.outcome, 0.2) for w in window) / n
            want = 0.55 * good + 0.2 * min(1.0, sum(w.results for w in window) / n / 5.0) + 0.15 * fast + 0.1 * (1 - sum(w.outcome == "captcha" for w in window) / n)
            assert (r.key, r.event_id) == ("p", c.event_id) and r.score == pytest.approx(max(0.0, min(1.0, want)), abs=1e-12)
