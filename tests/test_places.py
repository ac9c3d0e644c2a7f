from pyspark.sql import functions as F

from placeloom.functions import text, web
from placeloom.operators import places
from placeloom.plans.graph import components
from placeloom.queries.place_queries import normal

SF = "/root/testdata/sf0.001"


def test_components_follow_chains(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7)], "u long, v long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(5, 2), (4, 2), (3, 2), (2, 2), (9, 8), (8, 8)}


def test_resolve_does_not_depend_on_order(spark):
    r = normal(spark, SF)
    a = {(x.record_id, x.place_id) for x in places.resolve(r).collect()}
    assert a == {(x.record_id, x.place_id) for x in places.resolve(r.orderBy(F.desc("record_id"))).collect()}
    expected = {}
    for x in r.select("record_id", "p", "lat").collect():
        if x.lat is not None:
            expected.setdefault(x.p, []).append(x.record_id)
    got = dict(a)
    assert all(len({got[i] for i in ids}) == 1 for ids in expected.values())


def test_phone_forms(spark):
    rows = spark.createDataFrame([("0901234567",), ("+84901234567",), ("84 901 234 567",), ("12",), (None,), ("901234567",)], "x string")
    assert [r[0] for r in rows.select(text.normalize_phone(F.col("x"))).collect()] == ["+84901234567"] * 3 + [None, None, "+0901234567"]


def test_canonical_url(spark):
    rows = spark.createDataFrame([("HTTP://www.m.Example.com:80/a/?utm_x=1&b=2&a=1#top",), ("//x.vn/",), ("x.vn?ref=1",), ("",)], "x string")
    assert [r[0] for r in rows.select(web.canonical_url(F.col("x"))).collect()] == ["http://example.com/a?a=1&b=2", "https://x.vn", "https://x.vn", ""]


def test_upsert_twice_is_the_same(spark):
    s = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, seq long, h string")
    b = spark.createDataFrame([(2, 2, "c"), (3, 3, "d")], "k long, seq long, h string")
    once = places.upsert(s, b, ["k"], "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, places.upsert(once, b, ["k"], "seq").collect())) == [(1, 1, "a"), (2, 2, "c"), (3, 3, "d")]


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id long, norm_name string, phone string, domain string, category string, admin_unit long, lat double, lon double")


def brute_components(spark, r, threshold=0.62):
    """Components over all accepted pairs of blocks, each pair scored."""
    ids = [x.record_id for x in r.collect()]
    blocks = places.block_keys(r)
    pairs = blocks.toDF("a", "block").join(blocks.toDF("b", "block"), "block").filter("a < b").select("a", "b").distinct()
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in places.scored_pairs(r, pairs).filter(f"score >= {threshold} OR rule IS NOT NULL").collect():
        x, y = find(p.a), find(p.b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_resolve_equals_all_pairs(spark):
    import random

    rng = random.Random(6)
    words = "pho ha bun cafe sach nha thuoc an xanh do".split()
    rows = []
    for i in range(220):
        name = " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
        spot = rng.choice([None, (10.0, 105.0), (10.0 + rng.random() * 0.004, 105.0 + rng.random() * 0.004), (10.5, 105.0)])
        lat, lon = spot or (None, None)
        rows.append((i, name, rng.choice([None, "+841", f"+84{rng.randint(2, 60)}"]), rng.choice([None, "a.vn", f"b{rng.randint(0, 60)}.vn"]), rng.choice([None, "food", "shop"]), rng.choice([1, 2]), lat, lon))
    rows += [(300 + k, *rows[5][1:]) for k in range(3)]  # equal records
    r = records(spark, rows)
    want = brute_components(spark, r)
    blocked = {i for i, in r.select("record_id").collect()}
    got = {x.record_id: x.place_id for x in places.resolve(r).collect()}
    assert set(got) == blocked and got == want


def test_a_hot_phone_loses_no_pair(spark):
    n = 500
    rows = [(i, f"name{i}", "+84900", None, None, i % 3, None if i % 2 else 10.0, None if i % 2 else 105.0) for i in range(n)]
    rows += [(1000 + i, f"branch{i}", "+84901", None, None, 1, 10.0 + i * 0.01, 105.0) for i in range(300)]  # a chain with one hotline: branches stay apart
    got = {x.record_id: x.place_id for x in places.resolve(records(spark, rows)).collect()}
    assert {got[i] for i in range(n)} == {0} and len({got[1000 + i] for i in range(300)}) == 300
    assert places.candidate_pairs(records(spark, rows)).count() < 3 * len(rows)
    assert places.block_keys(records(spark, rows)).filter("block = 'phone:+84900'").count() == n


def test_units_are_followed_to_their_ends(spark):
    relations = [(i, i + 1) for i in range(1, 20)] + [(30, 31), (31, 30), (40, 41), (40, 42)]
    units = [*range(1, 21), 30, 31, 40, 41, 42]
    got = places.current_units(spark.createDataFrame(relations, "from_unit long, to_unit long"), spark.createDataFrame([(u,) for u in units], "unit long")).collect()
    assert sorted((r.unit, r.current) for r in got if r.unit < 21) == [(i, 20) for i in range(1, 21)]
    assert sorted((r.unit, r.current) for r in got if r.unit > 21 and r.current) == [(40, 41), (40, 42), (41, 41), (42, 42)] and [r.unit for r in got if r.current is None] == [30, 31]


def test_audit_takes_the_largest_pair(spark):
    m = spark.createDataFrame([(1, 10.0, 105.0), (1, 10.0015, 105.0), (1, 10.00075, 105.0013), (2, 10.0, 105.0), (2, 10.0, 105.01), (3, None, None)], "place_id long, lat double, lon double")
    got = {r.place_id: r for r in places.merge_audit(m).collect()}
    assert set(got) == {2} and abs(got[2].span_m - 1095) < 5  # the box of place 1 is wider than 200 m, no pair is


def test_business_groups_and_aliases(spark):
    r = records(spark, [(1, "pho ha", "+841", None, "food", 1, None, None), (2, "pho ha", "+841", None, "shop", 2, None, None), (3, "pho ha", None, None, "shop", 3, None, None), (4, "pho ha", None, None, "bank", 4, None, None), (5, "", "+841", None, "food", 1, None, None)])
    assert {x.record_id: x.business_id for x in places.business_groups(r).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    named = spark.createDataFrame([(1, "Phở Hà"), (2, "Bún")], "place_id long, name string")
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "place_id long, record_id long")
    raw = spark.createDataFrame([(1, "PHỞ HÀ"), (2, "pho ha"), (3, "Pho Ha"), (4, None)], "record_id long, raw_name string")
    assert {x.place_id: x.aliases for x in places.alias_lineage(named, links, raw).collect()} == {1: ["Pho Ha"], 2: []}


def test_reasons(spark):
    c = F.col
    rows = spark.createDataFrame([("x", None, None, None, None, None), ("x", "bad", None, None, None, None), (None, None, "verified", "2024", "phone_confirmation", None), ("x", None, "verified", "2024", "phone_confirmation", "http://a.vn"), ("x", None, "maybe", None, "hearsay", None)], "name string, err string, status string, at string, method string, url string")
    none = F.lit(None).cast("double")
    got = [r[0] for r in rows.select(places.reject_reasons(c("name"), F.lit(None).cast("string"), F.lit(1), none, none, F.lit(None).cast("string"), F.lit(None).cast("string"), c("err"), c("status"), c("at"), c("method"), c("url"))).collect()]
    assert got == [[], ["parse_error"], ["missing_name", "missing_identity", "incomplete_review_evidence"], [], ["unknown_verification_method", "invalid_review_status"]]


def test_names_phones_and_words_of_queries(spark):
    one = lambda f, *xs: [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x string").select(f(F.col("x"))).collect()]
    assert one(text.norm_name, "Công ty TNHH Cửa hàng ABC", "CTY CP - Siêu thị Xanh", "Nhà thuốc, An Khang", "Quán Bar 1", "Quanh co", None) == ["abc", "xanh", "an khang", "bar 1", "quanh co", ""]
    assert one(text.redact, "mail a.b+c@d-e.com.vn, gọi 0912345678/+84912345678", "mã 123456 và 12345, x1234567", None) == ["mail [email], gọi [sdt]/[sdt]", "mã [id] và 12345, x1234567", None]
    assert one(text.query_language, "quán bún", "gia vang", "gold price") == ["vi", "vi", "en"]
    assert one(text.intent, "A vs B today", "tin mới nhất là gì", "what is x", "how to x", "review x", "renew") == ["comparison", "current_fact", "definition", "howto", "opinion", "current_fact"]
    assert one(text.time_range, "bitcoin price now", "bitcoin price", "API rate limit", "rates", "epl", "what is x") == ["day", "week", None, "week", "week", None]
    assert one(text.freshness_class, "quán phở gần đây", "tin tức", "python documentation", "localhost") == ["hours", "minutes", "static", "days"]
    assert one(text.legal_clause, "theo Điều 5, Khoản 2", "Điều 12", "Khoản 2") == ["Điều 5, Khoản 2", "Điều 12", None]
