from pyspark.sql import functions as F

from placeloom.functions import payload, text
from placeloom.operators import curation
from placeloom.queries import flow_queries, registry  # noqa: F401
from placeloom.queries.curation_queries import sources

SF = "/root/testdata/sf0.001"


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def test_rich_fields_of_bad_payloads_are_null(spark):
    for bad in (None, "", "{no", "[]", "1", '{"review_rating": "1e400", "review_count": true, "photos": 3}'):
        got = one(spark, bad, payload.rich_fields)
        assert (got.rating, got.review_count, got.price) == (None, None, None)


def test_counts_are_whole(spark):
    got = lambda c: one(spark, f'{{"review_count": {c}}}', payload.rich_fields).review_count
    assert [got(c) for c in ('"1,234"', '"1,2"', "12", "12.0", "12.5", "-3", "2147483648", '" 7 "')] == [1234, None, 12, 12, None, None, None, 7]


HANOI, SAIGON = "Thành phố Hà Nội", "Thành phố Hồ Chí Minh"
ADDRESSES = {  # house, lane, street, ward, district, city
    "Số 12 Ngõ 45 Trần Duy Hưng, phường Trung Hòa, quận Cầu Giấy, Hà Nội": ("12", "Ngõ 45", "Trần Duy Hưng", "Trung Hòa", "Cầu Giấy", HANOI),
    "số 12 ngõ 45 trần duy hưng , cầu giấy , hà nội": ("12", "Ngõ 45", "Trần Duy Hưng", None, "Cầu Giấy", HANOI),
    "55 Trần Hưng Đạo, P. Bến Thành, Q. 1, TP. HCM": ("55", None, "Trần Hưng Đạo", "Bến Thành", "1", SAIGON),
    "12 Lê Lợi, Quận 1, Sài Gòn": ("12", None, "Lê Lợi", None, "1", SAIGON),
    "TP. HCM, Quận 1": (None, None, None, None, "1", SAIGON),
    "12A Đường 3/2, P. Xuân Khánh, Q. Ninh Kiều, Cần Thơ": ("12A", None, "Đường 3/2", "Xuân Khánh", "Ninh Kiều", "Thành phố Cần Thơ"),
    "Trần Duy Hưng, Cầu Giấy, Hà Nội": (None, None, "Trần Duy Hưng", None, "Cầu Giấy", HANOI),
    "12 ngõ 45 trần duy hưng": ("12", "Ngõ 45", "Trần Duy Hưng", None, None, None),
    "Nhà 7 / 3b hẻm 5a\nBến Nghé\nQuận 1;Đồng Tháp": ("7/3b", "Hẻm 5A", None, "Đồng Tháp", "1", None),
    "A, B, C, D": (None, None, "A", "C", "D", None),  # leftovers by place: last district, then ward; B is none of these
    "sg, hue": (None, None, "Sg", None, None, "Thành phố Huế"),  # a city once, the rightmost
    "Asgard": (None, None, "Asgard", None, None, None),  # short forms are words
    "": (None,) * 6,
    " , ;\n": (None,) * 6,
}


def test_addresses_are_used_up_part_by_part(spark):
    rows = spark.createDataFrame([(i, a) for i, a in enumerate([*ADDRESSES, None])], "i int, a string")
    got = [r.p for r in rows.select("i", payload.address_parts(F.col("a")).alias("p")).orderBy("i").collect()]
    assert [(g.house, g.lane, g.street, g.ward, g.district, g.city) for g in got] == [*ADDRESSES.values(), (None,) * 6]
    own = one(spark, "1 x, Old Town", lambda c: payload.address_parts(c, {"old town": "Old Town City"}))
    assert (own.house, own.street, own.city) == ("1", "X", "Old Town City")


def test_normal_and_likely_addresses(spark):
    normal = {"Số 12 ngõ 45 Trần Duy Hưng , Cầu Giấy , Hà Nội": "Số 12 Ngõ 45 Trần Duy Hưng, Cầu Giấy, Hà Nội", "12a đường 3 / 2, p. xuân khánh": "12A Đường 3/2, P. Xuân Khánh", "   ": "", None: ""}
    assert [one(spark, a, payload.normal_address) for a in normal] == list(normal.values())
    likely = {"Số 12 Ngõ 45 Trần Duy Hưng, Cầu Giấy, Hà Nội": True, "Trần Hưng Đạo, TP. HCM": True, "quận Cầu Giấy somewhere": True, "How to cook pho noodles at home": False, "": False, None: False}
    assert [one(spark, a, payload.looks_like_address) for a in likely] == list(likely.values())


def test_metadata_of_no_json(spark):
    got = one(spark, "plain", payload.metadata_dates)
    assert got == (None, None, None)
    assert one(spark, '[{"datePublished": "a"}, {"pubdate": "b"}]', payload.metadata_dates).published == "a"


def test_near_copies_equal_all_pairs(spark):
    s = sources(spark, SF)
    rows = s.select("pack", "source_id", curation.simhash(F.col("words")).alias("h")).collect()
    packs, want = {}, {}
    for r in rows:
        packs.setdefault(r.pack, []).append((r.source_id, r.h & (1 << 64) - 1))
    for group in packs.values():
        kept = []
        for i, h in sorted(group):
            want[i] = min((j for j, g in kept if bin(g ^ h).count("1") <= 3), default=None)
            kept += [(i, h)] if want[i] is None else []
    assert {r.source_id: r.copy_of for r in registry.QUERIES["a13_near_copies"](spark, SF).collect()} == want and any(want.values())


def test_near_copies_of_dropped_ones_stay(spark, monkeypatch):
    h = {1: 0, 2: 0b111, 3: 0b111111, 4: 0b111111111, 5: -1}  # each within 3 bits of the one before
    monkeypatch.setattr(curation, "simhash", lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in h.items() for x in (kv[0], F.lit(kv[1]).cast("long"))]), c))
    rows = spark.createDataFrame([(p, i, i) for p in (1, 2) for i in h], "pack long, id long, w long")
    got = {(r.pack, r.id): r.copy_of for r in curation.drop_near_copies(rows, "pack", "id", "id", "w").collect()}
    assert got == {(p, i): {2: 1, 4: 3}.get(i) for p in (1, 2) for i in h}


def test_simhash_bits(spark):
    import xxhash

    words = ["a", "b", "c", "a", "đ"]
    hs = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs))
    got = spark.createDataFrame([(words,)], "w array<string>").select(curation.simhash(F.col("w"))).first()[0]
    assert got & (1 << 64) - 1 == want


def test_simhash_of_no_words(spark):
    assert one(spark, "", lambda c: curation.simhash(text.tokens(c))) == 0


def test_ema_state_equals_batch(spark):
    state = {(r.key, r.n): round(r.ema, 4) for r in registry.QUERIES["g5_ema_state"](spark, SF).collect()}
    seq = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        seq.setdefault(r.user_id, []).append(r.value)
    want = {}
    for k, vs in seq.items():
        ema = vs[0]
        for v in vs[1:]:
            ema = 0.7 * ema + 0.3 * v
        want[k, len(vs)] = round(ema, 4)
    assert state == want


def test_interactions_are_distinct(spark):
    got = registry.QUERIES["g6_distinct_interactions"](spark, SF).collect()
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type").distinct()
    assert sorted(map(tuple, got)) == sorted(map(tuple, e.collect()))


def test_relinked_places_are_resolved_again(spark):
    got = {r.record_id: (r.place_id, r.relinked) for r in registry.QUERIES["c3_relink_stale"](spark, SF).collect()}
    assert all(relinked == ((i - i % 3) % 15 == 0) for i, (_, relinked) in got.items())
    assert all(p == i - i % 3 for i, (p, relinked) in got.items() if not relinked)


def test_recrawl_follows_changes(spark):
    v = spark.createDataFrame([("a", 0, "x"), ("a", 10, "y"), ("a", 20, "z"), ("b", 0, "x"), ("b", 10, "x"), ("c", 5, "x")], "url string, at long, content_hash string").withColumn("at", F.timestamp_seconds("at"))
    got = {r.url: (round(r.rate, 6), r.visits, r.due) for r in curation.recrawl_plan(v, 0.5).withColumn("due", F.unix_timestamp("next_due")).collect()}
    assert got == {"a": (0.75, 3, 20 + 604800 - int(0.75 * 601200)), "b": (0.0, 2, 10 + 604800), "c": (0.0, 1, 5 + 604800)}
