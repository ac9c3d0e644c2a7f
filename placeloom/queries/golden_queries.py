"""Queries of labelled cases, approvals, evidence scores, payload fields and parts of addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload, text
from ..operators import golden
from .fixtures import RANKED, RECORDS, derive, sql, table
from .registry import query

#: Golden cases of the orders.
CASES = """SELECT o_orderkey AS case_id, CASE o_orderkey % 9 WHEN 0 THEN 'nonsense' WHEN 1 THEN '' ELSE 'legal' END AS intent, CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE 'today' END AS freshness, CASE WHEN o_orderkey % 8 = 0 THEN 'boss' ELSE 'verified' END AS authority,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS anchor_label, CASE WHEN o_orderkey % 4 = 0 THEN 95.0e0 WHEN o_orderkey % 4 = 1 THEN 10.0e0 END AS anchor_lat, CASE WHEN o_orderkey % 4 < 2 THEN 105.0e0 END AS anchor_lon,
  CASE o_orderkey % 5 WHEN 0 THEN -1.0e0 WHEN 1 THEN 500.0e0 END AS radius_m, o_orderkey % 6 AS n, o_orderkey % 10 = 0 AS abstain FROM {orders}"""


@query("p7_label_errors", f"""SELECT case_id, concat_ws(',', CASE WHEN intent = 'nonsense' THEN 'intent' END, CASE WHEN freshness = 'soon' THEN 'freshness' END, CASE WHEN authority = 'boss' THEN 'authority' END,
 CASE WHEN anchor_lat = 95 AND anchor_label IS NULL THEN 'anchor' END, CASE WHEN radius_m < 0 THEN 'radius' END, CASE WHEN radius_m > 0 AND anchor_label IS NULL AND anchor_lat IS NULL THEN 'radius_without_anchor' END,
 CASE WHEN n = 1 THEN 'entities' END, CASE WHEN n > 1 AND abstain THEN 'abstention' END) AS errors FROM ({sql(CASES)})""")
def p7(spark, d):
    c = derive(spark, d, CASES).withColumn("entities", F.when(F.col("n") == 0, F.array().cast("array<string>")).when(F.col("n") == 1, F.array(F.lit(" "))).otherwise(F.array(F.lit("Phở"))))
    return golden.label_errors(c).select("case_id", F.concat_ws(",", "errors").alias("errors"))


#: Results for four of five cases.
GOLD = """SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS want_intent, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS want_unit, CASE WHEN c_custkey % 4 = 0 THEN 1000.0e0 END AS radius_m, CASE WHEN c_custkey % 7 = 0 THEN 'Phở  Thìn' END AS want_name,
  c_custkey % 11 = 0 AS abstain, CASE WHEN c_custkey % 6 = 0 THEN 'verified' END AS want_rung FROM {customer}"""
GOT = """SELECT c_custkey AS case_id, CASE WHEN c_custkey % 8 = 0 THEN 'other' ELSE c_mktsegment END AS intent, c_nationkey + CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS unit, CAST(c_custkey * 13 % 2000 AS DOUBLE) AS farthest_m, CASE WHEN c_custkey % 14 = 0 THEN 'quan pho thin bo ho' ELSE 'bun' END AS name,
  c_custkey % 5 AS exact, CASE WHEN c_custkey % 12 = 0 THEN 'authoritative' ELSE 'corroborated' END AS rung FROM {customer} WHERE c_custkey % 5 > 0"""


@query("a32_golden_failures", f"""SELECT w.case_id, concat_ws(',', CASE WHEN want_intent IS NOT NULL AND want_intent IS DISTINCT FROM intent THEN 'intent' END, CASE WHEN want_unit IS NOT NULL AND want_unit IS DISTINCT FROM unit THEN 'units' END, CASE WHEN farthest_m > radius_m THEN 'radius' END,
 CASE WHEN want_name IS NOT NULL AND NOT coalesce(contains(name, 'pho thin'), false) THEN 'entities' END, CASE WHEN abstain AND exact > 0 THEN 'abstention' END, CASE WHEN want_rung = 'verified' AND coalesce(rung, '') <> 'authoritative' THEN 'authority' END) AS failures FROM ({sql(GOLD)}) w LEFT JOIN ({sql(GOT)}) g USING (case_id)""")
def a32(spark, d):
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    w = derive(spark, d, GOLD).withColumnRenamed("case_id", "case").withColumn("want_units", one(F.col("want_unit").cast("long"))).withColumn("want_names", one("want_name"))
    g = derive(spark, d, GOT).select(F.col("case_id").alias("case"), "intent", one(F.col("unit").cast("long")).alias("units"), "farthest_m", one("name").alias("names"), "exact", "rung")
    return golden.golden_failures(w, g).select(F.col("case").alias("case_id"), F.concat_ws(",", "failures").alias("failures"))


SUITE = """SELECT event_type AS intent, CASE WHEN event_id % 4 = 0 THEN 'view' ELSE event_type END AS want_intent, CASE WHEN event_id % 5 = 0 THEN 'a' END AS specialty, CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS want_specialty,
  CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN event_id % 2 = 0 END AS unit_ok, CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'any' WHEN 2 THEN 'verified' END AS places, event_id % 6 AS shown, event_id % 6 % 3 AS exact, event_id % 6 % 2 AS correct, event_id % 6 % 4 % 2 AS outside, value AS latency_ms FROM {events}"""


@query("a31_suite_metrics", f"""WITH s AS ({sql(SUITE)}), l AS (SELECT list_sort(list(latency_ms)) AS v FROM s) SELECT count(*) AS cases, round(avg((intent = want_intent)::INT), 6) AS intent, round(avg(CASE WHEN want_specialty IS NOT NULL THEN (specialty IS NOT DISTINCT FROM want_specialty)::INT END), 6) AS specialty, round(avg(unit_ok::INT), 6) AS unit,
 round(sum(correct) / sum(shown)::DOUBLE, 6) AS place_precision, round(sum(outside) / sum(shown)::DOUBLE, 6) AS outside_rate, round(avg(CASE WHEN places = 'none' THEN (shown = 0)::INT END), 6) AS abstain_rate, round(avg(CASE WHEN places IN ('any', 'verified') THEN (CASE WHEN places = 'verified' THEN exact ELSE shown END = 0)::INT END), 6) AS zero_rate,
 any_value(v[CAST(ceil(len(v) * 0.5e0) AS BIGINT)]) AS p50, any_value(v[CAST(ceil(len(v) * 0.95e0) AS BIGINT)]) AS p95 FROM s, l""")
def a31(spark, d):
    m = golden.suite_metrics(derive(spark, d, SUITE))
    return m.select("cases", *[F.round(c, 6).alias(c) for c in m.columns if c not in ("cases", "p50", "p95")], "p50", "p95")


#: Observations of outlets by up to four sources.
OBSERVED = """SELECT o_custkey AS outlet, 's' || CAST(o_orderkey % 4 AS STRING) AS source, 'g' || CAST(o_orderkey % 4 % 3 AS STRING) AS source_group, o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'rejected' ELSE 'pending' END AS status, o_orderdate AS seen,
  CASE WHEN o_orderkey % 17 = 0 THEN 'other' ELSE 'food' END AS category, o_custkey % 3 AS unit, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '1' END AS phone, CASE WHEN o_orderkey % 19 = 0 THEN 'x' END AS tax_id, o_orderkey % 23 AS sp, 10.0e0 + o_orderkey % 2 * 0.001e0 + CASE WHEN o_orderkey % 29 = 0 THEN 0.01e0 ELSE 0.0e0 END AS lat, 105.0e0 AS lon FROM {orders}"""


@query("a33_approvals", f"""WITH o AS ({sql(OBSERVED)}), m AS (SELECT max(seen) AS m FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY outlet, source ORDER BY seen DESC, o_orderkey DESC) AS i FROM o WHERE status <> 'rejected'),
a AS (SELECT r.* FROM r, m WHERE i = 1 AND epoch(seen) >= epoch(m) - 730 * 86400), g AS (SELECT outlet, count(DISTINCT source_group) AS sources, count(DISTINCT category) > 1 AS c, count(DISTINCT unit) > 1 AS u, count(DISTINCT nullif(phone, '')) > 1 AS p, count(DISTINCT tax_id) > 1 AS t, bool_and(sp <> 0) AS shared, max(lat) - min(lat) > 0.002e0 AS l FROM a GROUP BY 1)
SELECT outlet, coalesce(sources, 0) AS sources, CASE WHEN shared THEN 'com|pho' WHEN shared IS NULL THEN '' ELSE 'pho' END AS specialties, concat_ws(',', CASE WHEN coalesce(sources, 0) < 2 THEN 'sources' END, CASE WHEN c THEN 'category' END, CASE WHEN u THEN 'unit' END, CASE WHEN p THEN 'phone' END, CASE WHEN t THEN 'tax_id' END, CASE WHEN sources IS NULL THEN 'specialties' END, CASE WHEN l THEN 'location' END) AS reasons
FROM (SELECT DISTINCT outlet FROM o) LEFT JOIN g USING (outlet)""")
def a33(spark, d):
    """As of the newest observation; the newest of one time is the larger order."""
    o = derive(spark, d, OBSERVED).withColumnRenamed("seen", "at")
    o = o.withColumn("specialties", F.when(F.col("sp") == 0, F.array(F.lit("Phở"))).otherwise(F.array(F.lit("phở"), F.lit("Cơm"))))
    once = o.groupBy("outlet", "source", "status", "at").agg(F.max_by(F.struct(*[c for c in o.columns if c not in ("outlet", "source", "status", "at")]), "o_orderkey").alias("r")).select("outlet", "source", "status", "at", "r.*")
    last = once.agg(F.max("at")).first()[0]
    g = golden.approvals(once, F.lit(last), 730)
    return g.select("outlet", "sources", F.array_join("specialties", "|").alias("specialties"), F.concat_ws(",", "reasons").alias("reasons"))


PLACES = """SELECT c_custkey % 40 AS query_id, c_custkey AS place_id, CAST(c_custkey % 5 AS DOUBLE) / 4 AS spec_hit, CAST(c_custkey % 3 AS DOUBLE) / 2 AS name_hit, CAST(c_custkey % 2 AS DOUBLE) AS addr_hit, c_custkey % 4 = 0 AS has_spec, c_custkey % 8 = 0 AS spec_in_name, c_mktsegment = 'BUILDING' AS same_category,
  c_custkey % 3 = 0 AS in_unit, c_custkey % 3 < 2 AS in_province, c_custkey % 40 % 5 > 0 AS has_location, c_custkey % 7 < 3 AS verified, CASE WHEN c_custkey % 9 > 0 THEN CAST(c_custkey % 50 AS DOUBLE) END AS dist_km, CASE WHEN c_custkey % 6 > 0 THEN 3.0e0 + CAST(c_custkey % 21 AS DOUBLE) / 10 END AS rating,
  CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 900 END AS reviews, CAST(c_custkey % 4 AS DOUBLE) AS trust FROM {customer}"""


@query("t10_embedded_places", f"""WITH s AS (SELECT query_id, place_id, 22 * spec_hit + 16 * name_hit + 4 * addr_hit + CASE WHEN has_spec THEN 18e0 ELSE 0e0 END + CASE WHEN spec_in_name THEN 8e0 ELSE 0e0 END + CASE WHEN same_category THEN 14e0 ELSE 0e0 END + CASE WHEN NOT has_location THEN 0e0 WHEN in_unit THEN 30e0 WHEN in_province THEN 12e0 ELSE -26e0 END
 + CASE WHEN dist_km IS NULL THEN 0e0 ELSE greatest(-10e0, least(8e0, 8 - 0.5e0 * dist_km)) END + trust + CASE WHEN verified THEN 6e0 ELSE 0e0 END + CASE WHEN rating IS NULL THEN 0e0 ELSE greatest(0e0, least(1.2e0, rating - 3.6e0)) * 5 END + CASE WHEN reviews IS NULL THEN 0e0 ELSE least(4e0, log10(1 + reviews) * 1.6e0) END AS score,
 CASE WHEN (has_spec OR same_category) AND has_location AND in_unit THEN CASE WHEN verified THEN 'exact' ELSE 'unverified' END ELSE 'related' END AS bucket FROM ({sql(PLACES)})), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY score DESC, place_id) AS rank FROM s)
SELECT query_id, bucket, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM k WHERE rank <= CASE bucket WHEN 'exact' THEN 20 WHEN 'unverified' THEN 10 ELSE 8 END""")
def t10(spark, d):
    return golden.embedded_places(derive(spark, d, PLACES), "query_id", "place_id").select("query_id", "bucket", "rank", F.round("score", 6).alias("score"))


FOUND = """SELECT l_partkey % 200 AS query_id, l_orderkey * 10 + l_linenumber AS doc, CAST(l_orderkey % 5 AS DOUBLE) / 4 AS overlap, l_suppkey % 6 = 0 AS has_spec, l_orderkey % 3 AS places, l_linenumber % 2 AS targets, l_partkey % 4 AS entities, CASE l_partkey % 200 % 4 WHEN 0 THEN 'legal' WHEN 1 THEN 'weather' WHEN 2 THEN 'market_price' ELSE 'lookup' END AS intent,
  CASE l_suppkey % 3 WHEN 0 THEN 'law' WHEN 1 THEN 'government' ELSE 'news' END AS source_type, CAST(l_suppkey % 9 AS DOUBLE) / 8 AS authority, CAST(l_orderkey % 17 AS DOUBLE) / 16 AS fresh, l_partkey % 200 % 3 = 0 AS today FROM {lineitem}"""


@query("t11_embedded_documents", f"""WITH s AS (SELECT query_id, doc, 30 * overlap + CASE WHEN has_spec THEN 20e0 ELSE 0e0 END + 12 * places + 16 * targets + 5 * entities + CASE WHEN intent = 'legal' AND source_type IN ('law', 'government') THEN 24e0 WHEN intent = 'market_price' AND source_type = 'news' THEN 12e0 WHEN intent = 'weather' AND source_type IN ('government', 'news') THEN 14e0 ELSE 0e0 END
 + 14 * authority + CASE WHEN today THEN 18e0 ELSE 8e0 END * fresh AS score FROM ({sql(FOUND)})), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s WHERE score > 24) SELECT query_id, doc, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM k WHERE rank <= 8""")
def t11(spark, d):
    return golden.embedded_documents(derive(spark, d, FOUND), "query_id", "doc").select("query_id", "doc", "rank", F.round("score", 6).alias("score"))


LISTS = """SELECT query_id, provider || CAST(item % 3 AS STRING) AS sub, item, q / 50 AS relevance, score, item % 7 AS auth FROM (""" + RANKED + ")"


@query("t16_multi_query", f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub ORDER BY score DESC, item) AS rank FROM ({sql(LISTS)})), b AS (SELECT query_id, item, sub, min(rank) AS rank, max(relevance) AS relevance FROM x GROUP BY 1, 2, 3),
g AS (SELECT query_id, item, sum(1e0 / (60 + rank)) AS fused, max(relevance) AS relevance, least(1e0, count(*) / 5e0) AS corroboration FROM b GROUP BY 1, 2),
s AS (SELECT query_id, item, 0.5e0 * fused / max(fused) OVER (PARTITION BY query_id) + 0.2e0 * least(1e0, relevance) + 0.15e0 * CASE WHEN item % 7 = 0 THEN 0.5e0 ELSE item % 7 / 8e0 END + 0.15e0 * corroboration AS score, corroboration FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM s)
SELECT query_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def t16(spark, d):
    from ..operators.ranking import with_rank

    x = with_rank(derive(spark, d, LISTS), ["query_id", "sub"], "score", "item")
    a = x.select("item", (F.col("item") % 7 / 8).alias("authority")).distinct().filter("item % 7 > 0")
    return golden.multi_query_rerank(x, "query_id", "item", a, 10).select("query_id", F.round("score", 6).alias("score"), "rank")


#: Payloads of the parts, well formed or not.
PAYLOADS = """SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN '5.5' WHEN 1 THEN '4.25' WHEN 2 THEN 'NaN' WHEN 3 THEN '0' WHEN 4 THEN '-1' ELSE '3.5' END AS rating, CASE p_partkey % 5 WHEN 0 THEN '1,234' WHEN 1 THEN '1,2' WHEN 2 THEN '17' WHEN 3 THEN '99999999999' ELSE 'many' END AS reviews,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '$$' END AS price, CASE p_partkey % 3 WHEN 0 THEN 'https://i.vn/a.jpg' WHEN 1 THEN 'data:x' ELSE ' http://i.vn/b.jpg ' END AS image FROM {part}"""


@query("f34_rich_fields", f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 4.25e0 WHEN 3 THEN 0e0 WHEN 5 THEN 3.5e0 END AS rating, CASE p_partkey % 5 WHEN 0 THEN 1234 WHEN 2 THEN 17 END AS review_count, nullif(price, '') AS price,
 CASE p_partkey % 3 WHEN 0 THEN 'https://i.vn/a.jpg https://i.vn/' || p_size WHEN 1 THEN 'https://i.vn/' || p_size || ' https://i.vn/a.jpg' ELSE 'https://i.vn/' || p_size || ' https://i.vn/a.jpg http://i.vn/b.jpg' END AS images FROM ({sql(PAYLOADS)})""")
def f34(spark, d):
    p = derive(spark, d, PAYLOADS)
    url = F.concat(F.lit("https://i.vn/"), F.col("p_size").cast("string"))
    photos = F.when(F.col("p_partkey") % 3 == 0, F.array(F.to_json(F.struct(F.lit("https://i.vn/a.jpg").alias("url"))), url)).otherwise(F.array(url, F.to_json(F.struct(F.lit("https://i.vn/a.jpg").alias("src"))), url))
    body = F.to_json(F.struct(F.col("rating").alias("review_rating"), F.col("reviews").alias("review_count"), F.col("price").alias("price_range"), photos.alias("photos"), F.col("image").alias("thumbnail")))
    x = p.select("p_partkey", payload.rich_fields(body).alias("f"))
    return x.select("p_partkey", "f.rating", "f.review_count", "f.price", F.array_join("f.images", " ").alias("images"))


@query("f35_metadata_dates", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '2024-01-0' || (page_id % 9 + 1) END AS published, CASE page_id % 3 WHEN 1 THEN '2024-02-0' || (page_id % 9 + 1) END AS updated, CASE page_id % 3 WHEN 2 THEN '2024-03-0' || (page_id % 9 + 1) END AS first_seen FROM pages""")
def f35(spark, d):
    """Dates in meta tags, JSON-LD text, or deep in the metadata of a page."""
    n = (F.col("page_id") % 9 + 1).cast("string")
    meta = F.to_json(F.struct(F.array(F.struct(F.lit("article:published_time").alias("property"), F.concat(F.lit("2024-01-0"), n).alias("content"))).alias("meta")))
    ld = F.to_json(F.struct(F.to_json(F.struct(F.concat(F.lit("2024-02-0"), n).alias("dateModified"))).alias("json-ld")))
    deep = F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("2024-03-0"), n).alias("first_seen_at")).alias("b")).alias("a")))
    p = table(spark, d, "pages").select("page_id", payload.metadata_dates(F.when(F.col("page_id") % 3 == 0, meta).when(F.col("page_id") % 3 == 1, ld).otherwise(deep)).alias("f"))
    return p.select("page_id", "f.*")


@query("f12_address_parts", f"""WITH r AS ({sql(RECORDS)}) SELECT record_id, CASE WHEN record_id % 2 = 0 THEN 'Thành phố Hà Nội' ELSE 'Thành phố Đà Nẵng' END AS city, CASE WHEN record_id % 3 = 0 THEN 'Ba Đình' END AS district, CASE WHEN record_id % 3 = 1 THEN CAST(admin_unit AS VARCHAR) END AS ward,
 CASE WHEN record_id % 4 = 0 THEN 'Ngõ ' || admin_unit END AS lane, CAST(record_id AS VARCHAR) AS house, 'Phố Huế' AS street, true AS looks FROM r""")
def f12(spark, d):
    # few bytes hold many records, so without this one task would parse them all
    r, i = derive(spark, d, RECORDS).select("record_id", "admin_unit").repartition(4 * spark.sparkContext.defaultParallelism, "record_id"), F.col("record_id")
    unit = F.col("admin_unit").cast("string")
    a = F.concat_ws(", ", F.concat(F.lit("Số "), i.cast("string"), F.when(i % 4 == 0, F.concat(F.lit(" ngõ "), unit)).otherwise(""), F.lit(" Phố Huế")), F.when(i % 3 == 1, F.concat(F.lit("Phường "), unit)), F.when(i % 3 == 0, "Quận Ba Đình"), F.when(i % 2 == 0, "TP. Hà Nội").otherwise("Đà Nẵng"))
    x = r.select("record_id", payload.address_parts(a).alias("p"), payload.looks_like_address(a).alias("looks"))
    return x.select("record_id", "p.*", "looks")


@query("f16_sub_queries", """SELECT c_custkey, n, CASE n WHEN 0 THEN 'find Customer' || c_custkey || ' office' ELSE 'Customer' || c_custkey || ' opening hours' END AS sub FROM customer, (SELECT unnest([0, 1]) AS n)""")
def f16(spark, d):
    """The second question's pronoun stands for the first one's entity."""
    q = F.concat(F.lit("find Customer"), F.col("c_custkey").cast("string"), F.lit(" office and then its opening hours"))
    return table(spark, d, "customer").select("c_custkey", F.posexplode(payload.sub_queries(q)).alias("n", "sub"))


@query("f16_decompose", """SELECT c_custkey, n, CASE c_custkey % 5 WHEN 0 THEN CASE n WHEN 0 THEN 'Phone' || c_custkey || ' giá' ELSE 'Phone' || c_custkey || ' camera' END WHEN 1 THEN CASE n WHEN 0 THEN 'A' || c_custkey ELSE 'B or C' END
 WHEN 2 THEN 'handy order ' || c_custkey WHEN 3 THEN CASE n WHEN 0 THEN 'pin Phone' || c_custkey ELSE 'pin Phone' || c_custkey || ' price of B' END ELSE '' END AS sub FROM customer, (SELECT unnest([0, 1]) AS n) WHERE n = 0 OR c_custkey % 5 NOT IN (2, 4)""".replace("'B or C'", "'B C'"))
def f16_decompose(spark, d):
    """Questions joined by a conjunction; an aspect alone gets the first one's thing."""
    k = F.col("c_custkey")
    key = k.cast("string")
    q = F.when(k % 5 == 0, F.concat(F.lit("Phone"), key, F.lit(" giá và camera"))).when(k % 5 == 1, F.concat(F.lit("So sánh A"), key, F.lit(" VS B or C"))).when(k % 5 == 2, F.concat(F.lit(" handy order "), key)).when(k % 5 == 3, F.concat(F.lit("pin Phone"), key, F.lit(" and price of B"))).otherwise("")
    return table(spark, d, "customer").select("c_custkey", F.posexplode(text.decompose(q)).alias("n", "sub"))


@query("p5_strict_specialty", "SELECT p_partkey, contains(lower(p_type), 'promo') AS has FROM part")
def p5_strict(spark, d):
    """By the specialties alone, whatever the name says."""
    return table(spark, d, "part").select("p_partkey", golden.strict_specialty(F.array("p_type"), F.lit("Promo")).alias("has"))
