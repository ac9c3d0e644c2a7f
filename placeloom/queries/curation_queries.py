"""Queries of packs, entities, hybrid and cached search, answers and crawl plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, web
from ..operators import answers, curation, evidence, passages
from .fixtures import derive, sql, table
from .passage_queries import _SUPPORT, CLAIMS, support
from .registry import query
from .text_queries import _LINKED, D_VISIBLE, d_hav, d_links, d_norm, d_tokens, d_urls

#: Sources of a pack: the turns of a conversation, each also with a copy of changed ending.
SOURCES = """SELECT conv_id AS pack, (conv_id * 1000 + turn) * 2 AS source_id, text FROM {conversations} UNION ALL SELECT conv_id, (conv_id * 1000 + turn) * 2 + 1, text || ' copied elsewhere' FROM {conversations} WHERE (conv_id + turn) % 3 = 0"""
_CLUSTERS = f"""s AS (SELECT pack, source_id, {d_tokens('text')} AS w FROM ({sql(SOURCES)})),
g AS (SELECT pack, source_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [array_to_string(w, ' ')] END) AS g FROM s),
o AS (SELECT pack, source_id, g, row_number() OVER (PARTITION BY pack ORDER BY source_id) AS i FROM g JOIN s USING (pack, source_id)),
k AS (SELECT b.source_id, list(a.source_id ORDER BY len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g))::DOUBLE DESC, a.source_id) AS us FROM g a JOIN g b ON a.pack = b.pack AND a.source_id < b.source_id WHERE len(list_intersect(a.g, b.g)) >= 0.25 * least(len(a.g), len(b.g)) GROUP BY 1),
q AS (SELECT o.pack, o.i, o.source_id, coalesce(us, []) AS us FROM o LEFT JOIN k USING (source_id)),
r(pack, i, source_id, cluster_id, led) AS (SELECT pack, i, source_id, source_id, [source_id] FROM q WHERE i = 1
 UNION ALL SELECT pack, i, source_id, coalesce(j, source_id), CASE WHEN j IS NULL THEN list_append(led, source_id) ELSE led END FROM (SELECT q.pack, q.i, q.source_id, r.led, list_filter(q.us, lambda x: list_contains(r.led, x))[1] AS j FROM r JOIN q ON q.pack = r.pack AND q.i = r.i + 1)),
c AS (SELECT source_id, cluster_id FROM r)"""


def sources(spark, d):
    return derive(spark, d, SOURCES).select("pack", "source_id", "text", text.tokens(F.col("text")).alias("words"))


@query("a11_independent_sources", f"WITH RECURSIVE {_CLUSTERS} SELECT pack, source_id, cluster_id FROM s JOIN c USING (source_id)")
def a11(spark, d):
    return curation.independent_sources(sources(spark, d)).select("pack", "source_id", "cluster_id")


@query("a13_near_copies")
def a13(spark, d):
    """SQL has no such hash; a test compares every pair."""
    s = sources(spark, d).withColumn("rank", F.col("source_id"))
    return curation.drop_near_copies(s, "pack", "source_id", "rank", "words").select("pack", "source_id", "copy_of")


@query("c6_evidence_pack")
def c6(spark, d):
    """Clusters of sources, verdicts of claims by clusters, coverage: pack, claims, coverage, confidence."""
    s = sources(spark, d)
    clusters = curation.independent_sources(s).select("source_id", "cluster_id", "pack")
    c = derive(spark, d, CLAIMS).select("conv_id", "claim_id", text.tokens(F.col("text")).alias("words"))
    found = c.select(F.col("conv_id").alias("pack"), "claim_id", F.explode(F.array_distinct("words")).alias("word")).join(s.select("pack", "source_id", F.explode(F.array_distinct("words")).alias("word")), ["pack", "word"])
    size = c.select("claim_id", F.size(F.array_distinct("words")).alias("n"))
    hit = found.filter("source_id <> claim_id * 2 AND source_id <> claim_id * 2 + 1").groupBy("pack", "claim_id", "source_id").agg(F.count(F.lit(1)).alias("k")).join(size, "claim_id")
    hit = hit.withColumn("overlap", F.col("k") / F.col("n")).filter("overlap >= 0.3").withColumn("negated", F.lit(False))
    v = evidence.verdicts(c, hit.select("claim_id", "source_id", "negated"), clusters.select("source_id", "cluster_id"))
    best = hit.groupBy("claim_id").agg(F.max("overlap").alias("confidence"))
    v = v.join(best, "claim_id", "left").fillna(0.0, ["confidence"]).join(c.select("claim_id", F.col("conv_id").alias("pack")), "claim_id")
    status = F.when(F.col("verdict") == "insufficient", "insufficient_evidence").otherwise(F.col("verdict"))
    return answers.pack_scores(v.withColumn("status", status), "pack").join(v.groupBy("pack").agg(F.count(F.lit(1)).alias("claims")), "pack")


#: Candidates of local searches, three lanes each, with typing errors.
LANES = """SELECT c_custkey % 100 AS query_id, c_custkey AS candidate, 'quan ' || CASE c_custkey % 7 WHEN 0 THEN 'pho bat dan gia truyen' WHEN 1 THEN 'pho bat dan gia truyenn' WHEN 2 THEN 'bun cha huong lien' ELSE 'com tam ' || CAST(c_custkey % 900 AS STRING) END AS name,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'so ' || CAST(c_custkey % 3 AS STRING) || ' pho hue' END AS address, CASE WHEN c_custkey % 6 = 0 THEN '+849' || CAST(c_custkey % 700 AS STRING) END AS phone,
  CASE WHEN c_custkey % 4 = 0 THEN 'site' || CAST(c_custkey % 300 AS STRING) || '.vn' END AS domain, CASE WHEN c_custkey % 9 > 0 THEN 21.0e0 + c_custkey % 3 * 0.0004e0 END AS lat, CASE WHEN c_custkey % 9 > 0 THEN 105.8e0 END AS lon,
  'https://u' || CAST(c_custkey % 40 AS STRING) || '.vn/' AS url FROM {customer}"""
_RATIO = "CASE WHEN length({0}) = 0 OR length({1}) = 0 THEN 0e0 ELSE 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))::DOUBLE END"
_ENTITIES = f"""c AS ({sql(LANES)}), l AS (SELECT x.candidate AS u, y.candidate AS v FROM c x JOIN c y ON x.query_id = y.query_id AND x.candidate <> y.candidate
 WHERE x.phone = y.phone OR (x.domain = y.domain AND {_RATIO.format('x.name', 'y.name')} >= 0.60e0) OR ({d_hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} <= 100 AND {_RATIO.format('x.name', 'y.name')} >= 0.88e0)
  OR ({_RATIO.format('x.name', 'y.name')} >= 0.90e0 AND {_RATIO.format('x.address', 'y.address')} >= 0.85e0)),
r(u, v) AS (SELECT candidate, candidate FROM c UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u), e AS (SELECT c.*, entity FROM c JOIN (SELECT u, min(v) AS entity FROM r GROUP BY 1) ON u = candidate)"""


@query("j17_same_entities", f"WITH RECURSIVE {_ENTITIES} SELECT query_id, candidate, entity FROM e")
def j17(spark, d):
    return curation.same_entities(derive(spark, d, LANES)).select("query_id", "candidate", "entity")


@query("j17_merged_entities", f"WITH RECURSIVE {_ENTITIES} SELECT query_id, entity, {', '.join(f'arg_min({k}, CASE WHEN {k} IS NOT NULL THEN candidate END) AS {k}' for k in ('name', 'address', 'phone', 'domain'))}, count(DISTINCT url) AS sources FROM e GROUP BY 1, 2")
def j17_merged(spark, d):
    return curation.merged_entities(curation.same_entities(derive(spark, d, LANES))).drop("lat", "lon")


_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
_COS = f"{_DOT.format('v.embedding', 'q.embedding')} / sqrt({_DOT.format('v.embedding', 'v.embedding')}) / sqrt({_DOT.format('q.embedding', 'q.embedding')})"


@query("q5_hybrid", f"""WITH d AS (SELECT doc_id AS doc, unnest({d_tokens('text')}) AS term FROM documents), w AS (SELECT doc, term, count(*)::DOUBLE AS w FROM d GROUP BY 1, 2), q AS (SELECT item_id AS query_id, unnest({d_tokens('text')}) AS term FROM benchmark), qw AS (SELECT query_id, term, count(*)::DOUBLE AS qw FROM q GROUP BY 1, 2),
s AS (SELECT query_id, doc, sum(w * qw) AS score FROM w JOIN qw USING (term) GROUP BY 1, 2), k AS (SELECT query_id, doc, 'lexical' AS provider, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s),
e AS (SELECT q.vec_id AS query_id, v.vec_id AS doc, {_COS} AS score FROM embeddings v JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark)), n AS (SELECT query_id, doc, 'vector' AS provider, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM e),
b AS (SELECT * FROM k WHERE rank <= 10 UNION ALL SELECT * FROM n WHERE rank <= 10), f AS (SELECT query_id, doc, sum(CASE provider WHEN 'lexical' THEN 1e0 ELSE 0.5e0 END / (60 + rank)) AS rrf FROM b GROUP BY 1, 2)
SELECT query_id, doc, round(rrf, 8) AS rrf, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc) AS rank FROM f) WHERE rank <= 10""")
def q5(spark, d):
    from ..operators import search

    count = lambda df, key, w: search.inverted(df, key, "words").select(key, "term", F.col("tf").cast("double").alias(w))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), text.tokens(F.col("text")).alias("words"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("words"))
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    qv = v.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).join(asked.select("query_id"), "query_id", "left_semi")
    dense = search.knn(v, qv, 10).withColumnRenamed("vec_id", "doc")
    return curation.hybrid(count(docs, "doc", "w"), count(asked, "query_id", "qw"), dense, 10, {"vector": 0.5}).select("query_id", "doc", F.round("rrf", 8).alias("rrf"), "rank")


@query("q8_semantic_cache", f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS hit, {_COS} AS score FROM embeddings v JOIN embeddings q ON v.vec_id < q.vec_id AND v.label = q.label WHERE q.vec_id % 20 = 0), k AS (SELECT * FROM s WHERE score >= 0.25e0)
SELECT query_id, min(hit) AS hit, round(arg_min(score, hit), 6) AS score FROM k GROUP BY 1""")
def q8(spark, d):
    """Every twentieth vector asks; the label is the scope, the id the time."""
    v = table(spark, d, "embeddings")
    cached = v.select(F.col("vec_id").alias("hit"), F.col("label").alias("scope"), F.col("vec_id").alias("stored_at"), F.col("embedding").alias("v"))
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("vec_id").alias("at"), F.col("embedding").alias("q"))
    return curation.cached_hits(asked, cached, 0.25).select("query_id", "hit", F.round("score", 6).alias("score"))


@query("q6_place_text", f"""WITH p AS (SELECT c_custkey AS place_id, {d_norm("c_name || ' ' || lower(c_mktsegment)")} AS name FROM customer), q AS (SELECT s_suppkey AS query_id, CASE s_suppkey % 3 WHEN 0 THEN 'customer ' || lpad(s_suppkey::VARCHAR, 9, '0') || ' building' WHEN 1 THEN 'customar ' || lpad(s_suppkey::VARCHAR, 9, '0') ELSE 'hous ' || lpad(s_suppkey::VARCHAR, 9, '0') END AS q FROM supplier),
w AS (SELECT query_id, place_id, q, name, list_distinct(string_split(q, ' ')) AS qw, list_distinct(string_split(name, ' ')) AS pw FROM p, q),
s AS (SELECT query_id, place_id, CASE WHEN name = q THEN 8e0 ELSE 0e0 END + CASE WHEN contains(' ' || name || ' ', ' ' || q || ' ') THEN 4e0 ELSE 0e0 END + 3 * len(list_intersect(qw, pw)) / len(qw)::DOUBLE
 + 2 * len(list_filter(qw, lambda x: NOT list_contains(pw, x) AND len(list_filter(pw, lambda y: left(x, 1) = left(y, 1) AND levenshtein(x, y) <= CASE WHEN length(x) < 5 THEN 0 WHEN length(x) <= 8 THEN 1 WHEN length(x) <= 14 THEN 2 ELSE 3 END)) > 0)) / len(qw)::DOUBLE AS score FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place_id) AS rank FROM s WHERE score > 0) SELECT query_id, place_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""")
def q6(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("place_id"), text.normalize(F.concat("c_name", F.lit(" "), F.lower("c_mktsegment"))).alias("name"))
    key = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    asked = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("customer "), key, F.lit(" building"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("customar "), key)).otherwise(F.concat(F.lit("hous "), key))
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), asked.alias("name"))
    return curation.place_text_search(p, q, 5).select("query_id", "place_id", F.round("score", 6).alias("score"), "rank")


@query("q9_documents_of_terms", f"""WITH d AS (SELECT doc_id AS doc, unnest({d_tokens('text')}) AS term FROM documents), w AS (SELECT doc, term, count(*)::DOUBLE AS w FROM d GROUP BY 1, 2), q AS (SELECT item_id AS query_id, unnest({d_tokens('text')}) AS term FROM benchmark), qw AS (SELECT query_id, term, count(*)::DOUBLE AS qw FROM q GROUP BY 1, 2),
s AS (SELECT query_id, doc, sum(w * qw) AS score FROM w JOIN qw USING (term) GROUP BY 1, 2), k AS (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s),
n AS (SELECT item_id AS query_id, doc_id AS doc FROM documents JOIN benchmark ON source = 'src' || (item_id % 20)), b AS (SELECT query_id, doc, false AS lane FROM k WHERE rank <= 24 UNION ALL SELECT query_id, doc, true FROM n) SELECT query_id, doc, bool_and(lane) AS lane FROM b GROUP BY 1, 2""")
def q9(spark, d):
    from ..operators import search

    count = lambda df, key, w: search.inverted(df, key, "words").select(key, "term", F.col("tf").cast("double").alias(w))
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    found = search.sparse_search(count(docs.select(F.col("doc_id").alias("doc"), text.tokens(F.col("text")).alias("words")), "doc", "w"), count(items.select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("words")), "query_id", "qw"), 24)
    lane = docs.select(F.col("doc_id").alias("doc"), "source").join(items.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source")), "source")
    return curation.with_lane(found, lane, "query_id", "doc")


@query("c12_filtered_answers", f"""WITH {_SUPPORT}, x AS (SELECT c.conv_id, c.turn, c.text, st.status = 'SUPPORTED' AS ok FROM c JOIN st USING (claim_id)), g AS (SELECT conv_id, string_agg(CASE WHEN ok THEN text END, ' ' ORDER BY turn) AS t, count(*) AS total, count(CASE WHEN NOT ok THEN 1 END) AS removed FROM x GROUP BY 1)
SELECT conv_id, CASE WHEN total = removed THEN 'Not enough evidence.' ELSE t END AS text, total, removed, total = removed AS abstained FROM g""")
def c12(spark, d):
    c, s = support(spark, d)
    rows = passages.block_status(c, s).join(c.select("claim_id", "conv_id", F.col("turn").alias("n"), F.col("text").alias("sentence")), "claim_id").withColumn("ok", F.col("status") == "SUPPORTED")
    return curation.filtered_answers(rows, "conv_id", "Not enough evidence.")


#: Crawl visits: an order is a visit of its customer's page; the status tells the content.
VISITS = "SELECT o_custkey AS url, o_orderdate AS at, o_orderkey, o_orderstatus AS content_hash FROM {orders}"


@query("c10_recrawl_plan", f"""WITH RECURSIVE v AS (SELECT url, "at", arg_max(content_hash, o_orderkey) AS h FROM ({sql(VISITS)}) GROUP BY 1, 2),
w AS (SELECT url, "at", row_number() OVER (PARTITION BY url ORDER BY "at") AS i, coalesce((lag(h) OVER (PARTITION BY url ORDER BY "at") <> h)::INT, 0)::DOUBLE AS c FROM v),
e AS (SELECT url, i, "at", c AS rate FROM w WHERE i = 1 UNION ALL SELECT w.url, w.i, w."at", 0.7e0 * e.rate + 0.3e0 * w.c FROM e JOIN w ON w.url = e.url AND w.i = e.i + 1),
l AS (SELECT url, arg_max(rate, i) AS rate, max(i) AS visits, max("at") AS d FROM e GROUP BY 1)
SELECT url, round(rate, 6) AS rate, CAST(visits AS INTEGER) AS visits, to_timestamp(floor(epoch(d) + 604800 - rate * 601200))::TIMESTAMP AS next_due FROM l""")
def c10(spark, d):
    v = derive(spark, d, VISITS).groupBy("url", "at").agg(F.max_by("content_hash", "o_orderkey").alias("content_hash"))
    return curation.recrawl_plan(v).withColumn("rate", F.round("rate", 6))


@query("c10_discovered", rf"""WITH {d_urls("(SELECT page_id % 4 + 1 AS page_id, target AS url, '' AS html FROM (" + d_links('page_id') + "))")}
SELECT canonical AS url, max(greatest(0.05e0, 1 - 0.25e0 * page_id)) AS priority, min(page_id) AS depth FROM urls WHERE host <> '' GROUP BY 1""")
def c10_discovered(spark, d):
    p = derive(spark, d, _LINKED).select("url", "html", (F.col("page_id") % 4).alias("d"))
    return curation.discovered(p, "html", "d")


@query("c8_businesses", rf"""WITH b AS (SELECT page_id, url, {d_norm("regexp_extract(html, '<title>([^<]*)', 1)")} AS name, {D_VISIBLE} AS t FROM pages),
f AS (SELECT name, url, nullif(regexp_extract(t, '((?:\+84|\b0)[0-9][0-9 .-]{{7,11}}[0-9])\b', 1), '') AS phone, nullif(regexp_replace(regexp_extract(t, '(\d{{1,2}}:\d{{2}}\s*[-–]\s*\d{{1,2}}:\d{{2}})', 1), '\s', '', 'g'), '') AS hours, TRY_CAST(nullif(regexp_extract(t, '(\d+(?:\.\d+)?)\s*/\s*5\b', 1), '') AS DOUBLE) AS rating FROM b WHERE name <> '')
SELECT name, count(DISTINCT url) AS urls, arg_min(phone, CASE WHEN phone IS NOT NULL THEN url END) AS phone, arg_min(hours, CASE WHEN hours IS NOT NULL THEN url END) AS hours, arg_min(rating, CASE WHEN rating IS NOT NULL THEN url END) AS rating, count(DISTINCT url) >= 2 AS corroborated FROM f GROUP BY 1""")
def c8(spark, d):
    p = table(spark, d, "pages").select("url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), web.visible_text(F.col("html")).alias("body"))
    return curation.businesses(p, "url", "title", "body").drop("lat", "lon")
