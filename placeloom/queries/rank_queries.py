"""Queries of ranking, search, evidence and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import evaluation, evidence, late_interaction, ranking, search, text_index
from ..plans.graph import shared_path
from .fixtures import RANKED, derive, sql, table
from .registry import query
from .text_queries import d_tokens

_R = f"r AS ({sql(RANKED)})"


def ranked(spark, d):
    return derive(spark, d, RANKED)


def n_rank(rows, *names):
    return rows.select(*[F.col(c).cast("int").alias(c) if c in ("rank", "place") else F.col(c) for c in names])


@query("a1_minmax", f"WITH {_R}, w AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(score) OVER w AS m, stddev_pop(score) OVER w AS sd FROM r WINDOW w AS (PARTITION BY query_id, provider)) SELECT query_id, provider, item, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN hi = 0 THEN 0 ELSE 1 END, 6) AS minmax, round(CASE WHEN sd > 0 THEN (score - m) / sd ELSE 0 END, 6) AS z FROM w")
def a1(spark, d):
    by = ["query_id", "provider"]
    r = ranking.zscore(ranking.minmax(ranked(spark, d), by, "score"), by, "score")
    return r.select("query_id", "provider", "item", F.round("minmax", 6).alias("minmax"), F.round("z", 6).alias("z"))


_RANK = f"{_R}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, provider ORDER BY score DESC, url) AS rank FROM r)"


@query("w1_rank", f"WITH {_RANK} SELECT query_id, provider, url, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def w1(spark, d):
    return ranking.with_rank(ranked(spark, d), ["query_id", "provider"], "score", "url").filter("rank <= 10").select("query_id", "provider", "url", "rank")


_RRF = f"{_RANK}, f AS (SELECT query_id, url, sum(CASE provider WHEN 'lexical' THEN 1.0e0 ELSE 0.8e0 END / (60 + rank)) AS rrf, count(*) AS n FROM k GROUP BY query_id, url)"


def fused(spark, d, weights=None):
    r = ranking.with_rank(ranked(spark, d), ["query_id", "provider"], "score", "url")
    return ranking.rrf(r, "query_id", "url", weights)


@query("a2_weighted_rrf", f"WITH {_RRF} SELECT query_id, url, round(rrf, 9) AS rrf, n AS providers FROM f")
def a2(spark, d):
    return fused(spark, d, {"vector": 0.8}).select("query_id", "url", F.round("rrf", 9).alias("rrf"), F.size("providers").cast("long").alias("providers"))


@query("a3_multi_query_rrf", f"WITH {_RANK} SELECT query_id % 5 AS topic, url, round(sum(1e0 / (60 + rank)), 9) AS rrf, count(DISTINCT query_id) AS matched FROM (SELECT query_id, url, min(rank) AS rank FROM k GROUP BY query_id, url) GROUP BY 1, 2")
def a3(spark, d):
    r = ranking.with_rank(ranked(spark, d), ["query_id", "provider"], "score", "url").withColumn("topic", F.col("query_id") % 5).withColumn("provider", F.col("query_id"))
    out = ranking.rrf(r, "topic", "url")
    return out.select("topic", "url", F.round("rrf", 9).alias("rrf"), F.size("providers").cast("long").alias("matched"))


@query("w2_domain_cap", f"WITH {_R}, c AS (SELECT query_id, domain, item, max(score) AS score FROM r GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY score DESC, item) AS dn FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM k WHERE dn <= 2) SELECT query_id, domain, item, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 15")
def w2(spark, d):
    c = ranked(spark, d).groupBy("query_id", "domain", "item").agg(F.max("score").alias("score"))
    return ranking.domain_cap(c, "query_id", "domain", "score", "item", 2, 15).select("query_id", "domain", "item", "rank")


@query("w3_w4_penalties", f"WITH {_R} SELECT query_id, provider, item, round(0.3e0 * count(*) OVER (PARTITION BY query_id, provider, domain)::DOUBLE / count(*) OVER (PARTITION BY query_id, provider), 6) AS diversity, round(least(1e0, 0.2e0 * count(*) OVER (PARTITION BY query_id, provider, domain ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 6) AS penalty FROM r")
def w3(spark, d):
    r = ranked(spark, d).withColumn("list", F.concat_ws(":", F.col("query_id").cast("string"), "provider"))
    r = ranking.earlier_of_domain(ranking.domain_share_penalty(r, "list", "domain"), "list", "domain", "item")
    return r.select("query_id", "provider", "item", F.round("diversity", 6).alias("diversity"), F.round("penalty", 6).alias("penalty"))


@query("t2_t3_quality", f"WITH {_R}, s AS (SELECT query_id, provider, item, score / 110000e0 AS rel, d * 10 AS auth, q / 50e0 AS fresh FROM r) SELECT query_id, provider, item, round(greatest(0e0, least(1e0, 0.35e0 * greatest(0e0, least(1e0, rel)) + 0.25e0 * auth + 0.25e0 * fresh - 0.10e0 * 0.1e0 + 0.05e0 * 0.5e0)) + 1e-9, 6) AS v1, round(greatest(0e0, least(1e0, 0.40e0 * rel + 0.20e0 * auth + 0.15e0 * fresh + 0.10e0 * fresh + 0.10e0 * auth + 0.05e0 * rel)) + 1e-9, 6) AS v2 FROM s")
def t2(spark, d):
    r = ranked(spark, d).select("query_id", "provider", "item", (F.col("score") / 110000).alias("rel"), (F.col("d") * 10).alias("auth"), (F.col("q") / 50).alias("fresh"))
    c = F.col
    v1 = ranking.quality_v1(c("rel"), c("auth"), c("fresh"), F.lit(0.1), F.lit(0.5))
    v2 = ranking.quality_v2(c("rel"), c("auth"), c("fresh"), c("fresh"), c("auth"), c("rel"))
    return r.select("query_id", "provider", "item", F.round(v1 + 1e-9, 6).alias("v1"), F.round(v2 + 1e-9, 6).alias("v2"))


@query("t8_url_prerank", f"WITH {_R}, s AS (SELECT query_id, domain, item, max(0.30e0 * score / 110000e0 + 0.25e0 * q / 50e0 + 0.15e0 * 0.5e0 + 0.10e0 * (1 - d) - 0.20e0 * 0.1e0) AS s FROM r GROUP BY 1, 2, 3) SELECT query_id, item, round(s + 1e-9, 6) AS score FROM s")
def t8(spark, d):
    c = F.col
    s = ranking.url_score(c("score") / 110000, c("q") / 50, F.lit(0.5), c("d"), F.lit(0.1))
    return ranked(spark, d).withColumn("s", s).groupBy("query_id", "domain", "item").agg(F.max("s").alias("s")).select("query_id", "item", F.round(F.col("s") + 1e-9, 6).alias("score"))


#: Hits of places for queries, with all that the place score looks at.
_HITS = """
SELECT l_suppkey % 20 AS query_id, l_orderkey * 10 + l_linenumber AS place_id, CAST(l_extendedprice AS DOUBLE) AS text_score, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity * 40e0 END AS distance_m,
  CASE l_suppkey % 4 WHEN 0 THEN 'food' WHEN 1 THEN 'tourism' WHEN 2 THEN '' ELSE 'office' END AS wanted, CASE l_partkey % 5 WHEN 0 THEN 'food' WHEN 1 THEN 'retail' WHEN 2 THEN 'culture' WHEN 3 THEN 'office' END AS category,
  l_discount * 10e0 AS confidence, l_tax * 12e0 AS freshness, l_linenumber AS source_count, CASE l_partkey % 6 WHEN 0 THEN 'open' WHEN 1 THEN 'unknown' WHEN 2 THEN 'temporarily_closed' WHEN 3 THEN 'permanently_closed' END AS status,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE 1e0 + l_partkey % 9 * 0.5e0 END AS rating, l_partkey % 3000 AS review_count, CASE l_linenumber % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS open_now
FROM {lineitem}
"""
_NEAR_SQL = "(wanted = 'food' AND category = 'retail') OR (wanted = 'retail' AND category = 'food') OR (wanted = 'tourism' AND category IN ('lodging', 'culture')) OR (wanted = 'office' AND category = 'industrial')"


@query("t1_place_rank", f"""WITH h AS ({sql(_HITS)}), c AS (SELECT *, text_score / max(text_score) OVER (PARTITION BY query_id) AS c1, CASE WHEN distance_m IS NULL THEN 0.5e0 ELSE exp(-distance_m / 750e0) END AS c2,
 CASE WHEN wanted = '' THEN 0.5e0 WHEN category IS NULL THEN 0.3e0 WHEN category = wanted THEN 1e0 WHEN {_NEAR_SQL} THEN 0.6e0 ELSE 0e0 END AS c3, least(1e0, greatest(0e0, confidence)) AS c4, least(1e0, greatest(0e0, freshness)) AS c5, least(1e0, source_count / 3e0) AS c6,
 CASE status WHEN 'open' THEN 1e0 WHEN 'temporarily_closed' THEN 0.25e0 WHEN 'permanently_closed' THEN 0e0 ELSE 0.6e0 END AS c7, least(1e0, (coalesce(rating, 3.5e0) * review_count + 35e0) / (review_count + 10) / 5) AS c8, least(1e0, ln(1e0 + review_count) / ln(1001e0)) AS c9, CASE WHEN open_now IS NULL THEN 0.5e0 WHEN open_now THEN 1e0 ELSE 0e0 END AS c10 FROM h),
s AS (SELECT *, round(0.30e0 * c1 + 0.20e0 * c2 + 0.08e0 * c3 + 0.08e0 * c4 + 0.07e0 * c5 + 0.06e0 * c6 + 0.06e0 * c7 + 0.06e0 * c8 + 0.04e0 * c9 + 0.05e0 * c10, 9) AS score FROM c),
k AS (SELECT 'score' AS sort, query_id, place_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance_m NULLS LAST, place_id) AS rank FROM s UNION ALL SELECT 'distance', query_id, place_id, score, row_number() OVER (PARTITION BY query_id ORDER BY distance_m NULLS LAST, score DESC, place_id) FROM s
 UNION ALL SELECT 'popularity', query_id, place_id, score, row_number() OVER (PARTITION BY query_id ORDER BY review_count DESC, score DESC, distance_m NULLS LAST, place_id) FROM s)
SELECT sort, query_id, place_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def t1(spark, d):
    h = derive(spark, d, _HITS).withColumn("categories", F.filter(F.array("category"), lambda x: x.isNotNull()))
    out = None
    for sort in (None, "distance", "popularity"):
        some = ranking.rank_places(h, "query_id", "place_id", 10, sort).select(F.lit(sort or "score").alias("sort"), "query_id", "place_id", F.round("score", 6).alias("score"), "rank")
        out = some if out is None else out.union(some)
    return out


@query("w9_keep_ends", f"WITH {_RANK}, t AS (SELECT * FROM k WHERE rank <= 9) SELECT query_id, provider, item, CAST(CASE WHEN rank % 2 = 1 THEN (rank + 1) / 2 ELSE 9 - rank / 2 + 1 END AS INTEGER) AS place FROM t")
def w9(spark, d):
    r = ranking.with_rank(ranked(spark, d), ["query_id", "provider"], "score", "url").filter("rank <= 9").withColumn("list", F.concat_ws(":", F.col("query_id").cast("string"), "provider"))
    return n_rank(ranking.keep_ends(r, "list", "rank", 9), "query_id", "provider", "item", "place")


@query("w10_pack", f"WITH {_RANK}, s AS (SELECT *, sum(q) OVER (PARTITION BY query_id, provider ORDER BY rank) AS spent FROM k) SELECT query_id, provider, item, round(spent, 3) AS spent FROM s WHERE spent <= 200")
def w10(spark, d):
    r = ranking.with_rank(ranked(spark, d), ["query_id", "provider"], "score", "url").withColumn("list", F.concat_ws(":", F.col("query_id").cast("string"), "provider"))
    return ranking.pack(r, "list", "rank", "q", 200).select("query_id", "provider", "item", F.round("spent", 3).alias("spent"))


@query("w11_ends_of", "WITH c AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) SELECT l_orderkey, l_linenumber FROM c WHERE i <= 2 OR i > n - 2")
def w11(spark, d):
    return ranking.ends_of(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber", 4)


@query("t9_recrawl_priority", "SELECT l_orderkey, l_linenumber, round(0.30e0 * l_discount * 10 + 0.20e0 * l_tax * 10 + 0.20e0 * l_quantity / 50 + 0.15e0 * 0.5e0 + 0.10e0 * 0.5e0 + 0.05e0, 6) AS priority FROM lineitem ORDER BY priority DESC, l_orderkey, l_linenumber LIMIT 100")
def t9(spark, d):
    c = F.col
    p = F.round(ranking.recrawl_priority(c("l_discount") * 10, c("l_tax") * 10, c("l_quantity") / 50, F.lit(0.5), F.lit(0.5), F.lit(1.0)), 6)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("priority")).orderBy(F.desc("priority"), "l_orderkey", "l_linenumber").limit(100)


# --- search ----------------------------------------------------------------------------------------------------

_BM25 = f"""
docs AS (SELECT doc_id AS doc, {d_tokens('text')} AS words FROM documents), qs AS (SELECT item_id AS query_id, unnest(list_distinct({d_tokens('text')})) AS term FROM benchmark),
st AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM docs), post AS (SELECT doc, len(words) AS len, unnest(words) AS term FROM docs),
tf AS (SELECT doc, len, term, count(*) AS tf FROM post WHERE term IN (SELECT term FROM qs) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / mean))) AS score FROM qs JOIN df USING (term) JOIN tf USING (term), st GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, doc) AS rank FROM sc)"""


def bm25_of(spark, d, top):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), text.tokens(F.col("text")).alias("words"))
    qs = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("words"))
    return search.bm25(docs, qs, top)


@query("q1_bm25", f"WITH {_BM25} SELECT query_id, round(score, 5) AS score FROM top WHERE rank <= 5")
def q1(spark, d):
    return bm25_of(spark, d, 5).select("query_id", F.round("score", 5).alias("score"))


_FIELDS = f"""d AS (SELECT doc_id AS doc, {d_tokens('text')} AS words, {d_tokens('source')} AS description FROM documents), f AS (SELECT doc, 'title' AS field, words[1:10] AS words FROM d UNION ALL SELECT doc, 'context', words FROM d UNION ALL SELECT doc, 'description', description FROM d),
qs AS (SELECT DISTINCT item_id AS query_id, unnest({d_tokens('text')}) AS term FROM benchmark), st AS (SELECT field, count(*) AS n, avg(len(words)) AS mean FROM f WHERE len(words) > 0 GROUP BY 1), post AS (SELECT doc, field, len(words) AS len, unnest(words) AS term FROM f),
tf AS (SELECT doc, field, len, term, count(*) AS tf FROM post WHERE term IN (SELECT term FROM qs) GROUP BY 1, 2, 3, 4), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY 1, 2),
sc AS (SELECT query_id, doc, field, CASE field WHEN 'title' THEN 3 WHEN 'context' THEN 2 ELSE 1 END * sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / mean))) AS score FROM qs JOIN tf USING (term) JOIN df USING (field, term) JOIN st USING (field) GROUP BY 1, 2, 3),
best AS (SELECT query_id, doc, max(score) AS score FROM sc GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, doc) AS rank FROM best)"""


@query("q1_fields", f"WITH {_FIELDS} SELECT query_id, round(score, 5) AS score FROM top WHERE rank <= 5")
def q1_fields(spark, d):
    """A stored index of title, context and description, searched with weights by field."""
    words = text.tokens(F.col("text"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.slice(words, 1, 10).alias("title"), words.alias("context"), text.tokens(F.col("source")).alias("description"))
    path = shared_path(spark, "text-index")
    text_index.build(docs, ["title", "context", "description"], path)
    qs = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("words"))
    return text_index.search(spark, path, qs, 5).select("query_id", F.round("score", 5).alias("score"))


_DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
_COS = f"{_DOT.format('v.embedding', 'q.embedding')} / sqrt({_DOT.format('v.embedding', 'v.embedding')}) / sqrt({_DOT.format('q.embedding', 'q.embedding')})"


@query("q2_knn", f"WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def q2(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return search.knn(v, q, 10).select("query_id", F.round("score", 5).alias("score"), "rank")


@query("q3_sparse", f"WITH d AS (SELECT doc_id AS doc, unnest({d_tokens('text')}) AS term FROM documents), w AS (SELECT doc, term, count(*)::DOUBLE AS w FROM d GROUP BY 1, 2), q AS (SELECT item_id AS query_id, unnest({d_tokens('text')}) AS term FROM benchmark), qw AS (SELECT query_id, term, count(*)::DOUBLE AS qw FROM q GROUP BY 1, 2), s AS (SELECT query_id, doc, sum(w * qw) AS score FROM w JOIN qw USING (term) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s) SELECT query_id, doc, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10")
def q3(spark, d):
    words = lambda t, k, n: search.inverted(table(spark, d, t).select(F.col(k).alias(n), text.tokens(F.col("text")).alias("w")), n, "w")
    docs = words("documents", "doc_id", "doc").select("doc", "term", F.col("tf").cast("double").alias("w"))
    qs = words("benchmark", "item_id", "query_id").select("query_id", "term", F.col("tf").cast("double").alias("qw"))
    return search.sparse_search(docs, qs, 10)


@query("q4_late_interaction", f"WITH s AS (SELECT q.label AS query_id, q.vec_id AS token, v.vec_id % 50 AS doc, max({_DOT.format('v.embedding', 'q.embedding')}) AS best FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 GROUP BY 1, 2, 3), t AS (SELECT query_id, doc, sum(best) AS score FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM t) SELECT query_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5")
def q4(spark, d):
    e = table(spark, d, "embeddings")
    docs = e.select((F.col("vec_id") % 50).alias("doc"), F.col("embedding").alias("v"))
    qs = e.filter("vec_id % 20 = 0").select(F.col("label").alias("query_id"), F.col("vec_id").alias("token"), F.col("embedding").alias("q"))
    at = late_interaction.centroids(docs)
    return late_interaction.search(late_interaction.index(docs, at), at, qs, 5).select("query_id", F.round("score", 5).alias("score"), "rank")


@query("a30_ir_metrics", f"WITH {_R}, k AS (SELECT query_id, item AS doc, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM r WHERE provider = 'lexical'), rel AS (SELECT DISTINCT query_id, item AS doc FROM r WHERE provider = 'vector' AND q > 45), t AS (SELECT query_id, count(*) AS total FROM rel GROUP BY 1), h AS (SELECT query_id, rank FROM k JOIN rel USING (query_id, doc)), g AS (SELECT query_id, count(*) FILTER (rank <= 50) AS h, count(*) FILTER (rank <= 10) AS p, coalesce(sum(1e0 / log2(rank + 1)) FILTER (rank <= 20), 0) AS dcg, max(1e0 / rank) AS mrr FROM h GROUP BY 1) SELECT query_id, round(coalesce(h::DOUBLE / total, 0), 6) AS recall, round(coalesce(p / 10e0, 0), 6) AS precision, round(coalesce(dcg / list_sum(list_transform(range(1, least(total, 20) + 1), lambda i: 1e0 / log2(i + 1))), 0), 6) AS ndcg, round(coalesce(mrr, 0), 6) AS mrr FROM t LEFT JOIN g USING (query_id)")
def a30(spark, d):
    r = ranked(spark, d)
    k = ranking.with_rank(r.filter("provider = 'lexical'").select("query_id", F.col("item").alias("doc"), "score"), ["query_id"], "score", "doc")
    rel = r.filter("provider = 'vector' AND q > 45").select("query_id", F.col("item").alias("doc"))
    m = evaluation.ir_metrics(k, rel)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "ndcg", "mrr")])


@query("a29_index_overlap", f"WITH {_RANK}, l AS (SELECT query_id, provider, list(item) AS ids FROM k WHERE rank <= 50 GROUP BY 1, 2) SELECT a.query_id, round(len(list_intersect(a.ids, b.ids))::DOUBLE / len(list_distinct(a.ids)), 6) AS recall, round(len(list_intersect(a.ids, b.ids))::DOUBLE / len(list_distinct(list_concat(a.ids, b.ids))), 6) AS jaccard FROM l a JOIN l b USING (query_id) WHERE a.provider = 'lexical' AND b.provider = 'vector'")
def a29(spark, d):
    k = ranking.with_rank(ranked(spark, d), ["query_id", "provider"], "score", "url").filter("rank <= 50").groupBy("query_id", "provider").agg(F.collect_set("item").alias("ids"))
    o = evaluation.overlap(k.filter("provider = 'lexical'"), k.filter("provider = 'vector'"))
    return o.select("query_id", F.round("recall", 6).alias("recall"), F.round("jaccard", 6).alias("jaccard"))


# --- evidence --------------------------------------------------------------------------------------------------


@query("f33_chunks", "WITH c AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 800) / 600e0)) AS BIGINT) + 1)) AS n FROM documents) SELECT doc_id, n * 600 AS begin, least(n * 600 + 800, length(text)) AS finish, sha256(doc_id || ':' || n * 600) AS chunk_id, md5(substr(text, n * 600 + 1, 800)) AS h FROM c")
def f33(spark, d):
    c = evidence.chunks(table(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("finish"), "chunk_id", F.md5("text").alias("h"))


@query("a12_near_pairs", f"""
WITH t AS (SELECT doc_id, {d_tokens('text')} AS t FROM documents), s AS (SELECT min(doc_id) AS a, s FROM (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')))) AS s FROM t WHERE len(t) >= 5) GROUP BY s),
g AS (SELECT a, len(s) AS n, unnest(s) AS g FROM s), c AS (SELECT x.a AS a, y.a AS b, x.n AS n, y.n AS m, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.a < y.a GROUP BY 1, 2, 3, 4)
SELECT a, b, round(k::DOUBLE / (n + m - k), 6) AS jaccard FROM c WHERE k::DOUBLE / (n + m - k) >= 0.8""")
def a12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return evidence.shingle_pairs(docs, "doc_id", "w").withColumn("jaccard", F.round("jaccard", 6))


_CS = f"c AS (SELECT item_id AS claim_id, list_distinct({d_tokens('text')}) AS w FROM benchmark), c1 AS (SELECT claim_id, len(w) AS n, unnest(w) AS word FROM c), s1 AS (SELECT doc_id AS source_id, unnest(list_distinct({d_tokens('text')})) AS word FROM documents), o AS (SELECT claim_id, source_id, count(*)::DOUBLE / n AS overlap FROM c1 JOIN s1 USING (word) GROUP BY claim_id, n, source_id)"


def supports(spark, d):
    words = lambda t, k, n: table(spark, d, t).select(F.col(k).alias(n), text.tokens(F.col("text")).alias("words"))
    c, s = words("benchmark", "item_id", "claim_id"), words("documents", "doc_id", "source_id")
    return c, evidence.claim_support(c, s, 0.5)


@query("j19_claim_support", f"WITH {_CS} SELECT claim_id, source_id, round(overlap, 6) AS overlap FROM o WHERE overlap >= 0.5")
def j19(spark, d):
    return supports(spark, d)[1].withColumn("overlap", F.round("overlap", 6))


@query("a17_verdicts", f"""WITH {_CS}, s AS (SELECT claim_id, source_id, source_id % 10 AS cluster_id, source_id % 3 = 0 AS negated FROM o WHERE overlap >= 0.5), k AS (SELECT claim_id, cluster_id, max(negated::INT) AS no, max((NOT negated)::INT) AS yes, count(*) AS n FROM s GROUP BY 1, 2), g AS (SELECT claim_id, sum(yes) AS yes, sum(no) AS no, sum(n) AS sources, count(*) AS clusters FROM k GROUP BY 1)
SELECT claim_id, CASE WHEN yes > 0 AND no > 0 THEN 'conflict' WHEN no > 0 THEN 'contradicted' WHEN yes >= 2 THEN 'supported' WHEN yes = 1 THEN 'partial' ELSE 'insufficient' END AS verdict, CAST(coalesce(clusters, 0) AS BIGINT) AS clusters, CAST(coalesce(sources, 0) AS BIGINT) AS sources FROM c LEFT JOIN g USING (claim_id)""")
def a17(spark, d):
    c, s = supports(spark, d)
    s = s.withColumn("negated", F.col("source_id") % 3 == 0)
    clusters = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") % 10).alias("cluster_id"))
    return evidence.verdicts(c, s, clusters)


@query("a15_numbers", r"WITH n AS (SELECT source AS claim_key, doc_id AS source_id, unnest(regexp_extract_all(text, '\b[0-9]{4}\b')) AS number FROM documents) SELECT claim_key, count(DISTINCT number) AS values, count(DISTINCT source_id) AS sources, count(DISTINCT source_id) = 1 AS single_source FROM n GROUP BY 1")
def a15(spark, d):
    n = table(spark, d, "documents").select(F.col("source").alias("claim_key"), F.col("doc_id").alias("source_id"), F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{4}\b"), F.lit(0))).alias("number"))
    return evidence.numeric_agreement(n)


_PASS = f"p AS (SELECT doc_id AS doc, n, unnest(list_distinct({d_tokens('substr(text, n * 600 + 1, 800)')})) AS word FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 800) / 600e0)) AS BIGINT) + 1)) AS n FROM documents)), q AS (SELECT item_id AS claim_id, unnest(list_distinct({d_tokens('text')})) AS word FROM benchmark WHERE item_id % 20 = 0), h AS (SELECT claim_id, doc, n, sum(CASE WHEN regexp_matches(word, '^[0-9]+$') THEN 3 ELSE 1 END) AS hits FROM q JOIN p USING (word) GROUP BY 1, 2, 3)"


@query("t12_best_passage", f"WITH {_PASS}, k AS (SELECT *, row_number() OVER (PARTITION BY claim_id, doc ORDER BY hits DESC, n) AS r FROM h) SELECT claim_id, doc, CAST(n AS INTEGER) AS n, CAST(hits AS BIGINT) AS hits FROM k WHERE r = 1")
def t12(spark, d):
    p = evidence.chunks(table(spark, d, "documents"), "doc_id", "text").select(F.col("doc_id").alias("doc"), "n", text.tokens(F.col("text")).alias("words"))
    c = table(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("claim_id"), text.tokens(F.col("text")).alias("words"))
    return evidence.best_passage(c, p)


@query("a14_evidence_per_query", f"WITH {_R} SELECT query_id, count(DISTINCT url) AS items, count(DISTINCT domain) AS domains, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers, round(count(DISTINCT domain) / 97e0, 6) AS coverage FROM r GROUP BY query_id")
def a14(spark, d):
    return evidence.per_query(ranked(spark, d), "query_id", 97).select("query_id", "items", "domains", F.array_join("providers", ",").alias("providers"), F.round("coverage", 6).alias("coverage"))


@query("u1_lane_union", f"WITH {_R} SELECT query_id, url, max(score) AS score FROM r GROUP BY 1, 2")
def u1(spark, d):
    r = ranked(spark, d)
    return ranking.lane_union(r.filter("provider = 'lexical'").unionByName(r.filter("provider <> 'lexical'")), "query_id", "url", "provider", "score").select("query_id", "url", "score")


@query("u3_difference", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def u3(spark, d):
    return evidence.difference(table(spark, d, "part").select(F.col("p_partkey").alias("id")), table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("id")), "id")


@query("u4_stale_passages", "WITH c AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 800) / 600e0)) AS BIGINT) + 1)) AS n FROM documents), n AS (SELECT doc_id, left(text, CAST(length(text) / 2 AS BIGINT)) AS text FROM documents WHERE doc_id % 3 = 0), f AS (SELECT doc_id, unnest(range(0, CAST(greatest(0, ceil((length(text) - 800) / 600e0)) AS BIGINT) + 1)) AS n FROM n) SELECT doc_id, sha256(doc_id || ':' || n * 600) AS chunk_id FROM c WHERE doc_id % 3 = 0 AND (doc_id, n) NOT IN (SELECT doc_id, n FROM f)")
def u4(spark, d):
    """Passages of documents cut to half that their new passages no longer have."""
    docs = table(spark, d, "documents")
    old = evidence.chunks(docs, "doc_id", "text")
    new = evidence.chunks(docs.filter("doc_id % 3 = 0").withColumn("text", F.expr("left(text, cast(length(text) / 2 as int))")), "doc_id", "text")
    return evidence.stale_passages(old, new, "doc_id").select("doc_id", "chunk_id")


_VEC = "vq AS (SELECT vec_id AS query_id, embedding FROM embeddings), vi AS (SELECT vec_id AS vid, embedding FROM embeddings)"


def semantic(spark, d, rows):
    """rows(query_id, item) with semantic: the cosine of the query's vector and the item's, null if one is missing."""
    v = table(spark, d, "embeddings")
    rows = rows.withColumn("vid", F.col("item") % 300)
    rows = rows.join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", "left").join(v.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("v")), "vid", "left")
    return rows.withColumn("semantic", F.when(F.col("q").isNotNull() & F.col("v").isNotNull(), geo.cosine(F.col("v"), F.col("q")))).drop("q", "v", "vid")


_COS2 = f"{_DOT.format('vi.embedding', 'vq.embedding')} / sqrt({_DOT.format('vi.embedding', 'vi.embedding')}) / sqrt({_DOT.format('vq.embedding', 'vq.embedding')})"


@query("t4_semantic_rerank", f"""WITH {_R}, {_VEC}, s AS (SELECT query_id, item, max(score) / 110000e0 AS cheap FROM r GROUP BY 1, 2), c AS (SELECT s.*, {_COS2} AS sem FROM s LEFT JOIN vq USING (query_id) LEFT JOIN vi ON vid = item % 300),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cheap, 9) DESC, item) AS r FROM c), f AS (SELECT query_id, item, round(coalesce(0.4e0 * cheap + 0.6e0 * sem, cheap), 6) AS final FROM k WHERE r <= 20), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item) AS rank FROM f) SELECT query_id, item, final, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10""")
def t4(spark, d):
    """Cheap score, then the top 2k blended with the vectors' cosine, then the top k."""
    r = ranked(spark, d).groupBy("query_id", "item").agg((F.max("score") / 110000).alias("cheap")).withColumn("c9", F.round("cheap", 9))
    some = ranking.with_rank(r, ["query_id"], "c9", "item", "r").filter("r <= 20").select("query_id", "item", "cheap")  # only these need vectors
    return ranking.staged_rerank(semantic(spark, d, some), "query_id", "item", "cheap", "semantic", 10, 0.6, 6).select("query_id", "item", "final", "rank")


@query("t5_rank_search", f"""WITH {_RANK}, {_VEC}, w AS (SELECT *, CASE provider WHEN 'lexical' THEN 1.2e0 ELSE 0.7e0 END AS pw FROM k), f AS (SELECT query_id, url, sum(pw / (60 + rank)) AS rrf FROM w GROUP BY 1, 2),
 i AS (SELECT query_id, url, domain, item, d, q FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY rank, provider) AS n FROM k) WHERE n = 1),
 n AS (SELECT *, (rrf - min(rrf) OVER p) / (max(rrf) OVER p - min(rrf) OVER p) AS normalized, 0.3e0 * count(*) OVER (PARTITION BY query_id, domain)::DOUBLE / count(*) OVER p AS diversity FROM i JOIN f USING (query_id, url) WINDOW p AS (PARTITION BY query_id)),
 z AS (SELECT *, greatest(0e0, least(1e0, 0.35e0 * normalized + 0.25e0 * d * 10 + 0.25e0 * q / 50e0 - 0.10e0 * diversity + 0.05e0 * 0.5e0)) AS quality FROM n),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(quality, 9) DESC, url) AS r FROM z), b AS (SELECT query_id, url, normalized, quality, round(coalesce(0.5e0 * quality + 0.5e0 * ({_COS2}), quality), 9) AS final FROM t LEFT JOIN vq USING (query_id) LEFT JOIN vi ON vid = item % 300 WHERE r <= 20),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, url) AS rank FROM b) SELECT query_id, url, round(normalized, 6) AS normalized, round(quality, 6) AS quality, round(final, 6) AS final, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 10""")
def t5(spark, d):
    r = ranking.with_rank(ranked(spark, d), ["query_id", "provider"], "score", "url", "position")
    r = r.select("query_id", "provider", "position", "url", "domain", "item", (F.col("d") * 10).alias("authority"), (F.col("q") / 50).alias("freshness"), F.lit(0.5).alias("geo"))
    out = ranking.rank_search(r, 10, {"lexical": 1.2, "vector": 0.7, "unknown": 0.7}, semantic=lambda rows: semantic(spark, d, rows))
    return out.select("query_id", "url", *[F.round(c, 6).alias(c) for c in ("normalized", "quality", "final")], "rank")


@query("a4_fused_lanes", f"""WITH {_RANK}, f AS (SELECT query_id, url, max(d) AS authority, round(sum(1e0 / (60 + rank)) * 10000) / 10 + CASE WHEN count(DISTINCT provider) > 1 THEN 5 ELSE 0 END AS score, count(DISTINCT provider) AS lanes FROM k GROUP BY 1, 2),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM f) SELECT query_id, url, authority, score, lanes, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 15""")
def a4(spark, d):
    from ..operators import curation

    r = ranking.with_rank(ranked(spark, d), ["query_id", "provider"], "score", "url").select("query_id", "url", F.col("provider").alias("lane"), "rank", F.col("item").alias("doc"), F.col("d").alias("authority"))
    return curation.fused_lanes(r, "query_id", "url", 15).select("query_id", "url", "authority", "score", "lanes", "rank")
