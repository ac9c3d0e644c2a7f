"""Queries of dictionary lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import lookup
from .fixtures import derive, sql, table
from .registry import query
from .text_queries import d_norm, d_tokens

#: Labels of parts, and keys that some of them are or hold.
LABELS = """SELECT p_partkey, lower(CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_name ELSE p_type || ' ' || p_name END) AS label FROM {part}"""
KEYS = """SELECT key, MIN(bucket) AS bucket FROM (SELECT lower(p_type) AS key, 'kind' || CAST(LENGTH(p_type) AS STRING) AS bucket FROM {part} WHERE p_type <> 'PROMO'
  UNION ALL SELECT SUBSTRING(p_name, 1, 4), 'short' FROM {part} WHERE p_size < 10 UNION ALL SELECT SUBSTRING(p_name, 1, 3), 'tiny' FROM {part}) AS k GROUP BY key"""
_BUCKET = f"""l AS (SELECT DISTINCT label FROM ({sql(LABELS)})), k AS ({sql(KEYS)}),
h AS (SELECT label, bucket, row_number() OVER (PARTITION BY label ORDER BY key = label DESC, length(key) DESC, key) AS i FROM l JOIN k ON label = key OR (length(key) > 3 AND contains(label, key)))"""


def buckets(spark, d):
    return lookup.bucket_of_labels(derive(spark, d, LABELS).select("label").distinct(), derive(spark, d, KEYS))


@query("f10_category", f"WITH {_BUCKET} SELECT p_partkey, bucket FROM ({sql(LABELS)}) x LEFT JOIN (SELECT * FROM h WHERE i = 1) USING (label)")
def f10(spark, d):
    return derive(spark, d, LABELS).join(buckets(spark, d), "label").select("p_partkey", "bucket")


@query("f18_category_hint", f"""WITH l AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' gần đây ' || lower(p_type), 'gần đây|quanh đây|gần tôi', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM part), k AS ({sql(KEYS)}),
h AS (SELECT p_partkey, key, bucket, row_number() OVER (PARTITION BY p_partkey ORDER BY key = label DESC, length(key) DESC, key) AS i FROM l JOIN k ON label = key OR (length(key) > 3 AND contains(label, key)))
SELECT p_partkey, label AS query, bucket FROM l LEFT JOIN (SELECT * FROM h WHERE i = 1) USING (p_partkey)""")
def f18(spark, d):
    """Phrases of nearness go, then the longest key in the query gives its category."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.concat("p_name", F.lit(" gần đây "), F.lower("p_type")), "gần đây|quanh đây|gần tôi", " "), r"\s+", " "))
    q = table(spark, d, "part").select("p_partkey", bare.alias("label"))
    b = lookup.bucket_of_labels(q.select("label").distinct(), derive(spark, d, KEYS))
    return q.join(b, "label").select("p_partkey", F.col("label").alias("query"), "bucket")


GROUPS = {"BUILDING": ["FURNITURE"], "FURNITURE": ["BUILDING", "HOUSEHOLD"], "HOUSEHOLD": ["FURNITURE"]}


@query("f11_related", """SELECT o_orderkey, CASE WHEN a IS NULL OR b = '' THEN 0.4e0 WHEN a = b THEN 1e0 WHEN (a, b) IN (('BUILDING', 'FURNITURE'), ('FURNITURE', 'BUILDING'), ('FURNITURE', 'HOUSEHOLD'), ('HOUSEHOLD', 'FURNITURE')) THEN 0.6e0 ELSE 0.1e0 END AS related
FROM (SELECT o_orderkey, x.c_mktsegment AS a, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE y.c_mktsegment END AS b FROM orders LEFT JOIN customer x ON x.c_custkey = o_custkey + 1 JOIN customer y ON y.c_custkey = o_custkey)""")
def f11(spark, d):
    c = table(spark, d, "customer")
    a = c.select((F.col("c_custkey") - 1).alias("o_custkey"), F.col("c_mktsegment").alias("a"))
    b = c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("b0"))
    o = table(spark, d, "orders").join(a, "o_custkey", "left").join(b, "o_custkey").withColumn("b", F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("b0")))
    return o.select("o_orderkey", lookup.related(F.col("a"), F.col("b"), GROUPS).alias("related"))


#: Synonyms: a part's brand digits and first word stand for its kind.
SYNONYMS = """SELECT DISTINCT lower(p_type) AS canon, SUBSTRING(p_name, 1, 5) AS form FROM {part} WHERE p_size < 6 AND p_partkey % 7 = 0
  UNION SELECT DISTINCT lower(p_type), lower(p_brand) FROM {part} WHERE p_partkey % 13 = 0"""
TERMS = """SELECT p_partkey AS query_id, CASE p_partkey % 5 WHEN 0 THEN lower(p_type) WHEN 1 THEN SUBSTRING(p_name, 1, 5) WHEN 2 THEN p_name WHEN 3 THEN lower(p_brand) ELSE SUBSTRING(lower(p_type), 1, 4) END AS term FROM {part}"""


@query("f48_synonyms", f"""WITH s AS ({sql(SYNONYMS)}), f AS (SELECT canon, form FROM s UNION SELECT canon, canon FROM s), t AS ({sql(TERMS)}), u AS (SELECT DISTINCT term FROM t WHERE length(term) >= 2),
h AS (SELECT DISTINCT term, canon FROM u JOIN f ON term = form OR (least(length(term), length(form)) >= 4 AND (contains(term, form) OR contains(form, term))))
SELECT query_id, term FROM t UNION SELECT query_id, form FROM t JOIN h USING (term) JOIN f USING (canon)""")
def f48(spark, d):
    return lookup.expand_synonyms(derive(spark, d, TERMS), derive(spark, d, SYNONYMS))


@query("f17_query_expansion")
def f17(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("query"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("locality"))
    return lookup.expand_queries(q, derive(spark, d, SYNONYMS))


#: Aliases of entities: opening words of benchmark items.
ALIASES = f"""SELECT DISTINCT unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:4], ' '), w[3]]) AS alias FROM (SELECT {d_tokens('text')} AS w FROM benchmark) WHERE len(w) >= 4"""


@query("j18_mentions", f"""WITH a AS (SELECT alias, 'e' || left(alias, 3) AS entity FROM ({ALIASES})), t AS (SELECT conv_id * 1000 + turn AS text_id, {d_tokens('text')} AS w FROM conversations),
i AS (SELECT text_id, w, unnest(range(1, len(w) + 1)) AS i FROM t), g AS (SELECT text_id, i - 1 AS first, i + k - 2 AS last, array_to_string(w[i:i + k - 1], ' ') AS alias FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT * FROM g JOIN a USING (alias)),
k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.text_id = f.text_id AND o.first <= f.last AND o.last >= f.first AND (o.last - o.first > f.last - f.first OR (o.last - o.first = f.last - f.first AND o.first < f.first)))),
r AS (SELECT *, row_number() OVER (PARTITION BY text_id, entity ORDER BY first, alias) AS n FROM k)
SELECT text_id, entity, alias, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM r WHERE n = 1""")
def j18(spark, d):
    w = table(spark, d, "benchmark").select(text.tokens(F.col("text")).alias("w")).filter("size(w) >= 4")
    a = w.select(F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 3), " "), F.get("w", F.lit(2)))).alias("alias")).distinct()
    a = a.withColumn("entity", F.concat(F.lit("e"), F.substring("alias", 1, 3)))
    t = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), text.tokens(F.col("text")).alias("words"))
    return lookup.mentions(t, a)


#: Units: nations as districts in five provinces (regions); names repeat across provinces by design.
UNITS = """SELECT 'khu ' || CAST(n_nationkey % 9 AS STRING) AS name, n_nationkey + 100 AS unit, 2 AS level, n_regionkey AS province, 'name' AS via FROM {nation}
  UNION ALL SELECT 'k' || CAST(n_nationkey % 9 AS STRING), n_nationkey + 100, 2, n_regionkey, 'alias' FROM {nation}
  UNION ALL SELECT 'tinh ' || lower(r_name), r_regionkey, 1, r_regionkey, 'name' FROM {region} UNION ALL SELECT 'khu 3', r_regionkey + 200, 3, r_regionkey, 'alias' FROM {region}"""
ADDRESSES = """SELECT s_suppkey AS addr_id, CAST(s_suppkey AS STRING) || ' Đường Láng, ' || CASE s_suppkey % 3 WHEN 0 THEN 'K' WHEN 1 THEN 'Khu ' ELSE 'KHU  ' END || CAST(s_suppkey % 9 AS STRING)
  || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE ', Tỉnh ' || r_name END AS address FROM {supplier} JOIN {region} ON r_regionkey = s_suppkey % 5"""


@query("j14_unit_match", f"""WITH u AS ({sql(UNITS)}), a AS ({sql(ADDRESSES)}), p0 AS (SELECT addr_id, regexp_split_to_array(address, '[,\\n;|]+') AS ps FROM a), p1 AS (SELECT addr_id, unnest(range(1, len(ps) + 1)) AS i, ps FROM p0),
p AS (SELECT addr_id, i - 1 AS pos, {d_norm('ps[i]')} AS name FROM p1), p2 AS (SELECT *, CASE WHEN regexp_matches(name, '^(phuong|xa|thi tran)\\b') THEN 3 WHEN regexp_matches(name, '^(quan|huyen|thi xa)\\b') THEN 2 WHEN regexp_matches(name, '^(tinh|thanh pho|tp)\\b') THEN 1 END AS hint FROM p),
h0 AS (SELECT *, coalesce(level = hint, false) AS fits FROM p2 JOIN u USING (name)), h1 AS (SELECT *, bool_or(fits) OVER (PARTITION BY addr_id, pos) AS anyfit FROM h0), h2 AS (SELECT * FROM h1 WHERE NOT anyfit OR fits),
pr AS (SELECT addr_id, arg_max(unit, (pos, -unit)) AS prov FROM h2 WHERE level = 1 GROUP BY 1), h3 AS (SELECT h2.*, prov, coalesce(province = prov, false) AS same FROM h2 LEFT JOIN pr USING (addr_id)),
h4 AS (SELECT *, row_number() OVER (PARTITION BY addr_id, pos ORDER BY same DESC, via = 'name' DESC, level DESC, unit) AS i FROM h3),
t AS (SELECT addr_id, pos, unit AS tu, level AS tl, via AS tv FROM h4 WHERE i = 1), q AS (SELECT addr_id, pos, bool_or(via = tv AND level = tl AND unit <> tu AND prov IS NULL) AS ambiguous FROM h4 JOIN t USING (addr_id, pos) GROUP BY 1, 2)
SELECT addr_id, CAST(pos AS INTEGER) AS pos, unit, level, via, fits AS hinted, ambiguous, CASE WHEN ambiguous THEN 0.4e0 WHEN prov IS NOT NULL AND same THEN 0.9e0 ELSE 0.7e0 END AS confidence FROM h4 JOIN q USING (addr_id, pos) WHERE i = 1""")
def j14(spark, d):
    return lookup.match_units(derive(spark, d, ADDRESSES), derive(spark, d, UNITS))


@query("j15_fuzzy_mentions")
def j15(spark, d):
    """Words of conversations that come close to opening words of benchmark items."""
    terms = table(spark, d, "benchmark").select(F.array_join(F.slice(text.tokens(F.col("text")), 1, 2), " ").alias("term")).filter("length(term) >= 5").distinct()
    q = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), text.tokens(F.col("text")).alias("words"))
    return lookup.fuzzy_mentions(q, terms).drop("target")


KNOWN = """SELECT s_suppkey AS place_id, s_nationkey % 3 AS province, 'quan ' || CASE s_suppkey % 4 WHEN 0 THEN 'bun' WHEN 1 THEN 'pho' WHEN 2 THEN 'com tam' ELSE 'che' END || ' so ' || CAST(s_suppkey % 50 AS STRING) AS name FROM {supplier}"""
CANDIDATES = """SELECT c_custkey AS candidate_id, c_nationkey % 3 AS province, CASE c_custkey % 3 WHEN 0 THEN 'quan ' ELSE 'qan ' END || CASE c_custkey % 4 WHEN 0 THEN 'bun' WHEN 1 THEN 'phoo' WHEN 2 THEN 'com tam' ELSE 'tra' END || ' so ' || CAST(c_custkey % 60 AS STRING) AS name FROM {customer}"""


@query("j16_known_place", f"""WITH c0 AS ({sql(CANDIDATES)}), p AS ({sql(KNOWN)}), c AS (SELECT *, string_split(name, ' ') AS w FROM c0),
m AS (SELECT candidate_id, place_id, levenshtein(c.name, p.name) AS edits FROM c JOIN p ON c.province = p.province AND (contains(p.name, array_to_string(w[1:2], ' ')) OR contains(p.name, array_to_string(w[greatest(1, len(w) - 1):], ' '))))
SELECT candidate_id, arg_min(place_id, (edits, place_id)) AS place_id, CAST(min(edits) AS INTEGER) AS edits FROM m WHERE edits <= 2 GROUP BY 1""")
def j16(spark, d):
    return lookup.known_place(derive(spark, d, CANDIDATES), derive(spark, d, KNOWN))


@query("c9_stage_documents", """WITH t AS (SELECT DISTINCT left(lower(text), 7) AS term FROM benchmark), d0 AS (SELECT doc_id, lower(text) AS body, lang, source || '/' || (doc_id % 97) AS url FROM documents),
d AS (SELECT * FROM d0 WHERE url NOT IN (SELECT url FROM d0 WHERE lang = 'de' AND url IS NOT NULL)),
h AS (SELECT doc_id, url, term FROM d JOIN t ON contains(body, term)) SELECT doc_id, url, array_to_string(list_sort(list(DISTINCT term)), '|') AS terms FROM h GROUP BY 1, 2""")
def c9(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.lower("text").alias("body"), F.concat("source", F.lit("/"), (F.col("doc_id") % 97).cast("string")).alias("url"))
    terms = table(spark, d, "benchmark").select(F.substring(F.lower("text"), 1, 7).alias("term")).distinct()
    return lookup.stage_documents(docs, terms, docs.filter("lang = 'de'")).withColumn("terms", F.array_join("terms", "|"))


HOSTS = """SELECT DISTINCT CASE p_partkey % 8 WHEN 0 THEN 'www' || CAST(p_size AS STRING) || '.moh.gov.vn' WHEN 1 THEN 'docs.lib' || CAST(p_size AS STRING) || '.io' WHEN 2 THEN 'a.news.example.com' WHEN 3 THEN 'shop' || CAST(p_size AS STRING) || '.vn'
  WHEN 4 THEN 'top10-seo' || CAST(p_size AS STRING) || '.com' WHEN 5 THEN 'forum.example.com' WHEN 6 THEN 'uni' || CAST(p_size AS STRING) || '.edu' ELSE 'site' || CAST(p_size AS STRING) || '.net' END AS host FROM {part}"""


@query("f46_host_authority", f"""WITH h AS ({sql(HOSTS)}), t AS (SELECT * FROM (VALUES ('example.com', NULL, 0.5e0), ('news.example.com', NULL, 0.8e0), ('forum.example.com', 'legal', 0.25e0), ('shop7.vn', NULL, 0.6e0)) x(tail, vertical, a)),
m AS (SELECT host, arg_max(a, (vertical IS NOT NULL, length(tail))) AS a, bool_or(vertical IS NOT NULL) AS own FROM h JOIN t ON host = tail OR ends_with(host, '.' || tail) GROUP BY 1)
SELECT host, CASE WHEN own THEN a WHEN split_part(host, '.', -1) IN ('gov', 'edu', 'mil') OR split_part(host, '.', -2) IN ('gov', 'edu') THEN 1e0 WHEN host LIKE 'docs.%' AND NOT regexp_matches(host, '{lookup.FARM}') THEN 0.85e0
 WHEN a IS NOT NULL THEN a WHEN regexp_matches(host, '{lookup.FARM}') THEN 0.18e0 WHEN host LIKE '%.vn' THEN 0.7e0 ELSE 0.3e0 END + CASE WHEN host LIKE '%.vn' THEN 1.5e0 ELSE 0e0 END AS authority FROM h LEFT JOIN m USING (host)""")
def f46(spark, d):
    t = spark.createDataFrame([("example.com", None, 0.5), ("news.example.com", None, 0.8), ("forum.example.com", "legal", 0.25), ("shop7.vn", None, 0.6)], "host string, vertical string, authority double")
    return lookup.host_authority(derive(spark, d, HOSTS), t, "legal", 1.5)


#: Questions about the suppliers' units: named, misspelt, or none.
ASKED = """SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN 'Quán phở ở tỉnh ' || r_name WHEN 1 THEN 'tinh ' || lower(SUBSTRING(r_name, 1, LENGTH(r_name) - 1)) || 'x quan an' WHEN 2 THEN 'com vs pho' ELSE 'how to cook' END AS query FROM {supplier} JOIN {region} ON r_regionkey = s_suppkey % 5"""


@query("c11_query_understanding", f"""WITH a AS (SELECT query_id, query, query_id % 5 AS r FROM ({sql(ASKED)})) SELECT query_id, CASE query_id % 4 WHEN 2 THEN 'comparison' WHEN 3 THEN 'howto' ELSE 'current_fact' END AS intent,
 CASE WHEN query_id % 4 = 0 THEN CAST(r + 500 AS VARCHAR) ELSE '' END AS units, CASE WHEN query_id % 4 = 2 THEN 'com|pho' ELSE '' END AS targets FROM a""")
def c11(spark, d):
    """Provinces were renumbered by 500."""
    names = derive(spark, d, UNITS).filter("level = 1")
    current = names.select("unit", (F.col("unit") + 500).alias("current")).distinct()
    u = lookup.understood(derive(spark, d, ASKED), names, derive(spark, d, SYNONYMS), current, ["quan pho"])
    return u.select("query_id", "intent", F.array_join(F.transform("units", lambda x: x.cast("string")), "|").alias("units"), F.array_join("targets", "|").alias("targets"))
