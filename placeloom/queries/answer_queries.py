"""Queries of answers: coverage, gaps, confidence, summaries, lists, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers
from .fixtures import RANKED, RECORDS, derive, sql, table
from .registry import query

_R = f"r AS ({sql(RANKED)})"

#: The first turn of a conversation as a query, its later turns as quotes.
TURNS = "SELECT conv_id AS query_id, turn, text, text AS quote, CAST(turn % 5 AS DOUBLE) / 8 AS support, role || CAST(turn % 4 AS STRING) AS domain FROM {conversations}"
_T = f"t AS ({sql(TURNS)})"
_WORDS = r"w AS (SELECT query_id, i AS pos, ws[i] AS word FROM (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT query_id, regexp_split_to_array(lower(text), '\s+') AS ws FROM t WHERE turn = 0)) WHERE length(ws[i]) >= 4)"


def turns(spark, d):
    t = derive(spark, d, TURNS)
    return t.filter("turn = 0").select("query_id", "text"), t.filter("turn > 0")


@query("a36_gap_summary", f"""WITH {_T}, {_WORDS}, e AS (SELECT query_id, lower(quote) AS quote, support FROM t WHERE turn > 0),
g AS (SELECT query_id, pos, word, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS i FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.query_id = w.query_id AND contains(e.quote, w.word))),
m AS (SELECT query_id, string_agg(word, ' ' ORDER BY pos) AS missing FROM g WHERE i <= 5 GROUP BY 1), s AS (SELECT query_id, count(*) AS n, avg(support) AS support FROM e GROUP BY 1)
SELECT q.query_id, coalesce(missing, '') AS missing, coalesce(n, 0) < 3 AS need_more, round(coalesce(least(n / 5e0 * support, 1e0), 0e0), 6) AS confidence FROM (SELECT query_id FROM t WHERE turn = 0) q LEFT JOIN m USING (query_id) LEFT JOIN s USING (query_id)""")
def a36(spark, d):
    g = answers.gap_summary(*turns(spark, d))
    return g.select("query_id", F.array_join("missing", " ").alias("missing"), "need_more", F.round("confidence", 6).alias("confidence"))


@query("a16_sufficiency", f"""WITH {_T}, {_WORDS}, e AS (SELECT query_id, lower(text) AS text, domain FROM t WHERE turn > 0),
h AS (SELECT DISTINCT query_id, word, EXISTS (SELECT 1 FROM e WHERE e.query_id = w.query_id AND contains(e.text, w.word)) AS hit FROM w), c AS (SELECT query_id, avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) AS coverage FROM h GROUP BY 1),
s AS (SELECT query_id, count(DISTINCT domain) AS domains FROM e GROUP BY 1)
SELECT query_id, round(coverage, 6) AS coverage, coalesce(domains, 0) AS domains, coverage >= 0.3 AND coalesce(domains, 0) >= 2 AS sufficient FROM c LEFT JOIN s USING (query_id)""")
def a16(spark, d):
    q, e = turns(spark, d)
    sub = q.select("query_id", F.explode(F.split(F.lower("text"), r"\s+")).alias("sub")).filter("length(sub) >= 4")
    return answers.sufficiency(sub, e, 0.3, 2).withColumn("coverage", F.round("coverage", 6))


VERDICTS = """SELECT l_orderkey AS pack, CASE l_linenumber % 4 WHEN 0 THEN 'insufficient_evidence' WHEN 1 THEN 'supported' WHEN 2 THEN 'partial' ELSE 'conflict' END AS status, l_discount * 8 AS confidence FROM {lineitem}"""


@query("a18_pack_scores", f"SELECT pack, round(avg(CASE WHEN status <> 'insufficient_evidence' THEN 1e0 ELSE 0e0 END), 6) AS coverage, round(avg(confidence), 6) AS confidence FROM ({sql(VERDICTS)}) GROUP BY 1")
def a18(spark, d):
    p = answers.pack_scores(derive(spark, d, VERDICTS), "pack")
    return p.select("pack", F.round("coverage", 6).alias("coverage"), F.round("confidence", 6).alias("confidence"))


#: 250 queries, documents found for 200 of them; authorities are exact fractions.
ASKED = """SELECT DISTINCT p_partkey % 250 AS query_id, CASE p_partkey % 250 % 4 WHEN 0 THEN 'local_search' WHEN 1 THEN 'legal' WHEN 2 THEN 'weather' ELSE 'lookup' END AS intent FROM {part}"""
FOUND = """SELECT l_partkey % 200 AS query_id,
  l_orderkey * 10 + l_linenumber AS doc, 'd' || CAST(l_suppkey % 9 AS STRING) AS domain, CAST(l_partkey * 7 % 65 AS DOUBLE) / 64 AS authority,
  CASE WHEN l_suppkey % 50 = 0 THEN 'law' ELSE 'news' END AS source_type, l_orderkey % 40 = 0 AS mentions_place, l_extendedprice AS score FROM {lineitem}"""
FOUND_PLACES = """SELECT s_suppkey % 200 AS query_id, COUNT(CASE WHEN s_suppkey % 3 = 0 THEN 1 END) AS exact, COUNT(CASE WHEN s_suppkey % 3 = 1 THEN 1 END) AS unverified FROM {supplier} GROUP BY 1"""


@query("a34_retrieval_quality", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS i FROM ({sql(FOUND)})), p AS ({sql(FOUND_PLACES)}),
g AS (SELECT query_id, count(DISTINCT domain) AS independent, avg(CASE WHEN i <= 3 THEN authority END) AS aa, bool_or(source_type IN ('law', 'government')) AS official, count(CASE WHEN mentions_place THEN 1 END) AS mentions FROM k GROUP BY 1),
j AS (SELECT a.query_id, intent, coalesce(independent, 0) AS independent, coalesce(aa, 0e0) AS aa, coalesce(official, false) AS official, coalesce(mentions, 0) AS mentions, coalesce(exact, 0) AS ex, coalesce(unverified, 0) AS un FROM ({sql(ASKED)}) a LEFT JOIN g USING (query_id) LEFT JOIN p USING (query_id)),
c AS (SELECT *, CASE WHEN intent = 'local_search' THEN CASE WHEN ex > 0 THEN 0.6e0 + least(0.25e0, 0.08e0 * ex) WHEN un > 0 THEN 0.3e0 + least(0.1e0, 0.05e0 * un) ELSE 0.08e0 END + least(0.08e0, 0.03e0 * mentions)
  WHEN independent = 0 THEN 0.05e0 ELSE 0.2e0 + 0.35e0 * aa + 0.07e0 * least(4, independent) + CASE WHEN intent IN ('legal', 'weather') AND official THEN 0.12e0 ELSE 0e0 END END AS x FROM j),
f AS (SELECT query_id, floor(least(0.97e0, x) * 100e0 + 0.5e0) / 100e0 AS confidence, independent, floor(aa * 100e0 + 0.5e0) / 100e0 AS avg_authority FROM c)
SELECT query_id, confidence, CASE WHEN confidence >= 0.7e0 THEN 'good' WHEN confidence >= 0.35e0 THEN 'partial' ELSE 'none' END AS coverage, independent, avg_authority FROM f""")
def a34(spark, d):
    return answers.retrieval_quality(derive(spark, d, ASKED), derive(spark, d, FOUND), derive(spark, d, FOUND_PLACES))


@query("p6_recall_gate", f"WITH {_R}, c AS (SELECT query_id, count(CASE WHEN q >= 45 THEN 1 END) AS useful FROM r GROUP BY 1) SELECT query_id, useful, useful >= 5 AS enough FROM c")
def p6(spark, d):
    return answers.recall_gate(derive(spark, d, RANKED), "query_id", F.col("q") >= 45, 10)


@query("a38_staging_snapshot", f"""WITH r AS ({sql(RECORDS)}), s AS (SELECT p, provider, days, CASE WHEN record_id % 7 = 0 THEN 'pending' WHEN record_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM r)
SELECT p, count(*) AS observations, count(DISTINCT provider) AS sources, CASE WHEN bool_or(status = 'pending') THEN 'pending' ELSE arg_max(status, (days, status)) END AS status FROM s GROUP BY 1""")
def a38(spark, d):
    status = F.expr("CASE WHEN record_id % 7 = 0 THEN 'pending' WHEN record_id % 2 = 0 THEN 'approved' ELSE 'rejected' END")
    return answers.staging_snapshot(derive(spark, d, RECORDS).withColumn("status", status), "p", "provider", "status", "days")


@query("t17_extractive_summary", r"""WITH k AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
s AS (SELECT source, doc_id, rank, array_to_string(string_split(coalesce(text, ''), '. ')[1:3], '. ') AS x FROM k WHERE rank <= 5)
SELECT source, doc_id, CAST(rank AS INTEGER) AS rank, CASE WHEN length(x) > 500 THEN substr(x, 1, 500) || '...' ELSE x END AS summary FROM s""")
def t17(spark, d):
    return answers.extractive_summary(table(spark, d, "documents"), "source", "n_chars", "doc_id", "text")


@query("t18_unified_list", f"""WITH {_R}, s AS (SELECT query_id, url, score, CASE WHEN q >= 48 AND provider = 'lexical' THEN 0 WHEN provider = 'lexical' THEN 1 ELSE 2 END AS section FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY section, score DESC, url) AS place FROM s) SELECT query_id, url, section, CAST(place AS INTEGER) AS place FROM k WHERE place <= 25""")
def t18(spark, d):
    r = derive(spark, d, RANKED).select("query_id", "url", "score", "q", "provider")
    sections = [r.filter("provider = 'lexical' AND q >= 48"), r.filter("provider = 'lexical' AND q < 48"), r.filter("provider = 'vector'")]
    return answers.unified(sections, "query_id", "score", "url", 25).select("query_id", "url", "section", "place")


@query("t19_blended_rerank", f"""WITH {_R}, b AS (SELECT query_id, url, 0.6e0 * (1 - d) + 0.4e0 * (q / 50) AS blend FROM r WHERE provider = 'vector'),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, url) AS place FROM b) SELECT query_id, url, round(blend, 6) AS blend, CAST(place AS INTEGER) AS place FROM k WHERE place <= 10""")
def t19(spark, d):
    r = derive(spark, d, RANKED).filter("provider = 'vector'")
    out = answers.blended(r, "query_id", 1 - F.col("d"), F.col("q") / 50, "url")
    return out.select("query_id", "url", F.round("blend", 6).alias("blend"), "place")


@query("w12_case_versions", """WITH v AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS superseded_by FROM orders)
SELECT o_custkey, o_orderkey, superseded_by, CASE WHEN superseded_by IS NULL THEN 'active' ELSE 'superseded' END AS state FROM v""")
def w12(spark, d):
    return answers.newest_versions(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


CALLS = """SELECT user_id % 5 AS engine, CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'signup' THEN 'captcha' ELSE 'success' END AS outcome, value AS latency FROM {events}"""


@query("w7_engine_counters", f"""SELECT engine, count(*) AS requests, round(avg(CASE outcome WHEN 'success' THEN 1e0 ELSE 0e0 END), 6) AS success_rate, round(avg(CASE outcome WHEN 'rate_limited' THEN 1e0 ELSE 0e0 END), 6) AS rate_429,
 round(avg(CASE outcome WHEN 'captcha' THEN 1e0 ELSE 0e0 END), 6) AS captcha_rate, round(avg(latency), 6) AS mean_latency FROM ({sql(CALLS)}) GROUP BY 1""")
def w7(spark, d):
    c = answers.engine_counters(derive(spark, d, CALLS), "engine", "outcome", "latency")
    return c.select("engine", "requests", *[F.round(x, 6).alias(x) for x in ("success_rate", "rate_429", "captcha_rate", "mean_latency")])


@query("f36_unwrap_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f36(spark, d):
    twice = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))
    stored = F.when(F.col("event_id") % 2 == 0, twice).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.get_json_object(answers.unwrap_json(stored), "$.k").alias("k"))
