"""Queries of gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from .fixtures import RANKED, derive, sql, table
from .registry import query

#: Evidence for 300 queries; some without authority or date.
EVIDENCE = """SELECT event_id % 300 AS query_id, event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id * 13 % 33 AS DOUBLE) / 32 END AS authority,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS published_at, value FROM {events}"""
AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def gated(spark, d):
    e = derive(spark, d, EVIDENCE)
    return gates.gated(e, {"authority": gates.authority_ok(F.col("authority"), 0.25), "freshness": gates.fresh_enough(F.col("published_at"), F.expr(AS_OF), 20), "value": F.col("value") > 1})


_GATED = f"""g AS (SELECT query_id, event_id, CASE WHEN coalesce(authority, 0.5e0) < 0.25e0 THEN 'authority'
 WHEN published_at IS NOT NULL AND floor((epoch_us(CAST({AS_OF} AS TIMESTAMP)) - epoch_us(published_at)) / 86400000000e0) > 20 THEN 'freshness' WHEN NOT coalesce(value > 1, false) THEN 'value' END AS dropped_by FROM ({sql(EVIDENCE)}))"""


@query("p3_evidence_gates", f"WITH {_GATED} SELECT query_id, event_id FROM g WHERE dropped_by IS NULL")
def p3(spark, d):
    return gated(spark, d).filter("dropped_by IS NULL").select("query_id", "event_id")


@query("c5_gate_counts", f"WITH {_GATED} SELECT query_id, count(CASE WHEN dropped_by IS NULL THEN 1 END) AS kept, {', '.join(f'''count(CASE WHEN dropped_by = '{x}' THEN 1 END) AS dropped_{x}''' for x in ('authority', 'freshness', 'value'))} FROM g GROUP BY 1")
def c5(spark, d):
    return gates.gate_counts(gated(spark, d), "query_id", ["authority", "freshness", "value"])


#: URLs of the parts, some private or of odd hosts.
URLS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'http://192.168.1.' || CAST(p_partkey % 200 AS STRING) || '/admin' WHEN 1 THEN 'https://content-mill.example.com/x' WHEN 2 THEN 'https://loans.top/a/b/c/d/e/f/g/h'
  WHEN 3 THEN 'http://localhost/x' WHEN 4 THEN 'https://news.xyz/' || p_brand ELSE 'https://www.place' || CAST(p_partkey AS STRING) || '.vn/' END AS url FROM {part}"""


@query("p4_blocked_urls", f"SELECT p_partkey, p_partkey % 6 IN (0, 1, 2, 3) AS blocked FROM ({sql(URLS)})")
def p4(spark, d):
    return derive(spark, d, URLS).select("p_partkey", gates.blocked_url(F.col("url")).alias("blocked"))


SOURCES = """SELECT url || CASE WHEN item % 23 = 0 THEN '/Casino' ELSE '' END AS url, provider, CASE item % 6 WHEN 0 THEN 'official' WHEN 1 THEN 'forum' WHEN 2 THEN 'reddit' WHEN 3 THEN 'unknown_seo_site' WHEN 4 THEN 'research_paper' ELSE 'other' END AS kind FROM (""" + RANKED + ")"


@query("f47_trust", f"""WITH s AS (SELECT url, kind, count(DISTINCT provider) AS n FROM ({sql(SOURCES)}) GROUP BY 1, 2),
b AS (SELECT *, CASE kind WHEN 'official' THEN 'high' WHEN 'research_paper' THEN 'high' WHEN 'forum' THEN 'medium' WHEN 'reddit' THEN 'low' ELSE 'unverified' END AS t FROM s)
SELECT url, n AS providers, CASE WHEN regexp_matches(url, '(?i)({gates.LOW_VALUE})') THEN 'low' WHEN n >= 2 AND t IN ('low', 'unverified') THEN 'medium' ELSE t END AS trust FROM b""")
def f47(spark, d):
    s = derive(spark, d, SOURCES).groupBy("url", "kind").agg(F.count_distinct("provider").alias("providers"))
    return s.select("url", "providers", gates.trust_label(F.col("kind"), F.col("providers"), F.col("url")).alias("trust"))


@query("p5_verified", """SELECT o_orderkey, coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH') AND CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END IS NOT NULL AND CAST(o_orderkey % 9 AS DOUBLE) / 8 >= 0.7e0, false) AS verified FROM orders""")
def p5(spark, d):
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "authoritative").when(F.col("o_orderpriority") == "2-HIGH", "corroborated").otherwise("observed")
    stamp = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", gates.is_verified(level, stamp, (F.col("o_orderkey") % 9).cast("double") / 8).alias("verified"))
