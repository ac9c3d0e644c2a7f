"""Tables that queries and their SQL derive from the given ones, by text that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Three records per place, of differing spelling, about ten metres apart.
RECORDS = """
SELECT c_custkey AS record_id, c_custkey - c_custkey % 3 AS p,
  CASE c_custkey % 4 WHEN 0 THEN 'osm' WHEN 1 THEN 'scraper' WHEN 2 THEN 'registry' ELSE 'web' END AS provider,
  CASE c_custkey % 3 WHEN 0 THEN 'Công ty TNHH Phở Hà ' || CAST(c_custkey - c_custkey % 3 AS STRING)
    WHEN 1 THEN 'PHỞ HÀ - ' || CAST(c_custkey - c_custkey % 3 AS STRING) ELSE 'Cửa hàng Phở Hà ' || CAST(c_custkey - c_custkey % 3 AS STRING) END AS raw_name,
  CASE WHEN c_custkey % 11 = 0 THEN '12' WHEN c_custkey % 2 = 0 THEN '09' || CAST(10000000 + c_custkey - c_custkey % 3 AS STRING)
    ELSE '+84 9' || CAST(10000000 + c_custkey - c_custkey % 3 AS STRING) END AS raw_phone,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'https://www.place' || CAST(c_custkey - c_custkey % 3 AS STRING) || '.vn/home/' END AS raw_website,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_mktsegment END AS raw_category,
  CASE c_custkey % 6 WHEN 0 THEN 'OPERATIONAL' WHEN 1 THEN 'Đang hoạt động' WHEN 2 THEN 'Temporarily closed - works' WHEN 3 THEN 'Đã đóng cửa' WHEN 4 THEN '' ELSE 'unknown' END AS raw_status,
  CASE WHEN c_custkey % 17 = 0 THEN 95.0e0 ELSE 10.0e0 + (c_custkey - c_custkey % 3) % 300 * 0.03e0 + c_custkey % 3 * 0.0001e0 END AS lat,
  CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 105.0e0 + ((c_custkey - c_custkey % 3) - (c_custkey - c_custkey % 3) % 300) % 3000 * 0.001e0 END AS lon,
  (c_custkey - c_custkey % 3) % 50 AS admin_unit, CAST(c_custkey % 400 AS DOUBLE) AS days
FROM {customer}
"""
TRACES = """
SELECT event_id AS trace_id, user_id, ts AS created_at, 'q' || CAST(user_id % 50 AS STRING) AS query, event_id % 7 AS results_total,
  event_id % 11 = 0 AS coverage_gap, CAST(event_id * 37 % 5003 AS DOUBLE) AS latency_ms, event_type AS intent
FROM {events}
"""
INTERACTIONS = """
SELECT event_id - event_id % 5 AS trace_id, event_id % 13 AS result_id, CAST(event_id % 6 + 1 AS BIGINT) AS rank, ts,
  CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'impression' WHEN 'error' THEN 'reformulate' ELSE 'source_open' END AS kind
FROM {events}
"""
#: Ranked lists: two providers' lists of URLs for each of 20 queries.
RANKED = """
SELECT l_suppkey % 20 AS query_id, CASE l_linenumber % 2 WHEN 0 THEN 'lexical' ELSE 'vector' END AS provider,
  'https://site' || CAST(l_partkey % 97 AS STRING) || '.vn/p/' || CAST(l_partkey AS STRING) AS url, 'site' || CAST(l_partkey % 97 AS STRING) || '.vn' AS domain,
  l_partkey AS item, MAX(l_extendedprice) AS score, MAX(l_quantity) AS q, MIN(l_discount) AS d
FROM {lineitem} GROUP BY 1, 2, 3, 4, 5
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    import re

    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def sql(text: str) -> str:
    """The same text over the oracle's views."""
    import re

    return re.sub(r"\{(\w+)\}", r"\1", text)
