"""Queries of telemetry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry
from .fixtures import INTERACTIONS, TRACES, derive, sql, table
from .registry import query

_T, _I = f"t AS ({sql(TRACES)})", f"i AS ({sql(INTERACTIONS)})"


@query("a22_trace_report", f"WITH {_T} SELECT count(*) AS searches, count(*) FILTER (results_total = 0) AS zero, count(*) FILTER (results_total BETWEEN 1 AND 2) AS low, count(*) FILTER (coverage_gap) AS gaps, percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50, percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95, round(100e0 * count(*) FILTER (results_total = 0) / count(*), 1) AS zero_rate FROM t")
def report(spark, d):
    return telemetry.trace_report(derive(spark, d, TRACES))


_CTR = ", ".join(f"count(*) FILTER (rank <= {k} AND c = 0) AS imp{k}, count(*) FILTER (rank <= {k} AND c = 1) AS clk{k}" for k in (1, 3, 5))


@query("a23_click_rates", f"WITH {_I}, d AS (SELECT DISTINCT trace_id, result_id, kind, rank FROM i), b AS (SELECT DISTINCT trace_id, result_id, rank, 0 AS c FROM d WHERE kind IN ('impression', 'click') UNION ALL SELECT trace_id, result_id, rank, 1 FROM d WHERE kind = 'click'), n AS (SELECT {_CTR} FROM b) SELECT *, {', '.join(f'round(clk{k}::DOUBLE / imp{k}, 6) AS ctr{k}' for k in (1, 3, 5))} FROM n")
def ctr(spark, d):
    return telemetry.click_rates(derive(spark, d, INTERACTIONS))


@query("j11_reformulations", f"WITH {_T}, e AS (SELECT event_id, ts AS happened, 'q' || CAST((user_id + 1) % 50 AS STRING) AS from_query FROM events WHERE event_type = 'click') SELECT DISTINCT event_id FROM e JOIN t ON from_query = query AND created_at BETWEEN happened - INTERVAL 600 SECONDS AND happened WHERE results_total = 0 OR coverage_gap")
def reformulations(spark, d):
    t = derive(spark, d, TRACES).withColumnRenamed("created_at", "at").withColumn("at", F.col("at").cast("timestamp"))
    e = table(spark, d, "events").filter("event_type = 'click'").select("event_id", F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("q"), ((F.col("user_id") + 1) % 50).cast("string")).alias("from_query"))
    return telemetry.reformulations(t, e, 600)


_FLAGS = """f AS (SELECT t.query, results_total = 0 AS zero, coverage_gap AS gap, latency_ms > 3000 AS slow, c.trace_id IS NULL AS no_click, coalesce(c.low, FALSE) AS low_rank_click, trace_id0 % 29 = 0 AS negative, trace_id0 % 31 = 0 AS reformulated
 FROM (SELECT *, trace_id AS trace_id0 FROM t) t LEFT JOIN (SELECT trace_id, bool_or(kind = 'click' AND rank >= 5) AS low FROM i WHERE kind IN ('click', 'source_open') GROUP BY trace_id) c ON c.trace_id = t.trace_id0)"""


def flags(spark, d):
    t = derive(spark, d, TRACES)
    c = derive(spark, d, INTERACTIONS).filter("kind IN ('click', 'source_open')").groupBy("trace_id").agg(F.bool_or((F.col("kind") == "click") & (F.col("rank") >= 5)).alias("low"))
    f = t.join(c, "trace_id", "left")
    return f.select("query", "trace_id", (F.col("results_total") == 0).alias("zero"), F.col("coverage_gap").alias("gap"), (F.col("latency_ms") > 3000).alias("slow"), F.col("low").isNull().alias("no_click"), F.coalesce("low", F.lit(False)).alias("low_rank_click"), (F.col("trace_id") % 29 == 0).alias("negative"), (F.col("trace_id") % 31 == 0).alias("reformulated"))


@query("a24_bad_searches", f"WITH {_T}, {_I}, {_FLAGS} SELECT query, count(*) AS searches, CAST(sum(zero::INT * 4 + reformulated::INT * 3 + negative::INT * 4 + no_click::INT + slow::INT + gap::INT * 2 + low_rank_click::INT * 2) AS BIGINT) AS score FROM f GROUP BY query ORDER BY score DESC, query LIMIT 15")
def bad(spark, d):
    return telemetry.bad_searches(flags(spark, d))


@query("j10_flags", f"WITH {_T}, {_I}, {_FLAGS} SELECT no_click, low_rank_click, count(*) AS n FROM f GROUP BY 1, 2")
def existence(spark, d):
    return flags(spark, d).groupBy("no_click", "low_rank_click").agg(F.count(F.lit(1)).alias("n"))


@query("a25_by_intent", f"WITH {_T} SELECT intent, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, round(avg(results_total), 6) AS mean_results FROM t GROUP BY intent")
def by_intent(spark, d):
    return derive(spark, d, TRACES).groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.round(F.avg("results_total"), 6).alias("mean_results"))


@query("a19_a20_daily", f"WITH {_T} SELECT CAST(created_at AS DATE) AS day, intent, count(*) AS n, round(avg(latency_ms), 6) AS mean_ms, max(latency_ms) AS worst FROM t GROUP BY 1, 2")
def daily(spark, d):
    return telemetry.by_day(derive(spark, d, TRACES), "created_at", "intent").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.max("latency_ms").alias("worst"))


#: A log of requests.
_LOG = """
SELECT event_id, event_type AS endpoint, ts AS at, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id * 31 % 1000 AS DOUBLE) / 1000 END AS quality_score, CAST(event_id * 37 % 5003 AS DOUBLE) AS latency_ms, event_id % 7 AS results_count,
  CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS cache_hit, CASE WHEN event_id % 50 = 0 THEN 'timeout' END AS error FROM {events}
"""
_SUMMARY = "count(*) AS queries, count(quality_score) AS scored, round(coalesce(avg(quality_score), 0), 6) AS avg_quality, round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(results_count), 6) AS avg_results, CAST(sum(cache_hit) AS BIGINT) AS cache_hits, count(error) AS errors"


@query("a20_quality_report", f'''WITH l AS ({sql(_LOG)}) SELECT 'day' AS part, CAST(CAST("at" AS DATE) AS VARCHAR) AS key, {_SUMMARY} FROM l GROUP BY 2 UNION ALL SELECT 'endpoint', endpoint, {_SUMMARY} FROM l GROUP BY 2''')
def quality_report(spark, d):
    log = derive(spark, d, _LOG)
    made = [telemetry.quality_summary(log, key).withColumn("part", F.lit(part)) for part, key in (("day", F.to_date("at").cast("string").alias("key")), ("endpoint", F.col("endpoint").alias("key")))]
    out = made[0].unionByName(made[1])
    return out.select("part", "key", "queries", "scored", *[F.round(c, 6).alias(c) for c in ("avg_quality", "avg_latency_ms", "avg_results")], "cache_hits", "errors")


@query("a20_worst_queries", f"WITH l AS ({sql(_LOG)}) SELECT event_id, endpoint, quality_score FROM l WHERE quality_score IS NOT NULL ORDER BY quality_score, event_id LIMIT 5")
def worst(spark, d):
    return telemetry.worst_queries(derive(spark, d, _LOG), "event_id").select("event_id", "endpoint", "quality_score")


@query("a21_request_quality", f"WITH {_T} SELECT trace_id, round(CASE WHEN intent = 'error' THEN 0 ELSE 0.30e0 * results_total / 6e0 + 0.30e0 * 0.5e0 + 0.25e0 * greatest(0e0, 1 - latency_ms / 5000e0) + 0.15e0 * least(1e0, user_id % 8 / 5e0) END, 6) AS quality FROM t")
def request_quality(spark, d):
    c = F.col
    q = telemetry.request_quality(c("results_total") / 6, F.lit(0.5), c("latency_ms"), c("user_id") % 8, c("intent") == "error")
    return derive(spark, d, TRACES).select("trace_id", F.round(q, 6).alias("quality"))


@query("a26_demand_cells", f"WITH {_T} SELECT user_id % 10 AS unit, intent AS category, CAST(isoyear(created_at) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(created_at) AS VARCHAR), 2, '0') AS week, count(*) AS demand, count(*) FILTER (results_total = 0) AS zero, count(*) FILTER (results_total BETWEEN 1 AND 2) AS low FROM t GROUP BY 1, 2, 3")
def demand(spark, d):
    t = derive(spark, d, TRACES).withColumn("u", F.col("user_id") % 10)
    return telemetry.demand_cells(t, "u", "intent", "created_at")


@query("a27_coverage_priority", f"WITH {_T}, g AS (SELECT user_id, count(*) AS n, avg(results_total) AS r FROM t GROUP BY 1) SELECT user_id, round(n * (1 - least(1e0, r / 5)) * 0.7e0 * 2e0 * (1 - 0.25e0), 6) AS priority FROM g")
def priority(spark, d):
    g = derive(spark, d, TRACES).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("results_total").alias("r"))
    return g.select("user_id", F.round(telemetry.coverage_priority(F.col("n"), F.col("r"), F.lit(0.7), F.lit(2.0), F.lit(0.25)), 6).alias("priority"))


@query("a28_usage", "SELECT CAST(ts AS DATE) AS day, user_id, event_type, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2, 3")
def usage(spark, d):
    return telemetry.by_day(table(spark, d, "events"), "ts", "user_id", "event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("w6_rolling_health", """
WITH c AS (SELECT event_id AS call_id, user_id % 5 AS provider, epoch(ts) AS t, CASE event_type WHEN 'error' THEN 'error' ELSE 'success' END AS outcome, value AS latency_ms, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS i FROM events),
j AS (SELECT a.call_id, a.provider, b.outcome, b.latency_ms FROM c a JOIN c b ON b.provider = a.provider AND b.i BETWEEN a.i - 63 AND a.i AND floor(b.t) >= floor(a.t) - 36000),
g AS (SELECT call_id, provider, count(*) AS n, count(*) FILTER (outcome = 'success')::DOUBLE / count(*) AS s, list_sort(list(latency_ms)) AS l FROM j GROUP BY 1, 2)
SELECT call_id, provider, n, round(s, 6) AS success_rate, l[greatest(1, CAST(ceil(n * 0.5e0) AS INT))] AS p50, l[greatest(1, CAST(ceil(n * 0.95e0) AS INT))] AS p95, CASE WHEN s >= 0.8 THEN 'healthy' WHEN s >= 0.5 THEN 'degraded' ELSE 'down' END AS status FROM g""")
def health(spark, d):
    c = table(spark, d, "events").select(F.col("event_id").alias("call_id"), (F.col("user_id") % 5).alias("provider"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("outcome"), F.col("value").alias("latency_ms"))
    return telemetry.rolling_health(c, 64, 36000).withColumn("n", F.col("n").cast("long")).withColumn("success_rate", F.round("success_rate", 6))


@query("c7_retention", f"""WITH {_T}, a AS (SELECT trace_id, intent, 'call 0912345678 now' AS query, greatest(0e0, (epoch(TIMESTAMP '2024-05-01') - floor(epoch(created_at))) / 86400) AS age FROM t)
SELECT trace_id, CASE WHEN age > 14 THEN 'call [sdt] now' ELSE query END AS query, CASE WHEN age <= 90 THEN intent END AS payload FROM a WHERE age <= 180""")
def keep(spark, d):
    t = derive(spark, d, TRACES).select("trace_id", "created_at", F.lit("call 0912345678 now").alias("query"), F.col("intent").alias("payload"))
    return telemetry.retention(t, F.lit("2024-05-01").cast("timestamp"), "created_at", "query", "payload").drop("created_at")


@query("k7_trace_export", f"WITH {_T} SELECT trace_id, query FROM t WHERE trace_id IN (SELECT event_id FROM events WHERE event_type = 'purchase') ORDER BY created_at DESC, trace_id LIMIT 200")
def export(spark, d):
    from ..sources.sinks import traces_with_feedback

    feedback = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("trace_id"))
    return traces_with_feedback(derive(spark, d, TRACES), feedback, 200).select("trace_id", "query")
