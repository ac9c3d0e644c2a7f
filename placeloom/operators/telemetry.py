"""Search telemetry: reports, click rates, bad searches, demand, health, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from .selection import interpolated


def trace_report(traces: DataFrame) -> DataFrame:
    """One row: searches, zero, low, gaps, p50 and p95 latency (interpolated), zero_rate in percent. Latencies are selected by ranges (selection.interpolated), never listed."""
    n = F.count(F.lit(1))
    p50, p95 = (F.lit(p).cast("double") for p in interpolated(traces, "latency_ms", (0.5, 0.95)))
    return traces.agg(n.alias("searches"), F.count_if(F.col("results_total") == 0).alias("zero"), F.count_if(F.col("results_total").between(1, 2)).alias("low"), F.count_if("coverage_gap").alias("gaps"), p50.alias("p50"), p95.alias("p95"), F.round(F.try_divide(100 * F.count_if(F.col("results_total") == 0), n), 1).alias("zero_rate"))


def click_rates(interactions: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Impressions, clicks and CTR at ranks of de-duplicated (trace, result, kind, rank); a click implies an impression."""
    d = interactions.select("trace_id", "result_id", "kind", "rank").distinct()
    imp = d.filter(F.col("kind").isin("impression", "click")).select("trace_id", "result_id", "rank").distinct().withColumn("click", F.lit(0))
    both = imp.union(d.filter("kind = 'click'").select("trace_id", "result_id", "rank", F.lit(1)))
    at = lambda k, c: F.count_if((F.col("rank") <= k) & (F.col("click") == c))
    out = both.agg(*[at(k, c).alias(f"{n}{k}") for k in ks for n, c in (("imp", 0), ("clk", 1))])
    return out.select("*", *[F.round(F.when(F.col(f"imp{k}") > 0, F.col(f"clk{k}") / F.col(f"imp{k}")), 6).alias(f"ctr{k}") for k in ks])


def reformulations(traces: DataFrame, events: DataFrame, before: int = 15) -> DataFrame:
    """event_id of reformulations(event_id, at, from_query) of a trace(query, at, results_total, coverage_gap) of poor quality up to `before` seconds earlier."""
    poor = traces.filter((F.col("results_total") == 0) | F.col("coverage_gap")).select("query", F.col("at").alias("trace_at"))
    e = events.withColumn("bucket", F.explode(F.array(F.floor(F.unix_timestamp("at") / before), F.floor(F.unix_timestamp("at") / before) - 1)))
    t = poor.withColumn("bucket", F.floor(F.unix_timestamp("trace_at") / before))
    near = (F.col("trace_at") <= F.col("at")) & (F.unix_millis("at") - F.unix_millis("trace_at") <= 1000 * before)
    return e.join(t, (e["from_query"] == t["query"]) & (e["bucket"] == t["bucket"])).filter(near).select("event_id").distinct()


#: Points of a search's flaws.
FLAWS = {"zero": 4, "reformulated": 3, "negative": 4, "no_click": 1, "slow": 1, "gap": 2, "low_rank_click": 2}


def bad_searches(flags: DataFrame, top: int = 15) -> DataFrame:
    """query, searches, score: flags(query and one boolean per flaw) added up, those above 0, the worst `top`."""
    points = sum((F.when(F.col(k), v).otherwise(0) for k, v in FLAWS.items()), F.lit(0))
    return flags.filter("query is not null").groupBy("query").agg(F.count(F.lit(1)).alias("searches"), F.sum(points).alias("score")).filter("score > 0").orderBy(F.desc("score"), "query").limit(top)


def by_day(rows: DataFrame, at: str, *keys: str) -> DataFrame:
    return rows.groupBy(F.to_date(at).alias("day"), *keys)


def quality_summary(rows: DataFrame, *keys) -> DataFrame:
    """keys, queries, scored, avg_quality, avg_latency_ms, avg_results, cache_hits, errors of rows(quality_score, latency_ms, results_count, cache_hit, error).

    By day: quality_summary(rows, F.to_date("at").alias("day")); by endpoint: quality_summary(rows, "endpoint").
    """
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("queries"), F.count("quality_score").alias("scored"), mean("quality_score").alias("avg_quality"), mean("latency_ms").alias("avg_latency_ms"), mean("results_count").alias("avg_results"), F.coalesce(F.sum("cache_hit"), F.lit(0)).alias("cache_hits"), F.count("error").alias("errors"))


def worst_queries(rows: DataFrame, key: str, top: int = 5) -> DataFrame:
    """The rows of lowest quality score, ties to the smaller key."""
    return rows.filter("quality_score IS NOT NULL").orderBy("quality_score", key).limit(top)


def request_quality(coverage: Column, relevance: Column, latency_ms: Column, unique_domains: Column, error: Column) -> Column:
    """0.30 coverage + 0.30 relevance + 0.25 latency (1 at 0, 0 at 5 s) + 0.15 domains (full at 5); 0 on error."""
    speed = F.greatest(F.lit(0.0), 1 - latency_ms / 5000)
    return F.when(error, 0.0).otherwise(0.30 * coverage + 0.30 * relevance + 0.25 * speed + 0.15 * F.least(F.lit(1.0), unique_domains / 5))


def demand_cells(rows: DataFrame, unit: str, category: str, at: str) -> DataFrame:
    """unit, category, week, demand, zero, low of rows(results_total)."""
    return rows.groupBy(F.col(unit).alias("unit"), F.col(category).alias("category"), geo.iso_week(F.col(at)).alias("week")).agg(F.count(F.lit(1)).alias("demand"), F.count_if(F.col("results_total") == 0).alias("zero"), F.count_if(F.col("results_total").between(1, 2)).alias("low"))


def coverage_priority(demand: Column, fresh_places: Column, staleness: Column, value: Column, confidence: Column) -> Column:
    return demand * (1 - F.least(F.lit(1.0), fresh_places / 5)) * staleness * value * (1 - confidence)


def rolling_health(calls: DataFrame, rows: int = 64, seconds: int = 1800) -> DataFrame:
    """calls(call_id, provider, at, outcome, latency_ms) with n, success_rate, p50, p95 (nearest rank) and health over the last `rows` calls not older than `seconds`."""
    # calls not older than `seconds` lie in a call's own period of that length or the one before, so periods are apart
    period = F.floor(F.unix_timestamp("at") / seconds)
    both = calls.withColumn("__period", F.explode(F.array(period, period + 1))).withColumn("__own", F.col("__period") == period)
    w = Window.partitionBy("provider", "__period").orderBy("at", "call_id").rowsBetween(-(rows - 1), 0)
    recent = F.filter(F.collect_list(F.struct(F.unix_timestamp("at").alias("t"), "outcome", "latency_ms")).over(w), lambda x: x["t"] >= F.unix_timestamp("at") - seconds)
    c = both.withColumn("r", recent).filter("__own")
    n = F.size("r")
    sorted_ = F.array_sort(F.transform("r", lambda x: x["latency_ms"]))
    rank = lambda p: F.element_at(sorted_, F.greatest(F.lit(1), F.ceil(n * p).cast("int")))
    good = F.size(F.filter("r", lambda x: x["outcome"] == "success")) / n
    out = c.select("call_id", "provider", n.alias("n"), good.alias("success_rate"), rank(0.5).alias("p50"), rank(0.95).alias("p95"))
    return out.withColumn("status", F.when(F.col("success_rate") >= 0.8, "healthy").when(F.col("success_rate") >= 0.5, "degraded").otherwise("down"))


def retention(rows: DataFrame, as_of: Column, at: str, query: str, payload: str) -> DataFrame:
    """Over 14 days old the query is redacted, over 90 the payload goes, over 180 the row goes."""
    age = geo.age_days(F.col(at), as_of)
    return rows.filter(age <= 180).withColumn(query, F.when(age > 14, text.redact(F.col(query))).otherwise(F.col(query))).withColumn(payload, F.when(age <= 90, F.col(payload)))
