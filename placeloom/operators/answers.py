"""Answers over evidence: coverage, gaps, sufficiency, confidence, summaries, result lists; one row per query or item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def round_half_up(x: Column, places: int = 2) -> Column:
    scale = 10.0**places
    return F.floor(x * scale + 0.5) / scale


def missing_words(queries: DataFrame, evidence: DataFrame, least: int = 4) -> DataFrame:
    """query_id, pos, word: words of `least` letters or more that no quote of the query contains.

    queries: query_id, text; evidence: query_id, quote. Words meet the quotes of their own query only.
    """
    words = queries.select("query_id", F.posexplode(F.split(F.lower("text"), r"\s+")).alias("pos", "word")).filter(F.length("word") >= least)
    quotes = evidence.select("query_id", F.lower("quote").alias("quote"))
    found = words.join(quotes, "query_id", "left").groupBy("query_id", "pos", "word").agg(F.max(F.coalesce(F.col("quote").contains(F.col("word")), F.lit(False))).alias("found"))
    return found.filter(~F.col("found")).select("query_id", "pos", "word")


def gap_summary(queries: DataFrame, evidence: DataFrame, first: int = 5, enough: int = 3) -> DataFrame:
    """query_id, missing (the first few missing words), need_more, confidence (a fifth for each quote times mean support, 1 at most).

    evidence also has support. A query without quotes misses all its words and has confidence 0.
    """
    order = Window.partitionBy("query_id").orderBy("pos")
    gaps = missing_words(queries, evidence).withColumn("i", F.row_number().over(order)).filter(F.col("i") <= first)
    gaps = gaps.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("missing"))
    support = evidence.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("support").alias("support"))
    out = queries.select("query_id").join(gaps, "query_id", "left").join(support, "query_id", "left")
    confidence = F.coalesce(F.least(F.col("n") / 5.0 * F.col("support"), F.lit(1.0)), F.lit(0.0))
    return out.select("query_id", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), (F.coalesce("n", F.lit(0)) < enough).alias("need_more"), confidence.alias("confidence"))


def sufficiency(subqueries: DataFrame, evidence: DataFrame, threshold: float = 0.8, domains: int = 3) -> DataFrame:
    """query_id, coverage (share of sub-queries that a text contains), domains, sufficient.

    subqueries: query_id, sub; evidence: query_id, text, domain.
    """
    texts = evidence.select("query_id", F.lower("text").alias("text"))
    hit = subqueries.distinct().join(texts, "query_id", "left").groupBy("query_id", "sub").agg(F.max(F.coalesce(F.col("text").contains(F.lower("sub")), F.lit(False))).alias("hit"))
    covered = hit.groupBy("query_id").agg(F.avg(F.col("hit").cast("double")).alias("coverage"))
    seen = evidence.groupBy("query_id").agg(F.count_distinct("domain").alias("domains"))
    out = covered.join(seen, "query_id", "left").withColumn("domains", F.coalesce("domains", F.lit(0)))
    return out.withColumn("sufficient", (F.col("coverage") >= threshold) & (F.col("domains") >= domains))


def pack_scores(verdicts: DataFrame, pack: str) -> DataFrame:
    """pack, coverage (share of claims with sufficient evidence), confidence (mean). verdicts: pack, status, confidence."""
    enough = (F.col("status") != "insufficient_evidence").cast("double")
    return verdicts.groupBy(pack).agg(F.avg(enough).alias("coverage"), F.avg("confidence").alias("confidence"))


def retrieval_quality(queries: DataFrame, docs: DataFrame, places: DataFrame) -> DataFrame:
    """query_id, confidence, coverage (good, partial, none), independent, avg_authority (of the best three).

    queries: query_id, intent; docs: query_id, doc, domain, authority, source_type, mentions_place, score; places: query_id, exact, unverified
    (numbers of places). A local search goes by its places and the documents that mention one, others by
    authority and independent domains, with a bonus for official sources of law and weather; without documents 0.05.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    official = F.col("source_type").isin("law", "government")
    q = docs.withColumn("i", rank).groupBy("query_id").agg(
        F.count_distinct("domain").alias("independent"),
        F.avg(F.when(F.col("i") <= 3, F.col("authority"))).alias("avg_authority"),
        F.max(official).alias("official"),
        F.count(F.when(F.col("mentions_place"), 1)).alias("mentions"),
    )
    q = queries.join(q, "query_id", "left").join(places, "query_id", "left")
    q = q.fillna(0, ["exact", "unverified", "mentions", "independent", "avg_authority"]).fillna(False, ["official"])
    local = F.when(F.col("exact") > 0, 0.6 + F.least(F.lit(0.25), 0.08 * F.col("exact"))).when(F.col("unverified") > 0, 0.3 + F.least(F.lit(0.1), 0.05 * F.col("unverified"))).otherwise(0.08) + F.least(F.lit(0.08), 0.03 * F.col("mentions"))
    bonus = F.when(F.col("intent").isin("legal", "weather") & F.col("official"), 0.12).otherwise(0.0)
    found = 0.2 + 0.35 * F.col("avg_authority") + 0.07 * F.least(F.lit(4), F.col("independent")) + bonus
    other = F.when(F.col("independent") == 0, 0.05).otherwise(found)
    confidence = round_half_up(F.least(F.lit(0.97), F.when(F.col("intent") == "local_search", local).otherwise(other)))
    q = q.withColumn("confidence", confidence)
    label = F.when(F.col("confidence") >= 0.7, "good").when(F.col("confidence") >= 0.35, "partial").otherwise("none")
    return q.select("query_id", "confidence", label.alias("coverage"), "independent", round_half_up(F.col("avg_authority")).alias("avg_authority"))


def recall_gate(candidates: DataFrame, query: str, useful: Column, limit: int) -> DataFrame:
    """query, useful, enough: whether min(5, limit) candidates are useful."""
    out = candidates.groupBy(query).agg(F.count_if(useful).alias("useful"))
    return out.withColumn("enough", F.col("useful") >= min(5, limit))


def staging_snapshot(observations: DataFrame, key: str, source: str, status: str, at: str) -> DataFrame:
    """key, observations, sources, status: pending if any observation is, else that of the newest (at; ties: the largest status)."""
    newest = F.max(F.struct(at, status))[status]
    pending = F.max(F.col(status) == "pending")
    return observations.groupBy(key).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct(source).alias("sources"), F.when(pending, "pending").otherwise(newest).alias("status"))


def extractive_summary(chunks: DataFrame, group: str, score: str, tie: str, body: str, top: int = 5, sentences: int = 3, most: int = 500) -> DataFrame:
    """group, tie, rank, summary: the first sentences of each group's best chunks; longer ones are cut and marked."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    best = chunks.withColumn("rank", rank).filter(F.col("rank") <= top)
    s = F.array_join(F.slice(F.split(F.coalesce(body, F.lit("")), r"\. "), 1, sentences), ". ")
    cut = text.let(s, lambda x: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x))
    return best.select(group, tie, "rank", cut.alias("summary"))


def unified(sections: list[DataFrame], query: str, score: str, tie: str, most: int) -> DataFrame:
    """Rows of all sections (same columns), a section's before those of the next, by score within, at most `most` for a query; with section and place."""
    rows = [s.withColumn("section", F.lit(i)) for i, s in enumerate(sections)]
    all_rows = rows[0]
    for r in rows[1:]:
        all_rows = all_rows.unionByName(r)
    place = F.row_number().over(Window.partitionBy(query).orderBy("section", F.desc(score), tie))
    return all_rows.withColumn("place", place).filter(F.col("place") <= most)


def blended(rows: DataFrame, query: str, semantic: Column, keyword: Column, tie: str, top: int = 10) -> DataFrame:
    """The best rows of each query by 0.6 semantic + 0.4 keyword score."""
    rows = rows.withColumn("blend", 0.6 * semantic + 0.4 * keyword)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("blend"), tie))
    return rows.withColumn("place", place).filter(F.col("place") <= top)


def newest_versions(cases: DataFrame, case: str, version: str) -> DataFrame:
    """cases with state: active for the newest version of a case, else superseded, and superseded_by, the next version."""
    w = Window.partitionBy(case).orderBy(version)
    following = F.lead(version).over(w)
    return cases.withColumn("superseded_by", following).withColumn("state", F.when(following.isNull(), "active").otherwise("superseded"))


def engine_counters(calls: DataFrame, engine: str, outcome: str, latency: str) -> DataFrame:
    """engine, requests, success_rate, rate_429, captcha_rate, mean_latency (of all calls)."""
    share = lambda x: F.avg((F.col(outcome) == x).cast("double"))
    return calls.groupBy(engine).agg(F.count(F.lit(1)).alias("requests"), share("success").alias("success_rate"), share("rate_limited").alias("rate_429"), share("captcha").alias("captcha_rate"), F.avg(latency).alias("mean_latency"))


def unwrap_json(value: Column) -> Column:
    """JSON text that was encoded twice becomes the text encoded once; other values stay."""
    return F.when(F.trim(value).startswith('"'), F.get_json_object(value, "$")).otherwise(value)
