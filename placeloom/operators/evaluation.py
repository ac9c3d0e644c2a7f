"""Ranking metrics over labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ir_metrics(ranked: DataFrame, relevant: DataFrame, recall_at: int = 50, precision_at: int = 10, ndcg_at: int = 20) -> DataFrame:
    """query_id, recall, precision, ndcg, mrr of ranked(query_id, doc, rank) against relevant(query_id, doc); queries without hits have zeros."""
    r = relevant.select("query_id", "doc", F.lit(1).alias("rel")).distinct()
    total = r.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    hit = ranked.join(r, ["query_id", "doc"])
    gain = F.sum(F.when(F.col("rank") <= ndcg_at, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    g = hit.groupBy("query_id").agg(F.count_if(F.col("rank") <= recall_at).alias("h"), F.count_if(F.col("rank") <= precision_at).alias("p"), gain.alias("dcg"), F.max(1 / F.col("rank")).alias("mrr"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(ndcg_at)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return total.join(g, "query_id", "left").select("query_id", zero(F.col("h") / F.col("total")).alias("recall"), zero(F.col("p") / F.lit(float(precision_at))).alias("precision"), zero(F.col("dcg") / ideal).alias("ndcg"), zero(F.col("mrr")).alias("mrr"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, recall of a's ids in b, jaccard: a and b have query_id, ids (array)."""
    both = a.select("query_id", F.col("ids").alias("x")).join(b.select("query_id", F.col("ids").alias("y")), "query_id")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("query_id", (common / F.size("x")).alias("recall"), (common / F.size(F.array_union("x", "y"))).alias("jaccard"))
