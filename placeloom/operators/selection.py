"""Exact order statistics and running averages, split over tasks."""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import written

#: Ranges into which an interval of values is cut, and values that are sorted at last.
RANGES, FEW = 4096, 4096


def order_statistics(rows: DataFrame, column: str, ranks: Iterable[int] | None = None, of_count=None) -> tuple[int, dict[int, float]]:
    """(number of values, {rank: the value of that rank}) of a numeric column, ranks counted from 1; of_count(n) gives the ranks where they depend on n.

    Values are counted by ranges of equal width, of which those with a wanted rank are cut again, from their own least to
    their own largest value, until all values are equal or FEW are left; so neither a list of all values nor a table of all
    different ones is held anywhere, and RANGES rows of counts reach the driver in a pass. Nulls and NaN are no values.
    """
    v = written(rows.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)"), "selected-values")
    n, low, high = v.agg(F.count("v"), F.min("v"), F.max("v")).first()
    wanted = {k for k in (of_count(n) if of_count else ranks) if 1 <= k <= n}
    found: dict[int, float] = {}
    open_ = [(low, high, 0, n, wanted)] if wanted else []
    while open_:
        low, high, before, size, mine = open_.pop()
        if low == high:
            found |= dict.fromkeys(mine, low)
            continue
        part = v.filter(F.col("v").between(low, high))
        if size <= FEW:
            values = sorted(r["v"] for r in part.collect())
            found |= {k: values[k - before - 1] for k in mine}
            continue
        # halves, as the difference of two doubles may be too large
        at = F.least(F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * RANGES), F.lit(RANGES - 1))
        for r in sorted(part.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: r["at"]):
            inside = {k for k in mine if before < k <= before + r["n"]}
            if inside:
                open_.append((r["low"], r["high"], before, r["n"], inside))
            before += r["n"]
    return n, found


def interpolated(rows: DataFrame, column: str, shares: Iterable[float]) -> list[float | None]:
    """Percentiles between neighbouring values (as percentile_cont); None of no values."""
    shares = list(shares)
    places = lambda n: [(n - 1) * p for p in shares]
    n, v = order_statistics(rows, column, of_count=lambda n: {int(f(x)) + 1 for x in places(n) for f in (floor, ceil)})
    if not n:
        return [None] * len(shares)
    both = [(v[floor(x) + 1], v[ceil(x) + 1], x) for x in places(n)]
    return [a if a == b else (ceil(x) - x) * a + (x - floor(x)) * b for a, b, x in both]


def nearest_rank(rows: DataFrame, column: str, shares: Iterable[float]) -> list[float | None]:
    """Percentiles that are values themselves: of n values the one of rank n times the share, rounded up."""
    shares = list(shares)
    rank = lambda n, p: max(1, ceil(n * p))
    n, v = order_statistics(rows, column, of_count=lambda n: {rank(n, p) for p in shares})
    return [v[rank(n, p)] if n else None for p in shares]


def ema(rows: DataFrame, by: str, at: str, value: str, alpha: float) -> DataFrame:
    """by, ema, n: alpha * value + (1 - alpha) * before over a key's values in order of `at` (then of value), from the first value on.

    Taking a run of values is an affine map of the average before it, so a key's rows, range-partitioned by (key, at), are
    reduced to one map for each partition that has some of them, and a key's few maps are composed in order; a key
    with many rows is the work of many tasks. Null values are left out.
    """
    r = rows.select(F.col(by).alias("k"), F.col(at).alias("t"), F.col(value).cast("double").alias("v")).filter("v is not null")
    r = written(r.repartitionByRange("k", "t", "v").withColumn("part", F.spark_partition_id()), "ema-values")
    w = Window.partitionBy("part", "k")
    r = r.select("part", "k", "v", F.row_number().over(w.orderBy("t", "v")).alias("i"), F.count(F.lit(1)).over(w).alias("m"))
    keep = F.lit(1.0 - alpha)
    maps = r.groupBy("k", "part").agg(F.max("m").alias("m"), F.sum(alpha * F.pow(keep, F.col("m") - F.col("i")) * F.col("v")).alias("b"), F.max(F.when(F.col("i") == 1, F.col("v"))).alias("first"))
    g = maps.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "m", "b", "first"))).alias("s"))
    out = F.aggregate("s", F.element_at("s", 1)["first"], lambda x, p: F.pow(keep, p["m"]) * x + p["b"])
    return g.select(F.col("k").alias(by), out.alias("ema"), F.aggregate("s", F.lit(0).cast("long"), lambda n, p: n + p["m"]).alias("n"))
