"""Labelled cases: checks of labels, pass and fail of results, suite metrics, approval of observation groups, scores by evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans.graph import written
from .ranking import clamp
from .search import small
from .selection import nearest_rank

INTENTS = ["local_search", "legal", "market_price", "weather", "comparison", "howto", "lookup"]
FRESHNESS = ["today", "week", "month", "any"]
RUNGS = ["observed", "corroborated", "verified", "authoritative"]
#: Places returned by bucket.
BUCKETS = {"exact": 20, "unverified": 10, "related": 8}


def _reasons(rules: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(bad, name) for bad, name in rules]), lambda x: x.isNotNull())


def label_errors(c: DataFrame) -> DataFrame:
    """c with errors: labels outside their vocabulary, radius not above 0 or without an anchor, blank entities, entities where none is expected.

    c: intent, freshness, authority, anchor_label, anchor_lat, anchor_lon, radius_m, entities (array), abstain.
    """
    outside = lambda k, known: (F.trim(k) != "") & ~F.trim(k).isin(known)
    some = F.col("anchor_label").isNotNull() | F.col("anchor_lat").isNotNull() | F.col("anchor_lon").isNotNull()
    good = (F.trim(F.coalesce("anchor_label", F.lit(""))) != "") | F.coalesce(F.col("anchor_lat").between(-90, 90) & F.col("anchor_lon").between(-180, 180), F.lit(False))
    blank = F.exists("entities", lambda e: F.trim(e) == "")
    rules = [
        (outside("intent", INTENTS), "intent"), (outside("freshness", FRESHNESS), "freshness"), (outside("authority", RUNGS), "authority"),
        (some & ~good, "anchor"), (F.col("radius_m") <= 0, "radius"), ((F.col("radius_m") > 0) & ~some, "radius_without_anchor"),
        (blank, "entities"), (~blank & (F.size("entities") > 0) & F.col("abstain"), "abstention"),
    ]
    return c.withColumn("errors", _reasons(rules))


def golden_failures(cases: DataFrame, results: DataFrame) -> DataFrame:
    """case, failures, pass of results against cases; a case without a result fails all that it expects.

    cases: case, want_intent, want_units, radius_m, want_names, abstain, want_rung; results: case, intent, units,
    farthest_m, names (normal, of the places shown), exact (number of), rung (best level among them).
    """
    x = cases.join(results, "case", "left")
    empty = F.array().cast("array<string>")
    names, units = F.coalesce("names", empty), F.coalesce("units", F.array().cast("array<bigint>"))
    missing = F.exists("want_names", lambda n: ~F.exists(names, lambda m: F.contains(m, text.normalize(n))))
    place = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, RUNGS)), c), F.lit(0))
    rules = [
        (F.col("want_intent").isNotNull() & ~F.col("want_intent").eqNullSafe(F.col("intent")), "intent"),
        (F.size(F.array_except("want_units", units)) > 0, "units"),
        (F.col("farthest_m") > F.col("radius_m"), "radius"),
        (missing, "entities"),
        (F.col("abstain") & (F.col("exact") > 0), "abstention"),
        (F.col("want_rung").isNotNull() & (place(F.col("rung")) < place(F.col("want_rung"))), "authority"),
    ]
    failures = _reasons(rules)
    return x.select("case", failures.alias("failures")).withColumn("pass", F.size("failures") == 0)


def suite_metrics(r: DataFrame) -> DataFrame:
    """One row over case results: intent, specialty and unit accuracy, precision of places, share outside the area, honest abstentions, zero rate, p50 and p95 (nearest rank).

    r: intent, want_intent, specialty, want_specialty, unit_ok (null: none wanted), places (none, any, verified or null), shown, exact, correct, outside, latency_ms.
    """
    share = lambda good, of: F.avg(F.when(of, good.cast("double")))
    yes = F.lit(True)
    need = F.when(F.col("places") == "verified", F.col("exact")).otherwise(F.col("shown"))
    p50, p95 = (F.lit(p).cast(r.schema["latency_ms"].dataType) for p in nearest_rank(r, "latency_ms", (0.5, 0.95)))
    return r.agg(
        F.count(F.lit(1)).alias("cases"), share(F.col("intent") == F.col("want_intent"), yes).alias("intent"),
        share(F.col("specialty").eqNullSafe(F.col("want_specialty")), F.col("want_specialty").isNotNull()).alias("specialty"), share(F.col("unit_ok"), F.col("unit_ok").isNotNull()).alias("unit"),
        F.try_divide(F.sum("correct"), F.sum("shown")).alias("place_precision"), F.try_divide(F.sum("outside"), F.sum("shown")).alias("outside_rate"),
        share(F.col("shown") == 0, F.col("places") == "none").alias("abstain_rate"), share(need == 0, F.col("places").isin("any", "verified")).alias("zero_rate"),
        p50.alias("p50"), p95.alias("p95"),
    )


def approvals(o: DataFrame, as_of: Column, days: int = 90, box: float = 0.002) -> DataFrame:
    """outlet, sources, specialties, reasons, approved: whether the newest observations of an outlet's sources agree.

    o: outlet, source, source_group, status, at, category, unit, phone, tax_id, specialties (array), lat, lon. Of each
    source the newest row that is not rejected counts, if it is not older than `days`.
    """
    newest = F.row_number().over(Window.partitionBy("outlet", "source").orderBy(F.desc("at")))
    a = o.filter("status <> 'rejected'").withColumn("__i", newest).filter("__i = 1").filter(F.unix_timestamp("at") >= F.unix_timestamp(as_of) - days * 86400)
    sets = F.collect_list(F.transform("specialties", text.normalize))
    several = lambda k: F.count_distinct(F.when(F.col(k).cast("string") != "", F.col(k))) > 1
    spread = F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon"))
    g = a.groupBy("outlet").agg(F.count_distinct("source_group").alias("sources"), sets.alias("__s"), *[several(k).alias(f"__{k}") for k in ("category", "unit", "phone", "tax_id")], spread.alias("__d"))
    all_ = o.select("outlet").distinct().join(g, "outlet", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    empty = F.array().cast("array<string>")
    shared = F.when(F.size("__s") > 0, F.aggregate("__s", F.element_at("__s", 1), lambda x, y: F.array_intersect(x, y))).otherwise(empty)
    all_ = all_.withColumn("specialties", F.array_sort(F.array_distinct(F.coalesce(shared, empty))))
    rules = [(F.col("sources") < 2, "sources"), *[(F.col(f"__{k}"), k) for k in ("category", "unit", "phone", "tax_id")], (F.size("specialties") == 0, "specialties"), (F.col("__d") > box, "location")]
    return all_.withColumn("reasons", _reasons(rules)).select("outlet", "sources", "specialties", "reasons").withColumn("approved", F.size("reasons") == 0)


def embedded_places(p: DataFrame, query: str, tie: str) -> DataFrame:
    """The best places of each query in three buckets (exact 20, unverified 10, related 8), with score, bucket and rank.

    p: spec_hit, name_hit, addr_hit (shares), has_spec, spec_in_name, same_category, in_unit, in_province, has_location, verified (booleans),
    dist_km, rating, reviews (or null), trust. Exact: right specialty or category, and in the area; else related.
    """
    points = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    within = lambda c, lo, hi: F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))
    area = F.when(~F.col("has_location"), 0.0).when(F.col("in_unit"), 30.0).when(F.col("in_province"), 12.0).otherwise(-26.0)
    score = 22 * F.col("spec_hit") + 16 * F.col("name_hit") + 4 * F.col("addr_hit") + points(F.col("has_spec"), 18) + points(F.col("spec_in_name"), 8) + points(F.col("same_category"), 14) + area
    score = score + zero(within(8 - 0.5 * F.col("dist_km"), -10, 8)) + F.col("trust") + points(F.col("verified"), 6) + zero(within(F.col("rating") - 3.6, 0, 1.2) * 5) + zero(within(F.log10(1 + F.col("reviews")) * 1.6, 0, 4))
    exact = (F.col("has_spec") | F.col("same_category")) & F.when(F.col("has_location"), F.col("in_unit")).otherwise(F.lit(False))
    bucket = F.when(exact & F.col("verified"), "exact").when(exact, "unverified").otherwise("related")
    s = p.withColumn("score", score).withColumn("bucket", bucket)
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy(query, "bucket").orderBy(F.desc("score"), tie)))
    most = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])
    return s.filter(F.col("rank") <= F.element_at(most, F.col("bucket")))


def embedded_documents(d: DataFrame, query: str, tie: str, least: float = 24.0, top: int = 8) -> DataFrame:
    """The best documents of each query: 30 overlap, 20 for the specialty, 12 for each place named, 16 for each compared target, 5 for each entity, by intent and class of source, 14 authority, 8 or 18 freshness; above `least`.

    d: overlap (share), has_spec, places, targets, entities (numbers), intent, source_type, authority, fresh (share), today (boolean).
    """
    points = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    kind, intent = F.col("source_type"), F.col("intent")
    score = 30 * F.col("overlap") + points(F.col("has_spec"), 20) + 12 * F.col("places") + 16 * F.col("targets") + 5 * F.col("entities") + points((intent == "legal") & kind.isin("law", "government"), 24) + points((intent == "market_price") & (kind == "news"), 12) + points((intent == "weather") & kind.isin("government", "news"), 14)
    score = score + 14 * F.col("authority") + F.when(F.col("today"), 18.0).otherwise(8.0) * F.col("fresh")
    s = d.withColumn("score", score).filter(F.col("score") > least)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), tie))).filter(F.col("rank") <= top)


def multi_query_rerank(lists: DataFrame, query: str, key: str, authority: DataFrame, top: int, k: int = 60) -> DataFrame:
    """query, key, score, corroboration, rank: sub-query lists(query, sub, key, rank, relevance) fused, then 0.5 fused (scaled to its best) + 0.2 relevance + 0.15 authority + 0.15 corroboration.

    corroboration: sub-queries that found the key, of five at most; authority: key, authority (unknown: 0.5).
    """
    best = lists.groupBy(query, key, "sub").agg(F.min("rank").alias("rank"), F.max("relevance").alias("relevance"))
    g = best.groupBy(query, key).agg(F.sum(1 / (k + F.col("rank"))).alias("fused"), F.max("relevance").alias("relevance"), F.least(F.lit(1.0), F.count(F.lit(1)) / 5.0).alias("corroboration"))
    g = written(g.join(authority, key, "left"), "fused-lists")
    # the best is joined to the rows, so that no task holds all rows of a query
    most = g.groupBy(F.col(query).alias("__q")).agg(F.max("fused").alias("__most"))
    g = g.join(small(most), F.col(query).eqNullSafe(F.col("__q"))).withColumn("fused", F.col("fused") / F.col("__most")).drop("__q", "__most")
    score = 0.5 * F.col("fused") + 0.2 * clamp(F.col("relevance")) + 0.15 * F.coalesce("authority", F.lit(0.5)) + 0.15 * F.col("corroboration")
    g = g.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key)))
    return g.filter(F.col("rank") <= top).select(query, key, "score", "corroboration", "rank")


def strict_specialty(specialties: Column, wanted: Column) -> Column:
    """Whether the specialties themselves (not the name) hold the wanted one."""
    return F.coalesce(F.exists(specialties, lambda s: F.contains(text.normalize(s), text.normalize(wanted))), F.lit(False))
