"""Gates: predicates that evidence, URLs and places must pass, and what each gate drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import web

# Trust by class of authority, URLs of low value, levels that count as verified.
TRUST = {
    "official": "high", "government": "high", "research_paper": "high", "major_publication": "high", "vendor_website": "medium",
    "specialist_blog": "medium", "forum": "medium", "reddit": "low", "unknown_seo_site": "unverified",
}
LOW_VALUE = "bokep|porn|xvideo|xxx|hentai|casino|bong88|lode|f88|vaytien|taichinh24h|nokiavn|clipnong"
VERIFIED_LEVELS = ["corroborated", "verified", "authoritative"]


def authority_ok(authority: Column, least: float) -> Column:
    """Unknown authority counts as 0.5."""
    return F.coalesce(authority, F.lit(0.5)) >= least


def fresh_enough(published_at: Column, as_of: Column, max_days: int) -> Column:
    """Whole days of age are at most max_days; an unknown date passes."""
    age = F.timestamp_diff("DAY", published_at.cast("timestamp"), as_of.cast("timestamp"))
    return published_at.isNull() | (age <= max_days)


def gated(evidence: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """evidence with dropped_by: the first gate (in order) that a row does not pass, null if it passes all."""
    first = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in gates.items()])
    return evidence.withColumn("dropped_by", first)


def gate_counts(rows: DataFrame, query: str, gates: list[str]) -> DataFrame:
    """query, kept, and dropped_<gate> for each gate; one aggregate over gated rows."""
    dropped = [F.count_if(F.col("dropped_by").eqNullSafe(F.lit(g))).alias(f"dropped_{g}") for g in gates]
    return rows.groupBy(query).agg(F.count_if(F.col("dropped_by").isNull()).alias("kept"), *dropped)


def blocked_url(url: Column, most: float = 0.5) -> Column:
    """Private addresses and URLs whose spam score reaches `most`."""
    return web.is_private(url) | (web.spam_score(url) >= most)


def trust_label(authority_type: Column, providers: Column, url: Column) -> Column:
    """high, medium, low or unverified: by class; two providers or more raise low and unverified to medium; a URL of low value is low."""
    known = F.create_map(*[F.lit(x) for pair in TRUST.items() for x in pair])
    base = F.coalesce(F.try_element_at(known, authority_type), F.lit("unverified"))
    raised = F.when((providers >= 2) & base.isin("low", "unverified"), "medium").otherwise(base)
    return F.when(F.coalesce(url, F.lit("")).rlike(f"(?i)({LOW_VALUE})"), "low").otherwise(raised)


def is_verified(level: Column, verified_at: Column, confidence: Column, least: float = 0.7) -> Column:
    """A level of the ladder, a time stamp and enough confidence; unknown parts do not pass."""
    return F.coalesce(level.isin(VERIFIED_LEVELS) & verified_at.isNotNull() & (confidence >= least), F.lit(False))
