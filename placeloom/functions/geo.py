"""Distances, cells, decays and calendar buckets on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
# Days in which a field's freshness falls to 1/e.
FIELD_DAYS = {"phone": 180.0, "website": 365.0, "hours": 90.0, "status": 45.0, "category": 365.0, "name": 730.0, "address": 730.0, "location": 1460.0}
DEFAULT_DAYS = 180.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere; null if a coordinate is."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def cell(lat: Column, lon: Column, size: float) -> Column:
    """The grid cell of a point, as row * 2^32 + column."""
    return F.floor(lat / size) * F.lit(1 << 32) + F.floor(lon / size)


def around(lat: Column, lon: Column, size: float) -> Column:
    """The nine cells in and around a point's cell."""
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return F.transform(at, lambda d: (F.floor(lat / size) + d["i"]) * F.lit(1 << 32) + F.floor(lon / size) + d["j"])


def age_days(at: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400.0)


def field_recency(field: Column, days: Column) -> Column:
    """exp(-days / tau) with the field's tau; half for an unknown age."""
    tau = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FIELD_DAYS.items() for x in kv]), field), F.lit(DEFAULT_DAYS))
    return F.coalesce(F.exp(-days / tau), F.lit(0.5))


def freshness(days: Column, halflife: float | None = None) -> Column:
    """Linear to 0 at twice the half-life, or at five years without one; half for an unknown age."""
    span = 2 * halflife if halflife else 365.25 * 5
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days / span)), F.lit(0.5))


def recrawl_seconds(rate: Column) -> Column:
    """Seven days less the change rate's share of all but one hour of it."""
    return 604800 - rate * (604800 - 3600)


def iso_week(at: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def week_bucket(at: Column) -> Column:
    """Seven-day periods since the epoch."""
    return F.floor(F.unix_timestamp(at) / 604800)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def open_now(ranges: Column, day: Column, minute: Column) -> Column:
    """Whether one of ranges (day 0-6, start, end in minutes; end before start runs past midnight) holds now; null ranges: null."""
    today = lambda r: (r["day"] == day) & F.when(r["start"] <= r["end"], minute.between(r["start"], r["end"])).otherwise(minute >= r["start"])
    tail = lambda r: (r["day"] == (day + 6) % 7) & (r["start"] > r["end"]) & (minute <= r["end"])
    return F.exists(ranges, lambda r: today(r) | tail(r))


# Weekdays as opening hours name them, 0 is Monday.
WEEKDAYS = {
    "monday": 0, "tuesday": 1, "wednesday": 2, "thursday": 3, "friday": 4, "saturday": 5, "sunday": 6,
    "thứ hai": 0, "thứ ba": 1, "thứ tư": 2, "thứ năm": 3, "thứ sáu": 4, "thứ bảy": 5, "chủ nhật": 6,
}


def parse_hours(hours: Column) -> Column:
    """Days of opening hours (JSON: day -> text or list of texts): array of struct(day, items, ranges).

    items: texts of the day that do not just say closed. ranges: those that read as "8:00-22:00" (minutes; after
    midnight end is before start) or as round the clock. Days by other names are left out. Null without JSON.
    """
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    each = F.map_entries(F.from_json(hours, "map<string,string>"))
    names = F.create_map(*[F.lit(x) for kv in WEEKDAYS.items() for x in kv])
    many = lambda v: F.when(v.startswith("["), F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(v))
    texts = lambda v: F.filter(F.transform(many(v), plain), lambda x: ~x.rlike("(?iu)^(?:đóng cửa|closed)$"))

    def minutes(x, k):
        h, m = (F.regexp_extract(x, r"^(\d{1,2}):(\d{2}) ?[–—-] ?(\d{1,2}):(\d{2})$", g).try_cast("int") for g in (k, k + 1))
        return F.when((h < 24) & (m < 60) | (h == 24) & (m == 0), h * 60 + m)

    day_long = lambda x: x.rlike(r"(?iu)24\s*(?:hours?|hrs?|h)\b|24/7|mở cửa cả ngày")
    one = lambda x: F.when(day_long(x), F.struct(F.lit(0).alias("start"), F.lit(1440).alias("end"))).otherwise(F.struct(minutes(x, 1).alias("start"), minutes(x, 3).alias("end")))
    ranges = lambda items: F.filter(F.transform(items, one), lambda r: r["start"].isNotNull() & r["end"].isNotNull())
    days = F.transform(each, lambda e: F.struct(F.try_element_at(names, F.lower(plain(e["key"]))).alias("day"), texts(e["value"]).alias("items")))
    return F.filter(F.transform(days, lambda d: F.struct(d["day"].alias("day"), d["items"].alias("items"), ranges(d["items"]).alias("ranges"))), lambda d: d["day"].isNotNull())


def open_state(hours: Column, day: Column, minute: Column) -> Column:
    """Whether a place with these opening hours (parse_hours) is open on a day at a minute; null if it cannot be told.

    Ranges over midnight count for the day on which they begin. A day that is listed without hours, or with hours of
    which none holds, is closed; a day that is not listed, or whose texts cannot be read, is unknown.
    """
    holds = lambda r: F.when(r["start"] <= r["end"], minute.between(r["start"], r["end"])).otherwise(minute >= r["start"])
    today = F.filter(hours, lambda d: d["day"] == day)
    open_ = F.exists(today, lambda d: F.exists(d["ranges"], holds))
    tail = F.exists(F.filter(hours, lambda d: d["day"] == (day + 6) % 7), lambda d: F.exists(d["ranges"], lambda r: (r["start"] > r["end"]) & (minute <= r["end"])))
    readable = F.exists(today, lambda d: (F.size(d["ranges"]) > 0) | (F.size(d["items"]) == 0))
    return F.when(F.size(hours) > 0, F.when(open_ | tail, True).when(readable, False))
