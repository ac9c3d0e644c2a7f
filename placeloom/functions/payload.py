"""Fields of JSON payloads, parts of addresses and of queries, on Columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

IMAGE_KEYS = ["photos", "image", "images", "thumbnail"]
MOST_REVIEWS = 2_147_483_647
# Names under which pages give their dates; words before the parts of an address.
PUBLISHED = ["articlepublishedtime", "datepublished", "ogpublishedtime", "publicationdate", "publishedat", "publisheddate", "publishedtime"]
UPDATED = ["articlemodifiedtime", "datemodified", "lastmodified", "modifiedat", "ogupdatedtime", "updatedat", "updatedtime"]
FIRST_SEEN = ["firstseen", "firstseenat"]
ROLES = ["city", "district", "ward"]
# Words of units before their names, patterns of a house number and of a lane, words that an address has,
# and folded forms of large cities.
CITY_WORDS = r"(?iu)^(?:thành phố|thanh pho|tỉnh|tinh|tp\.?)\s*"
DISTRICT_WORDS = r"(?iu)^(?:quận|quan|huyện|huyen|thị xã|thi xa|thị trấn|thi tran|q\.)\s*"
WARD_WORDS = r"(?iu)^(?:phường|phuong|xã|xa|thị trấn|thi tran|p\.)\s*"
HOUSE = r"(?iu)^(?:(?:số|so|nhà|nha|no)\s+)?(#\s*)?(\d+[a-zA-Z]?(?:\s*[/\-]\s*\d+[a-zA-Z]?)*)"
LANE = r"(?iu)^(?:(?:ngõ|ngo|hẻm|hem|kiệt|kiet|ngách|ngach|đường số|duong so)\s+)(\d+[a-zA-Z]?)\b"
ADDRESS_WORDS = r"(?iuU)\b(phường|phuong|xã|xa|quận|quan|huyện|huyen|thành phố|thanh pho|tỉnh|tinh|ngõ|ngo|hẻm|hem|kiệt|kiet|đường số|duong so|p\.|q\.|tp\.?)\b"
CITIES = {
    "ha noi": "Thành phố Hà Nội", "hanoi": "Thành phố Hà Nội", "ho chi minh": "Thành phố Hồ Chí Minh", "tphcm": "Thành phố Hồ Chí Minh", "tp.hcm": "Thành phố Hồ Chí Minh", "tp hcm": "Thành phố Hồ Chí Minh",
    "hcm": "Thành phố Hồ Chí Minh", "sai gon": "Thành phố Hồ Chí Minh", "saigon": "Thành phố Hồ Chí Minh", "sg": "Thành phố Hồ Chí Minh", "can tho": "Thành phố Cần Thơ", "da nang": "Thành phố Đà Nẵng",
    "hai phong": "Thành phố Hải Phòng", "hue": "Thành phố Huế",
}


def rich_fields(payload: Column) -> Column:
    """struct(rating, review_count, price, images) of a JSON payload; what is missing or malformed is null.

    A rating lies in 0 to 5; a count is a whole number, in text also with commas at thousands; images are different
    http(s) texts in order, under several keys, alone, in lists, or as url of objects.
    """
    get = lambda k: F.get_json_object(payload, f"$.{k}")
    rating = get("review_rating").try_cast("decimal(30,12)")
    raw = F.trim(get("review_count"))
    count = F.when(raw.rlike(r"^(\d{1,3}(,\d{3})+|\d+)(\.0+)?$"), F.regexp_replace(F.regexp_replace(raw, ",", ""), r"\.0+$", "").try_cast("decimal(38,0)"))
    urls = []
    for k in IMAGE_KEYS:
        one = F.when(get(k).rlike(r"(?i)^\s*https?://"), F.array(F.trim(get(k)))).otherwise(F.array().cast("array<string>"))
        many = F.coalesce(F.from_json(get(k), "array<string>"), F.array().cast("array<string>"))
        many = F.transform(many, lambda x: F.trim(F.coalesce(F.get_json_object(x, "$.url"), F.get_json_object(x, "$.src"), x)))
        urls += [one, F.filter(many, lambda x: F.lower(x).startswith("http://") | F.lower(x).startswith("https://"))]
    images = F.array_distinct(F.concat(*urls))
    return F.struct(F.when(rating.between(0, 5), rating.cast("double")).alias("rating"), F.when(count <= MOST_REVIEWS, count.cast("long")).alias("review_count"), F.nullif(F.trim(get("price_range")), F.lit("")).alias("price"), images.alias("images"))


def metadata_dates(payload: Column) -> Column:
    """struct(published, updated, first_seen) texts: the first value under a known name anywhere in the JSON, meta tags and JSON-LD text included."""
    names = {**dict.fromkeys(PUBLISHED, 0), **dict.fromkeys(UPDATED, 1), **dict.fromkeys(FIRST_SEEN, 2)}

    @F.pandas_udf("published string, updated string, first_seen string")
    def find(values: pd.Series) -> pd.DataFrame:
        plain = lambda k: re.sub(r"[^a-z0-9]", "", str(k).lower())

        def dates(value):
            found, stack = [None, None, None], [value]
            while stack:
                node = stack.pop()
                if isinstance(node, str) and node.lstrip()[:1] in ("{", "["):
                    try:
                        node = json.loads(node)
                    except ValueError:
                        continue
                if isinstance(node, list):
                    stack += reversed(node)
                elif isinstance(node, dict):
                    tag = node.get("property") or node.get("name") or node.get("itemprop")
                    pairs = ([(tag, node["content"])] if tag and "content" in node else []) + list(node.items())
                    for k, v in pairs:
                        at = names.get(plain(k))
                        if at is not None and isinstance(v, str) and found[at] is None:
                            found[at] = v
                    stack += reversed([v for v in node.values() if isinstance(v, (dict, list, str))])
            return found

        return pd.DataFrame([dates(v) for v in values], columns=["published", "updated", "first_seen"], dtype=object)

    return find(payload)


def _title(value: Column) -> Column:
    """Words with a capital first letter; all letters of words with a digit are capitals."""
    word = lambda w: F.when(w.rlike(r"\d"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.array_join(F.transform(F.filter(F.split(value, r"\s+"), lambda w: w != ""), word), " ")


def normal_address(address: Column) -> Column:
    """An address with single blanks, one after each comma and none around / and -, in title case; null: empty."""
    out = F.coalesce(address, F.lit(""))
    for pattern, by in ((r"\s+", " "), (r"\s*,\s*", ", "), (r"\s*/\s*", "/"), (r"\s*-\s*", "-")):
        out = F.regexp_replace(out, pattern, by)
    return _title(out)


def city_of(part: Column, cities: dict[str, str] = CITIES) -> Column:
    """The city that a part of an address names, or null: the first form (folded, forms of over three letters first) that it contains; shorter ones as words only."""
    bare = text.fold(F.regexp_replace(F.trim(F.regexp_replace(part, r"\s+", " ")), CITY_WORDS, ""))
    hit = lambda form: F.contains(bare, F.lit(form)) if len(form) > 3 else bare.rlike(rf"(?U)(?<!\w)\Q{form}\E(?!\w)")
    out = F.lit(None).cast("string")
    for form in reversed(sorted(cities, key=lambda f: len(f) <= 3)):  # the first one that hits is set last
        out = F.when(hit(form), F.lit(cities[form])).otherwise(out)
    return out


def address_parts(address: Column, cities: dict[str, str] = CITIES) -> Column:
    """struct(city, district, ward, lane, house, street), each null where there is none, of a free address.

    Parts are cut at commas, semicolons and line ends, and each is used once: the rightmost that names a city (of `cities`,
    folded form to name) is the city, then the rightmost with a district's word the district, and with a ward's word
    the ward, without these words. Of parts left over, while there are two or more, the last is the district if none was named, then
    the last the ward. The first part left gives house number, lane and street, in this order.
    """
    last = lambda found: F.coalesce(F.array_max(F.transform(found, lambda x, i: F.when(F.coalesce(x, F.lit("")) != "", i + 1).otherwise(0))), F.lit(0))
    without = lambda parts, at: F.filter(parts, lambda _, i: i + 1 != at)
    after = lambda words: (lambda p: F.when(p.rlike(words), _title(F.regexp_replace(p, words, ""))))

    def take(s: Column, role: str, find) -> Column:
        """s without the last part in which find() finds something, that being its role."""
        def chosen(found):
            at = last(found)
            return F.struct(without(s["parts"], at).alias("parts"), *[s[r].alias(r) for r in ROLES if r != role], F.when(at > 0, F.element_at(found, F.greatest(at, F.lit(1)))).alias(role))

        return text.let(F.transform(s["parts"], find), chosen)

    def leftover(s: Column, role: str) -> Column:
        mine = s[role].isNull() & (F.size(s["parts"]) > 1)
        return F.struct(F.when(mine, F.slice(s["parts"], 1, F.size(s["parts"]) - 1)).otherwise(s["parts"]).alias("parts"), *[s[r].alias(r) for r in ROLES if r != role], F.when(mine, _title(F.element_at(s["parts"], -1))).otherwise(s[role]).alias(role))

    def head(s: Column) -> Column:
        first = F.coalesce(F.try_element_at(s["parts"], F.lit(1)), F.lit(""))
        rest = lambda t, found: F.trim(F.substring(t, F.length(found) + 1, F.length(t)))
        house = F.regexp_extract(first, HOUSE, 0)
        behind = rest(first, house)
        lane = F.regexp_extract(behind, LANE, 0)
        some = lambda x: F.nullif(x, F.lit(""))
        return F.struct(s["city"].alias("city"), s["district"].alias("district"), s["ward"].alias("ward"), some(_title(lane)).alias("lane"), some(F.regexp_replace(F.regexp_extract(first, HOUSE, 2), r"\s+", "")).alias("house"), some(_title(rest(behind, lane))).alias("street"))

    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), r"[,\n;]"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    state = F.struct(parts.alias("parts"), *[F.lit(None).cast("string").alias(r) for r in ROLES])
    for step in (lambda s: take(s, "city", lambda p: city_of(p, cities)), lambda s: take(s, "district", after(DISTRICT_WORDS)), lambda s: take(s, "ward", after(WARD_WORDS)), lambda s: leftover(s, "district"), lambda s: leftover(s, "ward"), head):
        state = text.let(state, step)
    return state


def looks_like_address(address: Column, cities: dict[str, str] = CITIES) -> Column:
    """Two parts of an address or more, or a word of a unit or lane."""
    found = text.let(address_parts(address, cities), lambda a: sum((a[c].isNotNull().cast("int") for c in (*ROLES, "lane", "house", "street")), F.lit(0)))
    return (found >= 2) | F.coalesce(address, F.lit("")).rlike(ADDRESS_WORDS)


def sub_queries(query: Column) -> Column:
    """array of text: a query of several steps cut at its conjunctions; a part that begins with a pronoun gets the first part's last capitalised run."""
    parts = F.filter(F.transform(F.split(query, r"(?i)\s+(?:and then|and|then|sau đó|rồi|và)\s+|[;?]\s*"), lambda x: F.trim(x)), lambda p: p != "")
    entity = lambda ps: F.coalesce(F.try_element_at(F.regexp_extract_all(F.coalesce(F.try_element_at(ps, F.lit(1)), F.lit("")), F.lit(r"\p{Lu}[\p{L}\p{N}]*(?: \p{Lu}[\p{L}\p{N}]*)*"), F.lit(0)), F.lit(-1)), F.lit(""))
    carry = lambda ps: text.let(entity(ps), lambda e: F.transform(ps, lambda p, i: F.when((i > 0) & (e != "") & p.rlike(r"(?i)^(it|its|they|their|nó|họ)\b"), F.concat(e, F.lit(" "), F.trim(F.regexp_replace(p, r"(?i)^(it|its|they|their|nó|họ)\b", "")))).otherwise(p)))
    return text.let(parts, carry)
