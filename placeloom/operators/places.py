"""Place observations to canonical places: validation, change classes, blocking, scores, clusters, votes, trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text, web
from ..plans.graph import components, written
from .search import small, smallest

MERGE_THRESHOLD = 0.62
CELL_DEGREES = 0.005
#: Side of the cells in which located records meet: above 200 m, beyond which no pair is accepted, up to 60 degrees north.
NEAR_DEGREES = 0.004
#: A word or domain of more records is common: records that share nothing rarer meet as classes.
COMMON = 30
# Authority of a field where a provider's policy names none; box of valid coordinates.
FIELD_AUTHORITY = {"name": 0.5, "address": 0.5, "phone": 0.5, "website": 0.5, "category": 0.5, "hours": 0.4, "status": 0.4, "location": 0.5}
BOX = (6.0, 24.0, 100.0, 119.5)
# How a reviewer may have verified an observation, and what a review may say.
VERIFICATION_METHODS = ["official_website", "official_registry", "merchant_confirmation", "phone_confirmation", "physical_check"]
REVIEW_STATUSES = ["verified", "rejected"]


def reject_reasons(name: Column, external_id: Column, observed_at: Column, lat: Column, lon: Column, phone: Column, website: Column, parse_error: Column | None = None, review_status: Column | None = None, reviewed_at: Column | None = None, method: Column | None = None, source_url: Column | None = None) -> Column:
    """The reasons for which an observation is not staged; none if it is. A row that could not be parsed has that reason only."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    none = F.lit(None).cast("string")
    parse_error, review_status, reviewed_at, method, source_url = (none if c is None else c for c in (parse_error, review_status, reviewed_at, method, source_url))
    some = lat.isNotNull() | lon.isNotNull()
    both = lat.isNotNull() & lon.isNotNull()
    bad_lat, bad_lon = ~lat.between(-90, 90), ~lon.between(-180, 180)
    outside = ~(lat.between(BOX[0], BOX[1]) & lon.between(BOX[2], BOX[3]))
    evidence = ~blank(source_url) & reviewed_at.isNotNull() & ~blank(method)
    rules = [
        (blank(name), "missing_name"),
        (blank(name) & blank(external_id), "missing_identity"),
        (observed_at.isNull(), "missing_observed_at"),
        (some & ~both, "partial_coordinates"),
        (both & bad_lat, "invalid_latitude"),
        (both & ~bad_lat & bad_lon, "invalid_longitude"),
        (both & ~bad_lat & ~bad_lon & outside, "coords_outside_vietnam"),
        (~blank(phone) & text.normalize_phone(phone).isNull(), "implausible_phone"),
        (~blank(website) & (web.host(website) == ""), "malformed_website"),
        (~blank(method) & ~method.isin(VERIFICATION_METHODS), "unknown_verification_method"),
        (review_status.isNotNull() & ~review_status.isin(REVIEW_STATUSES), "invalid_review_status"),
        ((review_status == "verified") & ~evidence, "incomplete_review_evidence"),
    ]
    found = F.filter(F.array(*[F.when(rule, reason) for rule, reason in rules]), lambda x: x.isNotNull())
    return F.when(parse_error.isNotNull(), F.array(F.lit("parse_error"))).otherwise(found)


def identity_hash(*fields: Column) -> Column:
    """SHA-256 of normal fields, null told apart from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields]), 256)


def classify_changes(batch: DataFrame, state: DataFrame, key: list[str], hash_col: str, seq: str) -> DataFrame:
    """batch with change: new, changed or unchanged against the row before it with its key (in the batch, else in state)."""
    before = F.lag(hash_col).over(Window.partitionBy(*key).orderBy(seq))
    prior = state.select(*key, F.col(hash_col).alias("__prior"))
    out = batch.withColumn("__before", before).join(prior, key, "left").withColumn("__before", F.coalesce("__before", "__prior"))
    change = F.when(F.col("__before").isNull(), "new").when(F.col("__before") == F.col(hash_col), "unchanged").otherwise("changed")
    return out.withColumn("change", change).drop("__before", "__prior")


def upsert(state: DataFrame, batch: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The new state: of each key the row of highest seq."""
    both = state.unionByName(batch, allowMissingColumns=True)
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(seq)))
    return both.withColumn("__n", newest).filter("__n = 1").drop("__n")


def block_keys(records: DataFrame) -> DataFrame:
    """record_id, block: the keys under which records may be one place. Records have norm_name, phone, domain, admin_unit, lat, lon.

    Keys: phone, domain, unit with a word of 3 letters or more, the cells around. Nothing is cut off for large blocks;
    candidate_pairs finds the pairs of blocks that can be accepted without making all of them.
    """
    words = F.filter(F.split("norm_name", " "), lambda w: F.length(w) >= 3)
    cells = F.transform(geo.around(F.col("lat"), F.col("lon"), CELL_DEGREES), lambda c: F.concat(F.lit("cell:"), c.cast("string")))
    keys = F.concat(
        F.when(F.col("phone").isNotNull(), F.array(F.concat(F.lit("phone:"), "phone"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("domain").isNotNull(), F.array(F.concat(F.lit("domain:"), "domain"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("admin_unit").isNotNull(), F.transform(words, lambda w: F.concat(F.lit("word:"), F.col("admin_unit").cast("string"), F.lit(":"), w))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), cells).otherwise(F.array().cast("array<string>")),
    )
    return records.select("record_id", F.explode(F.array_distinct(keys)).alias("block"))


def _alike(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b: accepted pairs that connect all records of classes whose least alike members are accepted.

    rows: record_id, s (what all records of a class have: key, here, norm_name if all its words are common, words (the common ones), k, called,
    domain, category, lat, lon), look and met (the keys by which a class looks for others, and is found). Two classes are
    scored once: what they do not know of their members (other words, phones, rare domains) counts as different, so if they
    are accepted, all pairs of their records are. Each record is paired with the smallest one of a class that its own is accepted with.
    """
    sig = F.md5(F.to_json("s")).alias("sig")
    classes = written(rows.groupBy(sig).agg(F.min("record_id").alias("id"), *[F.first(c).alias(c) for c in ("s", "look", "met")]).withColumn("class", F.monotonically_increasing_id()), "record-classes")
    # by number, as a record can be the smallest of several classes
    met = classes.select(F.col("class").alias("x"), F.explode("look").alias("key")).join(classes.select(F.col("class").alias("y"), F.explode("met").alias("key")), "key").select("x", "y").distinct()

    def least(side: str):
        get = lambda c: F.col(f"s.{c}")
        # a word with a space is no word of a name, and a domain without a sign is none of those that are known
        own = F.concat(get("words"), F.transform(F.sequence(F.lit(0), get("k") - F.size(get("words"))), lambda i: F.concat(F.lit(f"{side} "), i.cast("string"))))
        return F.struct(get("key").alias("key"), get("here").alias("here"), get("norm_name").alias("norm_name"), F.slice(own, F.lit(1), get("k")).alias("words"), F.when(get("called"), side).alias("phone"), F.when(get("domain") == "", side).otherwise(get("domain")).alias("domain"), *[get(c).alias(c) for c in ("category", "lat", "lon")])

    side = lambda at, own: classes.select(F.col("class").alias(at), F.col("id").alias(own), least(own).alias(f"r{own}"))
    both = met.join(side("x", "a"), "x").join(side("y", "b"), "y")
    score, rule = pair_score("ra", "rb", "words")
    both = written(both.filter("ra.key IS NULL OR NOT (ra.here AND rb.here)").select("x", "y", "a", "b", score.alias("score"), rule.alias("rule")), "class-pairs")
    like = both.filter((F.col("score") >= threshold) | F.col("rule").isNotNull())
    other = like.select(F.col("x").alias("class"), F.col("b").alias("a")).union(like.select("y", "a")).groupBy("class").agg(F.min("a").alias("a"))
    to = classes.join(other, "class").select("sig", "a")
    return rows.select(sig, F.col("record_id").alias("b")).join(small(to), "sig").select("a", "b").union(like.select("a", "b"))


def candidate_pairs(records: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """a < b: pairs of records that share a block and connect just those records which all accepted pairs of blocks connect.

    No pair over 200 m apart is accepted, so records with coordinates meet within cells only. Records of one phone of
    which one has no coordinates are always accepted, as are those at one place, so these meet their smallest record
    only. Pairs of different phones score 0.445 at most beside their names (0.295 where coordinates are missing), so these must share
    a part of the smaller one's words; they meet by one of its rarest words (as many as must hold a shared one): with coordinates in a cell,
    else in a unit or domain. By a word or domain of COMMON records at most they meet one by one. A pair that shares none of
    these differs in nothing but the common words, domain, position, category and in what is missing, so such records meet as
    classes of one kind (_alike). So neither a hot phone nor a hot word makes all pairs of its block or cell, and none
    that can be accepted is left out.
    """
    if threshold <= 0.5:
        raise ValueError("at a threshold of 0.5 or less records over 200 m apart could be accepted")
    first = lambda most: F.slice("words", F.lit(1), F.greatest(F.lit(0), F.col("k") - F.ceil(((threshold - most) / 0.45 - 1e-9) * F.col("k")) + 1).cast("int"))
    here = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    words = F.array_distinct(F.filter(F.split(F.coalesce("norm_name", F.lit("")), " "), lambda w: w != ""))
    r = records.select("record_id", "norm_name", "phone", "domain", "category", "admin_unit", "lat", "lon", here.alias("here"), words.alias("words"))
    home, around = geo.cell(F.col("lat"), F.col("lon"), NEAR_DEGREES), geo.around(F.col("lat"), F.col("lon"), NEAR_DEGREES)

    # one phone
    called = r.filter("phone IS NOT NULL")
    hub = called.filter("NOT here").groupBy("phone").agg(F.min("record_id").alias("a"))
    star = called.select("phone", F.col("record_id").alias("b")).join(hub, "phone").select("a", "b")
    spots = called.filter("here").groupBy("phone", "lat", "lon").agg(F.min("record_id").alias("a"))
    same_spot = called.filter("here").select("phone", "lat", "lon", F.col("record_id").alias("b")).join(spots, ["phone", "lat", "lon"]).select("a", "b")
    near_spots = spots.select("phone", "a", home.alias("cell")).join(spots.select("phone", F.col("a").alias("b"), F.explode(around).alias("cell")), ["phone", "cell"]).select("a", "b")

    # names that share a word: a record's words, those of fewest records first
    often = lambda rows, c: small(written(rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COMMON), "common-values"))
    each = r.select("record_id", F.explode("words").alias("word"))
    each = each.join(often(each, "word"), "word", "left").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("w"))
    named = r.drop("words").join(each, "record_id").join(often(r.filter("domain IS NOT NULL"), "domain"), "domain", "left")
    named = named.withColumn("words", F.col("w.word")).withColumn("k", F.size("w")).withColumn("common", F.transform(F.filter("w", lambda x: x["n"] > 0), lambda x: x["word"])).withColumn("many", F.col("n").isNotNull())
    named = written(named.drop("w", "n"), "named-records")

    # one by one: a rare word, or a rare domain
    left = named.select(F.explode(F.array_except(first(0.445), "common")).alias("word"), F.col("record_id").alias("a"), F.col("here").alias("ha"), home.alias("cell"), F.col("domain").alias("da"), F.col("admin_unit").alias("ua"), first(0.295).alias("close"))
    right = named.select(F.explode(F.array_except("words", "common")).alias("word"), F.col("record_id").alias("b"), F.col("here").alias("hb"), around.alias("cells"), F.col("domain").alias("db"), F.col("admin_unit").alias("ub"))
    near, one = F.expr("ha AND hb AND array_contains(cells, cell)"), F.expr("NOT (ha AND hb) AND array_contains(close, word) AND (coalesce(da = db, false) OR coalesce(ua = ub, false))")
    by_word = left.join(right, "word").filter(near | one).select("a", "b")
    hosts = named.filter("here AND domain IS NOT NULL AND NOT many")
    by_domain = hosts.select("domain", F.col("record_id").alias("a"), home.alias("cell")).join(hosts.select("domain", F.col("record_id").alias("b"), around.alias("cells")), "domain").filter("array_contains(cells, cell)").select("a", "b")

    # as classes: common words only
    plain = named.filter(F.size("common") > 0)
    none, full = F.lit(None), F.when(F.size("common") == F.col("k"), F.col("norm_name")).alias("norm_name")
    known = lambda domain: F.when(F.col("domain").isNull(), F.lit(None)).when(domain, F.concat(F.lit("="), "domain")).otherwise("").alias("domain")
    kind = lambda key, domain, lat, lon: F.struct(key.cast("string").alias("key"), "here", full, F.col("common").alias("words"), "k", F.col("phone").isNotNull().alias("called"), known(domain), "category", lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    under = lambda w, keys: F.flatten(F.transform(keys, lambda c: F.transform(w, lambda x: F.concat(c.cast("string"), F.lit(" "), x))))
    located = plain.filter("here").select("record_id", kind(none, F.col("many"), F.col("lat"), F.col("lon")).alias("s"), under(F.array_intersect(first(0.445), "common"), F.array(home)).alias("look"), under(F.col("common"), around).alias("met"))
    keys = F.filter(F.array(F.concat(F.lit("d:"), "domain"), F.concat(F.lit("u:"), F.col("admin_unit").cast("string"))), lambda x: x.isNotNull())
    keyed = plain.withColumn("key", F.explode(keys))
    placeless = keyed.select("record_id", kind(F.col("key"), F.col("many") | F.col("key").startswith("d:"), none, none).alias("s"), under(F.array_intersect(first(0.295), "common"), F.array("key")).alias("look"), under(F.col("common"), F.array("key")).alias("met"))

    both = star.union(same_spot).union(near_spots).union(by_word).union(by_domain).union(_alike(located, threshold)).union(_alike(placeless, threshold)).filter("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def pair_score(a: str, b: str, words: str | None = None) -> tuple[Column, Column]:
    """(score, rule) of two records, whose columns are structs a and b. Rules force a merge: name_geo, phone. words: the field of a name's different words; by default these are made of the name."""
    get = lambda s, c: F.col(f"{s}.{c}")
    dist = geo.haversine_m(get(a, "lat"), get(a, "lon"), get(b, "lat"), get(b, "lon"))
    near = F.when(dist.isNull(), 0.4).when(dist <= 30, 1.0).when(dist >= 200, -1.0).otherwise(1 - (dist - 30) / 170)
    na, nb = get(a, "norm_name"), get(b, "norm_name")
    wa, wb = (get(a, words), get(b, words)) if words else (F.array_distinct(F.split(na, " ")), F.array_distinct(F.split(nb, " ")))
    name = F.when((na == "") | (nb == ""), 0.3).when(na == nb, 1.0).otherwise(F.greatest(geo.jaccard(wa, wb), 0.9 * geo.containment(wa, wb)))
    same = lambda c: F.when(get(a, c).isNull() | get(b, c).isNull(), 0.3).when(get(a, c) == get(b, c), 1.0).otherwise(0.0)
    kind = F.when(get(a, "category").isNull() | get(b, "category").isNull(), 0.4).when(get(a, "category") == get(b, "category"), 1.0).otherwise(0.1)
    score = F.least(F.lit(1.0), 0.45 * name + 0.25 * near + 0.15 * same("phone") + 0.10 * same("domain") + 0.05 * kind)
    rule = F.when((na != "") & (na == nb) & (dist <= 80), "name_geo").when((get(a, "phone") == get(b, "phone")) & (dist.isNull() | (dist <= 200)), "phone")
    return score, rule


def scored_pairs(records: DataFrame, pairs: DataFrame) -> DataFrame:
    cols = F.struct("norm_name", "phone", "domain", "category", "lat", "lon")
    r = records.select("record_id", cols.alias("r"))
    both = pairs.join(r.toDF("a", "ra"), "a").join(r.toDF("b", "rb"), "b")
    score, rule = pair_score("ra", "rb")
    return both.select("a", "b", score.alias("score"), rule.alias("rule"))


def accepted_links(records: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """a, b, score, rule of the candidate pairs that are one place. threshold is above 0.5, the most that a pair over 200 m apart can score."""
    return written(scored_pairs(records, candidate_pairs(records, threshold)), "scored-pairs").filter((F.col("score") >= threshold) | F.col("rule").isNotNull())


def resolve(records: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """record_id, place_id: components of the accepted pairs; a place is named after its smallest record.

    Records equal in all that is compared meet as one, if such a pair is accepted.
    """
    compared = ["norm_name", "phone", "domain", "category", "admin_unit", "lat", "lon"]
    as_one = records.select(*compared, "record_id").groupBy(*compared).agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n"))
    own, rule = pair_score("s", "s")
    as_one = as_one.withColumn("s", F.struct(*compared)).withColumn("meet", (F.col("n") > 1) & ((own >= threshold) | rule.isNotNull()))
    # written with its verdict: planning took 25 s where the long rule was a filter, of which constraints are inferred
    as_one = written(as_one.drop("s", "n"), "equal-records").filter("meet").drop("meet")
    equal = F.lit(True)
    for c in compared:
        equal &= F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    first = written(records.alias("x").join(as_one.alias("y"), equal, "left").select("x.*", F.coalesce("y.first", "x.record_id").alias("__first")), "first-records")
    links = accepted_links(first.filter("record_id = __first").drop("__first"), threshold)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return first.join(roots, F.col("__first") == F.col("node"), "left").select("record_id", F.coalesce("root", "__first").alias("place_id"))


def resolve_places(records: DataFrame, values: DataFrame, authority: DataFrame, contributions: DataFrame, threshold: float = MERGE_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, places, provenance): the whole way from records to canonical places.

    links: record_id, place_id (resolve). provenance: the weighted votes on the records' values (values: record_id,
    provider, field, value, signature, days; vote_fields). places: a row for each place with its fields map, confidence
    and source_count, level and keys (verification of contributions, which have record_id), business_id (groups of
    one name, business_groups) and suspicious (merge_audit's reason).
    """
    links = written(resolve(records, threshold), "place-links")
    provenance = written(vote_fields(values.join(links, "record_id"), authority), "provenance")
    fields = provenance.filter("chosen").groupBy("place_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    confidence = place_confidence(provenance).drop("fields")
    level = verification(contributions.join(links, "record_id"))
    placed = records.join(links, "record_id")
    audit = merge_audit(placed.select("place_id", "lat", "lon")).select("place_id", F.col("reason").alias("suspicious"))
    business = business_groups(placed).groupBy("place_id").agg(F.min("business_id").alias("business_id"))
    out = links.select("place_id").distinct()
    for part in (fields, confidence, level, business, audit):
        out = out.join(part, "place_id", "left")
    return links, out, provenance


def business_groups(records: DataFrame) -> DataFrame:
    """records with business_id: records of one normal name go together if they share category, phone, domain or unit with one of the group.

    Records meet the smallest one under each name and value, so a hot name makes no pairs of all its records. A
    record without a name is its own business.
    """
    links = None
    for c in ("category", "phone", "domain", "admin_unit"):
        have = records.filter(F.col(c).isNotNull() & (F.col("norm_name") != ""))
        least = have.groupBy("norm_name", c).agg(F.min("record_id").alias("u"))
        some = have.select("norm_name", c, F.col("record_id").alias("v")).join(least, ["norm_name", c]).select("u", "v")
        links = some if links is None else links.union(some)
    roots = components(links)
    return records.join(roots, F.col("record_id") == F.col("node"), "left").withColumn("business_id", F.coalesce("root", "record_id")).drop("node", "root")


def alias_lineage(places: DataFrame, links: DataFrame, records: DataFrame) -> DataFrame:
    """place_id, aliases: the different raw names of a place's records, without the place's own name, told apart without case.

    places: place_id, name; links: place_id, record_id; records: record_id, raw_name. Of spellings that differ in case
    only the first by code point stays. A place without other names has no aliases.
    """
    key = F.lower(F.trim("raw_name"))
    named = links.join(records.select("record_id", "raw_name"), "record_id").filter(key != "").groupBy("place_id", key.alias("key")).agg(F.min(F.trim("raw_name")).alias("alias"))
    own = places.select("place_id", F.lower(F.trim("name")).alias("key"))
    others = named.join(own, ["place_id", "key"], "left_anti").groupBy("place_id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return places.select("place_id").join(others, "place_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def serving_documents(provenance: DataFrame, members: DataFrame, fields: list[str]) -> DataFrame:
    """place_id, the chosen value of each field, confidence, lat, lon (means of the members that have them)."""
    pick = lambda f: F.max(F.when((F.col("field") == f) & F.col("chosen"), F.col("value"))).alias(f)
    v = provenance.groupBy("place_id").agg(*map(pick, fields), F.avg(F.when(F.col("chosen"), F.col("weight"))).alias("confidence"))
    return v.join(members.groupBy("place_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")), "place_id")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side (both, only_left, only_right) of the keys of two tables; only_right in an index against its store is what to delete."""
    l, r = left.select(key).distinct().withColumn("__l", F.lit(1)), right.select(key).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__l").isNull(), "only_right").when(F.col("__r").isNull(), "only_left").otherwise("both")
    return l.join(r, key, "full").select(key, side.alias("side"))


def unknown_categories(rows: DataFrame, category: str, known: DataFrame, sample: str) -> DataFrame:
    """category, n, sample: labels without a row in known(category), how often they occur, and the smallest row that has one."""
    some = rows.filter(F.col(category).isNotNull()).join(small(known.select(category)), category, "left_anti")
    return some.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.min(sample).alias("sample"))


def vote_fields(values: DataFrame, authority: DataFrame) -> DataFrame:
    """values(place_id, record_id, provider, field, value, signature, days) with weight and chosen.

    Weight: 0.6 authority + 0.3 recency + 0.1 share of the place's values of the field that agree, to 4 places; the
    highest is chosen, of equal ones the smallest record's. authority: provider, field, authority.
    """
    all_, same = Window.partitionBy("place_id", "field"), Window.partitionBy("place_id", "field", "signature")
    default = F.create_map(*[F.lit(x) for kv in FIELD_AUTHORITY.items() for x in kv])
    v = values.join(authority, ["provider", "field"], "left").withColumn("authority", F.coalesce("authority", F.try_element_at(default, F.col("field")), F.lit(0.5)))
    share = F.count(F.lit(1)).over(same) / F.count(F.lit(1)).over(all_)
    v = v.withColumn("weight", F.round(0.6 * F.col("authority") + 0.3 * geo.field_recency(F.col("field"), F.col("days")) + 0.1 * share, 4))
    return v.withColumn("chosen", F.row_number().over(all_.orderBy(F.desc("weight"), "record_id")) == 1)


def place_confidence(votes: DataFrame) -> DataFrame:
    """place_id, confidence (mean weight of the chosen values), source_count, fields."""
    return votes.groupBy("place_id").agg(F.avg(F.when(F.col("chosen"), F.col("weight"))).alias("confidence"), F.count_distinct("provider").alias("source_count"), F.count(F.when(F.col("chosen"), 1)).alias("fields"))


def verification(contributions: DataFrame) -> DataFrame:
    """place_id, level, keys: authoritative > verified > corroborated (two independent origins) > observed.

    contributions: place_id, provider, kind, source_url, review_status, reviewed_at, verification_method.
    """
    origin = F.when(F.col("kind") == "authority", F.concat(F.lit("authority:"), "provider")).when(F.coalesce(web.host(F.col("source_url")), F.lit("")) != "", F.concat(F.lit("url:"), web.host(F.col("source_url")))).otherwise(F.concat(F.lit("provider:"), "provider"))
    reviewed = (F.col("review_status") == "verified") & F.col("reviewed_at").isNotNull() & F.col("verification_method").isNotNull() & F.col("source_url").isNotNull()
    g = contributions.withColumn("origin", origin).groupBy("place_id").agg(F.max((F.col("kind") == "authority").cast("int")).alias("first"), F.max(F.coalesce(reviewed, F.lit(False)).cast("int")).alias("reviewed"), F.count_distinct("origin").alias("keys"))
    level = F.when(F.col("first") == 1, "authoritative").when(F.col("reviewed") == 1, "verified").when(F.col("keys") >= 2, "corroborated").otherwise("observed")
    return g.select("place_id", level.alias("level"), "keys")


def merge_audit(members: DataFrame, span_m: float = 200.0, most: int = 8) -> DataFrame:
    """Suspicious places: of members(place_id, lat, lon) two lie further apart than span_m, or there are more than most.

    span_m of the result is the largest distance of two members. Pairs are of different positions only, and only where
    the diagonal of the members' box is above span_m.
    """
    g = members.groupBy("place_id").agg(F.count(F.lit(1)).alias("records"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    wide = g.filter(geo.haversine_m(F.col("s"), F.col("w"), F.col("n"), F.col("e")) > span_m).select("place_id")
    spots = members.filter("lat IS NOT NULL AND lon IS NOT NULL").join(wide, "place_id").select("place_id", "lat", "lon").distinct()
    pairs = spots.join(spots.toDF("place_id", "lat2", "lon2"), "place_id").filter("(lat, lon) < (lat2, lon2)")
    span = pairs.groupBy("place_id").agg(F.max(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).alias("span"))
    out = g.join(span, "place_id", "left")
    reason = F.concat_ws(",", F.when(F.col("span") > span_m, "span"), F.when(F.col("records") > most, "size"))
    return out.select("place_id", "records", F.round("span", 3).alias("span_m"), reason.alias("reason")).filter("reason <> ''")


def category_overlay(rows: DataFrame, overlay: DataFrame, builtin: DataFrame) -> DataFrame:
    """rows(provider, raw_category) with bucket: the provider's own mapping, else the one for '*', else the built-in one."""
    own = overlay.select("provider", F.col("raw").alias("raw_category"), F.col("bucket").alias("b1"))
    star = overlay.filter("provider = '*'").select(F.col("raw").alias("raw_category"), F.col("bucket").alias("b2"))
    base = builtin.select(F.col("raw").alias("raw_category"), F.col("bucket").alias("b3"))
    out = rows.join(own, ["provider", "raw_category"], "left").join(star, "raw_category", "left").join(base, "raw_category", "left")
    return out.withColumn("bucket", F.coalesce("b1", "b2", "b3")).drop("b1", "b2", "b3")


def within_radius(queries: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """query_id, place_id, dist_m for places within radius_m of queries(query_id, lat, lon): cells of that size, then the distance."""
    size = radius_m / 111_000 / 0.9
    wide = size * 2  # at the latitudes of the box a degree of longitude is over half one of latitude
    q = queries.select("query_id", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), F.explode(geo.around(F.col("lat"), F.col("lon"), wide)).alias("cell"))
    p = places.select("place_id", "lat", "lon", geo.cell(F.col("lat"), F.col("lon"), wide).alias("cell"))
    dist = geo.haversine_m(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon"))
    return q.join(p, "cell").withColumn("dist_m", dist).filter(F.col("dist_m") <= radius_m).select("query_id", "place_id", "dist_m")


def nearest(within: DataFrame, k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("dist_m", "place_id"))
    return within.withColumn("rank", n).filter(F.col("rank") <= k)


def nearest_within(queries: DataFrame, places: DataFrame, radius_m: float, k: int, digits: int = 3) -> DataFrame:
    """query_id, place_id, dist_m, rank: the k nearest places within radius_m, distances to `digits` digits, ties to the smallest id.

    Queries and places meet by their different points; of the places of one point only the k smallest ids can be among the
    nearest, and they are taken by parts first, so a crowded point is not one task's. Null points are none.
    """
    spot = lambda df: df.filter("lat IS NOT NULL AND lon IS NOT NULL")
    part = smallest(spot(places).select("place_id", "lat", "lon"), "place_id", k, "lat", "lon")
    some = written(part.groupBy("lat", "lon").agg(F.sort_array(F.collect_list("place_id")).alias("ids")), "place-spots")
    asked = written(spot(queries).groupBy("lat", "lon").agg(F.min("query_id").alias("query_id")), "query-spots")
    met = within_radius(asked, some.select(F.struct("lat", "lon", "ids").alias("place_id"), "lat", "lon"), radius_m)
    near = nearest(met.select("query_id", F.explode("place_id.ids").alias("place_id"), F.round("dist_m", digits).alias("dist_m")), k)
    back = spot(queries).select("query_id", "lat", "lon").join(asked.withColumnRenamed("query_id", "__q"), ["lat", "lon"]).select("query_id", "__q")
    return back.join(near.withColumnRenamed("query_id", "__q"), "__q").select("query_id", "place_id", "dist_m", "rank")


#: Statuses of places that a search shows where it names none.
SHOWN_STATUSES = ["open", "unknown", "temporarily_closed"]


def matching_places(places: DataFrame, statuses: list[str] | None = None, category: str | None = None, min_rating: float | None = None, price_level: str | None = None, admin_unit: int | None = None, box: tuple[float, float, float, float] | None = None, tokens: list[str] | None = None, near: tuple[float, float, float] | None = None) -> DataFrame:
    """Places that meet all given conditions: status (permanently closed ones are hidden by default), category, rating,
    price level, unit, box (south, west, north, east), folded words within the normal name in any order, and
    near (lat, lon, metres), which adds distance_m. Conditions on columns reach the scan.

    places: place_id, norm_name, status, category, rating, price_level, admin_unit, lat, lon. A null where a condition
    asks for a value does not match; a null status is unknown.
    """
    out = places.filter(F.coalesce("status", F.lit("unknown")).isin(statuses or SHOWN_STATUSES))
    for column, value in (("category", category), ("price_level", price_level), ("admin_unit", admin_unit)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if min_rating is not None:
        out = out.filter(F.col("rating") >= min_rating)
    if box:
        out = out.filter(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    for word in tokens or []:
        out = out.filter(F.col("norm_name").contains(word))
    if near:
        lat, lon, metres = near
        reach = metres / 111_000
        out = out.filter(F.col("lat").between(lat - reach, lat + reach))
        out = out.withColumn("distance_m", geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))).filter(F.col("distance_m") <= metres)
    return out


def current_units(relations: DataFrame, units: DataFrame) -> DataFrame:
    """unit, current: the units in which a historical one lives on, along relations(from_unit, to_unit); a current unit is its own.

    Chains are followed to their ends, whatever their length; places already seen are not followed again, so a circle
    ends too. A unit from which only circles lead has current null.
    """
    edges = written(relations.select(F.col("from_unit").alias("at"), F.col("to_unit").alias("next")).distinct(), "relations")
    seen = ahead = written(units.select("unit", F.col("unit").alias("at")), "walk")
    while True:
        step = ahead.join(edges, "at").select("unit", F.col("next").alias("at")).distinct().join(seen, ["unit", "at"], "left_anti")
        ahead = written(step, "walk")
        if not ahead.limit(1).count():
            break
        seen = seen.union(ahead)
    ends = seen.join(edges, "at", "left_anti").select("unit", F.col("at").alias("current"))
    return units.select("unit").join(ends, "unit", "left")
