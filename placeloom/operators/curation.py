"""Evidence packs and candidate lists put in order: independent sources, near copies, same entities, hybrid and cached search, filtered answers, crawl plans.

A pack or query holds tens of rows, so rows meet within it by shared keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text, web
from ..plans.graph import components, leaders, written
from .ranking import rrf, with_rank
from .search import SCORES, fuzzy, in_blocks, nearest, small, small_or_sorted, smallest, sparse_search
from .selection import ema

CONTAINED, SHINGLE = 0.25, 3
#: Words of more names than this are common: names that only share such words with a query are scored by their form.
COMMON_NAMES = 1000
NAME_DOMAIN, NAME_NEAR, NAME_ADDRESS, ADDRESS, NEAR_M = 0.60, 0.88, 0.90, 0.85, 100.0


def _grouped(rows: DataFrame, links: DataFrame, key: str, name: str) -> DataFrame:
    """rows with `name`: the smallest key that links (u, v) reach from the row's own."""
    roots = components(links)
    return rows.join(roots, F.col(key) == F.col("node"), "left").withColumn(name, F.coalesce("root", key)).drop("node", "root")


def independent_sources(sources: DataFrame, least: float = CONTAINED, n: int = SHINGLE) -> DataFrame:
    """sources(pack, source_id, words) with cluster_id: a pack's sources in order of id; each joins the cluster whose first source holds the largest share of the smaller one's n-word shingles, if that is `least` or more, or founds one.

    So sources that are alike to a member only, not to its cluster's first source, stay apart. Equal texts are one
    cluster. All shingles count; a shorter text is one shingle. Of equal shares the earliest cluster is joined.
    """
    grams = F.when(F.size("words") >= n, text.ngrams(F.col("words"), n)).otherwise(F.array(F.array_join("words", " ")))
    s = sources.select("pack", "source_id", F.transform(F.array_distinct(grams), lambda g: F.xxhash64(g)).alias("g"), F.xxhash64(F.array_join("words", " ")).alias("same")).withColumn("m", F.size("g"))
    s = written(s.withColumn("first", F.min("source_id").over(Window.partitionBy("pack", "same"))), "source-shingles")
    e = s.filter("source_id = first").select("pack", "source_id", "m", F.explode("g").alias("g"))  # equal texts meet as one
    o = e.toDF("pack", "other", "m2", "g")
    shared = e.join(o, ["pack", "g"]).filter("source_id < other").groupBy("pack", "source_id", "other", "m", "m2").agg(F.count(F.lit(1)).alias("k"))
    share = F.col("k") / F.least("m", "m2")
    in_pack = lambda c: F.struct("pack", F.col(c).alias("id"))
    links = shared.filter(F.col("k") >= least * F.least("m", "m2")).select(in_pack("source_id").alias("u"), in_pack("other").alias("v"), share.alias("score"))
    led = leaders(links).select("node.pack", F.col("node.id").alias("first"), F.col("leader.id").alias("cluster_id"))
    return s.select("pack", "source_id", "first").join(led, ["pack", "first"], "left").select("pack", "source_id", F.coalesce("cluster_id", "first").alias("cluster_id"))


def simhash(words: Column) -> Column:
    """64 bits: one where over half of the words' xxHash64 have one; none of no words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # three bits are counted in each of 22 longs, in 20 of its bits; words number below 2^20
    places = [[b for b in range(3 * k, min(64, 3 * k + 3))] for k in range(22)]

    def count(hs, bits):
        added = lambda h: sum((F.shiftleft(F.getbit(h, F.lit(b)).cast("long"), 20 * j) for j, b in enumerate(bits)), F.lit(0).cast("long"))
        return F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: a + added(h))

    def packed(hs):
        out = F.lit(0).cast("long")
        for bits in places:
            n = count(hs, bits)
            for j, b in enumerate(bits):
                most = 2 * F.shiftright(n, 20 * j).bitwiseAND(F.lit((1 << 20) - 1)) > F.size(hs)
                out = out.bitwiseOR(F.when(most, F.lit(-(1 << 63) if b == 63 else 1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return text.let(hashes, packed)


def drop_near_copies(items: DataFrame, pack: str, key: str, rank: str, words: str, most: int = 3) -> DataFrame:
    """Items of a pack without those within `most` bits of a better ranked one that stays; copy_of tells the best such one (null: the item stays).

    Two fingerprints that differ in 3 bits agree on one of four 16-bit bands. Items are decided by rounds: one without
    a better near item stays; one near an item that stays goes; what went no longer counts for the rest.
    """
    h = items.select(pack, key, rank, simhash(F.col(words)).alias("h"))
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("h", 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("band")) for i in range(4)])
    e = h.select(pack, key, rank, "h", F.explode(bands).alias("b"))
    o = e.select(pack, F.col(key).alias("__o"), F.col(rank).alias("__r"), F.col("h").alias("__h"), "b")
    near = e.join(o, [pack, "b"]).filter((F.col("__r") < F.col(rank)) & (F.bit_count(F.col("h").bitwiseXOR(F.col("__h"))) <= most))
    open_ = all_ = written(near.select(pack, key, "__o", "__r").distinct(), "near-items")
    gone = None
    while open_.limit(1).count():
        # better items that are not themselves open (not in the left column) stay
        waiting = open_.select(pack, F.col(key).alias("__o")).distinct()
        now = written(open_.join(waiting, [pack, "__o"], "left_anti").select(pack, key).distinct(), "near-gone")
        gone = now if gone is None else gone.union(now)
        open_ = open_.join(now, [pack, key], "left_anti")
        open_ = written(open_.join(now.withColumnRenamed(key, "__o"), [pack, "__o"], "left_anti").select(pack, key, "__o", "__r"), "near-items")
    if gone is None:
        return items.withColumn("copy_of", F.lit(None).cast(items.schema[key].dataType))
    stays = all_.join(gone, [pack, key], "left_semi").join(gone.withColumnRenamed(key, "__o"), [pack, "__o"], "left_anti")
    copy = stays.groupBy(pack, key).agg(F.min_by("__o", "__r").alias("copy_of"))
    return items.join(copy, [pack, key], "left")


def ratio(a: Column, b: Column) -> Column:
    """Similarity 1 - edits / longer length; 0 if one is empty."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / n)


def same_entities(c: DataFrame) -> DataFrame:
    """c(query_id, candidate, name, address, phone, domain, lat, lon) with entity, the smallest candidate of a query that is the same.

    Same: one phone; one domain and names alike by 0.60; names by 0.88 within 100 m; names by 0.90 and addresses by
    0.85. Candidates of a query meet by phone, domain, nearby cells, and names within the edits that 0.90 allows (a ninth
    of a name's letters, met by fuzzy's pieces), so none is missed. Candidates of a query that are equal in all these are the
    same if one rule holds between two of them, and else the same as none, so they meet as one, their smallest.
    """
    compared = ["query_id", "name", "address", "phone", "domain", "lat", "lon"]
    every = c
    c = written(c.groupBy(*compared).agg(F.min("candidate").alias("candidate")), "equal-candidates")
    cells = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.transform(geo.around(F.col("lat"), F.col("lon"), 0.002), lambda x: F.concat(F.lit("c"), x.cast("string"))))
    keys = F.filter(F.flatten(F.array(F.array(F.concat(F.lit("p"), "phone"), F.concat(F.lit("d"), "domain")), F.coalesce(cells, F.array().cast("array<string>")))), lambda k: k.isNotNull())
    cols = ["candidate", "name", "address", "phone", "domain", "lat", "lon"]
    e = c.select("query_id", F.explode(F.array_distinct(keys)).alias("key"), F.struct(*cols).alias("x"))
    pairs = e.join(e.withColumnRenamed("x", "y"), ["query_id", "key"]).filter("x.candidate < y.candidate").select("query_id", "x", "y")
    names = c.filter("name <> ''").select("name").distinct()
    most = (names.agg(F.max(F.length("name"))).first()[0] or 0) // 9
    alike = fuzzy(names.withColumnRenamed("name", "term"), names.select(F.lit(0).alias("query_id"), F.col("name").alias("word")), lambda w: F.floor(F.length(w) / 9).cast("int"), most).select("word", "term")
    x = c.select("query_id", F.struct(*cols).alias("x"), F.col("name").alias("word")).join(alike, "word")
    named = x.join(c.select("query_id", F.struct(*cols).alias("y"), F.col("name").alias("term")), ["query_id", "term"]).filter("x.candidate <> y.candidate")
    first = F.col("x.candidate") < F.col("y.candidate")
    pairs = pairs.union(named.select("query_id", F.when(first, F.col("x")).otherwise(F.col("y")), F.when(first, F.col("y")).otherwise(F.col("x")))).distinct()
    get = lambda k: (F.col(f"x.{k}"), F.col(f"y.{k}"))
    name = ratio(*get("name"))
    near = geo.haversine_m(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon")) <= NEAR_M
    eq = lambda k: get(k)[0] == get(k)[1]
    same = eq("phone") | (eq("domain") & (name >= NAME_DOMAIN)) | (near & (name >= NAME_NEAR)) | ((name >= NAME_ADDRESS) & (ratio(*get("address")) >= ADDRESS))
    links = pairs.filter(same).select(F.col("x.candidate").alias("u"), F.col("y.candidate").alias("v"))
    named, placed = F.col("name") != "", F.col("lat").isNotNull() & F.col("lon").isNotNull()
    met = F.col("phone").isNotNull() | (named & (F.col("domain").isNotNull() | placed | (F.col("address") != "")))
    equal = F.lit(True)
    for k in compared:
        equal &= F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    groups = _grouped(c.withColumn("met", F.coalesce(met, F.lit(False))), links, "candidate", "entity")
    return every.alias("x").join(groups.alias("y"), equal).select("x.*", F.when(F.col("y.met"), F.col("y.entity")).otherwise(F.col("x.candidate")).alias("entity"))


def merged_entities(c: DataFrame) -> DataFrame:
    """query_id, entity, and of each field the first candidate's value that is there; sources: number of different urls."""
    first = lambda k: F.min_by(k, F.when(F.col(k).isNotNull(), F.col("candidate"))).alias(k)
    return c.groupBy("query_id", "entity").agg(*[first(k) for k in ("name", "address", "phone", "domain", "lat", "lon")], F.greatest(F.lit(1), F.count_distinct("url")).alias("sources"))


def hybrid(sparse_docs: DataFrame, sparse_queries: DataFrame, dense: DataFrame, top: int, weights: dict[str, float]) -> DataFrame:
    """query_id, doc, rrf, providers, rank: lexical and vector lists (dense: query_id, doc, rank) fused."""
    lexical = sparse_search(sparse_docs, sparse_queries, top).select("query_id", "doc", "rank", F.lit("lexical").alias("provider"))
    both = lexical.unionByName(dense.select("query_id", "doc", "rank", F.lit("vector").alias("provider")))
    return with_rank(rrf(both, "query_id", "doc", weights), ["query_id"], "rrf", "doc").filter(F.col("rank") <= top)


def fused_lanes(rows: DataFrame, query: str, key: str, top: int, corroborated: float = 5.0) -> DataFrame:
    """query, key, doc, authority, score, lanes, rank of rows(lane, rank from 1, doc, authority): lanes fused by reciprocal ranks.

    score: a thousand times the sum of 1 / (60 + rank), to one place, and `corroborated` more if several lanes have the
    key. Of a key's copies the one of highest authority stays, then the best placed, then the first lane's.
    """
    first = F.struct("authority", -F.col("rank"), "doc")
    g = rows.groupBy(query, key).agg(F.max(first).alias("__b"), F.sum(1 / (60 + F.col("rank"))).alias("__rrf"), F.count_distinct("lane").alias("lanes"))
    score = F.round(F.col("__rrf") * 10000) / 10 + F.when(F.col("lanes") > 1, corroborated).otherwise(0.0)
    out = g.select(query, key, F.col("__b.doc").alias("doc"), F.col("__b.authority").alias("authority"), score.alias("score"), "lanes")
    return with_rank(out, [query], "score", key).filter(F.col("rank") <= top)


def cached_hits(queries: DataFrame, cached: DataFrame, least: float = 0.94) -> DataFrame:
    """query_id, hit, score: the earliest cached query of the same scope with a cosine of `least` or more, older than the query.

    queries: query_id, scope, at, q; cached: hit, scope, stored_at, v. Stated queries go to every task as matrices, in blocks. A
    task multiplies its vectors with those of their scope and keeps the earliest hit of each query in a batch.
    """
    kind = [f.dataType.simpleString() for f in (queries.schema["query_id"], cached.schema["stored_at"], cached.schema["hit"])]
    schema = f"query_id {kind[0]}, stored_at {kind[1]}, hit {kind[2]}, score double"
    spread = cached.filter("scope IS NOT NULL AND stored_at IS NOT NULL AND v IS NOT NULL").select("scope", "stored_at", "hit", "v").repartition("hit")

    def unit(column):
        m = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def block(some):
        asked = some.filter("scope IS NOT NULL AND at IS NOT NULL AND q IS NOT NULL").select("query_id", "scope", "at", "q").toArrow().combine_chunks()
        of = {}
        for i, s in enumerate(asked.column("scope").to_pylist()):
            of.setdefault(s, []).append(i)
        part = lambda rows, c: asked.column(c).take(pa.array(rows)).combine_chunks()
        shared = cached.sparkSession.sparkContext.broadcast({s: (part(rows, "query_id"), part(rows, "at").to_numpy(zero_copy_only=False), unit(part(rows, "q"))) for s, rows in of.items()})

        def first(it):
            for batch in it:
                batch = batch.take(pc.sort_indices(batch, sort_keys=[("stored_at", "ascending"), ("hit", "ascending")]))
                scopes = {}
                for i, s in enumerate(batch.column("scope").to_pylist()):
                    scopes.setdefault(s, []).append(i)
                for s, rows in scopes.items():
                    if s not in shared.value:
                        continue
                    names, at, matrix = shared.value[s]
                    own = batch.take(pa.array(rows))
                    vectors, stored = unit(own.column("v")), own.column("stored_at").to_numpy(zero_copy_only=False)
                    step = max(1, SCORES // len(rows))
                    for begin in range(0, len(matrix), step):
                        scores = vectors @ matrix[begin : begin + step].T
                        fits = (scores >= least) & (stored[:, None] < at[None, begin : begin + step])
                        q = np.flatnonzero(fits.any(axis=0))
                        v = fits.argmax(axis=0)[q]
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q + begin)), own.column("stored_at").take(pa.array(v)), own.column("hit").take(pa.array(v)), pa.array(scores[v, q])], names=["query_id", "stored_at", "hit", "score"])

        near = spread.mapInArrow(first, schema)
        return near.groupBy("query_id").agg(F.min(F.struct("stored_at", "hit", "score")).alias("b")).select("query_id", "b.hit", "b.score")

    return in_blocks(queries, "query_id", block)


def place_text_search(places: DataFrame, queries: DataFrame, top: int, common: int = COMMON_NAMES) -> DataFrame:
    """query_id, place_id, score, rank: 8 for the equal name, 4 for the phrase, 3 times the share of query words found, 2 for words within their typos.

    places: place_id, name (normal); queries: query_id, name. A word within its typos begins with the same letter, wherever
    the typo is. Null and empty names meet none. A score depends on the name alone, so of equal names the `top` smallest
    ids are enough. Words of over `common` names are common; a name's form shows these and masks all others. By the words
    that a query shares with them, names are candidates thus:
    common ones only: the form is enough, with its `top` smallest ids;
    a rarer one: all names that have it;
    else one near to a rarer one: of each form the `top` smallest names that have such a one (nearest);
    else two or more near to rarer ones: all such names (fuzzy).
    Candidates are scored by their own names, or forms.
    """
    allowance = text.edit_allowance
    split = lambda name: F.array_distinct(F.filter(F.split(name, " "), lambda x: x != ""))
    words = lambda df, key: df.select(key, F.explode(split("name")).alias("word"))
    ids = smallest(places.filter("name <> ''").select("place_id", "name"), "place_id", top, "name")
    ids = written(ids.groupBy("name").agg(F.min("place_id").alias("first"), F.sort_array(F.collect_list("place_id")).alias("ids")), "place-names")
    q, p = written(words(queries, "query_id"), "query-words"), words(ids, "first")
    often = written(p.groupBy(F.col("word").alias("term")).agg(F.count(F.lit(1)).alias("names")).filter(F.col("names") > common).select("term"), "common-words")
    asked = written(q.select("word").distinct(), "asked-words")

    # each name's form: its common words where they are, a mark for others
    each = ids.select("first", F.posexplode(F.split("name", " ")).alias("at", "term")).join(small(often.withColumn("often", F.lit(True))), "term", "left")
    each = written(each, "placed-words")
    shown = F.struct("at", F.when(F.col("often") | (F.col("term") == ""), F.col("term")).otherwise("\x01").alias("w"), F.coalesce("often", F.lit(False)).alias("often"))
    form = each.groupBy("first").agg(F.array_sort(F.collect_list(shown)).alias("f")).filter(F.exists("f", lambda x: x["often"]))
    form = written(form.select("first", F.array_join(F.transform("f", lambda x: x["w"]), " ").alias("form")), "name-forms")
    forms = smallest(form.join(ids, "first").select("form", F.explode("ids").alias("place_id")), "place_id", top, "form")
    forms = written(forms.groupBy("form").agg(F.collect_list("place_id").alias("ids")), "forms")
    kinds = form.join(small(form.groupBy("form").agg(F.min("first").alias("kind"))), "form").select("first", "kind")
    rare = each.filter("often IS NULL AND term <> ''").select("first", "term").distinct().join(kinds, "first", "left")
    rare = written(rare, "rare-words")

    near = lambda terms, some: fuzzy(terms, some.select(F.lit(0).alias("query_id"), "word"), allowance).filter(F.substring("word", 1, 1) == F.substring("term", 1, 1)).select("word", "term")
    pairs = written(asked.join(often, F.col("word") == F.col("term"), "left_semi").select("word", F.col("word").alias("term")).union(near(often, asked)), "common-pairs")
    in_form = forms.select("form", F.explode(F.array_distinct(F.split("form", " "))).alias("term")).join(small(pairs), "term").join(q, "word").select("query_id", "form").distinct()

    one = written(nearest(rare.select("term", "kind", "first"), asked, allowance, top), "near-names")
    with_typo = q.join(small_or_sorted(one.select("word").distinct()), "word", "left_semi")
    several = written(with_typo.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("query_id"), "queries-of-several")
    found = q.join(small_or_sorted(rare.withColumnRenamed("term", "word")), "word").select("query_id", "first")
    found = found.union(q.join(small_or_sorted(one), "word").select("query_id", "first"))
    if not several.isEmpty():
        some = written(with_typo.join(small_or_sorted(several), "query_id", "left_semi"), "words-of-several")
        both = near(rare.select("term").distinct(), some.select("word").distinct()).join(rare, "term").join(some, "word")
        found = found.union(both.groupBy("query_id", "first").agg(F.count_distinct("word").alias("n")).filter("n > 1").select("query_id", "first"))
    found = found.distinct().join(small_or_sorted(ids), "first").select("query_id", "name", "ids")

    c = found.union(in_form.join(small(forms), "form").select("query_id", F.col("form").alias("name"), "ids"))
    c = c.join(small_or_sorted(queries.select("query_id", F.col("name").alias("q"))), "query_id").withColumn("qw", split("q")).withColumn("pw", split("name"))
    equal, n = F.size(F.array_intersect("qw", "pw")), F.size("qw")
    typo = lambda x, y: (F.left(x, F.lit(1)) == F.left(y, F.lit(1))) & (F.levenshtein(x, y) <= allowance(x))
    met = F.size(F.filter(F.array_except("qw", "pw"), lambda x: F.exists("pw", lambda y: typo(x, y))))
    score = F.when(F.col("name") == F.col("q"), 8.0).otherwise(0.0) + F.when(F.contains(F.concat(F.lit(" "), "name", F.lit(" ")), F.concat(F.lit(" "), "q", F.lit(" "))), 4.0).otherwise(0.0) + 3 * (equal / n) + 2 * (met / n)
    best = c.select("query_id", score.alias("score"), F.explode("ids").alias("place_id")).groupBy("query_id", "place_id").agg(F.max("score").alias("score"))
    return with_rank(best, ["query_id"], "score", "place_id").filter(F.col("rank") <= top)


def with_lane(found: DataFrame, lane: DataFrame, query: str, doc: str) -> DataFrame:
    """Found rows, then those of the lane that were not found: query, doc, lane."""
    both = found.select(query, doc, F.lit(False).alias("lane")).unionByName(lane.select(query, doc, F.lit(True).alias("lane")))
    return both.groupBy(query, doc).agg(F.min("lane").alias("lane"))


def filtered_answers(sentences: DataFrame, answer: str, abstain: str) -> DataFrame:
    """answer, text (its kept sentences in order), total, removed, abstained: sentences(n, sentence, ok); without any kept one the text abstains."""
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("n", "sentence")))), lambda x: x["sentence"])
    g = sentences.groupBy(answer).agg(F.array_join(kept, " ").alias("text"), F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok")).alias("removed"))
    none = F.col("total") == F.col("removed")
    return g.select(answer, F.when(none, abstain).otherwise(F.col("text")).alias("text"), "total", "removed", none.alias("abstained"))


def recrawl_plan(visits: DataFrame, alpha: float = 0.3) -> DataFrame:
    """url, rate, visits, next_due: moving average of content changes over visits(url, at, content_hash), and the last visit plus the interval of that rate."""
    changed = F.lag("content_hash").over(Window.partitionBy("url").orderBy("at")) != F.col("content_hash")
    v = written(visits.select("url", "at", F.coalesce(changed.cast("double"), F.lit(0.0)).alias("changed")), "visits")
    last = v.groupBy("url").agg(F.max("at").alias("at"), F.count(F.lit(1)).cast("int").alias("visits"))
    rates = ema(v, "url", "at", "changed", alpha).select("url", F.col("ema").alias("rate"))
    due = F.unix_timestamp("at") + geo.recrawl_seconds(F.col("rate"))
    return last.join(rates, "url").select("url", "rate", "visits", F.timestamp_seconds(F.floor(due)).alias("next_due"))


def discovered(pages: DataFrame, html: str, depth: str, allowed: DataFrame | None = None, url: str = "url") -> DataFrame:
    """url, priority, depth: links of pages (resolved against their url) one deeper, a quarter less for each step (0.05 at least); of a URL the best priority and least depth."""
    links = pages.select(F.explode(web.page_links(F.col(html), F.col(url))).alias("link"), (F.col(depth) + 1).alias("depth"))
    links = links.select(web.canonical_url(F.col("link")).alias("url"), "depth").filter("url <> ''")
    if allowed is not None:
        links = links.withColumn("host", web.host(F.col("url"))).join(allowed.select("host").distinct(), "host", "left_semi")
    return links.groupBy("url").agg(F.max(F.greatest(F.lit(0.05), 1 - 0.25 * F.col("depth"))).alias("priority"), F.min("depth").alias("depth"))


def businesses(pages: DataFrame, url: str, title: str, body: str) -> DataFrame:
    """name, urls, phone, hours, rating, lat, lon, corroborated (by two URLs or more): facts read from page text, joined by the folded title."""
    first = lambda p, g=1: F.nullif(F.regexp_extract(body, p, g), F.lit(""))
    facts = pages.select(
        text.normalize(F.col(title)).alias("name"), F.col(url).alias("url"), first(r"((?:\+84|\b0)[0-9][0-9 .-]{7,11}[0-9])\b").alias("phone"),
        F.regexp_replace(first(r"(\d{1,2}:\d{2}\s*[-–]\s*\d{1,2}:\d{2})"), r"\s", "").alias("hours"), first(r"(\d+(?:\.\d+)?)\s*/\s*5\b").cast("double").alias("rating"),
        first(r"(-?\d{1,3}\.\d+)\s*,\s*-?\d{1,3}\.\d+").cast("double").alias("lat"), first(r"-?\d{1,3}\.\d+\s*,\s*(-?\d{1,3}\.\d+)").cast("double").alias("lon"),
    ).filter("name <> ''")
    by_url = lambda k: F.min_by(k, F.when(F.col(k).isNotNull(), F.col("url"))).alias(k)
    return facts.groupBy("name").agg(F.count_distinct("url").alias("urls"), *[by_url(k) for k in ("phone", "hours", "rating", "lat", "lon")]).withColumn("corroborated", F.col("urls") >= 2)
