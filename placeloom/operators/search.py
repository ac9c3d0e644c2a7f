"""Search of tables, all queries of a table at once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..plans.graph import written
from .ranking import with_rank

K1, B = 1.5, 0.75
#: A table of so many bytes at most is sent whole to every task.
BROADCAST_ROWS = 50_000
#: Scores that a task holds at once (8 bytes each, twice).
SCORES = 4_000_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_or_sorted(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if it has at most `most` rows, else never: Spark would tell by the size of the files that rows come from, and these may hold like rows in little."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def in_blocks(queries: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame], most: int = BROADCAST_ROWS) -> DataFrame:
    """answer() of each block of the stated queries, of about `most` rows, united. A key's rows are in one block."""
    blocks = max(1, -(-queries.count() // most))
    out = None
    for b in range(blocks):
        some = answer(queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b))
        out = some if out is None else out.union(some)
    return out


def inverted(docs: DataFrame, key: str, words: str) -> DataFrame:
    """key, term, tf. A document's words are brought to one task before they are told apart, so that what counts or scores by document shuffles no more."""
    each = docs.select(key, words).repartition(key).select(key, F.explode(words).alias("term"))
    return each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """query_id, doc, score, rank. docs: doc, words; queries: query_id, words.

    The documents' words are written once, for the statistics and the postings. Postings are those of the queries' terms
    (semi-join). A document's words are in one task, where it is scored, and only the best of each task are shuffled.
    """
    docs = written(docs.select("doc", F.size("words").alias("len"), "words"), "search-words")
    terms = written(queries.select("query_id", F.explode(F.array_distinct("words")).alias("term")), "query-terms")
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
    n, mean = stats["n"], float(stats["mean"] or 1.0)
    wanted = small(terms.select("term").distinct())
    # so many parts that a task holds the scores of some documents only, however many there are
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * terms.select("query_id").distinct().count() // SCORES))
    post = docs.repartition(parts, "doc").select("doc", "len", F.explode("words").alias("term")).join(wanted, "term", "left_semi").groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = written(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "document-frequencies")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    weighted = post.join(small(df.select("term", idf.alias("idf"))), "term").select("doc", "term", (F.col("idf") * tf).alias("w"))
    scored = weighted.join(small(terms), "term").groupBy("query_id", "doc").agg(F.sum("w").alias("score"))
    return with_rank(scored, ["query_id"], "score", "doc").filter(F.col("rank") <= top)


def knn(vectors: DataFrame, queries: DataFrame, top: int, where: Column | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: cosine of stated queries(query_id, q) against all vectors(vec_id, v, ...), exactly.

    where: a condition on the vectors' columns; it is applied before any score, so each query gets `top` rows that meet it.
    The stated queries go to every task as a matrix, in blocks of BROADCAST_ROWS at most. A task multiplies its vectors with
    some of them at a time, SCORES scores at most, and keeps the best `top` of each query in a batch, so only these are
    shuffled. A zero vector scores 0. Null vectors are left out.
    """
    vectors = vectors if where is None else vectors.filter(where)
    kind = [f.dataType.simpleString() for f in (queries.schema["query_id"], vectors.schema["vec_id"])]

    def unit(column):
        m = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def block(some):
        table = some.filter("q IS NOT NULL").select("query_id", "q").toArrow().combine_chunks()
        if not table.num_rows:
            return None
        shared = vectors.sparkSession.sparkContext.broadcast((table.column(0).combine_chunks(), unit(table.column(1).combine_chunks())))

        def best(it):
            names, matrix = shared.value
            for batch in it:
                for i in range(0, batch.num_rows, 4096):
                    part = batch.slice(i, 4096)
                    own = unit(part.column(1)).T
                    k, step = min(top, own.shape[1]), max(1, SCORES // own.shape[1])
                    for first in range(0, len(matrix), step):
                        scores = matrix[first : first + step] @ own
                        # all that tie with the k-th stay, so that ties are told by id in the end
                        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                        q, v = np.nonzero(scores >= cut[:, None])
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q + first)), part.column(0).take(pa.array(v)), pa.array(scores[q, v])], names=["query_id", "vec_id", "score"])

        rows = vectors.filter("v IS NOT NULL").select("vec_id", "v").mapInArrow(best, f"query_id {kind[0]}, vec_id {kind[1]}, score double")
        return with_rank(rows, ["query_id"], "score", "vec_id").filter(F.col("rank") <= top)

    none = with_rank(queries.limit(0).select("query_id").join(vectors.limit(0).select("vec_id"), F.lit(True)).withColumn("score", F.lit(0.0)), ["query_id"], "score", "vec_id")
    return in_blocks(queries, "query_id", lambda some: block(some) or none)


def sparse_search(docs: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """Dot product of sparse vectors: docs(doc, term, w), queries(query_id, term, qw)."""
    s = docs.join(small(queries), "term").groupBy("query_id", "doc").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    return with_rank(s, ["query_id"], "score", "doc").filter(F.col("rank") <= top)


def smallest(rows: DataFrame, key: str, most: int, *by: str) -> DataFrame:
    """The rows of the `most` smallest keys of each group, taken by parts first, so that no task holds a large group."""
    part = rows.withColumn("__p", F.pmod(F.xxhash64(key), F.lit(64)))
    for w in ([*by, "__p"], list(by)):
        part = part.withColumn("__i", F.row_number().over(Window.partitionBy(*w).orderBy(key))).filter(F.col("__i") <= most).drop("__i")
    return part.drop("__p")


def autocomplete(places: DataFrame, queries: DataFrame, top: int, longest: int = 24, scale_m: float = 2000.0) -> DataFrame:
    """query_id, place_id, score, rank of places whose name or alias begins with the query's prefix.

    places: place_id, names (own name first, normal), lat, lon; queries: query_id, prefix (normal), lat, lon. A hit in the
    own name counts 4.5, in an alias 1; the score halves at scale_m from the query's point, by a Gaussian, and stays
    where a point is missing. Names are met by their edge grams up to `longest` letters; of these only prefixes
    that a query asks for are kept. Scores have 9 digits, so beyond some distance all are 0 and the smallest ids go first.
    So a query (queries of one prefix and point are one) needs of each prefix: of the places of one kind of name at one
    spot the `top` smallest ids, where the spot is near or missing; and the `top` smallest ids of all.
    """
    asked = queries.filter("prefix <> ''").select("query_id", "prefix", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
    # one query for each prefix and point, by its smallest id
    same = F.col("prefix").eqNullSafe(F.col("p2")) & F.col("qlat").eqNullSafe(F.col("y2")) & F.col("qlon").eqNullSafe(F.col("x2"))
    q = written(asked.groupBy("prefix", "qlat", "qlon").agg(F.min("query_id").alias("first")), "asked-prefixes")
    wanted = q.select("prefix", F.substring("prefix", 1, longest).alias("gram")).distinct()
    n = places.select("place_id", "lat", "lon", F.posexplode("names").alias("at", "name"))
    grams = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("name"))), lambda k: F.substring(F.col("name"), F.lit(1), k))
    n = n.filter("name <> ''").select("place_id", "lat", "lon", "name", F.when(F.col("at") == 0, 4.5).otherwise(1.0).alias("hit"), F.explode(grams).alias("gram"))
    hit = n.join(small(wanted), "gram").filter(F.col("name").startswith(F.col("prefix"))).groupBy("prefix", "place_id", "lat", "lon").agg(F.max("hit").alias("hit"))

    least = lambda rows, *keys: smallest(rows, "place_id", top, *keys)
    spots = written(least(hit, "prefix", "hit", "lat", "lon"), "prefix-spots")
    # beyond this distance 4.5 times the decay rounds to 0
    reach = scale_m * math.sqrt(math.log2(4.5 / 4e-10))
    wide = reach / 111_000 / 0.9
    here = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    band = F.floor(F.col("lat") / wide)
    bands = F.explode(F.array(*[F.floor(F.col("qlat") / wide) + i for i in (-1, 0, 1)]))
    placed = q.filter("qlat IS NOT NULL AND qlon IS NOT NULL")
    cell = lambda y, x: F.explode(geo.around(y, x, wide))
    columns = ["first", "qlat", "qlon", "place_id", "lat", "lon", "hit"]
    # near: cells of a width that holds at this latitude; a wrap at 180 degrees and the poles meet by bands
    plain = (F.abs("qlat") < 55) & (F.abs("qlon") < 179)
    near = placed.filter(plain).withColumn("cell", cell(F.col("qlat"), F.col("qlon") / 2)).join(spots.filter(here).withColumn("cell", geo.cell(F.col("lat"), F.col("lon") / 2, wide)), ["prefix", "cell"]).select(columns)
    edge = placed.filter(~plain).withColumn("band", bands).join(spots.filter(here).withColumn("band", band), ["prefix", "band"]).select(columns)
    lost = q.join(least(spots.filter(~here), "prefix", "hit"), "prefix").select(columns)
    any_ = q.join(least(spots, "prefix", "hit"), "prefix").select(columns)
    far = geo.haversine_m(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon"))
    decay = F.coalesce(F.pow(F.lit(0.5), F.pow(far / scale_m, 2)), F.lit(1.0))
    s = near.union(edge).union(lost).union(any_).groupBy("first", "place_id").agg(F.max(F.col("hit") * decay).alias("score"))
    best = with_rank(s.withColumn("score", F.round("score", 9)), ["first"], "score", "place_id").filter(F.col("rank") <= top)
    back = asked.join(q.select("first", F.col("prefix").alias("p2"), F.col("qlat").alias("y2"), F.col("qlon").alias("x2")), same)
    return back.select("query_id", "first").join(best, "first").select("query_id", "place_id", "score", "rank")


def prefixes(names: DataFrame, key: str, name: str, least: int = 2, most: int = 8) -> DataFrame:
    """key, prefix: edge grams of the name."""
    grams = F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(most), F.length(name)))), lambda n: F.substring(F.col(name), F.lit(1), n))
    return names.select(key, name, F.explode(F.array_distinct(grams)).alias("prefix"))


def deletions(word: Column, k: Column, most: int) -> Column:
    """What is left of a word without k of its letters or fewer (`most` at most), each once."""
    shorter = lambda v: F.transform(F.filter(F.sequence(F.lit(0), F.length(v) - 1), lambda j: j >= 0), lambda j: F.concat(F.substring(v, F.lit(1), j), F.substring(v, j + 2, F.length(v))))
    out = F.array(word)
    for i in range(most):
        out = text.let(out, lambda o, i=i: F.when(k > i, F.array_distinct(F.concat(o, F.flatten(F.transform(F.filter(o, lambda v: F.length(v) > 0), shorter))))).otherwise(o))
    return out


def fuzzy(terms: DataFrame, queries: DataFrame, allowance: Callable[[Column], Column], most: int = 3) -> DataFrame:
    """query_id, word, term, edits: terms within the edits allowed for the word (`most` at most; allowance gives them by its letters), none left out.

    A word with k edits allowed is cut into k + 1 pieces, one of which an edited word keeps, moved by k letters at most;
    a term gives the letters at those places for each length of the words. Where a piece is so common that the words and
    terms that have it make more pairs than they leave forms without k letters, they meet by these forms of what is
    beside the piece: two texts within k edits have one in common. Pieces and forms are 64-bit hashes; every pair is checked.
    """
    k = lambda n: allowance(F.repeat(F.lit("x"), n))
    begin = lambda n, i: F.floor(i * n / (k(n) + 1)).cast("int")
    size = lambda n, i: begin(n, i + 1) - begin(n, i)
    key = lambda w, n, i, at: F.xxhash64(n, i, F.substring(w, at + 1, size(n, i)))
    beside = lambda w, n, i, at: F.concat(F.substring(w, F.lit(1), at), F.substring(w, at + size(n, i) + 1, F.length(w)))
    lengths = [r[0] for r in queries.select(F.length("word")).distinct().collect() if r[0] is not None]
    if not lengths:
        return queries.select("query_id", "word").limit(0).join(terms.select("term").limit(0), F.lit(True)).withColumn("edits", F.lit(0))
    n = F.length("word")
    q = queries.select("query_id", "word", n.alias("n"), F.explode(F.sequence(F.lit(0), k(n))).alias("i"))
    q = q.select("query_id", "word", "n", "i", key(F.col("word"), F.col("n"), F.col("i"), begin(F.col("n"), F.col("i"))).alias("key"))
    asked = q.groupBy("key").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n"))
    asked = written(asked, "asked-pieces")
    m = F.length("term")
    t = terms.select("term", F.explode(F.array_intersect(F.sequence(F.greatest(F.lit(0), m - most), m + most), F.lit(lengths))).alias("n")).filter(F.abs(F.col("n") - m) <= k(F.col("n")))
    t = t.select("term", "n", F.explode(F.sequence(F.lit(0), k(F.col("n")))).alias("i"))
    t = t.select("term", "n", "i", F.explode(F.sequence(-k(F.col("n")), k(F.col("n")))).alias("d"))
    t = t.withColumn("at", begin(F.col("n"), F.col("i")) + F.col("d")).filter("at >= 0")
    t = t.select("term", "n", "i", "at", key(F.col("term"), F.col("n"), F.col("i"), F.col("at")).alias("key"))
    t = written(t.join(small(asked.select("key"), 500_000), "key", "left_semi"), "term-pieces")
    forms, form = F.lit(1.0), F.lit(1.0)
    left = F.col("n") - F.floor(F.col("n") / (k(F.col("n")) + 1))
    for i in range(most):
        form = form * F.greatest(left - i, F.lit(0)) / (i + 1)
        forms = forms + F.when(k(F.col("n")) > i, form).otherwise(0.0)
    both = asked.join(t.groupBy("key").agg(F.count(F.lit(1)).alias("terms")), "key")
    common = written(both.filter(F.col("words") * F.col("terms") > (F.col("words") + F.col("terms")) * forms).select("key"), "common-pieces")
    common = small(common, 500_000)
    few, shown = t.join(common, "key", "left_anti").select("term", "key"), q.select("query_id", "word", "key")
    pairs = (shown.join(small(few), "key") if shown.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS else few.join(F.broadcast(shown), "key")).select("query_id", "word", "term")
    ends = lambda c: F.explode(F.transform(deletions(c, k(F.col("n")), most), lambda v: F.xxhash64("key", v))).alias("form")
    qf = q.join(common, "key", "left_semi").select("query_id", "word", ends(beside(F.col("word"), F.col("n"), F.col("i"), begin(F.col("n"), F.col("i")))))
    tf = t.join(common, "key", "left_semi").select("term", ends(beside(F.col("term"), F.col("n"), F.col("i"), F.col("at")))).distinct()
    pairs = pairs.union(qf.join(tf, "form").select("query_id", "word", "term"))
    near = pairs.withColumn("edits", F.levenshtein("word", "term", most))
    return near.filter((F.col("edits") >= 0) & (F.col("edits") <= allowance(F.col("word")))).select("query_id", "word", "term", "edits").distinct()


def cuts(n: int, k: int, inserted: int) -> list[tuple[int, ...]]:
    """(p, q, r, s, place): what is left of a word of n letters, from p to q and r to s taken out, if k of its places behind the first letter (at most 2) are open; `inserted` of them are put between letters, the others are letters. place tells where they are."""
    found = {}

    def go(start, left, ins, cut):
        if not left:
            p, q, r, s = (*cut, n, n)[:4]
            gone = frozenset([*range(p, q), *range(r, s)])
            place = (k * 1000 + p) * 1000 + (p + r - q if k > 1 else 0)
            found.setdefault((gone, place), (p, q, r, s, place))
            return
        for at in range(start, n + 1):
            if ins:
                go(at, left - 1, ins - 1, (*cut, at, at))
            if left > ins and at < n:
                go(at + 1, left - 1, ins, (*cut, at, at + 1))

    go(1, k, inserted, ())
    return list(found.values())


#: Forms of words with open places that a task makes or sorts.
FORMS = 4_000_000


def _opened(words: DataFrame, word: str, forms: set[tuple[int, int, int]]) -> tuple[DataFrame, int]:
    """words with `rest` and `place`, a row for each form: (letters, open places, of these inserted); and about how many tasks they are for."""
    table = [(n, *c) for n, k, inserted in sorted(forms) for c in cuts(n, k, inserted)]
    spark, n = words.sparkSession, F.length(word)
    if not table:
        return words.limit(0).withColumns({"rest": F.lit(""), "place": F.lit(0)}), 1
    most = max(Counter(row[0] for row in table).values())
    parts = -(-words.count() * most // FORMS)
    rows = words.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))).join(F.broadcast(spark.createDataFrame(table, "n int, p int, q int, r int, s int, place int")), n == F.col("n"))
    piece = lambda a, b: F.substring(word, a + 1, b - a)
    return rows.select(*words.columns, F.concat(piece(F.lit(0), F.col("p")), piece(F.col("q"), F.col("r")), piece(F.col("s"), n)).alias("rest"), "place"), parts


def nearest(terms: DataFrame, words: DataFrame, allowance: Callable[[Column], Column], top: int) -> DataFrame:
    """word, kind, first: in each kind the `top` smallest `first` of the terms that begin as the word does and are within its edits, or equal.

    terms: term, kind (or null), first; words: word, distinct. A word with one or two edits allowed and a term are
    that near if they are one text once so many of their letters, or places between letters, are left open. So of the
    terms of such a form the smallest of each kind are enough, and pairs are not listed. Words with more edits meet
    terms pair by pair (fuzzy).
    """
    terms, words = written(terms.filter("term <> ''"), "near-terms"), written(words.filter("word <> ''"), "near-words")
    allowed = {r["n"]: r["k"] for r in words.select(F.length("word").alias("n"), allowance(F.col("word")).alias("k")).distinct().collect()}
    there = [r["m"] for r in terms.select(F.length("term").alias("m")).distinct().collect()]
    # i letters more and d fewer in the term: i places are inserted in the word, d in the term
    ways = [(n, m, k, i, n + i - m) for n, k in allowed.items() if 0 < k <= 2 for m in there for i in range(k + 1) if 0 <= n + i - m <= k - i]
    asked, n = _opened(words, "word", {(n, k, i) for n, _, k, i, _ in ways})
    shown, m = _opened(terms, "term", {(m, k, d) for _, m, k, _, d in ways})
    # forms are shuffled once, for the smallest of each and for the join
    parts = max(n, m, int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked, shown = asked.repartition(parts, "rest", "place"), shown.drop("term").repartition(parts, "rest", "place")
    # a term has a form twice where letters repeat, so rows are told by their rank
    within = lambda rows, *by: rows.withColumn("__i", F.dense_rank().over(Window.partitionBy(*by, "kind").orderBy("first"))).filter(F.col("__i") <= top).drop("__i")
    met = asked.join(within(shown, "rest", "place").hint("merge"), ["rest", "place"]).select("word", "kind", "first")
    far = fuzzy(terms.select("term").distinct(), words.filter(allowance(F.col("word")) > 2).select(F.lit(0).alias("query_id"), "word"), allowance)
    far = far.filter(F.substring("word", 1, 1) == F.substring("term", 1, 1)).join(terms, "term").select("word", "kind", "first")
    return within(met.union(far).distinct(), "word")
