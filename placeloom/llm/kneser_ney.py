"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_documents, save, slices

ORDER = 5
BITS = 12
#: Symbols of the alphabet. Where the trusted text has more different characters, the rarer ones are two symbols each; only
#: characters that it does not have are one unknown symbol.
ALPHABET = (1 << BITS) - 3
PAD, END, UNKNOWN = 0, 1, 2
#: Ids of trusted documents are broadcast up to this number; more are joined.
BROADCAST_IDS = 500_000
#: A document passes if its perplexity is at most SLACK times this quantile of the trusted documents of its language.
QUANTILE = 0.99
SLACK = 1.4
#: The scores of so many different n-grams of the corpus at most are broadcast (16 bytes each); more are joined.
BROADCAST_GRAMS = 4_000_000
#: Text that a task turns into n-grams at once.
PART_BYTES = 1 << 20


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in turn, number of characters of each)."""
    texts = pc.fill_null(texts, "")
    n = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), n


def alphabet(docs: DataFrame, text_col: str) -> np.ndarray:
    """The characters of all texts (as many as Unicode has at most): in order; of more than ALPHABET, those that are one symbol, then the others (_parts), each in order."""

    def counts(it):
        for batch in it:
            for part in slices(batch, 0, PART_BYTES):
                got = np.bincount(_characters(part.column(0))[0], minlength=1)
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(got[at], pa.int64())], names=["c", "n"])

    found = docs.select(text_col).mapInArrow(counts, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    c, n = (np.asarray(found.column(k)).astype(np.int64) for k in range(2))
    letters = c[np.lexsort((c, -n))]
    one, _, _ = _parts(letters)
    return np.concatenate((np.sort(letters[: len(one)]), np.sort(letters[len(one) :])))


def _parts(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(characters of one symbol, characters of two, different first symbols of these): width * width pairs are enough for the latter."""
    if len(letters) <= ALPHABET:
        return letters, letters[:0], 0
    width = 1
    while width * width < len(letters) - (ALPHABET - 2 * width):
        width += 1
    return letters[: ALPHABET - 2 * width], letters[ALPHABET - 2 * width :], width


def _symbols(texts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, each after ORDER - 1 pads and with an end; where each text begins)."""
    points, n = _characters(texts)
    one, two, width = _parts(letters)
    table = np.full(int(one.max(initial=0)) + 2, UNKNOWN, np.int64)
    table[one] = np.arange(len(one)) + UNKNOWN + 1
    symbols = table[np.minimum(points, len(table) - 1)]
    if len(two) and len(points):
        at = np.minimum(np.searchsorted(two, points), len(two) - 1)
        rare = two[at] == points
        place = np.cumsum(1 + rare) - 1 - rare
        both = np.empty(len(points) + int(rare.sum()), np.int64)
        first = UNKNOWN + 1 + len(one)
        both[place] = np.where(rare, first + at // width, symbols)
        both[place[rare] + 1] = first + width + at[rare] % width
        ends = np.cumsum(n)
        upto = np.append(0, np.cumsum(1 + rare))
        symbols, n = both, upto[ends] - upto[ends - n]
    wide = n + ORDER
    begin = np.cumsum(wide) - wide
    out = np.zeros(int(wide.sum()), np.int64)
    out[begin + wide - 1] = END
    out[np.repeat(begin + ORDER - 1 - (np.cumsum(n) - n), n) + np.arange(len(symbols))] = symbols
    return out, begin


def _grams(symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of the ORDER-gram that ends at each symbol but the pads, text of each)."""
    key = symbols[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        key |= symbols[ORDER - 1 - k : len(symbols) - k] << (BITS * k)
    text = np.zeros(len(symbols), np.int64)
    text[begin[1:]] = 1
    text = np.cumsum(text)
    real = np.ones(len(symbols), bool)
    for k in range(ORDER - 1):
        real[begin + k] = False
    return key[real[ORDER - 1 :]], text[real]


def gram_counts(docs: DataFrame, letters: np.ndarray, text_col: str) -> DataFrame:
    """gram, n: counts of the ORDER-grams; each part of a partition is counted before the shuffle."""

    def counts(it):
        for batch in it:
            for part in slices(batch, 0, PART_BYTES):
                key, n = np.unique(_grams(*_symbols(part.column(0), letters))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64())], names=["gram", "n"])

    return docs.select(text_col).mapInArrow(counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, BITS)


def train(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, list[DataFrame], list[DataFrame]]:
    """(letters, probabilities, backoffs) of the documents' text.

    probabilities[k]: gram, lp (natural log of the interpolated probability) of the (k+1)-grams seen;
    backoffs[k]: gram, lb (log of the mass that a context of k+1 symbols leaves to shorter ones).
    Counts of lower orders are the numbers of different symbols before a gram. The three discounts of each order
    come from its counts of counts; totals and shorter probabilities come by joins on the packed gram.
    """
    letters = alphabet(docs, text_col)
    counts: list[DataFrame] = [save(gram_counts(docs, letters, text_col), "grams")]
    for order in range(ORDER, 1, -1):
        counts.insert(0, save(counts[0].groupBy(_suffix(F.col("gram"), order).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams"))
    probabilities, backoffs, shorter = [], [], None
    uniform = math.log(1.0 / (min(len(letters), ALPHABET) + 2))
    for order, table in enumerate(counts, 1):
        c = table.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = (c[f"n{k}"] for k in (1, 2, 3, 4))
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
        else:
            d = [0.5, 0.75, 0.9]
        d = [min(max(x, 0.01), k - 0.01) for k, x in enumerate(d, 1)]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        table = table.withColumn("d", cut).withColumn("context", _context(F.col("gram")))
        totals = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        totals = save(totals.select("context", "total", (F.col("left") / F.col("total")).alias("left")), "contexts")
        got = table.join(totals, "context").select("gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("p"), "left")
        if shorter is None:
            got = got.withColumn("lp", F.log(F.col("p") + F.col("left") * math.exp(uniform)))
            backoffs.append(totals.select(F.log("left").alias("lb")))  # of the empty context
        else:
            got = got.withColumn("short", _suffix(F.col("gram"), order)).join(shorter, "short").withColumn("lp", F.log(F.col("p") + F.col("left") * F.exp("slp")))
            backoffs.append(totals.select(F.col("context").alias("gram"), F.log("left").alias("lb")))
        got = save(got.select("gram", "lp"), "probabilities")
        probabilities.append(got)
        shorter = got.select(F.col("gram").alias("short"), F.col("lp").alias("slp"))
    empty = backoffs[0].first()
    return letters, probabilities, [(empty["lb"] if empty else 0.0) + uniform, *backoffs[1:]]


class Tables:
    """A small model in memory, as sorted arrays: the same scores as gram_scores, for a few n-grams at a time."""

    def __init__(self, probabilities: list[DataFrame], backoffs: list):
        self.unseen = backoffs[0]
        self.grams = [self._sorted(t, "lp") for t in probabilities]
        self.contexts = [self._sorted(t, "lb") for t in backoffs[1:]]

    @staticmethod
    def _sorted(table: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
        t = table.select("gram", value).toArrow()
        key, x = np.asarray(t.column(0)).astype(np.int64), np.asarray(t.column(1)).astype(np.float64)
        order = np.argsort(key)
        return key[order], x[order]

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, x = table
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key))
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        return hit, np.where(hit, x[at], 0.0)

    def log_probability(self, gram: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(gram)), np.arange(len(gram))
        for order in range(ORDER, 0, -1):
            key = gram[todo] & ((1 << (BITS * order)) - 1)
            hit, lp = self._look(self.grams[order - 1], key)
            out[todo[hit]] += lp[hit]
            todo, key = todo[~hit], key[~hit]
            if order > 1:
                out[todo] += self._look(self.contexts[order - 2], key >> BITS)[1]
        out[todo] += self.unseen
        return out


def corpus_grams(rows: DataFrame, letters: np.ndarray) -> DataFrame:
    """The written table of the different ORDER-grams of all rows; each batch's are told apart before the shuffle."""

    def grams(it):
        for batch in it:
            found = [np.unique(_grams(*_symbols(part.column(0), letters))[0]) for part in slices(batch, 0, PART_BYTES)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["gram"])

    return save(rows.select("text").mapInArrow(grams, "gram long").distinct(), "corpus-grams")


def gram_scores(grams: DataFrame, probabilities: list, backoffs: list) -> DataFrame:
    """The written table of gram, lp: each gram's log probability, by joins with the sharded tables of counts.

    From the highest order down: a gram that is not scored yet takes the probability of its suffix if that was seen,
    else the backoff of the suffix's context is added and the next shorter one is tried.
    """
    lp = grams.withColumn("lp", F.lit(0.0)).withColumn("open", F.lit(True))
    for order in range(ORDER, 0, -1):
        lp = lp.withColumn("k", F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1)))
        found = probabilities[order - 1].select(F.col("gram").alias("k"), F.col("lp").alias("got"))
        lp = lp.join(found, "k", "left")
        hit = F.col("open") & F.col("got").isNotNull()
        lp = lp.withColumn("lp", F.col("lp") + F.when(hit, F.col("got")).otherwise(0.0)).withColumn("open", F.col("open") & ~hit).drop("got")
        if order > 1:
            left = backoffs[order - 1].select(F.col("gram").alias("ctx"), "lb")
            lp = lp.withColumn("ctx", _context(F.col("k"))).join(left, "ctx", "left")
            lp = lp.withColumn("lp", F.col("lp") + F.when(F.col("open"), F.coalesce("lb", F.lit(0.0))).otherwise(0.0)).drop("lb", "ctx")
    return save(lp.select("gram", (F.col("lp") + F.when(F.col("open"), F.lit(backoffs[0])).otherwise(0.0)).alias("lp")), "gram-scores")


def _sum_broadcast(rows: DataFrame, letters: np.ndarray, scores: DataFrame) -> DataFrame:
    """Documents' sums over their n-grams; the scores of the corpus' n-grams go to every task as two sorted arrays."""
    t = scores.toArrow()
    key, lp = np.asarray(t.column(0)).astype(np.int64), np.asarray(t.column(1)).astype(np.float64)
    order = np.argsort(key)
    shared = rows.sparkSession.sparkContext.broadcast((letters, key[order], lp[order]))

    def score(it):
        letters, keys, lps = shared.value
        for batch in it:
            for part in slices(batch, 2, PART_BYTES):
                key, text = _grams(*_symbols(part.column(2), letters))
                new, which = np.unique(key, return_inverse=True)
                lp = np.bincount(text, lps[np.searchsorted(keys, new)][which], minlength=part.num_rows)
                n = np.bincount(text, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(lp)], names=["doc_id", "lang", "n_symbols", "lp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, lang string, n_symbols long, lp double")


def _sum_joined(rows: DataFrame, letters: np.ndarray, scores: DataFrame) -> DataFrame:
    """The same sums for n-grams of any number: the rows' own meet the scores, then come back to the rows."""

    def grams(it):
        for batch in it:
            for part in slices(batch, 3, PART_BYTES):
                key, text = _grams(*_symbols(part.column(3), letters))
                order = np.lexsort((key, text))
                key, text = key[order], text[order]
                new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
                n = np.diff(np.append(new, len(key)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text[new])), pa.array(key[new]), pa.array(n, pa.int64())], names=["row", "gram", "n"])

    rows = save(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "text"), "scored-rows")
    pairs = rows.mapInArrow(grams, "row long, gram long, n long")
    sums = pairs.join(scores, "gram").groupBy("row").agg(F.sum("n").alias("n_symbols"), F.sum(F.col("n") * F.col("lp")).alias("lp"))
    return rows.drop("text").join(sums, "row").select("doc_id", "lang", "n_symbols", "lp")


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK, broadcast_grams: int = BROADCAST_GRAMS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per document: doc_id, lang, n_symbols, log_prob, perplexity, threshold, kept.

    The model is trained on the whole texts of all documents in trusted_ids (column doc_id). While these are at most
    broadcast_ids, they are broadcast, so training shuffles only n-gram counts. The different n-grams of all documents meet the sharded counts in joins (gram_scores), and the
    documents add up their scores. Perplexity is per character (rare ones of an alphabet of over ALPHABET count twice), the end counted. A language's threshold is slack times the
    quantile of its trusted documents' perplexities; a language without any has that of all trusted documents.

    Null text is empty text. Null language is a language of its own. Without trusted documents every document has
    the same odds and is kept. Null ids are rows like others, and never trusted; a perplexity equal to the threshold
    passes. Repeated rows stay repeated. Empty table: no rows.
    """
    some = save(trusted_ids.select(F.col("doc_id").alias("__id")).distinct(), "trusted-ids")
    some = F.broadcast(some) if some.count() <= broadcast_ids else some
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    trusted = rows.join(some, F.col("doc_id") == F.col("__id"), "left_semi")
    letters, probabilities, backoffs = train(trusted, "text")
    scores = gram_scores(corpus_grams(rows, letters), probabilities, backoffs)
    scored = (_sum_broadcast if scores.count() <= broadcast_grams else _sum_joined)(rows, letters, scores)
    scored = save(scored, "perplexities").withColumn("perplexity", F.exp(-F.col("lp") / F.col("n_symbols")))
    mine = scored.join(some, F.col("doc_id") == F.col("__id"), "left_semi")
    cut = F.percentile_approx("perplexity", quantile, 10_000) * slack
    overall = mine.agg(cut.alias("t")).first()["t"]
    by_lang = mine.groupBy(F.col("lang").alias("__lang")).agg(cut.alias("__t"))
    by_lang = F.broadcast(by_lang) if by_lang.count() <= 100_000 else by_lang
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    threshold = F.coalesce("__t", F.lit(float("inf") if overall is None else overall))
    return out.select("doc_id", "lang", "n_symbols", F.col("lp").alias("log_prob"), "perplexity", threshold.alias("threshold"), (F.col("perplexity") <= threshold).alias("kept"))


def op5_kneser_ney_quality(spark, sf_dir):
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return classify(read_documents(spark, sf_dir), trusted)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
