"""Quality rules of documents and of hosts; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, fresh, let, read_documents, save, text_or_empty

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Rules whose failures are counted by host. The first two also reject a document by itself.
RULES = ("short", "repeats", "symbols", "lines", "letters")
#: A host goes if, for some rule, its rate of failing documents is credibly above MIN_HOST_RATE and above HOST_FACTOR
#: times the median host's: the shrunken rate less CREDIBLE standard deviations of its posterior.
MIN_HOST_RATE = 0.3
HOST_FACTOR = 2.0
CREDIBLE = 1.645
#: Bounds of the prior's strength, in documents.
STRENGTH = (10.0, 1e6)
#: Up to so many hosts the table of hosts is broadcast; beyond, it is joined by salted keys.
BROADCAST_HOSTS = 200_000
SALTS = 64


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the text, the first time included.

    Windows are hashed to 64 bits; where no hash occurs twice, no window does. Else windows are compared by 96 bits of
    two hashes within the text, sorted with their places; runs of equal hashes give the covered places, of which each word
    counts once. n log n in the words of the text.
    """
    of = lambda w, i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(*of(words, i)))
    windows = lambda h: F.transform(h, lambda x, i: F.struct(x.alias("h"), F.hash(*of(words, i)).alias("g"), i.alias("i")))
    same = lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"])
    pairs = lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    begins = lambda h: F.array_sort(F.array_distinct(F.flatten(let(F.array_sort(windows(h)), pairs))))
    gaps = lambda b: F.zip_with(F.slice(b, 1, F.size(b) - 1), F.slice(b, 2, F.size(b) - 1), lambda x, y: F.least(F.lit(3), y - x))
    covered = lambda b: F.when(F.size(b) == 0, 0).otherwise(F.aggregate(gaps(b), F.lit(3), lambda t, g: t + g))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(begins(h), covered)))
    return F.when(F.size(words) < 4, 0).otherwise(found).cast("long")


def features(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a text. Null text: all 0."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).alias("repeats")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again")))
    plain = text
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    made = lambda w, x: F.struct(
        w["n"].alias("n_words"), w["chars"].alias("word_chars"), (F.char_length(text) - F.char_length(plain)).cast("long").alias("n_symbols"),
        x["n"].alias("n_lines"), x["again"].alias("n_dup_lines"), w["repeats"].alias("n_repeat_words"),
    )
    return let(by_words, lambda w: let(by_lines, lambda x: made(w, x)))


def failures(f: Column) -> dict[str, Column]:
    """rule -> whether a document with these features fails it. Rules other than "short" ask nothing of a text without words."""
    n = f["n_words"]
    return {
        "short": n < MIN_WORDS,
        "repeats": 100 * f["n_repeat_words"] > 50 * n,
        "symbols": 10 * f["n_symbols"] > n,
        "lines": 10 * f["n_dup_lines"] > 3 * f["n_lines"],
        "letters": (n > 0) & ~f["word_chars"].between(3 * n, 10 * n),
    }


def base_failed(failed: dict[str, Column]) -> Column:
    return failed["short"] | failed["repeats"]


def host_verdicts(rows: DataFrame, host: str, failed: dict[str, Column], min_rate: float = MIN_HOST_RATE, factor: float = HOST_FACTOR) -> DataFrame:
    """host, n, host_ok, host_rules (the rules that reject it), and of each rule fails_<rule> and rate_<rule>.

    rate: the host's share of failing documents, shrunk by an empirical beta prior. The prior's mean is the share of
    all documents that fail; its strength comes from the spread of the hosts' own rates beyond what their sizes
    explain (moments). A host of few documents stays near the mean; one with many goes by its own rate.

    A host is rejected by a rule if rate - CREDIBLE * sd is above min_rate and above factor times the median of
    the hosts' rates, where sd is the posterior's; so where all hosts are alike, none goes, whatever the rate.

    Null is a host of its own. Sums over hosts reach the driver, a row for each rule; the table of hosts does not.
    """
    counted = [F.count(F.when(x, 1)).alias(f"fails_{r}") for r, x in failed.items()]
    hosts = save(rows.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *counted), "hosts")
    s = hosts.agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("nn"), F.count(F.lit(1)).alias("hosts"), *[F.sum(f"fails_{r}").alias(r) for r in failed]).first()
    n, k = s["n"] or 0, s["hosts"]
    mean = {r: (s[r] or 0) / n if n else 0.0 for r in failed}
    spread = hosts.agg(*[F.sum(F.col("n") * (F.col(f"fails_{r}") / F.col("n") - mean[r]) ** 2).alias(r) for r in failed]).first()
    rates, bad = {}, {}
    for r in failed:
        chance = mean[r] * (1 - mean[r])
        between = (spread[r] - (k - 1) * chance) / (n - s["nn"] / n) if k > 1 else 0.0
        strength = min(STRENGTH[1], max(STRENGTH[0], chance / between - 1)) if between > 0 else STRENGTH[1]
        rate = (F.col(f"fails_{r}") + F.lit(strength * mean[r])) / (F.col("n") + F.lit(strength))
        sd = F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(strength + 1)))
        rates[r], bad[r] = rate, rate - F.lit(CREDIBLE) * sd
    rated = hosts.select("*", *[c.alias(f"rate_{r}") for r, c in rates.items()])
    middle = rated.agg(*[F.percentile_approx(f"rate_{r}", 0.5, 10_000).alias(r) for r in failed]).first()
    cut = {r: max(min_rate, factor * (middle[r] or 0.0)) for r in failed}
    rules = F.filter(F.array(*[F.when(bad[r] > cut[r], r) for r in failed]), lambda x: x.isNotNull())
    return rated.withColumn("host_rules", rules).withColumn("host_ok", F.size("host_rules") == 0)


def join_hosts(rows: DataFrame, hosts: DataFrame, host: str, salt_by: str, most: int = BROADCAST_HOSTS) -> DataFrame:
    """rows with the struct `verdict` (the columns of hosts but host); hosts are broadcast if they are `most` or fewer,
    else repeated SALTS times so that a hot host's rows spread."""
    key, salt, mine, verdict = fresh(rows, "host_key", "host_salt", "row_salt", "verdict")
    hosts = save(hosts.select(F.col("host").alias(key), F.struct(*[c for c in hosts.columns if c != "host"]).alias(verdict)), "host-verdicts")
    if hosts.count() <= most:
        return rows.join(F.broadcast(hosts), F.col(host).eqNullSafe(F.col(key))).drop(key)
    hosts = hosts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn(mine, F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    return rows.join(hosts, F.col(host).eqNullSafe(F.col(key)) & (F.col(mine) == F.col(salt))).drop(mine, salt, key)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_rate: float = MIN_HOST_RATE, factor: float = HOST_FACTOR) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    failed_rules, host_rules, host_rate (the largest of its host's shrunken rates).

    A document fails by its own rules if it has under 50 words or over half of its words stand in repeated
    3-word windows. kept: it does not fail and its host is not rejected (host_verdicts, over all RULES). The features
    are computed once and written, without text; a table of hosts comes back to the rows.

    Null text: no words, so it fails. Null ids are rows like others. Null host: a host of its own. Repeated rows
    count each. Ties (a host's bound equal to the cut) stay. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host_name"), features(F.col(text_col)).alias("f"))
    rows = save(rows, "quality-features")
    failed = failures(F.col("f"))
    hosts = host_verdicts(rows, "host_name", failed, min_rate, factor)
    out = join_hosts(rows, hosts, "host_name", "doc_id")
    own = F.filter(F.array(*[F.when(x, r) for r, x in failed.items()]), lambda x: x.isNotNull())
    rate = F.greatest(*[F.col(f"verdict.rate_{r}") for r in failed])
    return out.select(
        "doc_id", *[F.col(f"f.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(failed).alias("base_failed"), (~base_failed(failed) & F.col("verdict.host_ok")).alias("kept"),
        own.alias("failed_rules"), F.col("verdict.host_rules").alias("host_rules"), rate.alias("host_rate"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", salt_by: str = "doc_id", min_rate: float = MIN_HOST_RATE, factor: float = HOST_FACTOR) -> DataFrame:
    """docs without the rows that judge rejects; the columns of docs, whatever their names.

    One pass over the text: rows are written with their failures (a row that fails by itself without its text, as
    only its host's count needs it), hosts are judged from them, and the rows left are filtered. No text is shuffled.
    Null text fails; null ids, null hosts, repeated rows and an empty table are as in judge.
    """
    flags = fresh(docs, "flags")[0]
    rows = docs.withColumn(flags, let(features(F.col(text_col)), lambda f: F.struct(*[x.alias(r) for r, x in failures(f).items()])))
    failed = {r: F.col(f"{flags}.{r}") for r in RULES}
    rows = save(rows.withColumn(text_col, F.when(~base_failed(failed), F.col(text_col))), "quality-rows")
    hosts = host_verdicts(rows, host_col, failed, min_rate, factor)
    verdict = fresh(rows, "verdict")[0]
    out = join_hosts(rows.filter(~base_failed(failed)), hosts, host_col, salt_by)
    return out.filter(F.col(f"{verdict}.host_ok")).select(*docs.columns)


def op9_host_rules(spark, sf_dir):
    return judge(read_documents(spark, sf_dir))
