"""SimHash fingerprints of documents and of edited documents, and search by permuted block tables; DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, read_documents, save, text_or_empty

#: Bits of a fingerprint: two longs.
BITS = 128
RADIUS = 3
#: The bits are cut into BLOCKS blocks; two fingerprints that differ in RADIUS bits agree on BLOCKS - RADIUS of them.
BLOCKS = 6
#: Counters of two bits share a long: bit i and bit i + 32, 32 bits each. Weights of a text add up to its length, which is below 2^31.
LANES = 0x0000000100000001


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, f1, f2 of each different value of keys: the SimHash of its text (of all its texts, if rows repeat keys).

    Terms are words; each occurrence votes with the word's number of code points, so a term weighs its frequency
    times its length. A bit is 1 if the hashes of terms of over half the weight have it. No word, or null:
    fingerprint zero. Equal texts have equal fingerprints. Two counters of 32 bits share a long, so the 128 sums take 64
    columns; they are summed in generated code where the words stand, and a row for each key is all that may be shuffled.
    """
    words = rows.select(*keys, F.explode(F.split(text_or_empty(text_col), f"[{SPACES}]+")).alias("word"))
    votes = words.select(*keys, F.char_length("word").cast("long").alias("w"), F.xxhash64("word").alias("h1"), F.xxhash64(F.lit(BITS), "word").alias("h2"))
    lane = lambda h, i: F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * F.col("w"))
    sums = votes.groupBy(*keys).agg(F.sum("w").alias("w"), *[lane(h, i).alias(f"{h}_{i}") for h in ("h1", "h2") for i in range(32)])

    def bits(h: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            low, high = F.col(f"{h}_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{h}_{i}", 32)
            for k, votes_for in ((i, low), (i + 32, high)):
                out = out.bitwiseOR(F.when(2 * votes_for > F.col("w"), F.lit((1 << k) - ((1 << 64) if k == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return sums.select(*keys, bits("h1").alias("f1"), bits("h2").alias("f2"))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def likeness(bits: Column) -> Column:
    """The cosine of two texts' term weights that this many differing bits tell, not below 0: a bit differs with probability angle / pi."""
    return F.greatest(F.lit(0.0), F.cos(bits * F.lit(3.141592653589793 / BITS)))


def block_tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[tuple[int, int, int]]:
    """(blocks as bits, mask of the first long, mask of the second) of each table: every choice of blocks - radius blocks.

    A table's key are the bits of its blocks, as if they were permuted to the front; fingerprints within the radius
    of each other agree on the key of one table at least.
    """
    bits = lambda b: sum(1 << i for i in range(BITS * b // blocks, BITS * (b + 1) // blocks))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(bits(b) for b in chosen)
        out.append((sum(1 << b for b in chosen), signed(mask & ((1 << 64) - 1)), signed(mask >> 64)))
    return out


def within(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """q1, q2, f1, f2, bits: of all fingerprints of queries and of corpus (columns f1, f2), those at most `radius` bits apart, once each.

    Both sides stand in the block tables under (table, key) and meet where these are equal. A pair comes out only in the
    first of the tables in which it meets, told by its lowest agreeing blocks, so nothing is made distinct
    afterwards. Equal fingerprints of one side are one. Null fingerprints meet nothing. No pair is lost, and the
    rows of a crowded bucket are those of the result; a join of skewed keys splits them.
    """
    tables = block_tables(radius, blocks)
    rows = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for t, a, b in tables])
    one = [m for m in block_tables(blocks - 1, blocks)]

    def keyed(df: DataFrame, x: str) -> DataFrame:
        df = df.select("f1", "f2").filter("f1 is not null and f2 is not null").distinct().select(F.col("f1").alias(f"{x}1"), F.col("f2").alias(f"{x}2"), F.explode(rows).alias("m"))
        return df.select(f"{x}1", f"{x}2", F.col("m.t").alias("t"), F.col(f"{x}1").bitwiseAND(F.col("m.a")).alias("a"), F.col(f"{x}2").bitwiseAND(F.col("m.b")).alias("b"))

    x1, x2 = F.col("q1").bitwiseXOR(F.col("f1")), F.col("q2").bitwiseXOR(F.col("f2"))
    agree = sum((F.when((x1.bitwiseAND(F.lit(a)) == 0) & (x2.bitwiseAND(F.lit(b)) == 0), F.lit(t)).otherwise(F.lit(0)) for t, a, b in one), F.lit(0))
    first, left = F.lit(0), agree
    for _ in range(blocks - radius):
        first, left = first + left.bitwiseAND(-left), left.bitwiseAND(left - 1)
    bits = distance(F.col("q1"), F.col("q2"), F.col("f1"), F.col("f2"))
    met = keyed(queries, "q").join(keyed(corpus, "f"), ["t", "a", "b"])
    return met.filter((bits <= radius) & (F.col("t") == first)).select("q1", "q2", "f1", "f2", bits.alias("bits"))


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The written table of k1, k2 (128 bits of id and text together), doc_id, n_chars, copies (rows with both equal) and p1, p2, p_chars: key and n_chars of the one before.

    Order: id, nulls first, then the keys; the first one follows the last. Only ids and lengths are range-partitioned;
    of a range's neighbours, one row each meets in a task.
    """
    order = ["doc_id", "k1", "k2"]
    rows = keyed_rows(docs, id_col, text_col).groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min(F.char_length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    rows = save(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "document-order")
    me = F.struct(*order, "n_chars")
    ends = rows.groupBy("part").agg(F.max(me).alias("last"))
    parts = Window.orderBy("part")
    ends = ends.select(F.col("part").alias("at"), F.coalesce(F.lag("last").over(parts), F.last("last").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    before = F.coalesce(F.lag(me).over(Window.partitionBy("part").orderBy(*order)), F.col("before"))
    rows = rows.join(F.broadcast(ends), rows["part"] == ends["at"]).withColumn("b", before)  # a row for each partition
    return save(rows.select("k1", "k2", "doc_id", "n_chars", "copies", F.col("b.k1").alias("p1"), F.col("b.k2").alias("p2"), F.col("b.n_chars").alias("p_chars")), "document-neighbours")


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2, doc_id, text (null: empty)."""
    id_, text = F.col(id_col), text_or_empty(text_col)
    return docs.select(F.xxhash64(id_.isNull(), id_, text).alias("k1"), F.xxhash64(F.lit(2), text, id_, id_.isNull()).alias("k2"), id_.alias("doc_id"), text.alias("text"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, f1, f2.

    The edited text: the last quarter of the code points (rounded down) replaced by as many first ones of the next
    document (all, if it has fewer), by ascending id; after the last comes the first. near_*: likeness of fingerprints.

    Texts are shuffled once, by their key, and of each next document the wanted beginning; words are counted where
    the text then stands. Null text is empty (fingerprint zero, near to other empty texts by 1). Null ids come first.
    Of one id, rows stand by a hash of their texts; rows that repeat id and text follow each other, and are worked
    on once. Empty table: no rows. Other columns are not read.
    """
    order = neighbours(docs, id_col, text_col)
    texts = keyed_rows(docs, id_col, text_col).select("k1", "k2", "text")
    repeats = bool(order.filter("copies > 1").limit(1).count())
    if repeats:
        texts = texts.dropDuplicates(["k1", "k2"])
    whole = texts.join(order.select("k1", "k2", "n_chars", "copies", "p1", "p2", "p_chars"), ["k1", "k2"])
    heads = whole.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.substring("text", F.lit(1), F.floor(F.col("p_chars") / 4).cast("int")).alias("head"))
    whole = whole.join(heads, ["k1", "k2"])
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    stays = F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int"))
    version = lambda v, t: F.struct(F.lit(v).alias("v"), t.alias("text"))
    versions = [version(0, F.col("text")), version(1, F.concat(stays, "head"))]
    if repeats:
        versions.append(F.when(F.col("copies") > 1, version(2, F.concat(stays, F.substring("text", F.lit(1), quarter)))))
    rows = whole.select("k1", "k2", F.explode(F.array(*versions)).alias("x")).filter("x is not null")
    rows = rows.select("k1", "k2", F.col("x.v").alias("v"), F.when(F.col("x.v") > 0, F.unhex(F.sha2("x.text", 256))).alias("sha"), F.col("x.text").alias("text"))
    made = save(fingerprints(rows, ["k1", "k2", "v", "sha"], "text"), "document-fingerprints")

    of = lambda v, names: made.filter(F.col("v") == v).select("k1", "k2", *[F.col(c).alias(n) for c, n in names.items()])
    mine = order.join(of(0, {"f1": "f1", "f2": "f2"}), ["k1", "k2"])
    after = mine.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    edited = {"f1": "e1", "f2": "e2", "sha": "sha"}
    out = mine.join(of(1, edited), ["k1", "k2"]).join(after, ["k1", "k2"])
    if repeats:
        again = mine.filter("copies > 1").join(of(2, edited), ["k1", "k2"]).withColumns({"g1": F.col("f1"), "g2": F.col("f2")})
        part = 1 << 16  # of a row's copies, not all at once
        again = again.withColumn("more", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 2) / part))))
        again = again.withColumn("more", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(part), F.col("copies") - 1 - F.col("more") * part)))).drop("more")
        out = out.unionByName(again)
    text = lambda a, b: F.lower(F.concat(F.lpad(F.hex(b), 16, "0"), F.lpad(F.hex(a), 16, "0")))
    return out.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), text("f1", "f2").alias("fingerprint"), text("e1", "e2").alias("edited_fingerprint"),
        likeness(distance(F.col("f1"), F.col("f2"), F.col("e1"), F.col("e2"))).alias("near_edited"),
        likeness(distance(F.col("f1"), F.col("f2"), F.col("g1"), F.col("g2"))).alias("near_next"), "f1", "f2",
    )


def count_within(rows: DataFrame, asked: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """rows (f1, f2 and others) with n_within: for the rows asked for, the number of rows within the radius, itself included; null for others."""
    sizes = save(rows.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(asked, F.lit(False))).alias("asked")), "fingerprint-sizes")
    found = within(sizes.filter("asked"), sizes, radius, blocks).join(sizes.select("f1", "f2", "n"), ["f1", "f2"])
    counts = found.groupBy(F.col("q1").alias("f1"), F.col("q2").alias("f2")).agg(F.sum("n").alias("n_within"))
    return rows.filter(asked).join(counts, ["f1", "f2"]).select(*rows.columns, "n_within").union(rows.filter(~F.coalesce(asked, F.lit(False))).withColumn("n_within", F.lit(None).cast("long")))


def op13_simhash_blocks(spark, sf_dir):
    rows = save(compare(read_documents(spark, sf_dir)), "compared-documents")
    return count_within(rows, F.col("doc_id") % 20 == 0).drop("f1", "f2")
