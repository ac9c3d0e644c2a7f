"""A stored inverted index over the fields of documents, and searches of it that skip what cannot rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.graph import written
from .ranking import with_rank
from .search import K1, B, small

#: Documents of a range. A term's documents in a range are one block of postings.
RANGE_DOCS = 4096
#: Ranges that a search scores first, to know what a document must reach.
FIRST_RANGES = 4
#: Weights of a document's fields.
FIELD_WEIGHTS = {"title": 3.0, "context": 2.0, "description": 1.0}


def build(docs: DataFrame, fields: list[str], path: str, range_docs: int = RANGE_DOCS) -> None:
    """Write the index of docs (doc, and an array of words for each field) under path: tables postings, terms, fields.

    postings: a row for each term, field and range of documents (by hash): its documents with frequency and length, and
    the most that one of them can score. A common term has a row for each range, so no row and no task holds all its
    documents. Null and empty fields have no words; a document without any word is not in the index; words of a
    repeated document add up.
    """
    spark = docs.sparkSession
    docs = written(docs.select("doc", *fields), "field-words")
    ranges = max(1, -(-docs.select("doc").distinct().count() // range_docs))
    long_form = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.filter(F.col(f), lambda w: w.isNotNull()).alias("words")) for f in fields])).alias("x")
    sizes = docs.select("doc", long_form).filter(F.size("x.words") > 0).groupBy("doc", "x.field").agg(F.sum(F.size("x.words")).alias("len"))
    sizes.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).write.parquet(f"{path}/fields")
    stats = F.broadcast(spark.read.parquet(f"{path}/fields"))  # a row for each field
    # a range's words are brought to one task (few ranges to each), where its blocks are made; nothing longer is shuffled
    rows = docs.withColumn("range", F.pmod(F.xxhash64("doc"), F.lit(ranges))).repartition(4 * ranges, "range").select("range", "doc", long_form)
    counted = rows.select("range", "doc", "x.field", F.explode("x.words").alias("term")).groupBy("range", "doc", "field", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = counted.withColumn("len", F.sum("tf").over(Window.partitionBy("range", "doc", "field")))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    blocks = counted.join(stats, "field").withColumn("w", weight).groupBy("term", "field", "range").agg(F.max("w").alias("most"), F.collect_list(F.struct("doc", "w")).alias("docs"))
    blocks.sortWithinPartitions("term", "field", "range").write.parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("field", "term").agg(F.sum(F.size("docs").cast("long")).alias("df")).write.parquet(f"{path}/terms")


def search(spark: SparkSession, path: str, queries: DataFrame, top: int, weights: dict[str, float] | None = None, first_ranges: int = FIRST_RANGES) -> DataFrame:
    """query_id, doc, score, rank: the best documents of queries (query_id, words), each by its best field: weight times BM25.

    A range's bound for a query are the best fields' most possible scores, from the heads of its blocks alone. The ranges of
    highest bound are scored first; ranges whose bound is below the score of the `top`-th document found there cannot
    rank, and their postings are not read. The result is that of scoring every document. Words count once in a query;
    null words: no hits.
    """
    weights = weights or FIELD_WEIGHTS
    boost = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, float(w))])
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("term")).filter("term is not null")
    fields = F.broadcast(spark.read.parquet(f"{path}/fields").filter(F.col("field").isin(*weights)))
    known = spark.read.parquet(f"{path}/terms").join(small(asked.select("term").distinct()), "term").join(fields, "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = written(asked.join(known.select("term", "field", (boost[F.col("field")] * idf).alias("idf")), "term"), "query-terms")
    postings = spark.read.parquet(f"{path}/postings")
    parts = 4 * ((postings.agg(F.max("range")).first()[0] or 0) + 1)
    heads = postings.select("term", "field", "range", "most").join(small(terms), ["term", "field"])
    bound = heads.groupBy("query_id", "range", "field").agg(F.sum(F.col("idf") * F.col("most")).alias("b")).groupBy("query_id", "range").agg(F.max("b").alias("bound"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    bound = written(bound.withColumn("i", best), "range-bounds")

    def scored(ranges):
        # ranges stay whole: a block is read once for all queries, and its documents are scored where it is
        wanted = ranges.select("query_id", "range")
        asked_blocks = postings.join(small(wanted.select("range").distinct()), "range", "left_semi").join(small(terms.select("term", "field").distinct(), 500_000), ["term", "field"], "left_semi")
        blocks = asked_blocks.repartition(parts, "range").join(small(terms, 500_000), ["term", "field"]).join(small(wanted, 500_000), ["query_id", "range"], "left_semi")
        hits = blocks.select("range", "query_id", "field", "idf", F.explode("docs").alias("d"))
        by_field = hits.groupBy("range", "query_id", F.col("d.doc").alias("doc"), "field").agg(F.sum(F.col("idf") * F.col("d.w")).alias("s"))
        best_field = by_field.groupBy("range", "query_id", "doc").agg(F.max("s").alias("score"))
        return with_rank(best_field, ["query_id"], "score", "doc").filter(F.col("rank") <= top).select("query_id", "doc", "score")

    first = written(scored(bound.filter(F.col("i") <= first_ranges)), "first-scores")
    least = with_rank(first, ["query_id"], "score", "doc").filter(F.col("rank") == top).select("query_id", F.col("score").alias("least"))
    # sums in another order may differ in their last digits
    rest = bound.filter(F.col("i") > first_ranges).join(small(least), "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") * (1 + 1e-9) >= F.col("least")))
    return with_rank(first.union(scored(rest)), ["query_id"], "score", "doc").filter(F.col("rank") <= top)
