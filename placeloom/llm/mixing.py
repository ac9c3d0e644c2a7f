"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, read_documents, save, small, text_or_empty

#: Weights by rank of the source, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
#: The weight schedule of each weight class: multipliers at evenly spaced times from 0 to 1, linear between
#: them. The first class fades out, the last one fades in; each is scaled so that its integral is the target.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.4, 1.0, 1.6))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = MAX_PASSES) -> DataFrame:
    """sizes(source, source_size) -> source, source_no, source_size, cls (index of its weight), target.

    Sources share the sum of all sizes by weight; a share above cap times the source's size stops there, and the
    excess is shared again by weight among the others until no share is above. Each round is one aggregate over
    the table of sources, of which two numbers reach the driver; a round caps one source or more.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("source_no", F.row_number().over(order) - 1).withColumn("cls", F.col("source_no") % len(weights))
    t = t.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("cls") + 1)).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    t = save(t, "mix-sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    per_weight, capped = -1.0, 0
    while True:
        full = F.col("most") <= F.col("w") * F.lit(per_weight)
        a = t.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("w"))), F.count(F.when(full, 1))).first()
        if per_weight >= 0 and a[2] == capped or not a[1]:
            break
        capped, per_weight = a[2], max(0.0, (total - (a[0] or 0.0)) / a[1])
    return t.select("source", "source_no", "source_size", "cls", F.least(F.col("most"), F.col("w") * F.lit(per_weight)).alias("target"))


def positions(share: Column, cls: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """The time in [0, 1] at which the share of a source's target has been demanded.

    The schedule is piecewise linear, so the demand (its integral) is piecewise quadratic; the piece is looked up
    by its share of the integral and the quadratic solved in closed form.
    """
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        step = 1.0 / (len(knots) - 1)
        areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:])]
        whole, begun = sum(areas), 0.0
        y = share * whole
        t = F.lit(1.0)
        pieces = []
        for i, area in enumerate(areas):
            a, slope = knots[i], (knots[i + 1] - knots[i]) / step
            z = F.greatest(F.lit(0.0), y - begun)
            # a*x + slope*x^2/2 = z, in the form that also holds for slope 0
            x = 2 * z / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * z)))
            pieces.append((begun + area, i * step + F.least(F.lit(step), x)))
            begun += area
        for upper, value in reversed(pieces):
            t = F.when(y <= upper, value).otherwise(t)
        out = F.when(cls == k, t).otherwise(out)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, seed: int = 17, order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, plan): the training order and one row per document.

    A source's documents stand in a fixed random order (a hash of id, or order_col, and seed). Its target is read off that order
    again and again, at most MAX_PASSES times; the last document reached counts with the words still wanted. Each
    copy stands at the time when its source's cumulative demand reaches the copy's first word.

    copies: doc_id, source_no, start, size, pass, words, position (0 to 1), one row per copy, range-partitioned and
    sorted by position; start is the document's first word in its source's order.
    plan: doc_id, source_no, start, size, source_size, target, taken; documents that the mix leaves out have taken 0.

    Sizes of a source are summed over hash buckets first, so that a hot source's running sum is split over
    many tasks. Null text: size 0. Null source: a source of its own, last in order. Documents of size 0 are
    never taken. Repeated rows: each counts. Null ids are one id; rows of one id stand by size. Empty table: no rows. The table of sources (a row each) is
    numbered in one task, and broadcast only if it is small.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(order_col or id_col, F.lit(seed)).alias("h"))
    docs = save(docs, "mix-sizes")
    n = docs.count()
    buckets = max(1024, n // 10_000)
    docs = docs.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * buckets).cast("long"))
    bucket_sizes = docs.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bucket_sizes = bucket_sizes.withColumn("bucket_start", F.coalesce(before, F.lit(0))).drop("bucket_size")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = rows["source"].eqNullSafe(bucket_sizes["source"]) & (rows["bucket"] == bucket_sizes["bucket"])
    rows = rows.join(bucket_sizes, same).select("doc_id", rows["source"], "size", (F.col("bucket_start") + F.col("inside")).alias("start"))
    sources = save(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-targets")
    if sources.count() <= 100_000:
        sources = F.broadcast(sources)
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop("source")
    wanted = F.round("target").cast("long")
    passes = F.transform(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1)), lambda p: F.struct(p.alias("pass"), F.greatest(F.lit(0), F.least(F.col("size"), wanted - p * F.col("source_size") - F.col("start"))).alias("words"), (p * F.col("source_size") + F.col("start")).alias("at")))
    rows = rows.withColumn("copies", F.filter(passes, lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    share = lambda at: F.least(F.lit(1.0), at / F.col("target"))
    plan = rows.select("doc_id", "source_no", "start", "size", "source_size", "target", taken.alias("taken"))
    copies = rows.select("doc_id", "source_no", "start", "size", "target", "cls", F.explode("copies").alias("c")).select("doc_id", "source_no", "start", "size", F.col("c.pass").alias("pass"), F.col("c.words").alias("words"), positions(share(F.col("c.at")), F.col("cls"), schedules).alias("position"))
    copies = copies.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "pass")
    return copies, plan


def mixed(docs: DataFrame, **columns) -> DataFrame:
    """The documents' rows in training order, a row for each copy, texts whole; documents that the mix leaves out go.

    A row is known by its id, the digest of its text and, of rows equal in both, its number by a hash of all their
    columns; so an id over several texts and null ids take no other row with them, and no row comes more than MAX_PASSES
    times. Null text has no words and is left out, null sources are a source. Ties in position stand by these
    keys, then by copy. Empty table: no rows. Columns of docs stay, whatever their names. Only rows that repeat id and text are
    shuffled to be numbered.
    """
    id_col, text_col = columns.pop("id_col", "doc_id"), columns.get("text_col", "text")
    digest, number, key, copy, position, again = fresh(docs, "digest", "number", "key", "copy", "position", "again")
    rows = docs.withColumn(digest, F.unhex(F.md5(text_or_empty(text_col))))
    same = rows.groupBy(F.col(id_col).alias(key), F.col(digest).alias(again)).agg(F.count(F.lit(1)).alias(number)).filter(F.col(number) > 1)
    same = small(save(same.select(key, again), "mix-repeated"))
    first = F.lit(1)
    if same.limit(1).count():
        on = F.col(id_col).eqNullSafe(F.col(key)) & (F.col(digest) == F.col(again))
        order = Window.partitionBy(id_col, digest).orderBy(F.xxhash64(*docs.columns))
        twice = rows.join(same, on, "left_semi").withColumn(number, F.row_number().over(order))
        rows = rows.join(same, on, "left_anti").withColumn(number, first).union(twice)
    else:
        rows = rows.withColumn(number, first)
    rows = rows.withColumn(key, F.struct(F.col(id_col).alias("id"), F.col(digest).alias("digest"), F.col(number).alias("number")))
    copies, _ = mix(rows, id_col=key, order_col=id_col, **columns)
    copies = small(save(copies.select(F.col("doc_id").alias(again), F.col("pass").alias(copy), F.col("position").alias(position)), "mix-copies"))
    mine = [F.col(f"{key}.{c}").eqNullSafe(F.col(f"{again}.{c}")) for c in ("id", "digest", "number")]
    out = rows.join(copies, mine[0] & mine[1] & mine[2])
    return out.repartitionByRange(position, key).sortWithinPartitions(position, key, copy).select(*docs.columns)


def op3_curriculum_mix(spark, sf_dir):
    """Words taken are added up over the written training order."""
    copies, plan = mix(read_documents(spark, sf_dir))
    copies = save(copies, "mix-order")
    got = copies.groupBy("source_no", "start", "size").agg(F.sum("words").alias("taken"), F.min("position").alias("first_position"), F.count(F.lit(1)).alias("copies"))
    plan = plan.drop("taken").join(got, ["source_no", "start", "size"], "left")
    return plan.withColumn("taken", F.coalesce("taken", F.lit(0))).withColumn("copies", F.coalesce("copies", F.lit(0)))
