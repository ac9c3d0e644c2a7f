"""Exact duplicates: groups of one 128-bit content hash, split by comparing bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, attach, fresh, save, small, text_or_empty


#: Up to so many repeated hashes are broadcast, so that only texts which may be copies are shuffled.
BROADCAST_HASHES = 500_000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_HASHES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id stays.
    Each row's 128-bit MD5 is counted first, without text. Texts whose MD5 occurs twice or more are then grouped by
    MD5 and text, which compares the bytes, so a hash collision makes two groups. While at most `most` hashes are
    repeated, these are broadcast and only their texts are shuffled; beyond, each distinct text is, once. Copies meet
    in the map-side part of that grouping, so a text that a third of all rows share costs one row per map task. The
    groups come back to the rows by (MD5, SHA-256), hot groups by a bounded broadcast.

    Null text counts as empty text. Null ids never stay while another id is in the group (of a group of null
    ids only exactly one row stays). Rows repeated with the same id and text: exactly one stays. Empty table: no rows.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_or_empty(text_col)).alias("norm"))
    rows = rows.withColumn("md5", F.unhex(F.md5("norm")))
    narrow = save(rows.select("doc_id", "md5", F.sha2("norm", 256).alias("text_sha256")), "exact-hashes")
    twice = save(narrow.groupBy("md5").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("md5"), "exact-repeated")
    if twice.count() <= most:
        rows = rows.join(F.broadcast(twice), "md5", "left_semi")
    groups = (
        rows.groupBy("md5", "norm")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("md5", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    groups = save(groups, "exact-groups")
    out = attach(narrow, groups, ["md5", "text_sha256"], "group_size", narrow.count(), F.xxhash64("doc_id"))
    single = F.col("group_size").isNull()
    out = out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
    )
    again = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("keep_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", (stays & (again == 1)).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each text, the one that exact_groups keeps; all columns stay, whatever their names.

    Rows go by id and digest of the text together, so neither null ids nor one id over several texts take another
    row with them. Of rows equal in both one stays, also where the ids are null. Null text is empty text: of all null
    and empty texts one row stays. Empty table: no rows.
    """
    gone_id, gone_sha, again, digest = fresh(docs, "gone_id", "gone_sha", "again", "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias(again)
    found = exact_groups(docs, id_col, text_col).filter("not kept")
    found = save(found.select(F.col("doc_id").alias(gone_id), F.unhex("text_sha256").alias(gone_sha), stays).distinct(), "exact-dropped")
    rows = docs.withColumn(digest, F.unhex(F.sha2(ascii_lower(text_or_empty(text_col)), 256)))
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(digest) == F.col(gone_sha))
    gone = save(found.filter(~F.col(again)).drop(again), "exact-gone")
    rows = rows.join(small(gone), same, "left_anti")
    twice = found.filter(again)
    if twice.limit(1).count():  # rows repeated under the id that stays
        rows = rows.join(twice, same, "left").drop(gone_id, gone_sha)
        once = rows.filter(F.col(again).isNull())
        rows = once.union(rows.filter(again).dropDuplicates([id_col, digest]))
    return rows.select(*docs.columns)


def op2_exact_dedup(spark, sf_dir):
    from .common import read_documents

    return exact_groups(read_documents(spark, sf_dir))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
