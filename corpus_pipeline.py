"""From raw documents to token ids: quality rules, exact and near duplicates out, mixed to target weights, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder
and rereads it as the next one's docs; a stage's own tables are deleted once it is written. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from placeloom.llm.common import read_documents, save, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail their own rules or whose host is rejected go. Null or empty text fails; null ids and null hosts are values like others; repeated rows stay or go together; extra columns stay."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays, of rows equal in both one. Null text is empty text; a null id stays only where its texts have no other; extra columns stay."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the smallest doc_id stays. Null and empty texts are one set; a null id stays only where its component has no other; rows go by id and text together; extra columns stay."""
    return simhash.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, a row for each time that the mix reads them; those that it leaves out go.

    Texts without words are left out; null sources are a source; null ids, and ids over several texts, are rows of their own; ties in position stand by id.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the ids and of the text that they decode to, a row for each row of docs. Null text has no ids; null ids and repeated rows are rows like others; extra columns go."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select("doc_id", "text")
    # less text at once than op10 takes, as earlier stages have grown the executors
    both = bpe.encode(rows, ranks, public_tokenizers.PATTERN, decoded="decoded", keep_text=False, corpus_bytes=2 << 20)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", bpe.ids_digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("curriculum mix", mix), ("byte-level BPE", tokens)]

#: SQL expresses neither SimHash components nor BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        with scratch(spark):
            docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"), kept=True)
    return docs
