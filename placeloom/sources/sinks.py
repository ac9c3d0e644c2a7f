"""Sinks: append-only history, snapshots with a pointer, dead letters, overflow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DLQ_BYTES = 32 * 1024
OVERFLOW_BYTES = 64 * 1024


def append_history(rows: DataFrame, path: str, run_id: str) -> None:
    """Rows of a run; a run written again replaces itself, never another."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run_id}")


def write_snapshot(df: DataFrame, path: str) -> str:
    """A new generation directory; the pointer table is appended last, so readers see a whole one."""
    gen = uuid.uuid4().hex
    df.write.parquet(f"{path}/gen={gen}")
    spark = df.sparkSession
    spark.range(1).select(F.current_timestamp().alias("at"), F.lit(gen).alias("gen")).coalesce(1).write.mode("append").parquet(f"{path}/_pointer")
    return gen


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest generation."""
    last = spark.read.schema("at timestamp, gen string").parquet(f"{path}/_pointer").agg(F.max_by("gen", "at").alias("gen")).first()["gen"]
    return spark.read.parquet(f"{path}/gen={last}")


def sync_buckets(spark: SparkSession, path: str, batch: DataFrame, key: str, merge, buckets: int = 64) -> None:
    """Bring a table kept in buckets of its key up to date: only buckets that the batch touches are read and written again.

    merge(state, batch) gives the new rows. Each bucket's newest generation is named in the pointer table, which is appended last.
    """
    number = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    batch = batch.withColumn("__bucket", number)
    touched = [r[0] for r in batch.select("__bucket").distinct().collect()]
    if not touched:
        return
    before = read_buckets(spark, path, batch.drop("__bucket"), touched)
    gen = uuid.uuid4().hex
    merged = merge(before, batch.drop("__bucket")).withColumn("__bucket", number)
    merged.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/gen={gen}")
    spark.createDataFrame([(b, gen) for b in sorted(touched)], "bucket int, gen string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/_pointer")


def read_buckets(spark: SparkSession, path: str, like: DataFrame, some: list[int] | None = None) -> DataFrame:
    """The newest generation of each bucket (or of some), with the columns of `like`; no rows where nothing is written yet."""
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_pointer")
    if not pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer):
        return like.limit(0)
    last = spark.read.schema("bucket int, gen string, at timestamp").parquet(f"{path}/_pointer").groupBy("bucket").agg(F.max_by("gen", "at").alias("gen")).collect()
    paths = [f"{path}/gen={r['gen']}/__bucket={r['bucket']}" for r in last if some is None or r["bucket"] in some]
    return spark.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)


def dead_letters(rows: DataFrame, payload: str, most: int = DLQ_BYTES) -> DataFrame:
    """Payload stays valid JSON: above `most` bytes an envelope of its size and beginning; other text is the raw of an object.

    try_parse_json stops after the first value ("12 monkeys" parses), so a payload must also parse as the only item of an
    array and as the value of an object: what may follow a value in both is blank.
    """
    n = F.octet_length(payload)
    envelope = F.to_json(F.struct(F.lit(True).alias("truncated"), n.alias("size_bytes"), F.substring(payload, 1, 1000).alias("preview")))
    valid = F.when(F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), payload, F.lit("}"))).isNotNull(), F.col(payload)).otherwise(F.to_json(F.struct(F.col(payload).alias("raw"))))
    return rows.withColumn(payload, F.when(n > most, envelope).otherwise(valid))


def overflow(rows: DataFrame, payload: str, most: int = OVERFLOW_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows with large payloads replaced by payload_ref, table of payload_ref and payload)."""
    big = F.octet_length(payload) > most
    r = rows.withColumn("payload_ref", F.when(big, F.sha2(payload, 256)))
    side = r.filter("payload_ref is not null").select("payload_ref", payload).dropDuplicates(["payload_ref"])
    return r.withColumn(payload, F.when(F.col("payload_ref").isNull(), F.col(payload))), side


def traces_with_feedback(traces: DataFrame, feedback: DataFrame, newest: int) -> DataFrame:
    return traces.join(feedback.select("trace_id").distinct(), "trace_id", "left_semi").orderBy(F.desc("created_at"), "trace_id").limit(newest)
