"""Connected components and walks over link tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, a new local folder in local mode (tests); on a cluster this raises."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot if it holds at least 1/HOT_PARTS of all rows; so many keys at most are.
HOT_PARTS = 1000


def attach(rows: DataFrame, values: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows JOIN values USING (key), values having one row for each key and its number of rows, n: hot keys' values go to all tasks, so their rows need not meet in one."""
    hot = F.col(n) * HOT_PARTS >= total
    few = F.broadcast(values.filter(hot).drop(n))
    return rows.join(few, key).union(rows.join(few, key, "left_anti").join(values.filter(~hot).drop(n), key))


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for links (u, v); ids of any one type that has an order.

    Large-star and small-star steps in turn, until the links stay: each node's larger neighbours are linked to its smallest
    neighbour (or itself), then its smaller ones are. A hub's links are reduced where they stand and come by its smallest
    neighbour without meeting in one task (attach); each step's links are written, their count and a checksum reach
    the driver. Nulls and loops are no links. No links: no rows.
    """
    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least(e, low):
        return e.groupBy("u").agg(low.alias("m"), F.count(F.lit(1)).alias("n"))

    e = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    was, now = None, state(e)
    while now != was and now[0]:
        both = e.union(e.select("v", "u"))
        low = least(both, F.least(F.min("v"), F.col("u")))
        e = attach(both.filter("v > u"), low, "u", "n", now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = written(e, "links")
        low = least(e, F.min("v"))
        moved = attach(e, low, "u", "n", now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = written(moved.union(low.select("u", "m")).distinct(), "links")
        was, now = now, state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def leaders(links: DataFrame) -> DataFrame:
    """node, leader of each node of the links (u, v, score), u being before v: items taken in order, each joins the best earlier leader that it is linked to (the earliest of equal ones), or leads itself.

    In rounds: a node without an earlier node that may lead is a leader; nodes linked to a leader are members; what a
    member was linked to no longer counts. So a round decides all nodes whose earlier ones are decided, and there are as
    many rounds as such a chain is long, not as there are items. A leader and its members are links, not a group of pairs.
    """
    every = written(links.filter("u <> v").select("u", "v", "score"), "ordered-links")
    left, members = written(every.select("u", "v").distinct(), "undecided-links"), every.select(F.col("v").alias("node")).limit(0)
    while left.limit(1).count():
        lead = left.select("u").distinct().join(left.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        joined = written(left.join(lead, "u", "left_semi").select(F.col("v").alias("node")).distinct(), "members")
        members = members.union(joined)
        left = left.join(joined.withColumnRenamed("node", "v"), "v", "left_anti").join(joined.withColumnRenamed("node", "u"), "u", "left_anti")
        left = written(left.select("u", "v"), "undecided-links")
    led = every.join(members.withColumnRenamed("node", "u"), "u", "left_anti").join(members.withColumnRenamed("node", "v"), "v", "left_semi")
    best = led.groupBy(F.col("v").alias("node")).agg(F.min_by("u", F.struct(-F.col("score"), F.col("u"))).alias("leader"))
    alone = every.select("u").union(every.select("v")).distinct().join(members.withColumnRenamed("node", "u"), "u", "left_anti")
    return best.union(alone.select("u", "u"))
