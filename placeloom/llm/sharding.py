"""Sharding on a consistent-hash ring with virtual nodes and bounded loads; DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_documents, text_or_empty

#: The ring has this many points; keys and virtual nodes stand on points, so the ring fits a bounded table.
POINTS = 1 << 16
VIRTUAL_NODES = 128


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES, points: int = POINTS) -> list[tuple[int, int]]:
    """(point, shard) of each virtual node, by point; of two on one point the smaller shard stays.

    A node's point depends on its shard and its number there only, so one more shard adds points and moves none.
    """
    shard, number = (F.col("id") / virtual_nodes).cast("int"), F.col("id") % virtual_nodes
    nodes = spark.range(shards * virtual_nodes).select(F.pmod(F.xxhash64(F.lit("node"), shard, number), F.lit(points)).alias("p"), shard.alias("s"))
    return sorted((r["p"], r["s"]) for r in nodes.groupBy("p").agg(F.min("s").alias("s")).collect())


def place(arcs: list[tuple[int, int]], load: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank, shard, first slot): which ranks of each arc's keys go to which shard.

    In round r, each arc offers the keys it has left to the r-th different shard clockwise from it; a shard takes
    what it has room for, arcs in ring order, and the rest goes on clockwise. Work and result depend on the ring
    (shards x virtual nodes), not on the number of keys.
    """
    n, room = len(arcs), list(room)
    left = {a: (0, load.get(a, 0)) for a in range(n) if load.get(a, 0)}
    at = {a: a for a in left}
    met = {a: {arcs[a][1]} for a in left}
    used, out = [0] * len(room), []
    while left:
        for a in sorted(left):
            done, count = left[a]
            shard = arcs[at[a]][1]
            k = min(count, room[shard])
            if k:
                out.append((a, done, done + k - 1, shard, used[shard]))
                used[shard] += k
                room[shard] -= k
                left[a] = (done + k, count - k)
        left = {a: x for a, x in left.items() if x[1]}
        for a in left:
            if len(met[a]) == len({s for _, s in arcs}):
                raise ValueError("the shards have less room than there are keys")
            while arcs[at[a]][1] in met[a]:
                at[a] = (at[a] + 1) % n
            met[a].add(arcs[at[a]][1])
    return out


def shard(docs: DataFrame, shards: int = 40, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, arc, moved.

    A document stands on the ring by a hash of its id and belongs to the next virtual node clockwise; a shard
    that is full passes keys on clockwise. With slack 0 the shards' rooms add up to the number of documents and
    differ by one at most, so the law is "rows": counts at most one apart. With more slack a shard has room for
    (1 + slack) times its share. moved: the document is not in its own node's shard because that was full.

    One count per arc reaches the driver (shards x virtual_nodes rows at most), where the keys of each arc are
    assigned by rank; the assignment goes back as a table of that size. Rows are shuffled once, without text,
    by arc. Null text has size 16; null ids hash like any value; repeated rows each have a slot. Empty table: no
    rows. Equal texts are not kept together: only ids decide.
    """
    spark = docs.sparkSession
    arcs = ring(spark, shards, virtual_nodes)
    points = [p for p, _ in arcs]
    owner = [(p, bisect_left(points, p) % len(arcs)) for p in range(POINTS)]
    owner = F.broadcast(spark.createDataFrame(owner, "point int, arc int"))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(id_col).alias("h"))
    rows = rows.withColumn("point", F.pmod(F.col("h"), F.lit(POINTS)).cast("int")).join(owner, "point")
    load = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(load.values())
    room = [int((total // shards + (s < total % shards)) * (1 + slack)) for s in range(shards)]
    plan = place(arcs, load, room)
    plan = spark.createDataFrame(plan, "arc int, first long, last long, shard int, base long")
    plan = plan.groupBy("arc").agg(F.collect_list(F.struct("first", "last", "shard", "base")).alias("parts"))
    rank = F.row_number().over(Window.partitionBy("arc").orderBy("h", "doc_id", "size", "text_crc32")) - 1
    rows = rows.withColumn("rank", rank.cast("long")).join(F.broadcast(plan), "arc")
    part = F.filter("parts", lambda x: (F.col("rank") >= x["first"]) & (F.col("rank") <= x["last"]))[0]
    home = F.broadcast(spark.createDataFrame([(a, s) for a, (_, s) in enumerate(arcs)], "arc int, home int"))
    rows = rows.withColumn("part", part).join(home, "arc")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows" if slack == 0 else "bounded").alias("law"), F.col("part.shard").alias("shard"),
        (F.col("part.base") + F.col("rank") - F.col("part.first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "arc", (F.col("part.shard") != F.col("home")).alias("moved"),
    )


def op8_bounded_ring(spark, sf_dir):
    return shard(read_documents(spark, sf_dir))
