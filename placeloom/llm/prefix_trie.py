"""Prefix trie of conversations: range shards, padded turn-id matrices, boundary nodes recombined."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, attach, save, text_or_empty

#: A shard holds about so many turns at most (a conversation is never cut).
SHARD_TURNS = 250_000
#: Columns of a padded matrix; rows that agree on all of them go on to a matrix of their next turns.
PANEL = 16
#: Nodes go out in batches of so many at least.
BATCH = 1 << 15
NODE = "part int, low long, depth int, parent_low long, key binary, pkey binary, n_convs long, n_children long, n_leaves long, saved long, sha string, ends string, first binary, last binary"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: array of (a, b, w), a turn's two hashes of role and text together and its words, in order of turn.

    Null turns come first; equal turns stand by role, then by hash; null role or text is empty. Rows of a null conversation
    belong to none and are left out. A conversation is one row, 24 bytes a turn; texts are not shuffled.
    """
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "a", "b", "w"))).alias("s"))
    return own.select("conv_id", F.transform("s", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["w"].alias("w"))).alias("turns"))


def rebuilt(own: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """own (conv_id, turns) with the first `heads` turns (at most `most`) replaced by as many of the conversation `base` (fewer or none, where it has or is none)."""
    first = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    rows = own.withColumns({"base": base, "h": heads}).join(first, "base", "left")
    none = F.slice("turns", 1, 0)
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), none).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("h")))
    return rows.select("conv_id", F.concat(head, rest).alias("turns"))


# --- a shard ----------------------------------------------------------------------------------------------------


def turn_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 1 on of the turns' hashes, in the order of (a, b); 0 is padding."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    return out


def sorted_rows(ids: np.ndarray, start: np.ndarray, size: np.ndarray, conv: np.ndarray, panel: int = PANEL) -> np.ndarray:
    """The rows (ids[start : start + size]) in lexicographic order, equal ones by conv.

    Padded matrices of `panel` columns are sorted by numpy's lexsort; rows equal in a whole matrix go on to the next one.
    """
    rows, group, active, at = np.arange(len(conv)), np.zeros(len(conv), np.int64), np.arange(len(conv)), 0
    while len(active):
        r = rows[active]
        column = at + np.arange(panel)
        there = column < size[r][:, None]
        m = np.where(there, ids[np.where(there, start[r][:, None] + column, 0)], 0) if len(ids) else np.zeros((len(r), panel), np.int64)
        order = np.lexsort((conv[r], *m.T[::-1], group[active]))
        m, g = m[order], group[active][order]
        rows[active] = r[order]
        number = np.cumsum(np.append(False, (m[1:] != m[:-1]).any(axis=1) | (g[1:] != g[:-1])))
        on = (np.bincount(number)[number] > 1) & (m[:, -1] != 0)
        group[active] = number
        active, at = active[on], at + panel
    return rows


def prefix_keys(path: np.ndarray) -> list[bytes]:
    """128-bit keys of the prefixes of 0, 1, ... turns of a path of (a, b)."""
    from xxhash import xxh3_128

    x = xxh3_128()
    out = [x.digest()]
    for turn in path:
        x.update(turn.tobytes())
        out.append(x.digest())
    return out


def shard_nodes(part: int, conv: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray):
    """Record batches (NODE) of the nodes of a shard of conversations.

    Every sum over a subtree is a sum over its rows: a row is new at a depth if it starts a node there, tells its
    children; the words that it shares with the row before are saved; it ends a leaf if the next row shares less than all
    of it. So nodes that go on in other shards (those of the first and of the last row, given with their key) need but be
    summed, and corrected where shards meet (seam). The last batch has the first and the last row themselves.
    """
    start = np.cumsum(size) - size
    ids = turn_ids(a, b)
    rows = sorted_rows(ids, start, size, conv)
    n, conv, size, start = len(rows), conv[rows], size[rows], start[rows]
    words = np.append(0, np.cumsum(w))
    deepest = int(size.max())

    new, first_new, act = np.zeros(n, bool), size + 1, np.arange(n)
    new[0], first_new[0] = True, 1
    for d in range(1, deepest + 1):
        act = act[size[act] >= d]
        before = np.maximum(act - 1, 0)
        there = size[before] >= d
        was = np.where(there, ids[np.where(there, start[before] + d - 1, 0)], 0)
        changed = (ids[start[act] + d - 1] != was) & ~new[act]
        new[act[changed]] = True
        first_new[act[changed]] = d
    shared = first_new - 1
    leaf = np.append(shared[1:] < size[:-1], True).astype(np.int64)
    saved_words = words[start + shared] - words[start]

    path = lambda r: np.stack((a, b, w), axis=1)[start[r] : start[r] + size[r]]
    ends = [path(0), path(n - 1)]
    keys = [prefix_keys(p[:, :2]) for p in ends]
    owner, side, act = np.zeros(n, np.int64), np.zeros(n, np.int8), np.arange(n)
    columns: list[list] = [[] for _ in range(13)]
    schema = pa.schema([("part", pa.int32()), ("low", pa.int64()), ("depth", pa.int32()), ("parent_low", pa.int64()), ("key", pa.binary()), ("pkey", pa.binary()), *[(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved")], ("sha", pa.string()), ("ends", pa.string()), ("first", pa.binary()), ("last", pa.binary())])

    def batch(firsts=None, lasts=None):
        k = len(columns[0])
        out = pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), *[pa.array(c, f.type) for c, f in zip(columns[:11], list(schema)[1:12])], pa.array(firsts or [None] * k, pa.binary()), pa.array(lasts or [None] * k, pa.binary())], schema=schema)
        for c in columns:
            c.clear()
        return out

    for d in range(deepest + 1):
        act = act[size[act] >= d]
        at = np.flatnonzero(first_new[act] <= d) if d else np.zeros(1, np.int64)
        head, total = act[at], lambda x: np.add.reduceat(x, at)  # noqa: B023, E731
        count = np.diff(np.append(at, len(act)))
        low = np.minimum.reduceat(conv[act], at)
        children = total(((size[act] > d) & (first_new[act] <= d + 1)).astype(np.int64))
        again = saved_words[act]
        again[at] = 0
        saved = total(again) - ((count - 1) * (words[start[head] + d - 1] - words[start[head]]) if d else 0)
        ending = total((size[act] == d).astype(np.int64))
        k = len(at)
        edge = np.zeros(k, np.int8)
        edge[-1] = 2 * (act[-1] == n - 1)
        if act[0] == 0:
            edge[0] = 1
        texts = [",".join(map(str, conv[act[i : i + e]].tolist())) if e else None for i, e in zip(at.tolist(), ending.tolist())]
        parent_side = side[head] if d else np.zeros(1, np.int8)
        of = lambda sides, depth: [None if not s else keys[s - 1][depth] for s in sides.tolist()]
        inner = (edge == 0).tolist()
        values = [low.tolist(), [d] * k, [x if not s and d else None for x, s in zip(owner[head].tolist(), parent_side.tolist())], of(edge, d), of(parent_side, d - 1), count.tolist(), children.tolist(), total(leaf[act]).tolist(), saved.tolist()]
        values += [[(hashlib.sha256(t.encode()).hexdigest() if t else NO_ENDS) if i else None for t, i in zip(texts, inner)], [None if i else t for t, i in zip(texts, inner)]]
        for c, v in zip(columns, values):
            c.extend(v)
        owner[act], side[act] = np.repeat(low, count), np.repeat(edge, count)
        if len(columns[0]) >= BATCH:
            yield batch()
    yield batch()
    for c in columns[:11]:
        c.append(None)
    yield batch([ends[0].tobytes()], [ends[1].tobytes()])


def seam(part: int, last: bytes, first: bytes):
    """key, n_children, n_leaves, saved to be added where a shard's first row follows another shard's last row."""
    x, y = (np.frombuffer(p, np.int64).reshape(-1, 3) for p in (last, first))
    k = min(len(x), len(y))
    differ = np.flatnonzero((x[:k, :2] != y[:k, :2]).any(axis=1))
    k = int(differ[0]) if len(differ) else k
    words = np.append(0, np.cumsum(y[:k, 2]))
    depth = np.arange(k + 1)
    saved = words[k] - words[np.maximum(depth - 1, 0)]
    return prefix_keys(y[:k, :2]), -(depth < k).astype(np.int64), np.full(k + 1, -int(k == len(x)), np.int64), saved


# --- all shards -------------------------------------------------------------------------------------------------


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the prefix trie of convs (conv_id, turns as sequences gives them; ids not null, each once):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are range-partitioned by (turns, conv_id), so equal ones, however many, spread over shards. A shard
    is sorted as padded matrices and reduced depth by depth (shard_nodes). Nodes of a shard's first and last rows may
    go on in others: they are summed by their 128-bit key with the corrections of the seams; the ids of
    conversations that end in such a node come as a chunk from each shard, and one digest reads the chunks in order.
    Children of these nodes get the parent's id by a skew-safe join. Conversations without turns are members of
    the root only. No conversations: no rows, not even a root.
    """
    convs = save(convs.select("conv_id", F.transform("turns", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("ids"), F.transform("turns", lambda x: x["w"]).alias("w")), "trie-conversations")
    spark = convs.sparkSession
    total = convs.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_turns))

    def shard(it):
        got = [b for b in it if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        ids, w = t.column("ids").combine_chunks(), t.column("w").combine_chunks()
        flat = ids.flatten()
        size = np.diff(np.asarray(ids.offsets)).astype(np.int64)
        as_long = lambda x: np.asarray(x).astype(np.int64)
        yield from shard_nodes(t.column("part")[0].as_py(), as_long(t.column("conv_id")), size, as_long(flat.field(0)), as_long(flat.field(1)), as_long(w.flatten()))

    dealt = convs.repartitionByRange(parts, "ids", "conv_id").select(F.spark_partition_id().alias("part"), "conv_id", "ids", "w")
    nodes = save(dealt.mapInArrow(shard, NODE), "trie-nodes")

    def corrections(it):
        for batch in it:
            for part, last, first in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                keys, children, leaves, saved = seam(part, last, first)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *map(pa.array, (children, leaves, saved))], names=["key", "n_children", "n_leaves", "saved"])

    rows = nodes.filter("first is not null").select("part", "first", "last")
    follows = rows.select("part", F.lag("part").over(Window.orderBy("part")).alias("before"))  # a number for each shard
    met = follows.join(rows.select("part", "first"), "part").join(rows.select(F.col("part").alias("before"), "last"), "before").select("part", "last", "first")
    fixes = met.mapInArrow(corrections, "key binary, n_children long, n_leaves long, saved long")
    sums = ["n_convs", "n_children", "n_leaves", "saved"]
    edges = nodes.filter("key is not null").select("key", "pkey", "depth", "low", *sums)
    none = lambda kind: F.lit(None).cast(kind)
    edges = edges.union(fixes.select("key", none("binary"), none("int"), none("long"), F.lit(0).cast("long"), "n_children", "n_leaves", "saved"))
    edges = edges.groupBy("key").agg(F.max("pkey").alias("pkey"), F.max("depth").alias("depth"), F.min("low").alias("low"), *[F.sum(c).alias(c) for c in sums])

    def digests(it):
        key, x = None, None
        for batch in it:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, x.hexdigest()))
                    key, x = k, hashlib.sha256(text.encode())
                else:
                    x.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([x.hexdigest()], pa.string())], names=["key", "sha"])

    chunks = nodes.filter("ends is not null").select("key", "part", "ends").repartition("key").sortWithinPartitions("key", "part")
    edges = save(edges.join(chunks.mapInArrow(digests, "key binary, sha string"), "key", "left"), "trie-edges")
    columns = ["low", "depth", *sums, F.coalesce("sha", F.lit(NO_ENDS)).alias("sha")]
    inner = nodes.filter("key is null and first is null")
    orphans = inner.filter("pkey is not null").select("pkey", *columns).union(edges.select("pkey", *columns))
    parents = edges.select(F.col("key").alias("pkey"), F.col("low").alias("parent_low"), F.greatest("n_children", F.lit(1)).alias("n"))
    orphans = attach(orphans, parents, ["pkey"], "n", max(1, total), F.xxhash64("low", "depth"))
    all_nodes = inner.filter("pkey is null").select("parent_low", *columns).union(orphans.select("parent_low", "low", "depth", *sums, "sha"))
    return all_nodes.select(F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_low").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir):
    own = save(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "conversation-sequences")
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return trie(rebuilt(own, F.col("conv_id") - F.col("conv_id") % 20, heads.cast("int"), 3))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
