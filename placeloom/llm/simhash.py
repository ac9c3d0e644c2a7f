"""SimHash near-duplicates: pivot distance tables, links, connected components."""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh, read_documents, save, slices, small, text_or_empty

SHINGLE = 4
MAX_BITS = 4
#: The 64 bits are cut into BLOCKS blocks; two fingerprints that differ in MAX_BITS bits agree on BLOCKS - MAX_BITS of them.
BLOCKS = 7
PIVOTS = 16
#: A bucket that may hold more fingerprints than this is split by blocks of its other bits.
HOT_BUCKET = 100_000
# The near-dedup stage: shingles of words, least similarity, SimHash bits, most that differ, pivots, and buckets by minima.
NEAR_SHINGLE, NEAR_JACCARD = 5, 0.8
NEAR_BITS, NEAR_RADIUS, NEAR_PIVOTS = 256, 64, 8
NEAR_BANDS, NEAR_ROWS = 24, 5
#: Rounds in which each set is held against one other set of its buckets, before pairs of different components are.
NEAR_ROUNDS = 3
#: Cells of a set's histogram, and sets of a bucket that are compared with each other in one task.
NEAR_CELLS, NEAR_TILE = 256, 8192
#: Up to so many texts' digests are broadcast to find the texts again.
BROADCAST_TEXTS = 1_000_000


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (64 bits as a long) of each row.

    A-Z is lower-cased; the shingles are runs of `shingle` words, repeats included, joined by spaces (of fewer
    words: all of them; no word, or null: fingerprint zero). A bit is 1 if over half of the shingles' XXH64
    (seed 42) have it. Whole texts; the bit counts of a text are added up in parts of bounded size. Null ids and
    repeated rows are rows like others. Empty table: no rows. Other columns are not read.
    """
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def batches(it):
        from xxhash import xxh64_intdigest

        for batch in it:
            out = np.zeros(batch.num_rows, np.uint64)
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").translate(lower).split()
                n = max(1, len(words) - shingle + 1) if words else 0
                if not n:
                    continue
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                first = np.concatenate(([0], ends[:-1]))[:n].tolist()
                last = (ends[-n:] - 1).tolist()
                ones = np.zeros(64, np.int64)
                for i in range(0, n, 65536):
                    part = first[i : i + 65536]
                    h = np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(part, last[i : i + 65536])), np.uint64, len(part))
                    ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[k] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"doc_id {kind}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random 64-bit numbers."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def pivot_table(distinct: DataFrame, n_pivots: int = PIVOTS) -> DataFrame:
    """The written table of fp and table: its distances to the pivots, a byte each, packed into longs."""
    def packed(refs):
        one = lambda i, p: F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(p.view(np.int64))))).cast("long"), 8 * i)
        return sum((one(i, p) for i, p in enumerate(refs)), F.lit(0).cast("long"))

    refs = pivots(n_pivots)
    return save(distinct.select("fp", F.array(*[packed(refs[i : i + 8]) for i in range(0, n_pivots, 8)]).alias("table")), "pivot-distances")


def bucket_links(fp: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[list, np.ndarray]:
    """(links, counts): a spanning forest of the links (at most max_bits differing bits) between distinct fingerprints
    of a bucket; counts of pairs met, left by the table, and linked.

    table holds their distances to the pivots, and is sorted by the first pivot. A fingerprint's partners lie within
    max_bits of it in every coordinate (triangle inequality), so only that slice is looked at, rows whose
    largest coordinate difference is above max_bits are discarded, and the rest is verified. Each fingerprint
    is reached once, so a bucket of n gives n - 1 links at most, and one within a tight cluster costs one pass.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    waiting, links, counts = np.ones(len(fp), bool), [], np.zeros(3, np.int64)
    for seed in range(len(fp)):
        if not waiting[seed]:
            continue
        waiting[seed], stack = False, [seed]
        while stack:
            a = stack.pop()
            lo, hi = np.searchsorted(table[:, 0], (table[a, 0] - max_bits, table[a, 0] + max_bits + 1))
            met = lo + np.flatnonzero(waiting[lo:hi])
            left = met[np.abs(table[met] - table[a]).max(axis=1, initial=0) <= max_bits]
            near = left[np.bitwise_count(fp[left] ^ fp[a]) <= max_bits]
            counts += len(met), len(left), len(near)
            waiting[near] = False
            links += [(fp[a], fp[b]) for b in near]
            stack += near.tolist()
    return links, counts


def block_masks(of: int, blocks: int, max_bits: int) -> list[int]:
    """Masks of blocks - max_bits of the blocks into which the bits of `of` are cut: numbers that differ in max_bits of these bits agree under one of them."""
    bits = [1 << i for i in range(64) if of >> i & 1]
    cut = [sum(bits[len(bits) * b // blocks : len(bits) * (b + 1) // blocks]) for b in range(blocks)]
    return [sum(c) for c in combinations(cut, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def met_pairs(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, n_pivots: int = PIVOTS, most: int = HOT_BUCKET) -> DataFrame:
    """The written table of links (u, v) found in the buckets, and of counts (u null): met, left, linked.

    Two linked fingerprints agree on blocks - max_bits of the blocks, so they share one of the tables' buckets. A
    bucket's rows carry their pivot distances, are sorted together and read as a stream; bucket_links discards its
    pairs by these distances and verifies what is left. Buckets are counted under hashes first; those that may hold
    more than `most` fingerprints are split by blocks of their other bits in the same way, so that a bucket then
    agrees on 42 bits and holds at most 2^22 different fingerprints.
    """
    width = -(-n_pivots // 8) * 8

    def stream(it):
        counts = np.zeros(3, np.int64)

        def batch(u, v, c):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), *[pa.array(x, pa.int64()) for x in c]], names=["u", "v", "met", "left", "linked"])

        def runs(t, key, fp, table):
            """Links of the whole buckets in these sorted rows."""
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            begins, ends = np.concatenate(([0], new)), np.concatenate((new, [len(fp)]))
            sizes = ends - begins
            two = begins[sizes == 2]
            left = two[np.abs(table[two] - table[two + 1]).max(axis=1, initial=0) <= max_bits]
            near = left[np.bitwise_count(fp[left] ^ fp[left + 1]) <= max_bits]
            counts[:] += len(two), len(left), len(near)
            out = [np.stack((fp[near], fp[near + 1]), axis=1)]
            for i, j in zip(begins[sizes > 2], ends[sizes > 2]):
                found, c = bucket_links(fp[i:j], table[i:j], max_bits)
                counts[:] += c
                if found:
                    out.append(np.array(found, np.uint64))
            found = np.sort(np.concatenate(out).view(np.int64), axis=1)
            none = [[None] * len(found)] * 3
            return batch(found[:, 0], found[:, 1], none)

        held = []  # parts of the last bucket so far
        for rows in it:
            if not rows.num_rows:
                continue
            t, key, fp = (np.asarray(rows.column(c)).astype(kind, copy=False) for c, kind in enumerate((np.int32, np.int64, np.int64)))
            flat = np.asarray(rows.column(3).flatten()).astype(np.int64, copy=False)
            now = [t, key, fp.view(np.uint64), flat.view(np.uint8).reshape(-1, width)[:, :n_pivots].astype(np.int16)]
            cut = int(np.argmax((t == t[-1]) & (key == key[-1])))
            same = held and held[0][0][0] == t[0] and held[0][1][0] == key[0]
            if cut or not same:
                whole = [np.concatenate(x) for x in zip(*held, [x[:cut] for x in now])]
                if len(whole[0]):
                    yield runs(*whole)
                held = []
            held.append([x[cut:] for x in now])
        if held:
            yield runs(*[np.concatenate(x) for x in zip(*held)])
        yield batch([None], [None], [[int(c)] for c in counts])

    def links(rows):
        rows = rows.select("t", "key", "fp", "table").repartition("t", "key").sortWithinPartitions("t", "key")
        return rows.mapInArrow(stream, "u long, v long, met long, left long, linked long")

    def keyed(rows, masks, t):
        return rows.select("fp", "table", F.explode(F.transform(F.arrays_zip(masks.alias("m"), t.alias("t")), lambda x: F.struct(x["t"].alias("t"), F.col("fp").bitwiseAND(x["m"]).alias("key")))).alias("b")).select("b.t", "b.key", "fp", "table")

    table = pivot_table(distinct, n_pivots)
    tables = block_masks((1 << 64) - 1, blocks, max_bits)
    longs = lambda xs: F.array(*[F.lit(_signed(x)).cast("long") for x in xs])
    rows = keyed(table, longs(tables), F.array(*[F.lit(i) for i in range(len(tables))]))
    cells = max(1 << 16, table.count() * len(tables) // most * 8)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("t", "key"), F.lit(cells)))
    hot = save(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("cell"), "hot-buckets")
    if not hot.limit(1).count():
        return save(links(rows), "pivot-links")
    hot = F.broadcast(hot)  # one row for each `most` rows of the tables at most
    inner = [block_masks(((1 << 64) - 1) ^ m, blocks, max_bits) for m in tables]
    of = F.element_at(F.array(*[longs([m | x for x in xs]) for m, xs in zip(tables, inner)]), F.col("outer") + 1)
    some = rows.join(hot, "cell", "left_semi").select("fp", "table", F.col("t").alias("outer"))
    some = keyed(some, of, F.transform(F.sequence(F.lit(0), F.lit(len(inner[0]) - 1)), lambda i: (F.col("outer") * len(inner[0]) + i).cast("int")))
    return save(links(rows.join(hot, "cell", "left_anti")).union(links(some)), "pivot-links")


def link_fingerprints(distinct: DataFrame, **settings) -> DataFrame:
    """Links u < v that connect just those of the distinct fingerprints (column fp) that links of at most max_bits bits connect."""
    return met_pairs(distinct, **settings).filter("u is not null").select("u", "v").distinct()


def pair_counts(found: DataFrame) -> tuple[int, int, int]:
    """Of met_pairs: pairs that met in a bucket (and by their first pivot), that the pivot table left, that are linked."""
    r = found.filter("u is null").agg(F.sum("met"), F.sum("left"), F.sum("linked")).first()
    return r[0] or 0, r[1] or 0, r[2] or 0


def components(links: DataFrame) -> DataFrame:
    """node, root of each node of the links (u, v): root is the smallest node of its component.

    Large-star and small-star steps in turn until the links stay the same; each step's links are written, so
    lineage stays short, and only their count and a checksum reach the driver. A hub's links are counted in a
    map-side sum; its smallest neighbour comes back to them by a bounded broadcast (attach). No links: no rows.
    """
    def state(e):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = save(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    now = state(e)
    def least(e, m):
        return save(e.groupBy("u").agg(m.alias("m"), F.count(F.lit(1)).alias("n")), "least")

    while now[0]:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = least(both, F.least(F.min("v"), F.col("u")))
        e = attach(both.filter("v > u"), low, ["u"], "n", now[0], F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = least(e, F.min("v"))
        kept = attach(e, low, ["u"], "n", now[0], F.xxhash64("v"))
        e = save(kept.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        was, now = now, state(e)
        if was == now:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, fingerprint_size.

    Documents with one fingerprint are one node, so copies never meet in pairs; fingerprints link at MAX_BITS or
    fewer differing bits. component_id is the smallest doc_id reachable over links. Candidates come from
    buckets of equal bit blocks, since pivot distances alone leave a third of all pairs; within a bucket the pivot
    table, written once, discards pairs before any is verified. The result has no false and no missing link.

    Null text is empty text: fingerprint zero, linked like any other. Null ids: rows get a component like
    others, and never give it its name unless it has no other id. Repeated rows stay repeated. Empty table: no rows.
    """
    rows = save(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = save(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    nodes = save(components(link_fingerprints(distinct.select("fp"))), "components")
    named = save(nodes.join(distinct, nodes["node"] == distinct["fp"]).select("fp", "root", "low"), "named-components")
    low = save(named.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("size")), "component-ids")
    linked = attach(named, low, ["root"], "size", named.count(), F.xxhash64("fp")).select("fp", "component_id")
    classes = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"), "n")
    classes = save(classes, "fingerprint-classes")
    out = attach(rows, classes, ["fp"], "n", docs.count(), F.xxhash64("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("n").alias("fingerprint_size"))


def text_digest(text_col: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text_col)))


def _shingles(text: bytes | None) -> np.ndarray:
    """The sorted XXH64 of the different runs of NEAR_SHINGLE words (A-Z lower-cased; of fewer words: all of them)."""
    from xxhash import xxh64_intdigest

    words = (text or b"").translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    n = max(1, len(words) - NEAR_SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = [0, *ends[: n - 1].tolist()]
    last = (ends[-n:] - 1).tolist() if words else [0]
    return np.unique(np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(first, last)), np.uint64, n))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest (MD5 of the text), set (16-byte digest of the shingles), n (shingles), fp, table, keys of each row.

    fp: the shingles' SimHash of NEAR_BITS bits. table: its distances to the pivots. keys: NEAR_BANDS bucket keys,
    each the hash of NEAR_ROWS minima.
    """
    rng = np.random.default_rng(80)
    times = rng.integers(0, 1 << 64, (NEAR_BANDS * NEAR_ROWS, 1), np.uint64) | np.uint64(1)
    plus = rng.integers(0, 1 << 64, (NEAR_BANDS * NEAR_ROWS, 1), np.uint64)
    lanes = rng.integers(0, 1 << 64, NEAR_BITS // 64, np.uint64)
    refs = rng.integers(0, 1 << 64, (NEAR_PIVOTS, NEAR_BITS // 64), np.uint64)

    def mixed(h):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def one(text):
        from xxhash import xxh3_128_digest

        h = _shingles(text)
        ones, low = np.zeros(NEAR_BITS, np.int64), np.full(NEAR_BANDS * NEAR_ROWS, np.iinfo(np.uint64).max)
        for i in range(0, len(h), 4096):
            part = h[i : i + 4096]
            bits = np.stack([mixed(part ^ x) for x in lanes], axis=1)
            ones += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            low = np.minimum(low, (part[None, :] * times + plus).min(axis=1))
        fp = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)
        table = np.bitwise_count(refs ^ fp).sum(axis=1, dtype=np.int32)
        low = low.reshape(NEAR_BANDS, NEAR_ROWS)
        key = np.zeros(NEAR_BANDS, np.uint64)
        for k in range(NEAR_ROWS):
            key = mixed(key ^ low[:, k])
        return xxh3_128_digest(h.tobytes()), len(h), fp.view(np.int64), table, key.view(np.int64)

    names = ["doc_id", "digest", "set", "n", "fp", "table", "keys"]
    types = [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def batches(it):
        for batch in it:
            for part in slices(batch, 2, 2 << 20):
                out = zip(*[one(t.as_py()) for t in part.column(2).cast(pa.binary())])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(out, types)]], names=names)
                pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches, f"doc_id {kind}, digest binary, set binary, n int, fp array<long>, table array<int>, keys array<long>")


def shingle_sets(docs: DataFrame, text_col: str, wanted: DataFrame, most: int = BROADCAST_TEXTS) -> DataFrame:
    """The written table of node, shingles for wanted(node, digest): the sets are made again from the texts with these
    digests, since those of all texts would be larger than the texts. Up to `most` digests are broadcast; beyond, texts
    meet them in a shuffled join."""

    def batches(it):
        for batch in it:
            for part in slices(batch, 1, 2 << 20):
                sets = [_shingles(t.as_py()).view(np.int64) for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])
                del sets
                pa.default_memory_pool().release_unused()

    wanted = save(wanted, "near-wanted")
    few = F.broadcast(wanted) if wanted.count() <= most else wanted
    rows = docs.select(text_digest(text_col).alias("digest"), F.col(text_col).alias("text")).join(few, "digest").select("node", "text")
    return save(rows.mapInArrow(batches, "node long, shingles array<long>").dropDuplicates(["node"]), "near-shingles")


def near_enough(a: str, b: str) -> Column:
    """Whether the sets of structs a and b (n, fp, table) can be alike by NEAR_JACCARD: sizes, then pivot distances, then differing bits."""
    at = lambda s, c, i: F.col(f"{s}.{c}")[i]
    ok = F.least(f"{a}.n", f"{b}.n") >= NEAR_JACCARD * F.greatest(f"{a}.n", f"{b}.n")
    for i in range(NEAR_PIVOTS):
        ok &= F.abs(at(a, "table", i) - at(b, "table", i)) <= NEAR_RADIUS
    return ok & (sum((F.bit_count(at(a, "fp", i).bitwiseXOR(at(b, "fp", i))) for i in range(NEAR_BITS // 64)), F.lit(0)) <= NEAR_RADIUS)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose shingles (sets: node, shingles) have a Jaccard similarity of NEAR_JACCARD or more, in whole numbers."""
    both = pairs.join(sets.toDF("v", "y"), "v").join(sets.toDF("u", "x"), "u")
    both = both.select("u", "v", (F.size("x") + F.size("y")).alias("all"), F.size(F.array_intersect("x", "y")).alias("common"))
    return save(both.filter(f"common >= {NEAR_JACCARD} * (all - common)").select("u", "v"), "near-links")


def histogram(shingles: np.ndarray) -> bytes:
    """How many of a set's shingles have each leading byte: two sets have at most the sum of the smaller counts in common."""
    return np.minimum(np.bincount((shingles.view(np.uint64) >> np.uint64(56)).astype(np.int64), minlength=NEAR_CELLS), 65535).astype(np.uint16).tobytes()


def tile_pairs(rows: dict[str, np.ndarray]) -> list[tuple[int, int]]:
    """Candidate pairs (node, node) of the sets of one tile of a bucket; rows are sorted by n.

    Pairs of one component, of sizes or histograms that rule NEAR_JACCARD out, of pivot coordinates or SimHash bits that
    differ by more than NEAR_RADIUS, and pairs that meet in an earlier band are discarded here, before they are rows.
    """
    n, table, fp, keys, cells, root, side, node = (rows[c] for c in ("n", "table", "fp", "keys", "cells", "root", "side", "node"))
    band, lo, hi = int(rows["band"][0]), int(rows["lo"][0]), int(rows["hi"][0])
    out = []
    for i in range(len(n) - 1):
        j = np.arange(i + 1, np.searchsorted(n, n[i] / NEAR_JACCARD, side="right"))
        j = j[(root[j] != root[i]) & ((side[j] != side[i]) | (lo == hi))]
        j = j[np.abs(table[j] - table[i]).max(axis=1, initial=0) <= NEAR_RADIUS]
        j = j[np.bitwise_count(fp[j] ^ fp[i]).sum(axis=1) <= NEAR_RADIUS]
        j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]
        common = np.minimum(cells[j], cells[i]).sum(axis=1, dtype=np.int64)
        j = j[((1 + NEAR_JACCARD) * common >= NEAR_JACCARD * (n[j] + n[i]) - 1e-6) | (n[j] > 65535)]
        out += [(int(node[i]), int(node[k])) for k in j]
    return out


def bucket_pairs(rest: DataFrame, sets: DataFrame, made: DataFrame, most: int = NEAR_TILE) -> DataFrame:
    """The written table of different candidate pairs (u, v) of the members (band, key, node, root) of buckets whose nodes are in several components.

    A bucket's members are sorted by size and compared in one task; a bucket of more than `most` is cut into tiles by
    hash, and each pair of tiles is a task's work, so no bucket has to fit a task and no pair of it is left out.
    """

    def cells(it):
        for batch in it:
            values = [histogram(np.asarray(x.values)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["node", "cells"])

    def stream(it):
        held: list[pa.RecordBatch] = []

        def whole(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            flat = lambda c, k, kind: np.asarray(t.column(c).combine_chunks().flatten()).astype(kind, copy=False).reshape(-1, k)
            rows = {c: np.asarray(t.column(c)) for c in ("band", "lo", "hi", "side", "node", "root", "n")}
            rows |= {"n": rows["n"].astype(np.int64), "table": flat("table", NEAR_PIVOTS, np.int32), "fp": flat("fp", NEAR_BITS // 64, np.int64).view(np.uint64), "keys": flat("keys", NEAR_BANDS, np.int64)}
            rows["cells"] = np.frombuffer(b"".join(t.column("cells").to_pylist()), np.uint16).reshape(-1, NEAR_CELLS)
            uv = np.array(tile_pairs(rows), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(uv.min(axis=1)), pa.array(uv.max(axis=1))], names=["u", "v"])

        last = None
        for batch in it:
            key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for i, k in zip(cuts, cuts[1:]):
                if k > i:
                    if held and tuple(key[i]) != last:
                        yield whole(held)
                        held = []
                    last = tuple(key[i])
                    held.append(batch.slice(i, k - i))
        if held:
            yield whole(held)

    sizes = rest.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"))
    tiles = F.ceil(F.col("members") / most).cast("int")
    side = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    rows = rest.join(sizes, ["band", "key"]).withColumn("tiles", tiles).withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("band", "key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "root")
    own = sets.select("node", "s.n", "s.fp", "s.table", "keys").join(made.mapInArrow(cells, "node long, cells binary"), "node")
    rows = rows.join(own, "node").select("band", "key", "lo", "hi", "side", "node", "root", "n", "fp", "table", "keys", "cells")
    rows = rows.repartition("band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi", "n")
    return save(rows.mapInArrow(stream, "u long, v long").distinct(), "near-more")


def near_links(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Links (u, v) that connect just those nodes (different sets of shingles) that candidate pairs alike by NEAR_JACCARD connect.

    Candidates are all pairs of a bucket. First each set is held against one other, the smallest head (smallest set of
    a bucket) of its buckets, so a large group of near copies gives no square of pairs. Then, in buckets whose sets are
    not all connected yet, those not connected to a head are held against it, for some rounds with another head each; at
    last all pairs from different components are looked at within their bucket (bucket_pairs). Pairs left out are
    connected already. Only sets in candidate pairs and of buckets looked at last are made from texts again.
    """
    light = F.struct("n", "fp", "table")
    sets = rows.select("node", light.alias("s"), "keys", "digest").groupBy("node").agg(F.first("s").alias("s"), F.first("keys").alias("keys"), F.min("digest").alias("digest"))
    sets = save(sets, "near-sets")
    s = sets.select("node", "s")
    made: list[DataFrame] = []

    def known(nodes):
        """The shingles of sets; those of nodes that were not made before are made now."""
        for before in made:
            nodes = nodes.join(before.select("node"), "node", "left_anti")
        made.append(shingle_sets(docs, text_col, nodes.join(sets.select("node", "digest"), "node")))
        every = made[0]
        for more in made[1:]:
            every = every.union(more)
        return every

    def linked(pairs):
        """Those of the different pairs that are alike."""
        pairs = pairs.join(s.toDF("v", "b"), "v").join(s.toDF("u", "a"), "u").filter(near_enough("a", "b"))
        pairs = save(pairs.select("u", "v"), "near-pairs")
        return verified(pairs, known(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()))

    def split_buckets(links):
        """band, key, node, root of the nodes in buckets whose nodes are in several components."""
        labelled = sets.select("node", "keys").join(components(links), "node", "left")
        members = save(labelled.select("node", F.coalesce("root", "node").alias("root"), "keys"), "near-labels").select("node", "root", F.posexplode("keys").alias("band", "key"))
        split = members.groupBy("band", "key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("band", "key")
        return save(members.join(split, ["band", "key"]), "near-split")

    members = sets.select("node", F.posexplode("keys").alias("band", "key"))
    heads = members.groupBy("band", "key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    heads = save(heads, "near-heads")
    first = attach(members, heads, ["band", "key"], "n", sets.count() * NEAR_BANDS, F.xxhash64("node")).filter("head < node")
    links = linked(first.groupBy(F.col("node").alias("v")).agg(F.min("head").alias("u")).select("u", "v"))

    for turn in range(NEAR_ROUNDS - 1):
        rest = split_buckets(links)
        if not rest.limit(1).count():
            return links
        head = rest.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root")).alias("h"))
        pairs = rest.join(head, ["band", "key"]).filter("root <> h.root").select(F.least("node", "h.node").alias("u"), F.greatest("node", "h.node").alias("v")).distinct()
        links = save(links.union(linked(pairs)), "near-links")

    rest = split_buckets(links)
    if not rest.limit(1).count():
        return links
    shingles = known(rest.select("node").distinct())
    return links.union(verified(bucket_pairs(rest, sets, shingles), shingles))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component of near duplicates, the smallest id; all columns stay.

    Near duplicates: sets of NEAR_SHINGLE-word shingles with a Jaccard similarity of NEAR_JACCARD or more, computed in
    full for each candidate. Candidates share one of NEAR_BANDS buckets (two sets alike by 0.8 share none in 7 of
    100,000 cases, by the rule of bands) and differ in NEAR_RADIUS of NEAR_BITS SimHash bits at most.

    Rows go by id and text together, so null ids and an id over several texts take no other row with them. A null
    id stays only if its component has no other. Rows repeated with the same id and text stay or go together. Null text
    and empty text are one set (of the empty shingle), so they are near copies of each other only; a text of fewer
    words than a shingle is one shingle. Ties cannot occur: equal ids with different texts are told apart by the
    texts' digests. Empty table: no rows. Columns of docs may have any names.
    """
    rows = save(sketches(docs, id_col, text_col), "sketches").withColumn("node", F.xxhash64("set"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    nodes = components(near_links(rows, docs, text_col))
    lows = rows.groupBy("node").agg(F.min(own).alias("low"), F.count(F.lit(1)).alias("n")).join(nodes, "node")
    lows = save(lows, "near-nodes")
    keep = lows.groupBy("root").agg(F.min("low").alias("keep"))
    classes = save(lows.join(keep, "root").select("node", "keep", "n"), "near-classes")
    alone = rows.groupBy("node").agg(F.min(own).alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").join(nodes, "node", "left_anti")
    classes = classes.unionByName(save(alone, "near-classes"))
    found = attach(rows.select("doc_id", "digest", "node"), classes, ["node"], "n", rows.count(), F.xxhash64("doc_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("digest") == F.col("keep.digest"))
    own, gone_id, gone_digest = fresh(docs, "digest", "gone_id", "gone_digest")
    gone = found.filter(F.col("keep").isNotNull() & ~stays).select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest)).distinct()
    gone = save(gone, "near-dropped")
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_digest))
    return docs.withColumn(own, text_digest(text_col)).join(small(gone), same, "left_anti").drop(own)


def op4_simhash_pivots(spark, sf_dir):
    return near_duplicates(read_documents(spark, sf_dir))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
