"""Alignment of two tokenizers: token ends merged by merge-path pieces, overlaps counted over the corpus."""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_process, read_documents, save, slices

#: Texts of so many bytes are aligned together (a longer text is alone).
BLOCK_BYTES = 4 << 20
#: Ends of both sides in a merge-path piece.
PIECE = 1 << 16
#: Id pairs whose counts are sent to all tasks at most (17 bytes each); more are joined.
BROADCAST_PAIRS = 4_000_000
#: An id pair as one number.
SHIFT = 32


class Tokenizers:
    """The byte-level BPE (A) and the piece BPE (B), for segments: a space and what follows up to the next one.

    A segment ends before a space that follows no space and precedes no white space. A's pattern cuts there, and no
    piece of B holds a space mark behind other letters (checked when loaded), so a text's tokens are its segments'.
    """

    def __init__(self, a_file: str, ranks_file: str, pattern: str, b_file: str):
        import base64

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(a_file)
        self.exact.encode_special_tokens = True
        byte_of = {c: b for b, c in byte_letters().items()}
        vocabulary = self.exact.get_vocab(with_added_tokens=True)
        self.a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a[i] = bytes(map(byte_of.get, t)) if all(c in byte_of for c in t) else t.encode()
        self.same = all(self.a[i] == t for t, i in ranks.items())
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.b = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id("\u2581")
        self.cut = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        self.find = re.compile("(?<=[^ ])(?= [^\\s\x85\u180e])").split  # two of these letters are white space for some libraries only
        self.latin = re.compile("[\x00-\u024f]*").fullmatch

    def segments(self, text: str | None) -> list[str]:
        return [] if not text else self.find(" " + text) if self.cut else [" " + text]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of A and of B of each segment. A's library itself is asked beyond Latin letters; tiktoken, with the same merges, for the rest."""
        a: list = [None] * len(segments)
        for i, s in enumerate(segments):
            if self.same and self.latin(s):
                a[i] = self.fast.encode_ordinary(s)
        other = [i for i, x in enumerate(a) if x is None]
        for k in range(0, len(other), 1000):
            some = other[k : k + 1000]
            for i, e in zip(some, self.exact.encode_batch([segments[i] for i in some], add_special_tokens=False)):
                a[i] = e.ids
        b = self.model.encode([s[1:] for s in segments], num_threads=1) if segments else []
        return a, [[self.space] if s == " " else ids for s, ids in zip(segments, b)]


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


# --- merge path -------------------------------------------------------------------------------------------------


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Rows (taken of a, taken of b): where the merge of the rising a and b (a first of equal ones) has taken 0, piece, 2 * piece, ... numbers, and all.

    A binary search along each diagonal, all diagonals at once.
    """
    n = len(a) + len(b)
    at = np.append(np.arange(0, n, piece), n)
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while len(on := np.flatnonzero(low < high)):
        mid = (low[on] + high[on]) // 2
        before = a[mid] <= b[at[on] - mid - 1]  # then a[mid] comes before the diagonal
        low[on[before]], high[on[~before]] = mid[before] + 1, mid[~before]
    return np.stack((low, at - low), axis=1)


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number in a, number in b, whether both end with it) of each stretch between neighbouring ends of a and b.

    a and b are ends of tokens of one byte string, rising, the last one in common. A stretch lies in one token of each
    side, and two tokens that overlap have one stretch in common. Pieces of equal work are merged independently; an
    end of both sides that a diagonal cuts apart (a's closes a piece, b's opens the next) is stitched.
    """
    cuts, found = diagonals(a, b, piece), []
    for (i, j), (k, m) in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        ends = np.concatenate((a[i:k], b[j:m]))
        order = np.argsort(ends, kind="stable")
        ends, of_a = ends[order], order < k - i
        first = np.append(True, ends[1:] != ends[:-1])
        taken = np.cumsum(of_a) - of_a  # of a, before each end
        both = np.append(~first[1:], False)
        x, y = i + taken[first], j + (np.arange(len(ends)) - taken)[first]
        found.append([x, y, both[first], ends[first]])
    for p, q in zip(found, found[1:]):
        if len(p[0]) and p[3][-1] == q[3][0]:  # p is empty if its one end closed the piece before
            p[2][-1] = True
            q[:] = [c[1:] for c in q]
    found = [f for f in found if len(f[0])]
    none = np.zeros(0, np.int64)
    x, y, both, _ = (np.concatenate(c) for c in zip(*found)) if found else (none, none, none.astype(bool), none)
    return x, y, both


# --- blocks of documents ----------------------------------------------------------------------------------------


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return size, np.fromiter((i for x in lists for i in x), np.int64, int(size.sum()))


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of runs of these sizes."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(size)
    return total[ends] - total[ends - size]


def aligned(segments: list[str], tokenizers: Tokenizers):
    """Of each segment: whether both sides' bytes are its own, (n_a, n_b, n_groups, n_links), its groups as text; and the id pairs of all links in turn."""
    a, b = tokenizers.encode(segments)
    good = np.ones(len(segments), bool)
    for i, s in enumerate(segments):
        own = s.encode()
        if b"".join(map(tokenizers.a.__getitem__, a[i])) != own or b"".join(map(tokenizers.b.__getitem__, b[i])) != own:
            good[i], a[i], b[i] = False, [], []
    size_a, a = _flat(a)
    size_b, b = _flat(b)
    wide = lambda vocabulary: np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
    x, y, both = overlaps(np.cumsum(wide(tokenizers.a)[a]), np.cumsum(wide(tokenizers.b)[b]))
    owner = np.repeat(np.arange(len(segments)), size_a)[x]
    links = np.bincount(owner, minlength=len(segments))
    groups = np.bincount(owner[both], minlength=len(segments))
    text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    ends = list(zip((x[both] + 1).tolist(), (y[both] + 1).tolist()))
    each = [f"{','.join(text_a[i:k])}|{','.join(text_b[j:m])}" for (i, j), (k, m) in zip([(0, 0), *ends], ends)]
    at = np.append(0, np.cumsum(groups)).tolist()
    texts = [";".join(each[i:k]) for i, k in zip(at, at[1:])]
    return good, np.stack((size_a, size_b, groups, links), axis=1), texts, (a[x] << SHIFT) + b[y]


def _pack(x: np.ndarray) -> bytes:
    data = np.ascontiguousarray(x).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data).to_pybytes()


def _unpack(data: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little")), kind)


def blocks(docs: DataFrame, make, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of documents: ids, stats and digests of its documents, their segments as numbers, each segment's links as numbers of the block's id pairs, and how often the block has each pair."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["block", "ids", "sha", "stats", "size", "seg", "n_links", "link", "pair", "n"]

    def batches(it):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        tokenizers = per_process(f"tokenizers {make}", lambda: Tokenizers(*make))
        for batch in it:
            for part in slices(batch, 1, block_bytes):
                number: dict[str, int] = {}
                size, seg = [], []
                for t in part.column(1):
                    s = [number.setdefault(x, len(number)) for x in tokenizers.segments(t.as_py())]
                    size.append(len(s))
                    seg += s
                size, seg = np.array(size, np.int64), np.array(seg, np.int64)
                good, stats, texts, links = aligned(list(number), tokenizers)
                del number
                whole = (_sums(~good[seg], size) == 0) & (size > 0)
                seg = seg[np.repeat(whole, size)]
                size = np.where(whole, size, 0)
                at = np.append(0, np.cumsum(size)).tolist()
                sha = [hashlib.sha256(";".join(map(texts.__getitem__, seg[i:k].tolist())).encode()).hexdigest() if i < k else "" for i, k in zip(at, at[1:])]
                mine = np.stack([_sums(stats[seg, c], size) for c in range(4)], axis=1)
                pair, link = np.unique(links, return_inverse=True)
                times = np.repeat(np.bincount(seg, minlength=len(stats)), stats[:, 3])
                n = np.bincount(link, times, len(pair)).astype(np.int64)
                row = [[_pack(x)] for x in (mine, size, seg.astype(np.int32), stats[:, 3], link.astype(np.int32), pair, n)]
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([block]), ids, pa.array([sha], pa.list_(pa.string())), *[pa.array(x, pa.binary()) for x in row]], names=names)
                block += 1
                pa.default_memory_pool().release_unused()

    binary = ", ".join(f"{x} binary" for x in names[3:])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, f"block long, ids array<{kind}>, sha array<string>, {binary}")


def pair_counts(made: DataFrame) -> DataFrame:
    """The written table of pair (A's id << 32, plus B's id), n (links of the corpus that hold it), best (no pair of this B id has more)."""

    def counts(it):
        for batch in it:
            for pair, n in zip(batch.column(0), batch.column(1)):
                pair, n = _unpack(pair.as_py()), _unpack(n.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(pair[n > 0]), pa.array(n[n > 0])], names=["pair", "n"])

    pairs = save(made.select("pair", "n").mapInArrow(counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-sums")
    b = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    most = F.broadcast(pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most")))  # a row for each id of B's vocabulary at most
    return save(pairs.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def align(docs: DataFrame, make: tuple[str, str, str, str], id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    make: files of A (json, the same as ranks), A's pattern, file of B. Each text is encoded by both sides, in segments that
    neither merges across; the different segments of a block are encoded and their ends merged once, by pieces of equal
    work. Blocks are written with their documents as numbers of segments and their links as numbers of id pairs, so the
    text is read once. Pairs are summed over blocks by Spark; their counts go back to the blocks in a broadcast up to
    broadcast_pairs pairs, else each block's own pairs meet them in a join.

    Null or empty text, and a text whose tokens' bytes are not its own, has no tokens: zeros and ''. Null ids and
    repeated rows are rows like others, and each counts. Empty table: no rows. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    made = save(blocks(docs, make, id_col, text_col, block_bytes), "aligned-blocks")
    counts = pair_counts(made)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    out = f"doc_id {kind}, {', '.join(f'{c} long' for c in columns)}, groups_sha256 string"

    def rows(batch, k, count, best):
        """The documents of the k-th block, from the counts of its pairs."""
        get = lambda c, kind=np.int64: _unpack(batch.column(c)[k].as_py(), kind)
        size, seg, link, n_links = get("size"), get("seg", np.int32), get("link", np.int32), get("n_links")
        sums = [_sums(_sums(x[link], n_links)[seg], size) for x in (best.astype(np.int64), count)]
        stats = get("stats").reshape(-1, 4)
        ids = batch.column("ids")
        ids = ids.values.slice(ids.offsets[k].as_py(), len(size))
        return pa.RecordBatch.from_arrays([ids, *[pa.array(stats[:, c]) for c in range(4)], *map(pa.array, sums), pa.array(batch.column("sha")[k].as_py(), pa.string())], names=["doc_id", *columns, "groups_sha256"])

    if counts.count() <= broadcast_pairs:
        t = counts.toArrow()
        pair = np.asarray(t.column("pair"))
        order = np.argsort(pair)
        shared = docs.sparkSession.sparkContext.broadcast((pair[order], np.asarray(t.column("n"))[order], np.asarray(t.column("best"))[order]))

        def look_up(it):
            keys, n, best = shared.value
            for batch in it:
                for k in range(batch.num_rows):
                    pair = _unpack(batch.column("pair")[k].as_py())
                    at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
                    # a pair of rejected documents alone has no count, and no document asks for it
                    yield rows(batch, k, n[at] if len(keys) else pair, best[at] if len(keys) else pair)

        return made.mapInArrow(look_up, out)

    def own(it):
        for batch in it:
            for block, pair in zip(batch.column(0).to_pylist(), batch.column(1)):
                pair = _unpack(pair.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block)), pa.array(pair), pa.array(np.arange(len(pair)))], names=["block", "pair", "at"])

    def joined(it):
        for batch in it:
            for k in range(batch.num_rows):
                got = batch.column("got")
                got = got.values.slice(got.offsets[k].as_py(), len(got[k]))
                n = len(_unpack(batch.column("pair")[k].as_py()))
                count, best, at = np.zeros(n, np.int64), np.zeros(n, bool), np.asarray(got.field(0))
                count[at], best[at] = np.asarray(got.field(1)), np.asarray(got.field(2))
                yield rows(batch, k, count, best)

    asked = made.select("block", "pair").mapInArrow(own, "block long, pair long, at long")
    found = asked.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("got"))
    none = F.array().cast("array<struct<at:bigint,n:bigint,best:boolean>>")
    return made.join(found, "block", "left").withColumn("got", F.coalesce("got", none)).mapInArrow(joined, out)


def op12_merge_path(spark, sf_dir):
    import public_tokenizers as files

    make = (files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN, files.path("piece_bpe_32k.model"))
    return align(read_documents(spark, sf_dir), make)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
