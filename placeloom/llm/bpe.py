"""Byte-level BPE: encoding by replaying all merges over a corpus' words, and decoding."""

from __future__ import annotations

import base64
import sys
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, per_process, read_documents, slices

#: Text of one replay: the words of about so many bytes are merged together.
CORPUS_BYTES = 8 << 20
#: Ids that decoding holds as Python numbers at once.
DECODE_IDS = 1 << 18


class Merges:
    """The ranks of a vocabulary file ("base64 rank" lines) as tables: ids of single bytes, and the id that a pair of ids makes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, i in self.ids.items():
            for k in range(1, len(token)):
                a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id (and rank) that each pair makes, or -1."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def alone(self, word: bytes) -> list[int]:
        """One word by the definition: the leftmost pair of lowest rank is merged until none is left."""
        if word in self.ids:
            return [self.ids[word]]
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            ranks = [self.ids.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            k = ranks.index(min(ranks))
            if ranks[k] == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in turn) of different words.

        All words lie in one array of symbols; an index leads from each pair's rank to its places. Ranks are taken
        in order; each merge touches its places and their neighbours, whose new pairs go into the index. A word in
        which a merge brings forth a pair of no higher rank (so that the order within the word would matter) is
        done alone afterwards.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        tok = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(tok)
        word = np.repeat(np.arange(len(words)), sizes)
        nxt = np.arange(1, n + 1)
        prv = np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        nxt[ends[sizes > 0] - 1] = -1
        prv[(ends - sizes)[sizes > 0]] = -1
        rank = np.full(n, -1, np.int64)
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self.rank(tok[inner], tok[inner + 1])
        whole = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))
        rank[whole[word] >= 0] = -1  # a word in the vocabulary is its own id
        alive, odd = np.ones(n, bool), []

        index: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> None:
            r = rank[at]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for a, b, k in zip(cuts, cuts[1:], r[cuts[:-1]].tolist()):
                if k in index:
                    index[k].append(at[a:b])
                else:
                    index[k] = [at[a:b]]
                    heappush(waiting, k)

        waiting: list[int] = []
        if len(first := np.flatnonzero(rank >= 0)):
            enter(first)
        heapify(waiting)
        while waiting:
            r = heappop(waiting)
            at = index.pop(r)
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            at = at[rank[at] == r]
            if not len(at):
                continue
            follows = np.zeros(len(at), bool)
            follows[1:] = nxt[at[:-1]] == at[1:]
            if follows.any():  # overlapping places: every other one, from the left
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(follows, 0, place))
                at = at[(place - start) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            tok[at], nxt[at] = r, after
            alive[gone], rank[gone] = False, -1
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            right, left = at[after >= 0], before[before >= 0]
            rank[at] = -1
            rank[right] = self.rank(tok[right], tok[nxt[right]])
            rank[left] = self.rank(tok[left], tok[nxt[left]])
            new = np.concatenate((right, left))
            new = new[rank[new] >= 0]
            if len(new):
                odd += word[new[rank[new] <= r]].tolist()
                enter(new)
        out = tok[alive]
        count = np.bincount(word[alive], minlength=len(words))
        if len(found := np.flatnonzero(whole >= 0)) or odd:
            redo = {int(w): [int(whole[w])] for w in found}
            redo.update((w, self.alone(words[w])) for w in set(odd))
            begin = np.cumsum(count) - count
            keep = np.ones(len(words), bool)
            keep[list(redo)] = False
            new_count = count.copy()
            new_count[list(redo)] = [len(x) for x in redo.values()]
            start = np.cumsum(new_count) - new_count
            merged = np.empty(int(new_count.sum()), np.int64)
            kept = keep[word[alive]]
            source = np.flatnonzero(kept)
            owner = word[alive][kept]
            merged[start[owner] + source - begin[owner]] = out[kept]
            size = np.fromiter(map(len, redo.values()), np.int64, len(redo))
            flat = np.fromiter((i for x in redo.values() for i in x), np.int64, int(size.sum()))
            where = np.repeat(start[list(redo)] - (np.cumsum(size) - size), size) + np.arange(len(flat))
            merged[where] = flat
            out, count = merged, new_count
        return count, out

    def encode(self, texts: list[str], find) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in turn); find(text) lists a text's matches."""
        chunks, counts = [], []
        for i in range(0, len(texts), 200):
            got = [find(t) for t in texts[i : i + 200]]
            counts += map(len, got)
            chunks.append(pa.array([w for ws in got for w in ws], pa.string()))
        words = pa.chunked_array(chunks, pa.string()).combine_chunks().dictionary_encode()
        size, flat = self.replay([w.encode() for w in words.dictionary.to_pylist()])
        first = np.cumsum(size) - size
        which = np.asarray(words.indices)
        wide = size[which]
        after = np.cumsum(wide)
        ids = flat[np.repeat(first[which] - (after - wide), wide) + np.arange(after[-1] if len(after) else 0)]
        bounds = np.append(0, after)[np.append(0, np.cumsum(np.array(counts, np.int64)))]
        return np.diff(bounds), ids


def _decode(tokens: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(b"".join(map(tokens.__getitem__, ids[i : i + DECODE_IDS].tolist())) for i in range(0, len(ids), DECODE_IDS))


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", out: str = "ids", decoded: str | None = None, keep_text: bool = True, corpus_bytes: int = CORPUS_BYTES) -> DataFrame:
    """docs with the ids (array of int) of each text, as tiktoken's encode_ordinary gives them.

    decoded: also a column of that name with the bytes that the ids decode to, from the same Python process.
    keep_text: without it the text column stays behind, and is not sent back from Python.

    Each match of the pattern is encoded separately. A task takes its documents in parts of corpus_bytes text; the
    different words of a part are merged together by Merges.replay, and its documents read their words' ids.
    Merges of one word do not depend on other words, so the parts do not show in the result; a table of all
    words of the whole corpus would have to be joined to every occurrence, which shuffles all text for the same
    ids. No shuffle. Null text is empty: no ids. Other columns, rows and their order stay as they are.
    """
    at = docs.columns.index(text_col)
    back = [i for i in range(len(docs.columns)) if keep_text or i != at]

    def batches(it):
        import regex

        merges = per_process(f"merges {ranks}", lambda: Merges(ranks))
        find = regex.compile(pattern).findall
        for batch in it:
            for part in slices(batch, at, corpus_bytes):
                n, ids = merges.encode([t or "" for t in part.column(at).to_pylist()], find)
                ends = np.cumsum(n)
                columns = [*map(part.column, back), pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))]
                if decoded:
                    columns.append(pa.array([_decode(merges.tokens, ids[b - k : b]) for k, b in zip(n.tolist(), ends.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*(part.schema.names[i] for i in back), *names])
                del columns, ids
                pa.default_memory_pool().release_unused()

    names = fresh(docs, *[x for x in (out, decoded) if x])
    added = [T.StructField(x, t) for x, t in zip(names, (T.ArrayType(T.IntegerType()), T.BinaryType()))]
    return docs.mapInArrow(batches, T.StructType([*(docs.schema.fields[i] for i in back), *added]))


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the bytes of each row's ids. Null ids: no bytes. An id outside the vocabulary raises."""
    at = encoded.columns.index(ids_col)

    def batches(it):
        tokens = per_process(f"merges {ranks}", lambda: Merges(ranks)).tokens
        for batch in it:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(at)), 0)).astype(np.int64)
            part = np.cumsum(sizes) // (16 * DECODE_IDS)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                rows = batch.slice(a, b - a)
                texts = [_decode(tokens, np.asarray(x.values) if x.is_valid else np.empty(0, np.int32)) for x in rows.column(at)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, name])

    (name,) = fresh(encoded, out)
    return encoded.mapInArrow(batches, T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())]))


def ids_digest(ids_col: str):
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " ").cast("binary"), 256)


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 (of the bytes that the ids decode to).

    Null text is empty: no ids, and digests of nothing. Null ids and repeated rows are rows like others. Empty table: no
    rows. Other columns are not read.
    """
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = encode(rows, ranks, public_tokenizers.PATTERN, decoded="decoded", keep_text=False)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe_replay(spark, sf_dir):
    return token_digests(read_documents(spark, sf_dir))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
