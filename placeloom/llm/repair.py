"""Token ids in Re-Pair compressed shards that can be read back at random."""

from __future__ import annotations

import re
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_process, read_documents, save, slices

END_ID = 1
#: A shard is closed at so many ids (a longer document has a shard of its own).
SHARD_IDS = 1 << 21
#: A pair gets a rule if a shard has it so many times: a rule takes three numbers (two symbols, a length), and each
#: replacement saves one.
MIN_PAIR = 4
#: Documents are read back together up to so many ids.
READ_IDS = 1 << 16
#: Rules of so many ids at most are expanded once for a shard.
SHORT = 64
#: Words whose ids a process keeps at most.
CACHE_WORDS = 1 << 20
MAGIC = b"RPR1"


# --- grammar ---------------------------------------------------------------------------------------------------


def _numbers(keys: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Place of each pair in keys, or -1: tables by hash; keys that meet in a slot go on to the next table."""
    out, todo, names = np.full(len(pair), -1, np.int32), np.arange(len(pair)), np.arange(len(keys), dtype=np.int32)
    left, times = keys, 0x9E3779B97F4A7C15
    while len(left):
        bits = np.uint64(64 - max(10, int(8 * len(left)).bit_length()))
        slot = lambda x: (x.view(np.uint64) * np.uint64(times)) >> bits  # noqa: B023, E731
        table = np.zeros(1 << int(64 - bits), np.int32)
        table[slot(left)] = np.arange(len(left))
        got = table[slot(pair[todo] if times != 0x9E3779B97F4A7C15 else pair)]
        same = left[got] == (pair[todo] if len(todo) < len(pair) else pair)
        out[todo[same]] = names[got[same]]
        lost = left[table[slot(left)]] != left
        todo, left, names, times = todo[~same], left[lost], names[lost], times * 5 & ((1 << 64) - 1)
    return out


def compress(ids: np.ndarray, first_rule: int, min_pair: int = MIN_PAIR) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): rule k makes symbol first_rule + k of two earlier symbols.

    Rounds until no pair occurs min_pair times (all frequent pairs of a round at once, not one pair at a time): the frequent pairs are counted, each gets a nonterminal, and of
    overlapping occurrences the one of the more frequent pair is replaced (in a run of equal pairs every other
    one). A round looks at the places whose pair can be frequent: those of the last round that are still there, and
    both sides of each symbol that is new.
    """
    seq, rules, made = ids.astype(np.int32), [np.empty((0, 2), np.int64)], first_rule
    at = np.arange(len(seq) - 1)
    while len(at):
        pair = seq[at].astype(np.int64) << 32 | seq[at + 1]
        order = np.sort(pair)
        first = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
        count = np.diff(np.append(first, len(order)))
        keys, count = order[first[count >= min_pair]], count[count >= min_pair]
        number = _numbers(keys, pair)
        at, number = at[number >= 0], number[number >= 0]
        if not len(at):
            break
        # priority: more frequent first, then the smaller pair
        priority = np.empty(len(keys), np.int32)
        priority[np.lexsort((keys, -count))] = np.arange(len(keys), 0, -1)
        mine = priority[number]
        touch = np.flatnonzero(at[1:] == at[:-1] + 1)
        left, right = np.zeros_like(mine), np.zeros_like(mine)
        left[touch + 1], right[touch] = mine[touch], mine[touch + 1]
        take = (mine > left) & (mine >= right)
        run = np.flatnonzero(mine == left)  # runs of one pair (a a a): every other occurrence, from the run's begin
        if len(run):
            begin = np.flatnonzero(np.append(True, run[1:] != run[:-1] + 1))
            odd = (np.arange(len(run)) - np.repeat(begin, np.diff(np.append(begin, len(run))))) % 2 == 1
            take[run] = odd & (mine[run] >= right[run])
        take[1:] &= ~(take[:-1] & (at[1:] == at[:-1] + 1))
        used = np.bincount(number[take], minlength=len(keys))
        kept = np.flatnonzero(used >= 2)  # a rule that is used once costs more than it saves
        if not len(kept):
            break
        symbol = np.full(len(keys), -1, np.int32)
        symbol[kept] = made + np.arange(len(kept))
        made += len(kept)
        rules.append(np.stack((keys[kept] >> 32, keys[kept] & 0xFFFFFFFF), axis=1))
        take &= symbol[number] >= 0
        here = at[take]
        seq[here] = symbol[number[take]]
        new, stay = np.zeros(len(seq) + 1, bool), np.ones(len(seq), bool)
        new[here], stay[here + 1] = True, False
        old = at[stay[at] & ~new[at] & ~new[at + 1]]
        mark = np.zeros(len(seq) + 1, bool)  # of places before the deletion
        mark[old], mark[here] = True, True
        before = here[here > 0] - 1
        mark[np.where(stay[before], before, before - 1)] = True
        seq, mark = seq[stay], mark[:-1][stay]
        at = np.flatnonzero(mark[:-1])
    return seq.astype(np.int64), np.concatenate(rules)


def lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each rule expands to. A rule's parts come before it, so levels of rules are done at a time."""
    out = np.ones(first_rule + len(rules), np.int64)
    done = np.arange(first_rule + len(rules)) < first_rule
    todo = np.arange(len(rules))
    while len(todo):
        ready = todo[done[rules[todo]].all(axis=1)]
        out[first_rule + ready] = out[rules[ready]].sum(axis=1)
        done[first_rule + ready] = True
        todo = todo[~done[first_rule + todo]]
    return out[first_rule:]


def expand(seq: np.ndarray, rules: np.ndarray, first_rule: int, stop: np.ndarray | None = None) -> np.ndarray:
    """The ids of a sequence: each pass replaces every nonterminal by its two parts (with stop, but those rules for which it is true)."""
    seq = seq.astype(np.int64)
    again = np.ones(first_rule + len(rules), bool)
    again[:first_rule] = False
    if stop is not None:
        again[first_rule:] = ~stop
    while len(big := np.flatnonzero(again[seq])):
        wide = np.ones(len(seq), np.int64)
        wide[big] = 2
        at = np.cumsum(wide) - wide
        out = np.empty(len(seq) + len(big), np.int64)
        out[at] = seq
        parts = rules[seq[big] - first_rule]
        out[at[big]], out[at[big] + 1] = parts[:, 0], parts[:, 1]
        seq = out
    return seq


# --- file format -----------------------------------------------------------------------------------------------
# magic, first_rule, number of rules, symbols, documents (u32 each); rules (u32 pairs); length of each rule (u32);
# sequence (u32); ids of each document (u64); each part after the header is deflated on its own.


def pack(ids: np.ndarray, sizes: np.ndarray, first_rule: int, min_pair: int = MIN_PAIR) -> bytes:
    seq, rules = compress(ids, first_rule, min_pair)
    parts = [rules.astype("<u4"), lengths(rules, first_rule).astype("<u4"), seq.astype("<u4"), sizes.astype("<u8")]
    packed = [zlib.compress(p.tobytes(), 1) for p in parts]
    return MAGIC + struct.pack("<8I", first_rule, len(rules), len(seq), len(sizes), *map(len, packed)) + b"".join(packed)


class Shard:
    """A shard of the format; document(k) decodes one document, ids() all."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        self.first_rule, *_, a, b, c, d = struct.unpack_from("<8I", blob, 4)
        at, parts = 36, []
        for n, kind in ((a, "<u4"), (b, "<u4"), (c, "<u4"), (d, "<u8")):
            parts.append(np.frombuffer(zlib.decompress(blob[at : at + n]), kind).astype(np.int64))
            at += n
        self.rules, self.rule_lengths, self.seq, self.sizes = parts[0].reshape(-1, 2), *parts[1:]
        self.ends = np.cumsum(self.sizes)
        self.wide = np.where(self.seq >= self.first_rule, np.append(self.rule_lengths, 0)[np.maximum(self.seq - self.first_rule, -1)], 1)
        self.after = np.cumsum(self.wide)
        # ids of each symbol that is short, one after the other; longer rules are replaced by these first
        self.short = self.rule_lengths <= SHORT
        size = np.append(np.ones(self.first_rule, np.int64), np.where(self.short, self.rule_lengths, 0))
        table = expand(self.first_rule + np.flatnonzero(self.short), self.rules, self.first_rule)
        self.size, self.flat = size, np.concatenate((np.arange(self.first_rule), table)).astype(np.uint32)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        return _gather(self.size, self.flat, expand(seq, self.rules, self.first_rule, self.short))[1]

    def ids(self) -> np.ndarray:
        return self._expand(self.seq)

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end of the shard; only symbols that overlap them are expanded."""
        if begin >= end:
            return np.empty(0, np.uint32)
        i, j = np.searchsorted(self.after, begin, "right"), np.searchsorted(self.after, end, "left")
        skip = begin - (self.after[i] - self.wide[i])
        return self._expand(self.seq[i : j + 1])[skip : skip + end - begin]

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.ends[k] - self.sizes[k]), int(self.ends[k]))

    def documents(self, most: int = READ_IDS):
        """The documents' ids in turn; a slice of about `most` ids (or one document) is expanded at a time."""
        k = 0
        while k < len(self.sizes):
            begin = int(self.ends[k] - self.sizes[k])
            stop = max(k + 1, int(np.searchsorted(self.ends, begin + most, "right")))
            ids = self.slice(begin, int(self.ends[stop - 1]))
            cuts = (self.ends[k:stop] - begin).tolist()
            yield from (ids[a:b] for a, b in zip([0, *cuts], cuts))
            k = stop


# --- encoding --------------------------------------------------------------------------------------------------

#: Letters of the Latin-1 block, then signs but no apostrophe: the tokenizer makes two pieces of these.
_PLAIN = r"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[!-&(-/:-@\[-`{-~]*)$"


class Encoder:
    """Ids of whole texts by the tokenizers library as it is loaded, which sees each different word of a batch once.

    No piece and no special token of the tokenizer spans white space, so a text's ids are those of its words in turn.
    Plain words go to the library many to a call, in lower case as it makes them itself, and are told apart by their
    word-end tokens; their ids are kept for the process's later batches, up to CACHE_WORDS words. All other words,
    and those that hold a special token, go one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = "|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())
        self.forget()

    def forget(self) -> None:
        self.words, self.sizes, self.flat = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _kept(self, words: pa.Array) -> np.ndarray:
        """Places of different plain words in self.words; those that are not there yet are encoded and added."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        at = np.asarray(pc.fill_null(at, -1)).astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(new))
        sizes, ids = self._plain(new)
        self.words, self.sizes, self.flat = pa.concat_arrays([self.words, new]), np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, ids))
        return at

    def _single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.array([i for x in ids for i in x], np.uint32)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in turn) of different plain words in lower case."""
        sizes, flat = [], []
        for i in range(0, len(words), 1024):
            part = words.slice(i, 1024)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # a word that is not one piece after all
                n, ids = self._single(part.to_pylist())
            else:
                n = np.diff(stops, prepend=0)
            sizes.append(n)
            flat.append(ids)
        return np.concatenate([np.empty(0, np.int64), *sizes]), np.concatenate([np.empty(0, np.uint32), *flat])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in turn); null is an empty text."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = cut.values.dictionary_encode()
        names = words.dictionary
        parts = pc.extract_regex(names, _PLAIN)
        plain = pc.is_valid(parts)
        if self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring_regex(names, self.special)))
            parts = pc.if_else(plain, parts, None)
        plain = np.asarray(plain)
        head = pc.utf8_lower(pc.struct_field(parts, 0)).dictionary_encode()
        tail = pc.fill_null(pc.struct_field(parts, 1), "").dictionary_encode()
        # pieces: kept heads, tails, other words; a word is one or two of them
        heads = self._kept(head.dictionary)
        tails, others = self._single(tail.dictionary.to_pylist()), self._single(names.filter(pa.array(~plain)).to_pylist())
        sizes, ids = np.concatenate((self.sizes, tails[0], others[0])), np.concatenate((self.flat, tails[1], others[1]))
        at_tail = len(self.sizes)
        at_other = at_tail + len(tails[0])
        pieces = np.empty((len(names), 2), np.int64)
        pieces[:, 1] = at_tail + np.asarray(tail.indices)
        pieces[~plain, 0] = at_other + np.arange(np.count_nonzero(~plain))
        pieces[plain, 0] = heads[np.asarray(head.indices.filter(pa.array(plain)))]
        size, ids = _gather(sizes, ids, pieces.ravel())
        size, ids = _gather(size.reshape(-1, 2).sum(axis=1), ids, np.asarray(words.indices))
        bounds = np.append(0, np.cumsum(size))[np.asarray(cut.offsets)]
        return np.diff(bounds), ids


def _gather(sizes: np.ndarray, flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, all values in turn) of the lists `which` of those that lie in flat one after the other."""
    first, size = np.cumsum(sizes) - sizes, sizes[which]
    after = np.cumsum(size)
    step = np.ones(after[-1] if len(after) else 0, np.int64)  # each place is the one before plus one, but where a list begins
    some = size > 0
    begin = first[which][some]
    if len(begin):
        step[0] = begin[0]
        step[(after - size)[some][1:]] = begin[1:] - begin[:-1] - size[some][:-1] + 1
    return size, flat[np.cumsum(step)]


# --- operator --------------------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, min_pair: int = MIN_PAIR) -> DataFrame:
    """The written table of shards: part, shard, first_id, doc_ids, n_ids, payload (the file format).

    Documents are range-partitioned by id, sorted, encoded and compressed in one pass; a partition's shards hold
    about shard_ids ids each, so a task holds one shard. Part, shard and place within a shard give ascending id
    order over all documents; equal ids stand in order of their texts (rows repeated with both: one after the other).
    Null ids come first; null and empty text have only the end id; a document over shard_ids has a shard of its own.
    Empty table: no shards. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def shards(it):
        from pyspark import TaskContext

        enc = per_process(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        part, number = TaskContext.get().partitionId(), 0
        names, sizes, raw, held = [], [], [], 0

        def flush():
            blob = pack(np.concatenate(raw), np.concatenate(sizes), enc.size, min_pair)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.ListArray.from_arrays(pa.array([0, sum(map(len, names))], pa.int32()), pa.concat_arrays(names)), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], names=["part", "shard", "doc_ids", "n_ids", "payload"])

        for batch in it:
            for some in slices(batch, 1):
                n, ids = enc.encode(some.column(1))
                ids = np.insert(ids, np.cumsum(n), END_ID)
                ends = np.cumsum(n + 1)
                begin = 0
                while begin < some.num_rows:  # documents until the shard is full
                    at = ends[begin - 1] if begin else 0
                    stop = min(some.num_rows, int(np.searchsorted(ends, at + shard_ids - held)) + 1)
                    names.append(some.column(0).slice(begin, stop - begin))
                    sizes.append(n[begin:stop] + 1)
                    raw.append(ids[at : ends[stop - 1]])
                    held += int(ends[stop - 1] - at)
                    begin = stop
                    if held >= shard_ids:
                        yield flush()
                        names, sizes, raw, held, number = [], [], [], 0, number + 1
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return save(rows.mapInArrow(shards, f"part int, shard int, doc_ids array<{kind}>, n_ids long, payload binary"), "repair-shards", "zstd")


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, shard, shard_start: ids in all shards before. Parts are summed in one task (a row each), shards within their part."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before("n", Window.orderBy("part")).alias("part_start"))
    rows = shards.select("part", "shard", before("n_ids", Window.partitionBy("part").orderBy("shard")).alias("inside"))
    return rows.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("inside")).alias("shard_start"))


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document of the written shards: doc_id, start, n_tokens, ids_crc32, part, shard, shard_bytes, shard_rules.

    Documents are read through the grammar by their places, READ_IDS ids at a time, never a whole shard at once.
    Null ids, repeated rows and documents without words (the end id only) come back as they were written. No shards:
    no rows.
    """
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    starts = save(shard_starts(shards), "repair-starts")

    def documents(it):
        for batch in it:
            for k in range(batch.num_rows):
                part, number, names, blob = (batch.column(c)[k].as_py() for c in range(4))
                s = Shard(blob)
                begins = (s.ends - s.sizes).tolist()
                crc = [zlib.crc32(ids.astype("<u4")) for ids in s.documents()]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(names, batch.schema.field(2).type.value_type), pa.array(begins, pa.int64()), pa.array(s.sizes), pa.array(crc, pa.int64()), pa.array([len(blob)] * n, pa.int64()), pa.array([len(s.rules)] * n, pa.int32())],
                    names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32", "shard_bytes", "shard_rules"],
                )

    rows = shards.select("part", "shard", "doc_ids", "payload").mapInArrow(documents, f"part int, shard int, doc_id {kind}, at long, n_tokens long, ids_crc32 long, shard_bytes long, shard_rules int")
    rows = rows.join(F.broadcast(starts) if starts.count() <= 200_000 else starts, ["part", "shard"])
    return rows.select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", "shard_bytes", "shard_rules")


def op1_repair_shards(spark, sf_dir):
    import public_tokenizers

    return read_shards(write_shards(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
