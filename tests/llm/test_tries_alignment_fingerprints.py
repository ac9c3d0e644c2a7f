"""Operators 11 to 13 against brute-force versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from placeloom.llm import alignment, fingerprints, prefix_trie

# --- op11 -------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    members = {}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + mine[h:]
        for k in range(len(rebuilt[c]) + 1):
            members.setdefault(tuple(rebuilt[c][:k]), []).append(c)
    children, below, out = {}, {}, set()
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        below[p] = (saved + sum(below[k][0] for k in children.get(p, [])), sum(below[k][1] for k in children.get(p, [])) or 1)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(rebuilt[c]) == len(p))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), below[p][1], below[p][0], hashlib.sha256(ends.encode()).hexdigest()))
    return out


CONVERSATIONS = "extra int, conv_id long, turn long, role string, text string, low long"


def nodes_of(spark, tmp_path, rows, shard_turns=None):
    spark.createDataFrame([(1, *r, 2) for r in rows], CONVERSATIONS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    if shard_turns:
        from pyspark.sql import functions as F

        own = prefix_trie.sequences(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
        made = prefix_trie.trie(prefix_trie.rebuilt(own, F.col("conv_id") - F.col("conv_id") % 20, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"), 3), shard_turns)
    else:
        made = prefix_trie.op11_prefix_trie(spark, str(tmp_path))
    return [tuple(r) for r in made.collect()]


def test_op11_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(11)
    texts = ["yes", "no way", "", None, "a b c"]
    rows = [(c, t if t else None, [None, "user", "assistant"][t % 3], texts[int(rng.integers(0, 2 + c % 4))]) for c in range(3, 160) for t in range(int(rng.integers(1, 7)))]
    rows += [(1000 + c, t, "user", f"turn {t}") for c in range(40) for t in range(4)]  # a group of copies
    rows += [(2000 + c, t, "user", f"turn {t % 3}") for c in range(3) for t in range(50 + 20 * (c // 2))]  # longer than a matrix is wide
    rows += [(None, 0, "user", "of no conversation"), (-7, 1, "user", "yes"), (5000, 1, "user", "long " * 200_000)]
    got = nodes_of(spark, tmp_path, rows)
    want = brute_trie(rows)
    assert len(got) == len(want) and set(got) == want


def test_op11_small_shards_give_the_same(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [(c, t, "user", str(int(rng.integers(0, 2)))) for c in range(120) for t in range(int(rng.integers(1, 9)))] + [(200 + c, 0, "user", "0") for c in range(60)]
    got = nodes_of(spark, tmp_path, rows, 12)
    want = brute_trie(rows)
    assert len(got) == len(want) and set(got) == want


def test_op11_turnless_and_empty(spark, tmp_path):
    rows = [(c, 0, "user", "x") for c in range(20, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4]
    got = nodes_of(spark, tmp_path / "a", rows)
    assert set(got) == brute_trie(rows) and len(got) == 1  # only the root: no base, and own turns replaced
    assert nodes_of(spark, tmp_path / "b", [(None, 0, "user", "x")]) == []


def test_op11_sorts_rows_longer_than_a_panel():
    rng = np.random.default_rng(13)
    size = rng.integers(0, 60, 300)
    ids = np.concatenate([np.ones(n, np.int64) for n in size])
    ids[rng.integers(0, len(ids), 40)] = 2
    start, conv = np.cumsum(size) - size, rng.permutation(300)
    got = prefix_trie.sorted_rows(ids, start, size, conv, 4)
    assert got.tolist() == sorted(range(300), key=lambda r: (ids[start[r] : start[r] + size[r]].tolist(), conv[r]))


# --- op12 -------------------------------------------------------------------------------------------------------

ODD = [None, "", " ", "  ", "a  b\n c d ", "▁x", "x▁ y", "<|endoftext|> </s> <s>", "中文 テスト 👍🏽  x", "\n\n  a", "a\xa0b   c　d", "<0x41> \x00 é", "it's I'LL  'tis", "x" * 5000, " lead", "tab\t x\t\ty", "᠎ y \x85 z \x1c w", "a ​ b ﻿ c", "ﬁ ½ ①", "word " * 3000, "same text", "same text"]


def makers():
    path = public_tokenizers.path
    return path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model")


def brute_alignment(rows):
    a_file, _, _, b_file = makers()
    t = Tokenizer.from_file(a_file)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=b_file)
    letters = {c: b for b, c in alignment.byte_letters().items()}
    count, per = Counter(), []
    for i, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = m.encode(text) if text else []
        as_a = [bytes(letters[c] for c in t.id_to_token(x)) for x in a]
        as_b = [bytes([int(m.id_to_piece(x)[3:5], 16)]) if m.is_byte(x) else m.id_to_piece(x).replace("▁", " ").encode() for x in b]
        own = (" " + (text or "")).encode()
        if not text or b"".join(as_a) != own or b"".join(as_b) != own:
            per.append((i, None))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, as_a))).tolist(), np.cumsum(list(map(len, as_b))).tolist()
        links = [(a[x], b[y]) for x in range(len(a)) for y in range(len(b)) if max(ends_a[x] - len(as_a[x]), ends_b[y] - len(as_b[y])) < min(ends_a[x], ends_b[y])] if len(a) < 300 else None
        if links is None:
            links, x, y = [], 0, 0
            while x < len(a):
                links.append((a[x], b[y]))
                x, y = x + (ends_a[x] <= ends_b[y]), y + (ends_b[y] <= ends_a[x])
        groups, low = [], 0
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(str(k) for k, z in zip(a, ends_a) if low < z <= e) + "|" + ",".join(str(k) for k, z in zip(b, ends_b) if low < z <= e) if len(a) < 300 else None)
            low = e
        count.update(links)
        per.append((i, (len(a), len(b), len(groups), links, None if None in groups else ";".join(groups))))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(i, 0, 0, 0, 0, 0, 0, "") if p is None else (i, *p[:3], len(p[3]), sum(count[x] == best[x[1]] for x in p[3]), sum(count[x] for x in p[3]), p[4] and hashlib.sha256(p[4].encode()).hexdigest()) for i, p in per]


def test_op12_equals_brute_force_both_ways(spark):
    rows = list(enumerate(ODD)) + [(None, "an id that is null"), (7, "one id, two texts")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, block string").repartition(3)
    want = brute_alignment(rows)
    for how in ({}, {"block_bytes": 40, "broadcast_pairs": 0}):
        got = {tuple(r) for r in alignment.align(docs, makers(), **how).collect()}
        known = {w[:7]: w[7] for w in want}
        assert {g[:7] for g in got} == set(known)
        assert all(known[g[:7]] in (g[7], None) for g in got)
    assert alignment.align(docs.limit(0), makers()).count() == 0


def test_op12_pieces_do_not_show():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 400):
        a, b = (np.unique(np.append(rng.integers(1, 500, n), 500)) for _ in range(2))
        whole = alignment.overlaps(a, b, 10_000)
        ends = np.union1d(a, b)
        assert [x.tolist() for x in whole] == [np.searchsorted(a, ends).tolist(), np.searchsorted(b, ends).tolist(), np.isin(ends, np.intersect1d(a, b)).tolist()]
        for piece in (1, 2, 3, 7, 64):
            assert all((x == y).all() for x, y in zip(alignment.overlaps(a, b, piece), whole))
            cuts = alignment.diagonals(a, b, piece)
            assert (np.diff(cuts.sum(axis=1))[:-1] == piece).all()


def test_op12_segments_are_encoded_as_whole_texts():
    t = alignment.Tokenizers(*makers())
    assert t.cut and t.same
    rng = np.random.default_rng(9)
    letters = list("ab' \n\t.,1é漢 ") + ["  ", " x", "'s", "́", "\U0001f44d", "\xad"]
    for _ in range(1500):
        text = "".join(rng.choice(letters, int(rng.integers(1, 30))))
        a, b = t.encode(t.segments(text))
        assert sum(a, []) == t.exact.encode(" " + text, add_special_tokens=False).ids
        assert sum(b, []) == t.model.encode(text)


# --- op13 -------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    """Spark's xxhash64 is XXH64 with seed 42; a second value is hashed with the first one's hash as its seed."""
    second = xxh64_intdigest((128).to_bytes(4, "little"), 42)
    votes, total = [0] * 128, 0
    for w in re.findall(r"[^\x20\x09-\x0d]+", text):
        h = xxh64_intdigest(w.encode(), 42) | xxh64_intdigest(w.encode(), second) << 64
        total += len(w)
        for i in range(128):
            votes[i] += len(w) * (h >> i & 1)
    return sum(1 << i for i in range(128) if 2 * votes[i] > total)


def like(a, b):
    return max(0.0, math.cos(math.pi * (a ^ b).bit_count() / 128))


def test_op13_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice("the of and river 漢字 naïve seven 👍 plate".split(), int(n))) for n in rng.integers(0, 60, 40)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(40) * 3, texts)]
    rows += [(500, None), (501, ""), (502, texts[3]), (503, texts[3]), (504, "word " * 300_000), (505, "x"), (506, "ab cd"), (506, "another text"), (None, "no id"), (507, "thrice the same"), (507, "thrice the same"), (507, "thrice the same")]
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, part string").repartition(3)
    got = fingerprints.compare(docs).collect()
    assert len(got) == len(rows)
    of = {(r.doc_id, r.n_chars): r for r in got}
    ordered = sorted({(i, t or "") for i, t in rows if i != 506 or t != "another text"}, key=lambda r: (r[0] is not None, r[0] or 0))
    prints = {t: brute_fingerprint(t) for t in {t or "" for _, t in rows}}
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        if i in (505, 506, 507):
            continue  # an id with two texts (their order is by hash), and repeated rows
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        r = of[i, len(t)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (int(r.fingerprint, 16), int(r.edited_fingerprint, 16)) == (prints[t], brute_fingerprint(edited))
        assert abs(r.near_edited - like(prints[t], brute_fingerprint(edited))) < 1e-12 and abs(r.near_next - like(prints[t], prints[after])) < 1e-12
    thrice = sorted((r.near_next, r.edited_sha256) for r in got if r.doc_id == 507)
    t = "thrice the same"
    assert [x[0] for x in thrice].count(1.0) >= 2 and [x[1] for x in thrice].count(hashlib.sha256((t[:12] + t[:3]).encode()).hexdigest()) == 2
    assert fingerprints.compare(docs.limit(0)).count() == 0
    alone = fingerprints.compare(docs.filter("doc_id = 505")).collect()
    assert [(r.near_edited, r.near_next) for r in alone] == [(1.0, 1.0)]


@pytest.mark.parametrize(("radius", "blocks"), [(3, 6), (1, 2), (5, 8)])
def test_op13_block_tables_lose_no_pair(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    near = [int.from_bytes(rng.bytes(16)) for _ in range(4)]
    fps = {x ^ sum(1 << int(b) for b in rng.choice(128, int(rng.integers(0, 5)), replace=False)) for x in near for _ in range(60)} | {0, (1 << 128) - 1}
    signed = lambda x: (x & (1 << 63) - 1) - (x & 1 << 63)
    both = lambda x: (signed(x & (1 << 64) - 1), signed(x >> 64))
    table = spark.createDataFrame([both(x) for x in fps], "f1 long, f2 long")
    asked = sorted(fps)[::5]
    got = fingerprints.within(spark.createDataFrame([both(x) for x in asked], "f1 long, f2 long"), table, radius, blocks).collect()
    want = {(*both(x), *both(y), (x ^ y).bit_count()) for x in asked for y in fps if (x ^ y).bit_count() <= radius}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_op13_counts_of_rows(spark):
    rows = spark.createDataFrame([(0, 1, 1), (20, 1, 1), (1, 1, 3), (2, 99, -1), (None, 1, 1)], "doc_id long, f1 long, f2 long")
    from pyspark.sql import functions as F

    got = {(r.doc_id, r.n_within) for r in fingerprints.count_within(rows, F.col("doc_id") % 20 == 0).collect()}
    assert got == {(0, 4), (20, 4), (1, None), (2, None), (None, None)}
