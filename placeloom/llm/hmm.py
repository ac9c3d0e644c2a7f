"""Hidden Markov language model: Baum-Welch over partitions, exact likelihood by scaled forward recursion."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_documents, save, slices

STATES = 8
#: Passes of Baum-Welch over all training documents go on until one gains less than GAIN of the log likelihood, at most
#: PASSES. First values come from SEED_PASSES over SEED_TOKENS tokens, taken in equal parts from SEED_BLOCKS blocks.
PASSES = 8
GAIN = 0.002
SEED_PASSES = 12
SEED_TOKENS = 200_000
SEED_BLOCKS = 256
#: A token has an emission of its own if it is at least 1/OWN_SHARE of the training tokens (so OWN_SHARE of them at
#: most); the others emit their ending's class, and then the token within its class.
OWN_SHARE = 8192
ENDINGS = 256
#: Text of a block, and tokens that the recursions hold at once.
BLOCK_BYTES = 16 << 20
BATCH_TOKENS = 1 << 19
SMOOTH = 0.1
COLD_SMOOTH = 0.5


# --- blocks ----------------------------------------------------------------------------------------------------


def tokenize(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """The written table of blocks: block, doc_ids, held_out, lengths, words (its different tokens), counts (of each in
    training documents), tokens (compressed places in words; -1 is the end). One pass over the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def blocks(it):
        import zstandard
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in it:
            for some in slices(batch, 1, block_bytes):
                cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(some.column(1), "")))
                real = np.asarray(pc.binary_length(cut.values)) > 0
                upto = np.append(0, np.cumsum(real))[np.asarray(cut.offsets)]
                n = np.diff(upto)
                words = cut.values.filter(pa.array(real)).dictionary_encode()
                held = np.asarray(some.column(2).fill_null(True))
                ids = np.asarray(words.indices).astype(np.int32)
                counts = np.bincount(ids[np.repeat(~held, n)], minlength=len(words.dictionary))
                ids = np.insert(ids, upto[1:], -1)
                one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
                packed = zstandard.ZstdCompressor(level=1).compress(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 24 | number], pa.int64()), one(some.column(0), None), one(held, pa.bool_()), one(n + 1, pa.int64()), one(words.dictionary, None), one(counts, pa.int64()), pa.array([packed], pa.binary())],
                    names=["block", "doc_ids", "held_out", "lengths", "words", "counts", "tokens"],
                )
                number += 1

    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held.alias("held"))
    return save(rows.mapInArrow(blocks, f"block long, doc_ids array<{kind}>, held_out array<boolean>, lengths array<long>, words array<string>, counts array<long>, tokens binary"), "lm-blocks")


def classify_tokens(blocks: DataFrame, train_tokens: int, ends: int, own_share: int, endings: int):
    """(rows, mass, class sizes, kinds, distinct): rows block, at, c, cls for every token of every block.

    The blocks' counts of a token are added up where they stand before they meet, and the table of counts is joined
    back to the blocks' tokens, so a token of every block is no group of its own; a token is in a block once, however often
    it stands there. Classes: 0 to endings - 1 for the others' endings, then own tokens (own_share at most), then the end.
    """
    tokens = blocks.select(F.col("block").alias("block"), F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("block", "at", F.col("x.words").alias("token"), F.col("x.counts").alias("n"))
    counts = save(tokens.groupBy("token").agg(F.sum("n").alias("c")), "lm-counts", "zstd")
    own = F.col("c") * own_share >= max(train_tokens, 1)
    owned = counts.filter(own).orderBy(F.desc("c"), "token").collect()
    number = {r["token"]: endings + k for k, r in enumerate(owned)}
    ending = (F.crc32(F.right("token", F.lit(2)).cast("binary")) % endings).cast("int")
    sums = counts.filter(~own & (F.col("c") > 0)).groupBy(ending.alias("cls")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    size, kinds = np.zeros(endings), np.zeros(endings)
    for r in sums:
        size[r["cls"]], kinds[r["cls"]] = r["n"], r["v"]
    classes = counts.withColumn("cls", ending)
    if number:
        table = blocks.sparkSession.createDataFrame(list(number.items()), "token string, own int")
        classes = classes.join(F.broadcast(table), "token", "left").select("token", "c", F.coalesce("own", "cls").alias("cls"))
    rows = tokens.select("block", "at", "token").join(classes, "token").select("block", "at", "c", "cls")
    mass = np.concatenate((size, [r["c"] for r in owned], [ends]))
    distinct = len(owned) + int(kinds.sum()) + (ends > 0)
    return rows, mass, size, kinds, distinct


def label(blocks: DataFrame, rows: DataFrame, n_classes: int, size: np.ndarray, kinds: np.ndarray, end_count: int) -> DataFrame:
    """The written table of labelled blocks: doc_ids, held_out, lengths, known, base (sums of log10(c + 0.1)), inside
    (sums of log10 of the token within its class), classes (compressed, of each token in turn)."""
    added = (("known", T.ArrayType(T.LongType())), ("base", T.ArrayType(T.DoubleType())), ("inside", T.ArrayType(T.DoubleType())), ("classes", T.BinaryType()))
    schema = T.StructType([*blocks.select("block", "doc_ids", "held_out", "lengths").schema.fields, *[T.StructField(*x) for x in added]])
    endings = len(size)

    def one_block(_key, left, right):
        import zstandard

        at, c, cls = (np.asarray(right.column(k).combine_chunks()) for k in ("at", "c", "cls"))
        d = len(at)
        count, label, inside = np.zeros(d + 1), np.zeros(d + 1, np.int64), np.zeros(d + 1)
        count[at], label[at] = c, cls
        count[d], label[d] = end_count, n_classes - 1  # place -1
        cold = np.flatnonzero(label < endings)
        k = label[cold]
        inside[cold] = np.log10((count[cold] + 0.1) / (size[k] + 0.1 * (kinds[k] + 1)))
        row = left.select(["block", "doc_ids", "held_out", "lengths"]).combine_chunks()
        n = np.asarray(row.column("lengths").chunk(0).values)
        tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(left.column("tokens")[0].as_py()), np.int32)
        begin = np.cumsum(n) - n
        sums = lambda x: np.add.reduceat(x[tokens], begin)
        packed = zstandard.ZstdCompressor(level=1).compress(label[tokens].astype("<u2").tobytes())
        for name, x, t in (("known", sums((count > 0).astype(np.int64)), pa.int64()), ("base", sums(np.log10(count + 0.1)), pa.float64()), ("inside", sums(inside), pa.float64())):
            row = row.append_column(name, pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.array(x, t)))
        return row.append_column("classes", pa.array([packed], pa.binary()))

    kept = blocks.select("block", "doc_ids", "held_out", "lengths", "tokens")
    return save(kept.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(one_block, schema), "lm-classes")


# --- recursions ------------------------------------------------------------------------------------------------


def _batches(seq: np.ndarray, n: np.ndarray, most: int = BATCH_TOKENS):
    """(sequences by falling length, their classes by time): at each time the sequences still running are the first ones."""
    order = np.argsort(-n, kind="stable")
    begin = np.cumsum(n) - n
    group = (np.cumsum(n[order]) - 1) // most
    for g in np.unique(group):
        rows = order[group == g]
        size, at = n[rows], begin[rows]
        running = np.searchsorted(-size, -np.arange(size[0]), "left")  # sequences longer than t
        yield rows, running, at, size


def _by_time(seq, running, at):
    """Classes in order of time; begin of each time's classes."""
    first = np.append(0, np.cumsum(running))
    t = np.repeat(np.arange(len(running)), running)
    k = np.arange(first[-1]) - first[t]
    return seq[at[k] + t], first


def log_likelihood(seq: np.ndarray, n: np.ndarray, start, move, emit) -> np.ndarray:
    """log10 likelihood of each sequence: the scaled forward recursion, all sequences of a batch at once."""
    out, by_class = np.zeros(len(n)), np.ascontiguousarray(emit.T)
    for rows, running, at, _ in _batches(seq, n):
        cls, first = _by_time(seq, running, at)
        total = np.zeros(len(rows))
        for t, m in enumerate(running.tolist()):
            e = by_class[cls[first[t] : first[t] + m]]
            a = (start if t == 0 else a[:m] @ move) * e
            c = a.sum(axis=1)
            a /= c[:, None]
            total[:m] += np.log10(c)
        out[rows] = total
    return out


def expected_counts(seq: np.ndarray, n: np.ndarray, start, move, emit):
    """(starts, moves, emissions, log likelihood): the counts that Baum-Welch expects of the sequences."""
    by_class = np.ascontiguousarray(emit.T)
    k, classes = emit.shape
    starts, moves, emissions, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, classes)), 0.0
    for _rows, running, at, _ in _batches(seq, n):
        cls, first = _by_time(seq, running, at)
        e = by_class[cls]
        alpha, scale = np.empty_like(e), np.empty(len(e), e.dtype)
        steps = list(zip(first.tolist(), running.tolist()))
        for t, (f, m) in enumerate(steps):
            a = (start if t == 0 else alpha[g : g + m] @ move) * e[f : f + m]
            c = a.sum(axis=1)
            scale[f : f + m] = c
            np.divide(a, c[:, None], out=alpha[f : f + m])
            g = f
        e /= scale[:, None]  # from here on: emission over scale
        beta = np.ones((running[0], k), e.dtype)
        for t in range(len(steps) - 1, 0, -1):
            f, m = steps[t]
            g = steps[t - 1][0]
            w = e[f : f + m] * beta[:m]
            moves += alpha[g : g + m].T @ w
            beta[:m] = w @ move.T
            alpha[g : g + m] *= beta[:m]  # gamma of time t - 1; longer sequences are the first ones
        for j in range(k):
            emissions[j] += np.bincount(cls, alpha[:, j], minlength=classes)
        starts += alpha[: running[0]].sum(axis=0)
        total += float(np.log10(scale).sum())
    return starts, moves * move, emissions, total


def maximize(starts, moves, emissions):
    """The parameters that the expected counts give, smoothed so that nothing is impossible."""
    start = (starts + SMOOTH) / (starts + SMOOTH).sum()
    move = (moves + SMOOTH) / (moves + SMOOTH).sum(axis=1, keepdims=True)
    prior = emissions.sum(axis=0)
    prior = (prior + COLD_SMOOTH) / (prior + COLD_SMOOTH).sum()
    own = emissions + 10.0 * prior
    return start, move, own / own.sum(axis=1, keepdims=True)


def first_values(mass: np.ndarray, states: int):
    rng = np.random.default_rng(7)
    share = (mass + COLD_SMOOTH) / (mass + COLD_SMOOTH).sum()
    emit = share * rng.uniform(0.5, 1.5, (states, len(mass)))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return np.full(states, 1.0 / states), move, emit / emit.sum(axis=1, keepdims=True)


def _unpack(row: dict):
    import zstandard

    seq = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["classes"]), "<u2").astype(np.int64)
    return seq, np.array(row["lengths"], np.int64), np.array(row["held_out"], bool)


def _training(row: dict):
    seq, n, held = _unpack(row)
    return seq[np.repeat(~held, n)], n[~held]


def seed_values(labelled: DataFrame, mass: np.ndarray, states: int, passes: int):
    """First values: Baum-Welch over SEED_TOKENS tokens at most, from the begins of SEED_BLOCKS blocks of smallest hash, in one task."""
    start, move, emit = first_values(mass, states)
    some = labelled.select("block", "classes", "lengths", "held_out").orderBy(F.xxhash64("block"), "block").limit(SEED_BLOCKS)
    n_blocks = some.count()
    if not n_blocks:
        return start, move, emit
    quota = SEED_TOKENS // n_blocks

    def begins(it):
        for batch in it:
            for row in batch.to_pylist():
                seq, n = _training(row)
                upto = np.minimum(np.cumsum(n), quota)
                n = np.diff(upto, prepend=0)
                n = n[n > 0]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([seq[: n.sum()].tolist()], pa.list_(pa.int64()))], names=["block", "n", "seq"])

    def seed(it):
        parts = sorted(((row["block"], row["n"], row["seq"]) for batch in it for row in batch.to_pylist()), key=lambda x: x[0])
        n, seq = (np.array([x for part in parts for x in part[k]], np.int64) for k in (1, 2))
        p = start, move, emit
        for _ in range(passes if len(n) else 0):
            p = maximize(*expected_counts(seq, n, *p)[:3])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in p]).tobytes()], pa.binary())], names=["p"])

    taken = some.mapInArrow(begins, "block long, n array<long>, seq array<long>")
    flat = np.frombuffer(taken.repartition(1).mapInArrow(seed, "p binary").first()["p"])
    return flat[:states], flat[states : states * (states + 1)].reshape(states, states), flat[states * (states + 1) :].reshape(states, -1)


def baum_welch(labelled: DataFrame, p):
    """(parameters, log likelihood before) of one pass over all training documents: each task adds up its blocks' expected counts, Spark sums them by class."""
    states, classes = p[2].shape
    shared = labelled.sparkSession.sparkContext.broadcast(tuple(x.astype(np.float32) for x in p))

    def counts(it):
        total = None
        for batch in it:
            for row in batch.to_pylist():
                got = expected_counts(*_training(row), *shared.value)
                total = got if total is None else tuple(a + b for a, b in zip(total, got))
        if total is None:
            return
        table = np.concatenate((total[2].T, total[1], total[0][None], np.full((1, states), total[3] / states)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table)), pa.int32()), *[pa.array(x) for x in table.T]], names=["row", *[f"s{j}" for j in range(states)]])

    names = [f"s{j}" for j in range(states)]
    sums = labelled.select("classes", "lengths", "held_out").mapInArrow(counts, "row int, " + ", ".join(f"{x} double" for x in names))
    table = np.zeros((classes + states + 2, states))
    for r in sums.groupBy("row").agg(*[F.sum(x).alias(x) for x in names]).collect():
        table[r["row"]] = [r[x] for x in names]
    return maximize(table[-2], table[classes:-2], np.ascontiguousarray(table[:classes].T)), float(table[-1].sum())


# --- operator --------------------------------------------------------------------------------------------------


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int = PASSES, gain: float = GAIN, own_share: int = OWN_SHARE, endings: int = ENDINGS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens: words after lower-casing A-Z, then one end. Training documents are those whose crc32(id as text) mod
    10 is not 0. score is log10 of the model's probability of the token sequence: hidden states emit frequent
    tokens themselves and all others by the class of their ending, within which a token has its smoothed share
    of the training tokens. base_score is the smoothed unigram score.

    Text is read once, into blocks of bounded size that hold each different token once; token counts of all
    blocks meet in one shuffle by token and go back to the blocks, never to the driver. What the driver holds is
    bounded: parameters of states x (own_share + endings + 1) classes. Each Baum-Welch pass covers all training
    documents; passes end when one gains less than `gain` of the log likelihood, or after `passes`. Tables are
    written in the shared folder between the steps.

    Null text: only the end. Null ids count as empty text: held out. Repeated rows count each. A document without
    words has one token. Equal texts have equal scores (sums in another order aside). Empty table: no rows. Other
    columns are not read.
    """
    blocks = tokenize(docs, id_col, text_col, block_bytes)
    trained = lambda x: F.aggregate(F.zip_with("held_out", "lengths", lambda h, n: F.when(h, F.lit(0).cast("long")).otherwise(x(n))), F.lit(0).cast("long"), lambda a, b: a + b)
    s = blocks.agg(F.sum(trained(lambda n: n)).alias("n"), F.sum(trained(lambda n: F.lit(1).cast("long"))).alias("ends")).first()
    n, ends = s["n"] or 0, s["ends"] or 0
    rows, mass, size, kinds, distinct = classify_tokens(blocks, n, ends, own_share, endings)
    labelled = label(blocks, rows, len(mass), size, kinds, ends)
    p = seed_values(labelled, mass, states, SEED_PASSES)
    before = None
    for _ in range(passes):
        p, likelihood = baum_welch(labelled, p)
        if before is not None and likelihood - before < gain * abs(before):
            break
        before = likelihood
    shared = docs.sparkSession.sparkContext.broadcast(p)
    base = float(np.log10(n + 0.1 * (distinct + 1)))
    field = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def scores(it):
        for batch in it:
            at = {name: batch.column(name) for name in batch.schema.names}
            for k in range(batch.num_rows):
                row = {name: at[name][k].as_py() for name in ("classes", "lengths", "held_out")}
                seq, size, held = _unpack(row)
                ids = at["doc_ids"][k].values
                got = log_likelihood(seq, size, *shared.value) + np.asarray(at["inside"][k].values)
                floor = np.asarray(at["base"][k].values) - size * base
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(held), pa.array(size), at["known"][k].values, pa.array(np.full(len(size), n)), pa.array(floor), pa.array(got)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return labelled.drop("block").mapInArrow(scores, f"doc_id {field}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_hmm_scores(spark, sf_dir):
    return score(read_documents(spark, sf_dir))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
