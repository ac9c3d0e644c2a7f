"""Late interaction (sum over a query's tokens of the best product with a document's tokens) by centroids, with bounds that keep it exact."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import written
from .ranking import with_rank
from .search import in_blocks

#: Centroids are fitted on so many token vectors at most, taken by a hash.
SAMPLE = 20_000
CENTROIDS, PASSES = 64, 8
#: Centroids nearest to a query's token whose documents are scored first.
PROBES = 4
#: Queries that go to every task together.
BLOCK_QUERIES = 500


def centroids(docs: DataFrame, k: int = CENTROIDS, sample: int = SAMPLE, passes: int = PASSES) -> np.ndarray:
    """k centroids (or fewer, of fewer different vectors) of token vectors docs(doc, v), by Lloyd's passes over a bounded sample: at most `sample` vectors, those of smallest hash."""
    rows = docs.filter("v is not null").select("v").orderBy(F.xxhash64("v")).limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.unique(np.array([r["v"] for r in rows], float), axis=0)
    at = x[np.random.default_rng(4).permutation(len(x))[:k]]
    for _ in range(passes):
        own = np.argmin((at**2).sum(axis=1) - 2 * x @ at.T, axis=1)
        size = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        at = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], at)
    return at


def index(docs: DataFrame, at: np.ndarray) -> DataFrame:
    """The written table of doc, v (its token vectors, flat), cells (its different centroids), far (its farthest token from each), of docs(doc, v): a document is a row."""
    shared = docs.sparkSession.sparkContext.broadcast(at)
    kind = docs.schema["doc"].dataType.simpleString()

    def cells(it):
        at = shared.value
        for batch in it:
            flat, all_cells, far = [], [], []
            for tokens in batch.column(1).to_pylist():
                x = np.array(tokens, float)
                d = np.sqrt(np.maximum(0.0, (x**2).sum(axis=1)[:, None] + (at**2).sum(axis=1) - 2 * x @ at.T))
                own = d.argmin(axis=1)
                found = np.unique(own)
                flat.append(x.ravel())
                all_cells.append(found.astype(np.int32))
                far.append(np.array([np.linalg.norm(x[own == c] - at[c], axis=1).max() for c in found]))
            lists = lambda v, t: pa.array(v, pa.list_(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(flat, pa.float64()), lists(all_cells, pa.int32()), lists(far, pa.float64())], names=["doc", "v", "cells", "far"])

    grouped = docs.filter("v is not null").groupBy("doc").agg(F.collect_list(F.col("v").cast("array<double>")).alias("v"))
    return written(grouped.mapInArrow(cells, f"doc {kind}, v array<double>, cells array<int>, far array<double>"), "late-interaction-index")


def search(indexed: DataFrame, at: np.ndarray, queries: DataFrame, top: int, probes: int = PROBES, exact: bool = True) -> DataFrame:
    """query_id, doc, score, rank: the best documents for stated queries (query_id, token, q).

    Documents that have a token in one of the `probes` centroids nearest to a query's tokens are scored first. With exact,
    the others follow whose bound reaches the `top`-th score found: a token scores at most its centroid's product plus the
    query token's length times the distance of the document's farthest token of that centroid. Without exact these are
    left out. A task reads a document's tokens once and scores it for all queries that ask for it, so no pair of tokens
    becomes a row. Queries go to the tasks in blocks of BLOCK_QUERIES. Null tokens score nothing.
    """
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc {indexed.schema['doc'].dataType.simpleString()}, score double"

    def block(some):
        rows = some.filter("q is not null").select("query_id", "token", F.col("q").cast("array<double>").alias("q")).distinct().orderBy("query_id", "token").collect()
        names = list(dict.fromkeys(r["query_id"] for r in rows))
        q = np.array([r["q"] for r in rows], float).reshape(len(rows), -1) if rows else np.zeros((0, 0))
        owner = np.array([names.index(r["query_id"]) for r in rows], np.int64)
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
        near = q @ at.T if len(q) and len(at) else np.zeros((len(q), 0))
        nearest = np.argsort(-near, axis=1)[:, :probes] if near.size else np.zeros((len(q), 0), int)
        probe = np.zeros((len(names), len(at)), bool)
        probe[np.repeat(owner, nearest.shape[1]), nearest.ravel()] = True
        length = np.linalg.norm(q, axis=1) if len(q) else np.zeros(0)

        def made(first: bool, least):
            shared = indexed.sparkSession.sparkContext.broadcast((q, begin, near, probe, length, least))

            def rows_of(it):
                q, begin, near, probe, length, least = shared.value
                for batch in it:
                    docs, who, scores = [], [], []
                    for doc, v, cells, far in zip(batch.column("doc"), batch.column("v"), batch.column("cells"), batch.column("far")):
                        cells = np.asarray(cells.values)
                        mine = probe[:, cells].any(axis=1)
                        if not first:
                            bound = np.add.reduceat((near[:, cells] + length[:, None] * np.asarray(far.values)).max(axis=1), begin)
                            mine = ~mine & (bound + 1e-9 * np.abs(bound) >= least)
                        asked = np.flatnonzero(mine)
                        if len(asked):
                            x = np.asarray(v.values).reshape(-1, q.shape[1])
                            best = np.add.reduceat((q @ x.T).max(axis=1), begin)
                            docs += [doc] * len(asked)
                            who += asked.tolist()
                            scores += best[asked].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in who], query_type), pa.array([d.as_py() for d in docs], batch.column("doc").type), pa.array(scores, pa.float64())], names=["query_id", "doc", "score"])

            return indexed.mapInArrow(rows_of, kind)

        from pyspark.sql.pandas.types import to_arrow_type

        query_type = to_arrow_type(queries.schema["query_id"].dataType)
        if not names:
            return with_rank(indexed.limit(0).select("doc").join(queries.limit(0).select("query_id"), F.lit(True)).select("query_id", "doc", F.lit(0.0).alias("score")), ["query_id"], "score", "doc")
        found = written(with_rank(made(True, None), ["query_id"], "score", "doc").filter(F.col("rank") <= top), "late-first")
        if not exact:
            return found
        cut = {r["query_id"]: r["score"] for r in found.filter(F.col("rank") == top).select("query_id", "score").collect()}
        least = np.array([cut.get(n, -np.inf) for n in names])
        return with_rank(found.drop("rank").union(made(False, least)), ["query_id"], "score", "doc").filter(F.col("rank") <= top)

    return in_blocks(queries, "query_id", block, BLOCK_QUERIES)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
