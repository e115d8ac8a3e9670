"""Exact top-k search by no-random-access aggregation of sorted lists (operator 4).

Queries and candidates are dealt into bounded blocks and every query block meets every candidate block (a stated query
set against all rows). In a block, each dimension is a list of the candidates sorted by value. The lists are read
sequentially, from the high end where the query's component is positive and from the low end where it is negative, to
the same, doubling depth. After each depth every candidate has a lower bound (what was read, plus the worst a list can
still give) and an upper bound (what was read, plus the value at the depth reached). Reading stops for a query when few
candidates' upper bounds reach the k-th best lower bound, at the latest when the lists are read out; the scores of those
left are then resolved exactly, in integers. All queries of a block are advanced together, as matrix products over the
read part of the lists. Each block returns at most k rows per query; a ranked window, pruned before the shuffle,
merges them.

Defined cases: vectors that are null or hold null or non-finite components take no part; only vectors of equal length
are compared; a query's own id never answers it; repeated candidate rows count as one; scores beyond 64 bits saturate;
empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralith.llm.store import stored


def scaled(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as long; null if the vector is null or has a null or non-finite component."""
    big = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == big))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    flat = table.column("v").combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return np.asarray(flat, np.int64).reshape(table.num_rows, dims)


def _exact(rows: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    if small:
        return rows @ query
    return np.clip(rows.astype(object) @ query.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def nra(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of each query's k best candidates of the block, ties to the smaller id."""
    n, dims = x.shape
    if not n or not len(queries):
        return []
    reach = float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, dims)
    small, slack = reach < 2.0 ** 52, 0.0 if reach < 2.0 ** 52 else reach * 2.0 ** -40
    ranks = np.empty((n, dims), np.int32)
    order = np.argsort(x, axis=0, kind="stable")
    np.put_along_axis(ranks, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    values, xf = np.take_along_axis(x, order, axis=0).astype(float), x.astype(float)
    up, down = np.maximum(queries, 0).T.astype(float), np.minimum(queries, 0).T.astype(float)  # dims x queries
    own = ids[:, None] == query_ids[None, :]
    live, depth, left = np.arange(len(queries)), max(k + 1, n // 16), {}
    while len(live):
        depth = min(depth, n)
        top, low = ranks >= n - depth, ranks < depth  # read from the high end, from the low end
        p, m = up[:, live], down[:, live]
        seen = (xf * top) @ p + (xf * low) @ m
        upper = seen + (~top) @ (p * values[n - depth][:, None]) + (~low) @ (m * values[depth - 1][:, None])
        lower = seen + (~top) @ (p * values[0][:, None]) + (~low) @ (m * values[n - 1][:, None])
        lower[own[:, live]] = -np.inf
        upper[own[:, live]] = -np.inf
        bar = np.partition(lower, max(0, n - k), axis=0)[max(0, n - k)] - slack
        possible = (upper + slack >= bar) & ~own[:, live]
        done = (possible.sum(axis=0) <= max(4 * k, n // 32)) | (depth == n)
        for at in np.flatnonzero(done):
            left[int(live[at])] = np.flatnonzero(possible[:, at])
        live, depth = live[~done], 2 * depth
    out = []
    for q, rows in left.items():
        score = _exact(x[rows], queries[q], small)
        best = np.lexsort((ids[rows], -score))[:k] if small else sorted(range(len(rows)), key=lambda i: (-int(score[i]), ids[rows[i]]))[:k]
        out += [(int(query_ids[q]), int(ids[rows[i]]), int(score[i])) for i in best]
    return out


def _block(k: int) -> Callable:
    def search(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        found = nra(_matrix(candidates, dims), np.asarray(candidates.column("id"), np.int64),
                    _matrix(queries, dims), np.asarray(queries.column("id"), np.int64), k) if queries.num_rows and candidates.num_rows else []
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return search


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block_rows: int = 4096, block_queries: int = 256) -> DataFrame:
    """``queries`` and ``candidates``: (id long, v array<long> or null). Returns (query_id, rank, vec_id, score)."""
    def sized(df: DataFrame, name: str, rows: int) -> tuple[DataFrame, int]:
        df = stored(df.filter("v is not null and id is not null").select("id", "v", F.size("v").alias("dims")).distinct(), name)
        return df, max(1, -(-df.count() // rows))

    asked, ask_blocks = sized(queries, "queries", block_queries)
    given, give_blocks = sized(candidates, "candidates", block_rows)

    def block(blocks: int) -> Column:
        return F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = asked.withColumns({"qb": block(ask_blocks), "cb": every(give_blocks)})
    right = given.withColumns({"cb": block(give_blocks), "qb": every(ask_blocks)})
    keys = ["dims", "qb", "cb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
