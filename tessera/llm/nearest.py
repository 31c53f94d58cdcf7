"""Exact nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; a cell of the grid holds one block of each.  In
a cell, int8 product tiles give every inner product with a bound on its quantisation error.
Pairs whose upper bound reaches the k-th best lower bound survive and are recomputed in double
precision; heaps merge the tiles of a cell, and a keyed top-k merges the cells.  Nothing is
lost: the bounds are proven, so recall is 1.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pinned

#: Rows of a block at most, least rows that are worth a block of their own, rows of a tile.
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCK, TILE = 2048, 8192, 256, 2048


def usable(vector: Column) -> Column:
    """True for vectors that take part: not null, finite in every component and not zero."""
    inf = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the dequantised rows, norms of the residuals."""
    scale = np.abs(m).max(axis=1) / 127
    q = np.rint(m / scale[:, None]).astype(np.int8)
    approx = q * scale[:, None]
    return q, scale, np.linalg.norm(approx, axis=1), np.linalg.norm(m - approx, axis=1)


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 rows, exact: sums stay below 2**24 in slices of 1024 components."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at:at + 1024].astype(np.float32) @ b[:, at:at + 1024].astype(np.float32).T
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added in component order: equal vectors, equal scores."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _runs(*sorted_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    n = len(sorted_by[0])
    new = np.ones(n, dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in sorted_by], axis=0)
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple]]:
    """Best k (score, -id) per query among the candidates of this cell; all rows of the query's
    own id are left out before any bound is taken."""
    # equal candidate vectors are scored once; k rows of an id and 2 k rows in all are enough of
    # each: at most k of them are the query's own
    c = np.ascontiguousarray(c + 0.0)
    rows, inverse = np.unique(c.view([("", c.dtype)] * c.shape[1]).ravel(), return_inverse=True)
    vectors = rows.view(c.dtype).reshape(len(rows), -1)
    order = np.lexsort((c_ids, inverse))
    owner, sorted_ids = inverse[order], c_ids[order]
    first, last = _runs(owner)
    sole = sorted_ids[first] == sorted_ids[last - 1]  # vectors that one id alone holds
    holder = sorted_ids[first]
    repeat_from, repeat_to = _runs(owner, sorted_ids)
    few = np.arange(len(order)) - np.repeat(repeat_from, repeat_to - repeat_from) < k
    owner, sorted_ids = owner[few], sorted_ids[few]
    first, last = _runs(owner)
    ids = [sorted_ids[a:min(b, a + 2 * k)] for a, b in zip(first.tolist(), last.tolist())]
    heaps: list[list[tuple]] = [[] for _ in q_ids]
    qq, qs, qn, qe = quantised(q)
    floor = np.full(len(q_ids), -np.inf)
    for at in range(0, len(rows), TILE):
        v = vectors[at:at + TILE]
        vq, vs, vn, ve = quantised(v)
        near = int8_product(qq, vq) * qs[:, None] * vs[None, :]
        slack = (qn[:, None] * ve[None, :] + qe[:, None] * (vn + ve)[None, :])
        slack += 1e-9 * (qn + qe)[:, None] * (vn + ve)[None, :]
        own_only = sole[at:at + TILE] & (holder[at:at + TILE] == q_ids[:, None])
        if near.shape[1] >= k:  # k vectors that others hold too bound the k-th neighbour
            low = np.where(own_only, -np.inf, near - slack)
            floor = np.maximum(floor, np.partition(low, near.shape[1] - k, axis=1)[:, -k])
        qi, vi = np.nonzero((near + slack >= floor[:, None]) & ~own_only)
        score = exact_products(q[qi], v[vi]) if len(qi) else np.zeros(0)
        for a, u, s in zip(qi.tolist(), vi.tolist(), score.tolist()):
            heap, own = heaps[a], q_ids[a]
            for i in ids[at + u].tolist():
                if i == own:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
                else:
                    break
        for a, heap in enumerate(heaps):
            if len(heap) == k:
                floor[a] = max(floor[a], heap[0][0])
    return heaps


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` candidates of the largest inner
    product, ties to the smaller id; all candidates of the query's own id are left out.

    Null ids and unusable vectors take no part; only vectors of equal length are compared;
    repeated rows are candidates each, and a query id held by several rows has the best pairs of
    them all.  Rows are dealt by id and row number, so one id fills no block.  A query without candidates, or an empty table, gives
    no rows.  Other columns are ignored."""
    def slim(df):
        return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
                .filter(F.col("id").isNotNull() & usable(F.col("v")))
                .withColumn("row", F.monotonically_increasing_id()))

    q, c = pinned(slim(queries)), pinned(slim(candidates))
    n_q, n_c = q.count(), c.count()
    rows = max(1, -(-n_q // QUERY_BLOCK))
    cols = max(1, -(-n_c // CANDIDATE_BLOCK), min(16, n_c // LEAST_BLOCK))

    def block(n, seed):
        return F.pmod(F.xxhash64("id", "row", F.lit(seed)), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    cells = (q.select("id", "v", F.lit(True).alias("is_query"), block(rows, 1).alias("r"), every(cols).alias("c"))
             .unionByName(c.select("id", "v", F.lit(False).alias("is_query"), every(rows).alias("r"),
                                   block(cols, 2).alias("c")))
             .withColumn("dim", F.size("v")))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
        out = []
        if len(a) and len(b):
            q_ids, c_ids = a["id"].to_numpy(), b["id"].to_numpy()
            heaps = search_block(q_ids, np.stack(a["v"]).astype(np.float64), c_ids,
                                 np.stack(b["v"]).astype(np.float64), k)
            out = [(i, -j, s) for i, heap in zip(q_ids.tolist(), heaps) for s, j in heap]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = cells.groupBy("dim", "r", "c").applyInPandas(cell, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
