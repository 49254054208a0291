"""Exact top-k by inner product with no-random-access aggregation.

Each task has one block of candidates and one block of queries. For every
dimension the block's values form a sorted list, read from its upper end by
queries with a positive weight there and from its lower end by the others, in growing
stretches (``DEPTHS``). After each stretch of all lists each (query, candidate) pair has a lower bound
(what was seen, plus the worst value of each list not yet seen) and an upper bound
(what was seen, plus each list's frontier). Candidates whose upper bound is under
the query's bar, the k-th best lower bound, cannot qualify; once few others are left their scores
are resolved, and a query stops there. Of a query that does not stop the lists are read to their end, where both
bounds are the score, so results are exact for any data.

One block is read first. The k-th best scores that it gives are bars for all other blocks, where
a query stops much sooner than by its own block's bounds. Blocks bound the memory of a task; block
results are at most k rows a query and meet in a window. ``read_shares`` tells how far lists were read.

Cases: vectors that are null or hold null, NaN or infinite components take no part,
neither as query nor as candidate; shorter vectors count as filled with zeros;
ties go to the smaller id; a candidate with the query's own id is never returned;
each repeated query row gets its own results and repeated candidates are all
ranked; with fewer candidates than k all are returned; components saturate at
+-2**31 (scores would not fit 64 bits beyond); an empty table gives no rows;
extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Parts of the lists read at each test of the bounds.
DEPTHS = (0.5, 0.625, 0.75, 0.875)
#: Queries whose bounds a task holds at once.
TOGETHER = 512
#: A query's scores are resolved once at most this part of the block is left.
FEW = 0.125
#: Sums of absolute products below this are exact in float64.
EXACT = 2.0**52


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, as array<bigint>."""
    limit = float(2**31)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * F.lit(scale), F.lit(limit)), F.lit(-limit))))


def usable(vector: Column) -> Column:
    """Not null and all components finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def nra(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int, bars: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """For each query row: its number, ids and scores of the block's best k (those that can reach its bar), and the share of the lists read."""
    n, dims = x.shape
    # sums that float64 cannot hold exactly are taken in whole numbers of any size
    kind = object if dims and float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dims >= EXACT else np.float64
    xf = x.astype(kind)
    lists = np.sort(xf, axis=0)
    rank = np.empty(x.shape, dtype=np.int32)
    np.put_along_axis(rank, np.argsort(xf, axis=0, kind="stable"), np.arange(n, dtype=np.int32)[:, None], axis=0)
    for start in range(0, len(q), TOGETHER):
        part = np.arange(start, min(start + TOGETHER, len(q)))
        qf = q[part].astype(kind)
        qp, qn = np.maximum(qf, 0), np.minimum(qf, 0)
        least = np.full(len(part), -np.inf) if bars is None else bars[part]
        own = q_ids[part][:, None] == ids[None, :]
        waiting = np.arange(len(part))
        for depth in DEPTHS if n > k and dims else ():
            if not len(waiting):
                break
            d = max(1, int(n * depth))
            up, down = rank >= n - d, rank < d
            low = qp[waiting] @ np.where(up, xf, lists[0]).T + qn[waiting] @ np.where(down, xf, lists[-1]).T
            high = qp[waiting] @ np.where(up, xf, lists[n - d]).T + qn[waiting] @ np.where(down, xf, lists[d - 1]).T
            low[own[waiting]] = -np.inf
            bar = np.maximum(np.partition(low, n - k, axis=1)[:, n - k], least[waiting])
            alive = (high >= bar[:, None]) & ~own[waiting]
            done = alive.sum(1) <= max(k, FEW * n)
            for row, mask in zip(waiting[done], alive[done]):
                yield part[row], *best(ids[mask], xf[mask] @ qf[row], k), depth
            waiting = waiting[~done]
        if len(waiting):  # at the lists' end both bounds are the score
            for row, s in zip(waiting, qf[waiting] @ xf.T):
                yield part[row], *best(ids[~own[row]], s[~own[row]], k), 1.0


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id; scores beyond a long are given as its end, after they are ordered."""
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        return ids[order], np.array([min(max(int(scores[i]), -(1 << 63)), (1 << 63) - 1) for i in order], dtype=np.int64)
    scores = scores.astype(np.int64)
    if len(ids) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def padded(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), dtype=np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def searched(vectors: DataFrame, is_query: Column, k: int, id_col: str, vec_col: str, block_rows: int, query_rows: int) -> DataFrame:
    """query_id, uid, vec_id and score of each block's best, and a row without vec_id for each query and block with the share of the lists read."""
    own = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    rows = saved(own.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("uid")))
    n, n_q = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-n_q // query_rows))

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int")

    def every(first: int, count: int) -> Column:
        return F.explode(F.sequence(F.lit(first), F.lit(count - 1)))

    def search(cand: pa.Table, ask: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "uid": [], "vec_id": [], "score": [], "share": []}
        if len(cand) and len(ask):
            dims = max(max(map(len, t["v"].to_pylist())) for t in (cand, ask))
            ids, q_ids, uids = cand["id"].to_numpy(), ask["id"].to_numpy(), ask["uid"].to_numpy()
            bars = ask["bar"].cast(pa.float64()).fill_null(-np.inf).to_numpy()
            for row, found, scores, share in nra(ids, padded(cand["v"], dims), q_ids, padded(ask["v"], dims), k, bars):
                out["query_id"] += [int(q_ids[row])] * (len(found) + 1)
                out["uid"] += [int(uids[row])] * (len(found) + 1)
                out["vec_id"] += [*found.tolist(), None]
                out["score"] += [*scores.tolist(), None]
                out["share"] += [*[None] * len(found), share]
        return pa.table({name: pa.array(v, pa.float64() if name == "share" else pa.int64()) for name, v in out.items()})

    def met(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        left = candidates.select(dealt(blocks).alias("b"), every(0, groups).alias("g"), F.col("id").alias("id"), F.col("v").alias("v"))
        return left.groupBy("b", "g").cogroup(queries.groupBy("b", "g")).applyInArrow(search, "query_id long, uid long, vec_id long, score long, share double")

    queries = rows.where("q").select(dealt(groups).alias("g"), "id", "v", "uid")
    found = met(rows.where(dealt(blocks) == 0), queries.select(F.lit(0).alias("b"), "g", "id", "v", "uid", F.lit(None).cast("long").alias("bar")))
    if blocks > 1:
        found = saved(found)
        # the k-th best of the first block; a query with fewer has no bar
        bars = found.where("vec_id is not null").groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).where(F.col("n") >= k).select("uid", "bar")
        rest = queries.join(bars, "uid", "left").select(every(1, blocks).alias("b"), "g", "id", "v", "uid", "bar")
        found = found.union(met(rows.where(dealt(blocks) > 0), rest))
    return found


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096, query_rows: int = 8192) -> DataFrame:
    """The ``k`` best other rows for each row of ``vectors`` that ``is_query`` marks.

    Returns query_id, rank (from 1), vec_id, score. ``block_rows`` and ``query_rows``
    bound what a task holds, not what is compared: all blocks meet.
    """
    found = searched(vectors, is_query, k, id_col, vec_col, block_rows, query_rows).where("vec_id is not null")
    by = Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def read_shares(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096, query_rows: int = 8192) -> DataFrame:
    """share and n: in how many (query, block) pairs which share of the lists was read."""
    return searched(vectors, is_query, k, id_col, vec_col, block_rows, query_rows).where("share is not null").groupBy("share").agg(F.count(F.lit(1)).alias("n"))
