"""Exact k-means on whole-number vectors with Drake's adaptive bounds.

Each vector keeps an upper bound on the distance to its centroid, lower bounds on the distances to
its several next nearest centroids, and one lower bound for all the rest. After the centroids have moved,
bounds give way by the lengths of the moves. If the upper bound lies under every lower bound the
vector stays without a distance computed; if it lies under those from some place on, only the centroids before that
place are compared; if under none, all are (the ordering cannot be certified). Comparisons are of whole numbers, so
results are those of plain k-means, ties included; bounds only save work, with a margin for rounding. The number of bounds falls
to what a round has used.

A round is one pass over a written table (no shuffle of vectors): bounds, assignment, and a new table. A second pass
reads the vectors that changed sides, sums them in the tasks, and moves the sums of the
centroids: k x dims numbers, the only thing that reaches the driver. Lost executors repeat their part of one round.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part; repeated rows take part each; null ids
take part but start no centroid before others do; components beyond 2 ** 27 after scaling count as 2 ** 27 (a squared distance must fit a
long); fewer vectors than k give as many centroids; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_rows, saved, shared_dir, tidy

MOST = 1 << 27
#: Bounds must differ by more than this share and distance before they certify an order.
SHARE, APART = 1e-9, 1e-6


def usable(vector: Column, dims: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & ~bad


def whole(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, within the stated range."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(scale)), F.lit(-MOST)), F.lit(MOST)).cast("int"))


def as_matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def ranked(x: np.ndarray, centroids: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest ``places`` centroids of each row in order (ties: smaller number) and their squared distances."""
    far = np.stack([squared(x, c) for c in centroids], axis=1)
    order = np.argsort(far, axis=1, kind="stable")[:, :places]
    return order, np.take_along_axis(far, order, axis=1)


class Assigned:
    """Clusters and bounds of some vectors."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray) -> None:
        self.cluster, self.upper, self.near, self.lower, self.rest = cluster, upper, near, lower, rest
        self.place = np.zeros(len(cluster), dtype=np.int32)

    @classmethod
    def fresh(cls, x: np.ndarray, centroids: np.ndarray, bounds: int) -> Assigned:
        order, far = ranked(x, centroids, bounds + 2)
        far = np.sqrt(far.astype(np.float64))
        if order.shape[1] == bounds + 2:
            rest, order, far = far[:, -1], order[:, :-1], far[:, :-1]
        else:
            rest = np.full(len(x), np.inf)
        return cls(order[:, 0], far[:, 0], order[:, 1:], far[:, 1:], rest)

    def kept(self, bounds: int) -> None:
        """Drops the last bounds into the one of the rest."""
        if self.near.shape[1] > bounds:
            self.rest = np.minimum(self.rest, self.lower[:, bounds:].min(axis=1))
            self.near, self.lower = self.near[:, :bounds], self.lower[:, :bounds]

    def moved(self, x: np.ndarray, centroids: np.ndarray, moves: np.ndarray) -> None:
        """Clusters and bounds after the centroids have moved by ``moves``."""
        b = self.near.shape[1]
        self.upper = self.upper + moves[self.cluster]
        self.lower = np.maximum(self.lower - moves[self.near], 0.0)
        self.rest = np.maximum(self.rest - moves.max(), 0.0)
        # the least of all lower bounds from each place on; place b is the rest's alone
        least = np.minimum.accumulate(np.concatenate([self.lower, self.rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        open_ = np.flatnonzero(self.upper * (1 + SHARE) + APART >= least[:, 0])
        own = squared(x[open_], centroids[self.cluster[open_]])
        self.upper[open_] = np.sqrt(own.astype(np.float64))
        sure = self.upper[open_, None] * (1 + SHARE) + APART < least[open_]
        place = np.where(sure.any(axis=1), sure.argmax(axis=1), b + 1)
        self.place[open_] = place
        for z in range(1, b + 1):
            rows = open_[place == z]
            if len(rows):
                among = np.concatenate([self.cluster[rows, None], self.near[rows, :z]], axis=1)
                far = np.stack([squared(x[rows], centroids[among[:, j]]) for j in range(z + 1)], axis=1)
                order = np.lexsort((among, far), axis=1)
                among, far = np.take_along_axis(among, order, axis=1), np.sqrt(np.take_along_axis(far, order, axis=1).astype(np.float64))
                self.cluster[rows], self.upper[rows] = among[:, 0], far[:, 0]
                self.near[rows, :z], self.lower[rows, :z] = among[:, 1:], far[:, 1:]
        rows = open_[place == b + 1]
        if len(rows):
            new = Assigned.fresh(x[rows], centroids, b)
            self.cluster[rows], self.upper[rows], self.near[rows], self.lower[rows], self.rest[rows] = new.cluster, new.upper, new.near, new.lower, new.rest


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width or 1, dtype=np.int32) if width else np.zeros(n + 1, dtype=np.int32), pa.array(values.ravel(), kind))


STATE = "cluster int, was int, place int, upper double, near array<int>, lower array<double>, rest double"


def round_of(rows: DataFrame, centroids: np.ndarray, moves: np.ndarray | None, bounds: int) -> DataFrame:
    """(id, v) with a round's state; from the state before, or from nothing if ``moves`` is null."""
    dims, id_kind = centroids.shape[1], rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = as_matrix(batch["v"], dims)
            if moves is None:
                state, was = Assigned.fresh(x, centroids, bounds), np.full(len(x), -1, dtype=np.int32)
                state.place[:] = bounds
            else:
                width = batch["near"].flatten()
                b = len(width) // max(len(x), 1)
                was = batch["cluster"].to_numpy()
                state = Assigned(was.copy(), batch["upper"].to_numpy().copy(), width.to_numpy().reshape(len(x), b).copy(), batch["lower"].flatten().to_numpy().reshape(len(x), b).copy(), batch["rest"].to_numpy().copy())
                state.kept(bounds)
                state.moved(x, centroids, moves)
            arrays = [batch["id"], batch["v"], pa.array(state.cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(state.place), pa.array(state.upper)]
            yield pa.RecordBatch.from_arrays([*arrays, lists(state.near.astype(np.int32), pa.int32()), lists(state.lower, pa.float64()), pa.array(state.rest)], ["id", "v", "cluster", "was", "place", "upper", "near", "lower", "rest"])

    return rows.mapInArrow(tidy(run), f"id {id_kind}, v array<int>, {STATE}")


def changes(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """How the centroids' sums and counts change: vectors gained less vectors lost, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=np.int64)
        for batch in batches:
            x = np.concatenate([as_matrix(batch["v"], dims), np.ones((batch.num_rows, 1), dtype=np.int64)], axis=1)
            now, was = batch["cluster"].to_numpy(), batch["was"].to_numpy()
            for c in range(k):
                total[c] += x[now == c].sum(axis=0) - x[was == c].sum(axis=0)
        c, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(total[c, p])], ["c", "p", "d"])

    out = np.zeros((k, dims + 1), dtype=object)
    parts = state.where("cluster != was").select("v", "cluster", "was").mapInArrow(run, "c int, p int, d long")
    for c, p, d in parts.groupBy("c", "p").agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d")).collect():  # k x dims rows at most
        out[c, p] = int(d)
    return out[:, :dims], out[:, dims]


def lengths(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far each centroid has moved, rounded up."""
    return np.sqrt(squared(before, after).astype(np.float64)) * (1 + SHARE)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The vectors whose ids have the smallest digests."""
    named = rows.select("v", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"))
    found = named.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in found], dtype=np.int64)


def clustered(vectors: DataFrame, k: int, *, dims: int, scale: float = 1024.0, rounds: int = 10, bounds: int = 3, salt: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, place) of every usable vector after ``rounds`` rounds and a last assignment, and the centroids. ``place``: how far the last bounds had to be searched."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vec_col), dims)).select(F.col(id_col).alias("id"), whole(F.col(vec_col), scale).alias("v"))
    centroids = first_centroids(rows, k, salt)
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("place")), centroids
    k, least = len(centroids), max(1, k // 8)
    bounds, folders = min(bounds, k - 1), (shared_dir(spark), shared_dir(spark))
    sums, counts = np.zeros((k, dims), dtype=object), np.zeros(k, dtype=object)
    state, moves = rows, None
    for turn in range(rounds):
        state = saved(round_of(state, centroids, moves, bounds), folders[turn % 2])
        gained, more = changes(state, k, dims)
        sums, counts = sums + gained, counts + more
        before = centroids
        centroids = np.array([[s // n for s in sums[c]] if (n := counts[c]) else before[c] for c in range(k)], dtype=np.int64)
        moves = lengths(before, centroids)
        used = state.agg(F.max("place")).first()[0] if turn else bounds
        bounds = max(min(bounds, used), min(least, k - 1))
    last = round_of(state, centroids, moves, bounds)
    centre = F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in c]) for c in centroids])
    apart = F.aggregate(F.zip_with("v", F.get(centre, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)
    return saved(last.select(F.col("id").alias(id_col), "cluster", apart.alias("distance"), "place")), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with its clusters' and the whole's sums of distances, and the centroids' digests. One row a cluster is joined."""
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    names = literal_rows(found.sparkSession, [(c, digest(x)) for c, x in enumerate(centroids)] or [(0, "")], ["cluster", "centroid_sha256"])
    return found.join(F.broadcast(sums.join(F.broadcast(names), "cluster")), "cluster")
