"""Connected components of an edge table by alternating star contraction.

Each round replaces a node's edges by edges to its smallest neighbour (first for the
larger neighbours, then for the smaller ones); components become stars after a number
of rounds that grows with the logarithm of their size. Rounds are joins and
aggregates of the edge table, written to two folders in turn; only two sums reach the driver.

Cases: loops and rows with a null end are left out, repeated edges count once; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, shared_dir


def star(edges: DataFrame, larger: bool) -> DataFrame:
    """One half-round on edges (u, v) with u > v."""
    both = edges.select(F.col("u"), F.col("v"))
    if larger:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    moved = both.join(least, "u")
    if larger:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node."""
    folders = shared_dir(edges.sparkSession), shared_dir(edges.sparkSession)
    now = saved(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folders[0])
    mark, turn = None, 0
    while True:
        n, h = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if n == 0 or (n, h) == mark:
            break
        mark, turn = (n, h), 1 - turn
        now = saved(star(star(now, True), False), folders[turn])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
