"""A Merkle manifest of a table: a tree of digests for each group of rows, and one tree over the groups' roots.

A node is the lowercase hex SHA-256 of its run's digests (``fanout`` consecutive ones, in hex, concatenated); a lone node is its
tree's root. Trees shrink by superblocks: places are bucketed by fanout ** levels, a task collapses
``levels`` levels of a bucket at once, and the buckets' roots go through the same step until each
tree has one node. The way back down gives proofs: a bucket's own siblings (lower part) are put before the
proof of its root (upper part), found by the bucket's number. A bucket has a bounded number of rows, so a hot group is just many
buckets; places are numbered by a range sort and offsets of its partitions, never by one task for a group.
Every level is a written table, so lost executors recompute one level only.

Cases: a null field counts as ``-``, a null group or id sorts first, rows of one id go by their digest (repeated rows are leaves of
their own); texts of any length are hashed in the JVM; an empty table gives no rows; columns
named like the result's go unless they are fields, all others only pass through ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Tables of up to so many rows of offsets are broadcast.
MOST_BROADCAST = 200_000
PROOF = "array<struct<place: int, siblings: binary>>"


def field(value: Column) -> Column:
    """A value as the digest takes it: ``-`` for null, else its UTF-8 byte count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that ``digest`` (hex) gives with a proof's siblings."""

    def step(node: Column, level: Column) -> Column:
        others = F.lower(F.hex(level["siblings"]))
        left = level["place"] * 64
        return F.sha2(F.concat(F.substr(others, F.lit(1), left), node, F.substr(others, left + 1)), 256)

    return F.aggregate(proof, digest, step)


def siblings_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf's level up."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda level: F.lower(F.hex(level["siblings"])))), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, digest, ...) with ``idx``, the place within its tree by ``order``, and ``n``, the tree's size."""
    keys = [F.col("tree").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the upper bits of these numbers are the partition, the lower ones the place in it
    done = saved(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    counts = done.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")  # one row for each partition at most
    starts = saved(counts.select(F.col("tree").alias("_of"), F.col("part").alias("_in"), "first", (F.sum("c").over(tree.orderBy("part")) - F.col("c")).alias("start"), F.sum("c").over(tree).alias("n")))
    starts = F.broadcast(starts) if starts.count() <= MOST_BROADCAST else starts
    met = done.join(starts, F.col("tree").eqNullSafe(F.col("_of")) & (F.col("part") == F.col("_in")))
    return met.withColumn("idx", F.col("start") + F.col("at") - F.col("first")).drop("_of", "_in", "start", "first", "at", "part")


def hashed(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests).hex().encode()).digest()


def depth(n: int, fanout: int, most: int) -> int:
    """Levels until one of ``n`` nodes is left, up to ``most``."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // fanout), levels + 1
    return levels


def shrunk(digests: list[bytes], fanout: int, levels: int) -> list[list[bytes]]:
    """The nodes of a bucket level by level, from its leaves to its root."""
    out = [digests]
    for _ in range(levels):
        now = out[-1]
        out.append([hashed(now[i : i + fanout]) for i in range(0, len(now), fanout)])
    return out


def bucketed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    return nodes.withColumn("bucket", F.floor(F.col("idx") / F.lit(fanout**levels)).cast("long"))


def in_order(t: pa.Table) -> tuple[pa.Table, list[bytes]]:
    t = t.sort_by("idx")
    return t, t["digest"].to_pylist()


def raised(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The buckets' roots of (tree, idx, n, digest) as nodes of the next stage."""
    kind = nodes.schema["tree"].dataType.simpleString()

    def collapse(t: pa.Table) -> pa.Table:
        t, digests = in_order(t)
        n = t["n"][0].as_py()
        deep = depth(n, fanout, levels)
        root = shrunk(digests, fanout, deep)[-1][0]
        return pa.table({"tree": t["tree"].slice(0, 1), "idx": t["bucket"].slice(0, 1), "n": pa.array([-(-n // fanout**deep)], pa.int64()), "digest": pa.array([root], pa.binary())})

    return bucketed(nodes.select("tree", "idx", "n", "digest"), fanout, levels).groupBy("tree", "bucket").applyInArrow(collapse, f"tree {kind}, idx long, n long, digest binary")


def lowered(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with the columns that their buckets' roots have in ``above`` (tree, idx, proof, ...), a node's own siblings before the root's proof."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    passed = [c for c in above.columns if c not in ("tree", "idx", "proof", "n", "digest")]
    kinds |= {c: above.schema[c].dataType.simpleString() for c in passed} | {"proof": PROOF}
    proof_type = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.binary())]))

    def expand(t: pa.Table, u: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t.drop_columns(["bucket"])
        t, digests = in_order(t)
        n = t["n"][0].as_py()
        tiers = shrunk(digests, fanout, depth(n, fanout, levels))
        upper = u["proof"][0].as_py()
        proofs = []
        for i in range(len(digests)):
            own = []
            for tier in tiers[:-1]:
                run, place = tier[i - i % fanout : i - i % fanout + fanout], i % fanout
                own.append({"place": place, "siblings": b"".join(run[:place] + run[place + 1 :])})
                i //= fanout
            proofs.append(own + upper)
        out = t.drop_columns(["bucket"])
        for c in passed:
            out = out.append_column(c, pa.concat_arrays([pa.repeat(u[c][0], out.num_rows)]))
        return out.append_column("proof", pa.array(proofs, proof_type))

    left = bucketed(nodes, fanout, levels)
    right = above.drop("n", "digest").withColumnRenamed("idx", "bucket")
    # column by column, so that a null tree meets its own
    return left.groupBy("tree", "bucket").cogroup(right.groupBy("tree", "bucket")).applyInArrow(expand, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def stages(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Written tables of nodes from the leaves up to where every tree has one node."""
    out = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        out.append(saved(raised(out[-1], fanout, levels)))
        largest = -(-largest // fanout**levels)
    return out


def manifest(rows: DataFrame, *, fields: list[str], tree: str, order: str, keep: dict[str, Column] | None = None, fanout: int = 16, levels: int = 2) -> DataFrame:
    """For each row ``order``, ``keep``'s columns, leaf, subroot and root (hex), and proof: the siblings from the leaf to the root by level."""
    keep = keep or {}
    leaf = leaf_digest(*[F.col(c) for c in fields])
    picked = rows.select(F.col(tree).alias("tree"), F.col(order).alias("_id"), *[c.alias(f"_{k}") for k, c in keep.items()], F.unhex(leaf).alias("digest"))
    leaves = saved(placed(picked, ["_id", "digest"]))
    ground = stages(leaves, fanout, levels)
    roots = ground[-1].select("tree", F.col("digest").alias("subroot"))
    tops = saved(placed(roots.select(F.lit(0).alias("tree"), F.col("tree").alias("of"), F.col("subroot").alias("digest")), ["of"]))
    upper = stages(tops, fanout, levels)
    found = upper[-1].select("tree", "idx", F.lower(F.hex("digest")).alias("root"), F.array().cast(PROOF).alias("proof"))
    for nodes in upper[-2::-1] if len(upper) > 1 else [tops]:
        found = saved(lowered(nodes, found, fanout, levels))
    found = found.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("idx"), F.lower(F.hex("digest")).alias("subroot"), "root", "proof")
    for nodes in ground[-2::-1] if len(ground) > 1 else [leaves]:
        found = lowered(nodes, found, fanout, levels)
        found = found if nodes is leaves else saved(found)
    return found.select(F.col("_id").alias(order), *[F.col(f"_{k}").alias(k) for k in keep], F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", "proof")
