"""Mask graphs as tables: many copies' graphs at once, evaluated level by level.

    definitions(node, op, refs)      node of any type that can be compared, such as a struct of copy and mask
    payloads(node, width, height)    sources that have a plane (loaded, or a prompt's raster)
    planes(node, x, y, v)            their values

Nodes whose inputs are done are peeled off in rounds; a round joins the newly done nodes with the references that wait for them, so a shared node
is met once for each reference, however many paths lead to it. What stays behind has failed: each such node points to its
first failing reference, and doubling these pointers finds the failure that an evaluation in order meets first, or the
node where it meets itself. A level's planes are one join and one grouped aggregate.
Rounds are written tables; the driver sees their counts only.

Cases: a null node is left out; a repeated definition counts once (the smaller by op, then refs); repeated references are
operands of their own; sizes must agree; nodes of a cycle and all that need them fail; empty tables give empty results; extra columns go.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .masks import FULL
from .mask_graph import ARITY

PIXEL = ["node", "x", "y"]


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting both sides: tables of all copies' nodes look small as files, and Spark would send them whole through the driver."""
    return left.join(right.hint("merge"), on, how)


def distinct_definitions(definitions: DataFrame) -> DataFrame:
    some = definitions.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("op", F.coalesce("refs", F.array().cast(definitions.schema["refs"].dataType)).alias("refs"))).alias("d"))
    return some.select("node", "d.op", "d.refs")


def own_errors(definitions: DataFrame, payloads: DataFrame) -> DataFrame:
    """(node, op, refs, error): unknown_operation, arity or missing_payload, which a node has whatever its references are."""
    n, code = F.size("refs"), F.lit("unknown_operation")
    for op, (least, most) in ARITY.items():
        code = F.when(F.col("op") == op, F.when((n < least) | (n > most if most is not None else F.lit(False)), "arity")).otherwise(code)
    met = merged(definitions, payloads.select("node").distinct().withColumn("loaded", F.lit(True)), "node", "left")
    missing = F.when((F.col("op") == "source") & F.col("loaded").isNull(), "missing_payload")
    return met.select("node", "op", "refs", F.coalesce(code, missing).alias("error"))


def doubled(pointers: DataFrame, steps: int) -> DataFrame:
    """(node, to) after 2 ** steps steps; nodes without a row stay where they are."""
    now = pointers
    for _ in range(steps):
        on = now.select(F.col("node").alias("to"), F.col("to").alias("next"))
        now = written(merged(now, on, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
    return now


def levels(definitions: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, op, level, width, height) of the nodes that can be evaluated, and (node, error, at) of the others: the first failure met and the node that has it."""
    own = written(own_errors(distinct_definitions(definitions), payloads))
    edges = own.where("error IS NULL").select("node", F.posexplode("refs").alias("ord", "ref"))
    sizes = payloads.groupBy("node").agg(F.min("width").alias("width"), F.min("height").alias("height"))
    frontier = written(merged(own.where("error IS NULL AND op = 'source'"), sizes, "node").select("node", "width", "height", F.lit(0).alias("level")))
    done, pending, met, level = [frontier], written(edges), [], 0
    uneven = []
    while not frontier.isEmpty():
        level += 1
        reached = frontier.select(F.col("node").alias("ref"), "width", "height")
        step = written(merged(pending, reached, "ref").select("node", "ord", "width", "height"))
        met.append(step)
        pending = written(merged(pending, reached.select("ref"), "ref", "left_anti").select("node", "ord", "ref"))
        ready = merged(step.select("node").distinct(), pending, "node", "left_anti")
        everything = met[0]
        for m in met[1:]:
            everything = everything.union(m)
        grouped = written(merged(everything, ready, "node", "left_semi").groupBy("node").agg(F.min("width").alias("width"), F.max("width").alias("w1"), F.min("height").alias("height"), F.max("height").alias("h1")))
        same = "width = w1 AND height = h1"
        uneven.append(grouped.where(f"NOT ({same})").select("node"))
        frontier = written(grouped.where(same).select("node", "width", "height", F.lit(level).alias("level")))
        done.append(frontier)
    fine = done[0]
    for t in done[1:]:
        fine = fine.union(t)
    fine = written(merged(fine, own.select("node", "op"), "node").select("node", "op", "level", "width", "height"))
    return fine, failures(own, pending, met, uneven)


def failures(own: DataFrame, pending: DataFrame, met: list[DataFrame], uneven: list[DataFrame]) -> DataFrame:
    """(node, error, at) of the nodes that levels left behind."""
    first = pending.groupBy("node").agg(F.min_by("ref", "ord").alias("to"), F.min("ord").alias("at_ord"))
    # operands of different sizes before the first failing one fail first
    sizes = None
    for m in met:
        sizes = m if sizes is None else sizes.union(m)
    mixed = None
    if sizes is not None:
        before = merged(sizes, first.select("node", "at_ord"), "node").where("ord < at_ord")
        mixed = before.groupBy("node").agg((F.min("width") != F.max("width")).alias("a"), (F.min("height") != F.max("height")).alias("b")).where("a OR b").select("node")
        for u in uneven:
            mixed = mixed.union(u)
    known = own.where("error IS NOT NULL").select("node", "error")
    absent = merged(pending.select(F.col("ref").alias("node")).distinct(), own.select("node"), "node", "left_anti").select("node", F.lit("missing_mask").alias("error"))
    ends = known.union(absent)
    ends = written(ends if mixed is None else ends.union(mixed.distinct().select("node", F.lit("dimension_mismatch").alias("error"))))
    pointers = written(merged(first.select("node", "to"), ends.select("node"), "node", "left_anti"))
    n = pointers.count()
    steps = math.ceil(math.log2(n + 1)) if n else 0
    # after so many steps every pointer has reached a failure or a cycle, and each node of a cycle is reached
    far = doubled(pointers, steps)
    loops = written(merged(far.select(F.col("to").alias("node")).distinct(), ends.select("node"), "node", "left_anti"))
    straight = merged(pointers, loops, "node", "left_anti")
    last = doubled(written(straight), steps)
    ends = ends.union(loops.select("node", F.lit("cycle").alias("error")))
    return written(merged(last, ends.withColumnRenamed("node", "to"), "to").select("node", "error", F.col("to").alias("at")).union(ends.select("node", "error", F.col("node").alias("at"))))


def evaluated(definitions: DataFrame, fine: DataFrame, planes: DataFrame) -> DataFrame:
    """(node, x, y, v) of every node in ``fine``; a level reads only the levels that it refers to."""
    at = fine.select("node", "op", "level")
    edges = merged(distinct_definitions(definitions).drop("op"), at, "node").select("node", "op", "level", F.posexplode("refs").alias("ord", "ref"))
    edges = written(merged(edges, at.select(F.col("node").alias("ref"), F.col("level").alias("from")), "ref"))
    used = {}
    for r in edges.select("level", "from").distinct().collect():  # pairs of levels, no nodes
        used.setdefault(r["level"], set()).add(r["from"])
    done = {0: merged(planes.select(*PIXEL, "v"), at.where("level = 0").select("node"), "node", "left_semi")}
    for level in sorted(used):
        inputs = None
        for k in sorted(used[level]):
            inputs = done[k] if inputs is None else inputs.union(done[k])
        met = merged(edges.where(F.col("level") == level), inputs.withColumnRenamed("node", "ref"), "ref")
        one, two = F.min_by("v", "ord"), F.max_by("v", "ord")
        values = met.groupBy("node", "op", "x", "y").agg(F.max("v").alias("hi"), F.min("v").alias("lo"), one.alias("one"), two.alias("two"))
        less = F.floor((F.col("one").cast("long") * (FULL - F.col("two")) + 32767) / FULL).cast("int")
        v = F.when(F.col("op") == "union", F.col("hi")).when(F.col("op") == "intersect", F.col("lo")).when(F.col("op") == "invert", FULL - F.col("one")).otherwise(less)
        done[level] = written(values.select(*PIXEL, v.alias("v")))
    out = done[0]
    for level in sorted(used):
        out = out.union(done[level])
    return out


def layer_outcomes(layers: DataFrame, statuses: DataFrame, failed: DataFrame) -> DataFrame:
    """``layers`` (copy, layer, ord, node) with outcome (ok, unavailable, evaluation), reason and at.

    A layer is unavailable if its mask has no definition or one that is not Valid in ``statuses`` (node, status); otherwise its
    graph's failure counts. Every failure is a row: what a renderer that warns skips.
    """
    met = merged(merged(layers, statuses.select("node", "status"), "node", "left"), failed, "node", "left")
    gone = F.coalesce(F.col("status") != "Valid", F.lit(True))
    outcome = F.when(gone, "unavailable").when(F.col("error").isNotNull(), "evaluation").otherwise("ok")
    reason = F.when(gone, F.coalesce("status", F.lit("Missing"))).otherwise(F.col("error"))
    return met.select("copy", "layer", "ord", "node", outcome.alias("outcome"), reason.alias("reason"), F.when(~gone, F.col("at")).alias("at"))


def strict(outcomes: DataFrame) -> DataFrame:
    """A strict renderer's result for each copy: its first failing layer, or none."""
    failing = F.when(F.col("outcome") != "ok", F.struct("ord", "layer", "outcome", "reason"))
    found = outcomes.groupBy("copy").agg(F.min(failing).alias("f"), F.count(F.lit(1)).alias("layers"))
    return found.select("copy", "layers", F.col("f.layer").alias("failed_layer"), F.col("f.outcome").alias("outcome"), F.col("f.reason").alias("reason"))


__all__ = ["distinct_definitions", "evaluated", "layer_outcomes", "levels", "own_errors", "strict"]
