"""The graph of mask definitions: checks as relations, evaluation one DataFrame operator a node, prompts' mattes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .masks import FULL, combined, inverted, subtracted

#: Operands that each operation takes: least and most.
ARITY = {"source": (0, 0), "union": (2, None), "intersect": (2, None), "subtract": (2, 2), "invert": (1, 1)}


def reached(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) that paths of any length connect, each once. Each round doubles the length that is covered."""
    known = written(edges.select("src", "dst").distinct())
    n = known.count()
    while True:
        more = written(known.join(known.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst")).union(known).distinct())
        m = more.count()
        if m == n:
            return more
        known, n = more, m


def definition_errors(definitions: DataFrame) -> DataFrame:
    """definitions (id, op, refs) with error: null, unknown_operation, arity, dangling or cycle."""
    edges = definitions.select(F.col("id").alias("src"), F.explode("refs").alias("dst"))
    dangling = edges.join(definitions.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id"), F.lit(True).alias("dangling")).distinct()
    cycle = reached(edges).where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("cycle"))
    n = F.size("refs")
    arity = F.lit(False)
    for op, (least, most) in ARITY.items():
        arity = F.when(F.col("op") == op, (n < least) | (n > most if most is not None else F.lit(False))).otherwise(arity)
    met = definitions.join(dangling, "id", "left").join(cycle, "id", "left")
    code = F.when(~F.col("op").isin(*ARITY), "unknown_operation").when(arity, "arity").when(F.col("dangling"), "dangling").when(F.col("cycle"), "cycle")
    return met.select("id", "op", "refs", code.alias("error"))


def evaluated(definitions: dict[str, tuple[str, list[str]]], planes: dict[str, DataFrame], wanted: str) -> DataFrame:
    """The plane of ``wanted``: each definition (operation, references) is one operator of the plan; sources come from ``planes``."""

    def plane(node: str, path: tuple[str, ...]) -> DataFrame:
        if node in path:
            raise ValueError(f"cycle through {node}")
        if node not in definitions:
            raise ValueError(f"missing definition {node}")
        op, refs = definitions[node]
        least, most = ARITY.get(op, (None, None))
        if least is None or len(refs) < least or (most is not None and len(refs) > most):
            raise ValueError(f"{op} with {len(refs)} operands at {node}")
        if op == "source":
            if node not in planes:
                raise ValueError(f"no plane for source {node}")
            return planes[node]
        parts = [plane(r, (*path, node)) for r in refs]
        return inverted(parts[0]) if op == "invert" else subtracted(*parts) if op == "subtract" else combined(parts, op)

    return plane(wanted, ())


def blessed(definitions: DataFrame) -> DataFrame:
    """definitions (id, valid, refs) with blessed: sources that are valid, and derived nodes all of whose references are blessed in the end."""
    edges = definitions.select(F.col("id").alias("src"), F.explode("refs").alias("dst"))
    every = reached(edges)
    # a derived node fails if it reaches a missing or invalid source, or itself
    sources = definitions.where(F.size("refs") == 0).select(F.col("id").alias("dst"), "valid")
    inner = definitions.where(F.size("refs") > 0).select(F.col("id").alias("dst"), F.lit(True).alias("valid"))
    bad = every.join(sources.union(inner), "dst", "left").where(~F.coalesce("valid", F.lit(False)) | (F.col("src") == F.col("dst"))).select(F.col("src").alias("id"), F.lit(True).alias("bad")).distinct()
    loops = every.where("src = dst").select(F.col("src").alias("dst"))
    onto = every.join(loops, "dst", "left_semi").select(F.col("src").alias("id"), F.lit(True).alias("bad")).distinct()
    met = definitions.join(bad.union(onto).distinct(), "id", "left")
    return met.select("id", F.when(F.size("refs") == 0, F.col("valid")).otherwise(F.col("bad").isNull()).alias("blessed"))


def radial_matte(grid: DataFrame, width: int, height: int) -> DataFrame:
    """Opaque at the centre, fading with the distance in half frames."""
    dx, dy = (F.col("x") - (width - 1) / 2) / (width / 2), (F.col("y") - (height - 1) / 2) / (height / 2)
    return grid.withColumn("v", rounded_plane(1.0 - F.sqrt(dx * dx + dy * dy)))


def rounded_plane(alpha: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha)) * FULL).cast("int")


def box_matte(grid: DataFrame, width: int, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """Opaque inside, fading over a sixteenth of the width."""
    margin = float(max(width // 16, 1))
    out = lambda c, low, high: F.greatest(F.lit(low) - F.col(c), F.col(c) - high, F.lit(0)).cast("double")
    dx, dy = out("x", left, right), out("y", top, bottom)
    return grid.withColumn("v", rounded_plane(1.0 - F.sqrt(dx * dx + dy * dy) / margin))


def point_matte(grid: DataFrame, width: int, points: list[tuple[int, int, bool]]) -> DataFrame:
    """Points (x, y, adds) in order: each adds or takes away a disc fading over an eighth of the width."""
    radius, alpha = float(max(width // 8, 1)), F.lit(0.0)
    for x, y, adds in points:
        dx, dy = F.col("x") - float(x), F.col("y") - float(y)
        c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.sqrt(dx * dx + dy * dy) / radius))
        alpha = F.greatest(alpha, c) if adds else F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha - c))
    return grid.withColumn("v", rounded_plane(alpha))


def logit_matte(logits: DataFrame, logit: str = "logit") -> DataFrame:
    return logits.withColumn("v", rounded_plane(1.0 / (1.0 + F.exp(-F.col(logit)))))


def prompted(grid: DataFrame, width: int, height: int, logits: DataFrame | None = None, box: tuple[int, int, int, int] | None = None, points: list[tuple[int, int, bool]] | None = None) -> DataFrame:
    """A prompt's matte: logits before a box before points."""
    if logits is not None:
        return logit_matte(logits)
    if box is not None:
        return box_matte(grid, width, *box)
    if points:
        return point_matte(grid, width, points)
    raise ValueError("a prompt needs logits, a box or points")


def variant(cores: Column, override: Column) -> Column:
    """The model size for a machine; an explicit one wins."""
    return F.coalesce(override, F.when(cores < 4, "tiny").when(cores < 8, "small").when(cores < 16, "base_plus").otherwise("large"))


def layered(layers: DataFrame, definitions: DataFrame, planes: DataFrame) -> DataFrame:
    """layers (layer, copy, mask) with their definition's status and plane's size: warning is null, missing_definition, not_valid, missing_plane or size."""
    met = layers.join(definitions.select("copy", "mask", "status", "width", "height"), ["copy", "mask"], "left").join(planes.select("copy", "mask", F.col("width").alias("pw"), F.col("height").alias("ph")), ["copy", "mask"], "left")
    code = F.when(F.col("status").isNull(), "missing_definition").when(F.col("status") != "Valid", "not_valid").when(F.col("pw").isNull(), "missing_plane").when((F.col("pw") != F.col("width")) | (F.col("ph") != F.col("height")) | (F.col("pw") <= 0) | (F.col("ph") <= 0), "size")
    return met.select("layer", "copy", "mask", code.alias("warning"))


