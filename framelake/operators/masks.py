"""Masks: fuzzy set operations on planes of 0..65535, prompt rasters, the graph of definitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL = 65535
KEYS = ["image_id", "x", "y"]


def combined(planes: list[DataFrame], how: str) -> DataFrame:
    """Union (maximum) or intersection (minimum) of two or more planes, in one aggregate."""
    every = planes[0].select(*KEYS, "v")
    for p in planes[1:]:
        every = every.union(p.select(*KEYS, "v"))
    return every.groupBy(*KEYS).agg((F.max if how == "union" else F.min)("v").alias("v"))


def subtracted(a: DataFrame, b: DataFrame) -> DataFrame:
    met = a.select(*KEYS, "v").join(b.select(*KEYS, F.col("v").alias("w")), KEYS)
    return met.select(*KEYS, F.floor((F.col("v").cast("long") * (FULL - F.col("w")) + 32767) / FULL).cast("int").alias("v"))


def inverted(a: DataFrame) -> DataFrame:
    return a.withColumn("v", FULL - F.col("v"))


def with_density(a: DataFrame, density: float) -> DataFrame:
    return a if density >= 1 else a.withColumn("v", F.floor(F.col("v") * F.lit(density)).cast("int"))


def centre(c: str, n: int) -> Column:
    return (F.col(c) + 0.5) / n


def box(grid: DataFrame, w: int, h: int, x: float, y: float, bw: float, bh: float) -> DataFrame:
    inside = F.col("x").between(math.floor(x * w), math.ceil((x + bw) * w) - 1) & F.col("y").between(math.floor(y * h), math.ceil((y + bh) * h) - 1)
    return grid.withColumn("v", F.when(inside, FULL).otherwise(0))


def ellipse(grid: DataFrame, w: int, h: int, cx: float, cy: float, rx: float, ry: float) -> DataFrame:
    dx, dy = (centre("x", w) - cx) / rx, (centre("y", h) - cy) / ry
    return grid.withColumn("v", F.when(dx * dx + dy * dy <= 1, FULL).otherwise(0))


def polygon(grid: DataFrame, w: int, h: int, points: list[tuple[float, float]]) -> DataFrame:
    """Even-odd rule at pixel centres."""
    if len(points) < 3:
        return grid.withColumn("v", F.lit(0))
    nx, ny, odd = centre("x", w), centre("y", h), F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, [points[-1], *points[:-1]]):
        if y1 != y2:
            crosses = ((F.lit(y1) > ny) != (F.lit(y2) > ny)) & (nx < (x2 - x1) * (ny - y1) / (y2 - y1) + x1)
            odd = odd + crosses.cast("int")
    return grid.withColumn("v", F.when(odd % 2 == 1, FULL).otherwise(0))


def linear_gradient(grid: DataFrame, w: int, h: int, degrees: float, start: float, end: float) -> DataFrame:
    dx, dy = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    s = [x * dx + y * dy for x in (0.5 / w, 1 - 0.5 / w) for y in (0.5 / h, 1 - 0.5 / h)]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (centre("x", w) * dx + centre("y", h) * dy - min(s)) / (max(s) - min(s))))
    g = F.greatest(F.lit(0.0), F.least(F.lit(1.0), start + t * (end - start)))
    return grid.withColumn("v", F.floor(g * FULL + 0.5).cast("int"))


def brush(grid: DataFrame, w: int, h: int, marks: list[tuple[float, float, float, bool]]) -> DataFrame:
    """(x, y, radius, adds) in order; later marks win."""
    value = F.lit(0)
    for x, y, r, adds in marks:
        dx, dy = centre("x", w) - x, centre("y", h) - y
        value = F.when(dx * dx + dy * dy <= r * r, FULL if adds else 0).otherwise(value)
    return grid.withColumn("v", value)


def composite(px: DataFrame, region: DataFrame, replacement: DataFrame) -> DataFrame:
    """Pixels whose region value is 32768 or more come from the replacement."""
    met = px.join(region.select(*KEYS, "v"), KEYS, "left").join(replacement.select(*KEYS, *[F.col(c).alias(f"n{c}") for c in "rgb"]), KEYS, "left")
    return met.select(*KEYS, *[F.when((F.col("v") >= 32768) & F.col("nr").isNotNull(), F.col(f"n{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"])


def weighted_mean(px: DataFrame, planes: DataFrame, level: Column) -> DataFrame:
    """Mean of ``level`` by frame, weighted with the product of all layers' values; null where weights vanish."""
    weight = planes.groupBy(*KEYS).agg(F.product(F.col("v") / float(FULL)).alias("w"))
    met = px.join(weight, KEYS)
    return met.groupBy("image_id").agg(F.when(F.sum("w") > 1e-6, F.sum(level * F.col("w")) / F.sum("w")).alias("mean"))


def weighted_mean_of(px: DataFrame, planes: list[Column], level: Column) -> DataFrame:
    """``weighted_mean`` where the planes are columns of the frames themselves: one aggregate, no join."""
    weight = planes[0] / float(FULL)
    for v in planes[1:]:
        weight = weight * (v / float(FULL))
    return px.groupBy("image_id").agg(F.when(F.sum(weight) > 1e-6, F.sum(level * weight) / F.sum(weight)).alias("mean"))


def combined_columns(px: DataFrame, planes: list[Column], how: str) -> DataFrame:
    """``combined`` where the planes are columns of the frames themselves: a projection."""
    return px.select(*KEYS, (F.greatest if how == "union" else F.least)(*planes).alias("v"))
