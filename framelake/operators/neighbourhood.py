"""Operators that look at neighbours: windows within a frame, or joins on coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import luminance


def box_blur(plane: DataFrame, radius: int, passes: int = 1, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Rows, then columns of v: the floor of the mean over what lies inside. One exchange: all windows nest in ``keys``."""
    if radius <= 0:
        return plane
    out = plane.repartition(*keys)
    for _ in range(passes):
        for line, place in (("y", "x"), ("x", "y")):
            w = Window.partitionBy(*keys, line).orderBy(place).rowsBetween(-radius, radius)
            out = out.withColumn("v", F.floor(F.sum("v").over(w) / F.count("v").over(w)).cast("int"))
    return out


def gradient(px: DataFrame) -> DataFrame:
    """Central differences of luminance, edges replicated."""
    l, d = F.col("l"), px.withColumn("l", luminance()).repartition("image_id")  # noqa: E741
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    side = lambda f, w: F.coalesce(f("l").over(w), l)
    d = d.withColumns({"dx": (side(F.lead, row) - side(F.lag, row)) / 2.0, "dy": (side(F.lead, col) - side(F.lag, col)) / 2.0})
    return d.select("image_id", "x", "y", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("magnitude"))


def dark_channel(px: DataFrame, radius: int = 2) -> DataFrame:
    """Minimum of all channels over a square; the minimum is taken along rows, then columns."""
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-radius, radius)
    col = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-radius, radius)
    out = px.repartition("image_id").withColumn("dark", F.min(F.least("r", "g", "b")).over(row))
    return out.withColumn("dark", F.min("dark").over(col))


def crop(px: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = (F.col("x") >= x) & (F.col("x") < x + width) & (F.col("y") >= y) & (F.col("y") < y + height)
    return px.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def mirror(px: DataFrame, width: int, height: int, horizontal: bool, vertical: bool) -> DataFrame:
    return px.withColumns(({"x": width - 1 - F.col("x")} if horizontal else {}) | ({"y": height - 1 - F.col("y")} if vertical else {}))


def rotate90(px: DataFrame, width: int, height: int, turns: int) -> DataFrame:
    """Clockwise quarter turns."""
    x, y = F.col("x"), F.col("y")
    to = {0: (x, y), 1: (height - 1 - y, x), 2: (width - 1 - x, height - 1 - y), 3: (y, width - 1 - x)}[turns % 4]
    return px.withColumns({"x": to[0], "y": to[1]})


def targets(px: DataFrame, width: int, height: int) -> DataFrame:
    """The output raster of every frame."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return px.select("image_id").distinct().withColumn("x", every(width)).withColumn("y", every(height))


def nearest_resize(px: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    at = lambda c, n, m: F.floor(F.col(c) * n / m).cast("int")
    out = targets(px, to_width, to_height).withColumns({"sx": at("x", width, to_width), "sy": at("y", height, to_height)})
    return out.join(px.withColumnsRenamed({"x": "sx", "y": "sy"}).hint("merge"), ["image_id", "sx", "sy"]).drop("sx", "sy")
