"""Mask prompts from a table, rasterised by scanlines: every image has prompts and a size of its own.

    prompts(image_id, width, height, kind, box, ellipse, points, gradient, marks)

Shapes become spans (image_id, y, x0, x1): the pixels x0 <= x < x1 of a row whose centres lie inside. A polygon's edge
is met with the rows between its ends (a range join, as a sequence of rows for each edge); its crossings of a row are
pixel counts, and spans lie between crossings by parity. Brush marks are spans with a sign and an order, and a pixel takes the
last mark's (``max_by``). A task holds one row's crossings, never an image. Only planes, asked for at the end, have a row for each pixel.

Cases: shapes beyond the frame are cut; a null shape, a polygon of fewer than three points and an image of no pixels give no spans; equal crossings
cancel out; an unknown kind gives no spans and a plane of zeros; extra columns go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL = 65535
#: Types of the shape columns; a prompt has the one of its kind, the others are null.
SHAPES = {
    "box": "struct<x: double, y: double, w: double, h: double>",
    "ellipse": "struct<cx: double, cy: double, rx: double, ry: double>",
    "points": "array<struct<x: double, y: double>>",
    "gradient": "struct<angle: double, start: double, end: double>",
    "marks": "array<struct<x: double, y: double, radius: double, adds: boolean>>",
}


def place(c: Column, n: Column) -> Column:
    """A pixel's centre, 0..1."""
    return (c + F.lit(0.5)) / n


def within(v: Column, n: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), n).cast("int")


def rows_between(low: Column, high: Column, n: Column) -> Column:
    """All rows of ``n`` whose centres can lie between two places, one more on either side."""
    first, last = within(F.floor(F.greatest(low, F.lit(-1.0)) * n - 1.5), n), within(F.ceil(F.least(high, F.lit(2.0)) * n + 0.5), n) - 1
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def with_count(rows: DataFrame, name: str, x: str) -> DataFrame:
    """``name``: how many of ``width`` pixels have a centre under column ``x``, exact for the comparison of centres."""
    k, n, v = F.col("_k"), F.col("width"), F.col(x)
    under = lambda i: place(i, n) < v
    guess = within(F.ceil(F.least(F.greatest(v, F.lit(-1.0)), F.lit(2.0)) * n - 0.5), n)
    # the product may be one off where the quotient is not
    exact = F.when((k > 0) & ~under(k - 1), k - 1).when((k < n) & under(k), k + 1).otherwise(k)
    return rows.withColumn("_k", guess).withColumn(name, exact.cast("int")).drop("_k")


def polygon_spans(prompts: DataFrame) -> DataFrame:
    """The even-odd rule at pixel centres."""
    closed = prompts.where("kind = 'polygon' AND size(points) >= 3 AND width > 0 AND height > 0")
    edges = closed.select("image_id", "width", "height", F.explode(F.transform("points", lambda p, i: F.struct(p.alias("p"), F.element_at("points", F.when(i == 0, F.size("points")).otherwise(i)).alias("q")))).alias("e"))
    rows = edges.select("image_id", "width", "height", "e", F.explode(rows_between(F.least("e.p.y", "e.q.y"), F.greatest("e.p.y", "e.q.y"), F.col("height"))).alias("y"))
    ny = place(F.col("y"), F.col("height"))
    rows = rows.where((F.col("e.p.y") > ny) != (F.col("e.q.y") > ny))
    at = (F.col("e.q.x") - F.col("e.p.x")) * (ny - F.col("e.p.y")) / (F.col("e.q.y") - F.col("e.p.y")) + F.col("e.p.x")
    lines = with_count(rows.select("image_id", "y", "width", at.alias("_x")), "k", "_x").groupBy("image_id", "y").agg(F.sort_array(F.collect_list("k")).alias("k"))
    # from the last crossing back every other gap lies inside
    n = F.size("k")
    gaps = F.filter(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at("k", i).alias("x0"), F.element_at("k", i + 1).alias("x1"), (n - i).alias("left"))), lambda g: (g["left"] % 2 == 1) & (g["x0"] < g["x1"]))
    return lines.where(n > 1).select("image_id", "y", F.inline(gaps)).drop("left")


def box_spans(prompts: DataFrame) -> DataFrame:
    """From the floor of the upper left corner to the ceiling of the lower right one."""
    b = prompts.where("kind = 'box' AND box IS NOT NULL AND width > 0 AND height > 0")
    low = lambda c, n: within(F.floor(F.col(f"box.{c}") * F.col(n)), F.col(n))
    high = lambda c, d, n: within(F.ceil((F.col(f"box.{c}") + F.col(f"box.{d}")) * F.col(n)), F.col(n))
    b = b.select("image_id", low("x", "width").alias("x0"), high("x", "w", "width").alias("x1"), low("y", "height").alias("y0"), high("y", "h", "height").alias("y1")).where("x0 < x1 AND y0 < y1")
    return b.select("image_id", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1")


def disc_spans(discs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (image_id, width, height, cx, cy, rx, ry, ...) as spans with ``keep``'s columns; a pixel is inside if its centre is."""
    rows = discs.select("image_id", "width", "height", "cx", "cy", "rx", "ry", *keep, F.explode(rows_between(F.col("cy") - F.col("ry"), F.col("cy") + F.col("ry"), F.col("height"))).alias("y"))
    dy = (place(F.col("y"), F.col("height")) - F.col("cy")) / F.col("ry")
    rows = rows.withColumn("d2", dy * dy).where("d2 <= 1")
    half, w = F.col("rx") * F.sqrt(1 - F.col("d2")), F.col("width")

    def inside(k: Column) -> Column:
        dx = (place(k, w) - F.col("cx")) / F.col("rx")
        return dx * dx + F.col("d2") <= 1

    def nearby(x: Column) -> Column:
        """The pixels inside among the three about a place: the root may be off by one where the sum of squares is not."""
        k = F.least(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * w), w.cast("long") - 1)
        first, last = F.greatest(k - 1, F.lit(0)), F.least(k + 1, w.cast("long") - 1)
        return F.filter(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")), inside)

    found = rows.select("image_id", "y", F.array_min(nearby(F.col("cx") - half)).cast("int").alias("x0"), (F.array_max(nearby(F.col("cx") + half)) + 1).cast("int").alias("x1"), *keep)
    return found.where("x0 IS NOT NULL AND x1 IS NOT NULL")


def ellipse_spans(prompts: DataFrame) -> DataFrame:
    e = prompts.where("kind = 'ellipse' AND ellipse IS NOT NULL AND ellipse.rx > 0 AND ellipse.ry > 0 AND width > 0 AND height > 0")
    return disc_spans(e.select("image_id", "width", "height", "ellipse.*"), [])


def brush_spans(prompts: DataFrame) -> DataFrame:
    """Spans with ``mark``, the mark's place, and ``adds``."""
    m = prompts.where("kind = 'brush' AND marks IS NOT NULL AND width > 0 AND height > 0").select("image_id", "width", "height", F.posexplode("marks").alias("mark", "m")).where("m.radius > 0")
    return disc_spans(m.select("image_id", "width", "height", F.col("m.x").alias("cx"), F.col("m.y").alias("cy"), F.col("m.radius").alias("rx"), F.col("m.radius").alias("ry"), "mark", F.col("m.adds").alias("adds")), ["mark", "adds"])


def spans(prompts: DataFrame) -> DataFrame:
    """(image_id, y, x0, x1) of boxes, ellipses and polygons."""
    return polygon_spans(prompts).union(box_spans(prompts)).union(ellipse_spans(prompts))


def raster(prompts: DataFrame) -> DataFrame:
    """(image_id, x, y) of every image."""
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    sized = prompts.where("width > 0 AND height > 0").select("image_id", "width", F.explode(every("height")).alias("y"))
    return sized.select("image_id", F.explode(every("width")).alias("x"), "y")


def gradient_planes(prompts: DataFrame) -> DataFrame:
    """A ramp along an angle, whose outermost pixel centres have the start's and the end's value."""
    w, h = F.col("width"), F.col("height")
    g = prompts.where("kind = 'gradient' AND gradient IS NOT NULL AND width > 0 AND height > 0")
    g = g.withColumn("dx", F.cos(F.radians("gradient.angle"))).withColumn("dy", F.sin(F.radians("gradient.angle")))
    ends = [x * F.col("dx") + y * F.col("dy") for x in (0.5 / w, 1.0 - 0.5 / w) for y in (0.5 / h, 1.0 - 0.5 / h)]
    g = g.withColumn("low", F.least(*ends)).withColumn("span", F.greatest(F.greatest(*ends) - F.least(*ends), F.lit(1.1920928955078125e-07)))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    px = g.select("image_id", "width", "height", "dx", "dy", "low", "span", "gradient", F.explode(every(h)).alias("y")).select("*", F.explode(every(w)).alias("x"))
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    t = clamp((place(F.col("x"), w) * F.col("dx") + place(F.col("y"), h) * F.col("dy") - F.col("low")) / F.col("span"))
    v = clamp(F.col("gradient.start") + t * (F.col("gradient.end") - F.col("gradient.start")))
    return px.select("image_id", "x", "y", F.floor(v * FULL + 0.5).cast("int").alias("v"))


def planes(prompts: DataFrame) -> DataFrame:
    """(image_id, x, y, v) of every image's prompt, one prompt an image."""
    along = F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x")
    shape = spans(prompts).select("image_id", along, "y", F.lit(FULL).alias("v"))
    painted = brush_spans(prompts).select("image_id", along, "y", "mark", "adds").groupBy("image_id", "x", "y").agg(F.max_by(F.when(F.col("adds"), FULL).otherwise(0), "mark").alias("v"))
    flat = prompts.where(F.coalesce(F.col("kind"), F.lit("")) != "gradient")
    covered = raster(flat).join(shape.union(painted), ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.coalesce("v", F.lit(0)).alias("v"))
    return covered.union(gradient_planes(prompts))
