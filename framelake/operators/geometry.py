"""Geometry: every output pixel is mapped back into the source frame and sampled there.

A map is a pair of Column expressions over the output's x and y, so a warp is one
projection, one equi-join with the pixels and one aggregate, whatever the frame's size.
Parameters that hold for a whole frame (matrices, output sizes) are computed once on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import clamp, to_byte
from .neighbourhood import crop, mirror, rotate90, targets

#: Distortion k1..k3, vignette c0..c2, chromatic shift of red and blue by profile (fixed values).
PROFILES = {
    "wide-light": (0.12, -0.04, 0.01, 1.0, 0.0, 0.0, 0.006, -0.006),
    "tele-light": (-0.08, 0.02, 0.0, 1.0, 0.0, 0.0, -0.004, 0.004),
    "standard-neutral": (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0),
}
#: Width to height by crop preset (fixed values); None keeps the frame's own.
ASPECTS = {"original": None, "1:1": 1.0, "4:5": 4 / 5, "5:4": 5 / 4, "3:2": 3 / 2, "2:3": 2 / 3, "4:3": 4 / 3, "3:4": 3 / 4, "16:9": 16 / 9, "9:16": 9 / 16}


def bilinear(a: Column, b: Column, c: Column, d: Column, fx: Column, fy: Column) -> Column:
    """Of the corners: upper left, upper right, lower left, lower right."""
    return (a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy


def sampled(px: DataFrame, width: int, height: int, to_width: int, to_height: int, sx: Column, sy: Column, channels: tuple[str, ...] = ("r", "g", "b"), black: bool = True) -> DataFrame:
    """The output raster with each channel read at (sx, sy), unrounded.

    Outside of the source it is zero (``black``), or else the nearest edge's value.
    """
    inside = (sx >= 0) & (sy >= 0) & (sx < width) & (sy < height) if black else F.lit(True)
    t = targets(px, to_width, to_height).withColumns({"px": sx, "py": sy}).withColumn("inside", inside)
    t = t.withColumns({"px": clamp(F.col("px"), 0.0, float(width - 1) if not black else float(width)), "py": clamp(F.col("py"), 0.0, float(height - 1) if not black else float(height))})
    t = t.withColumns({"x0": F.least(F.floor("px"), F.lit(width - 1)).cast("int"), "y0": F.least(F.floor("py"), F.lit(height - 1)).cast("int")})
    # both sides are many times what their files weigh, by which Spark would send one whole through the driver
    met = t.join(quads(px, channels).withColumnsRenamed({"x": "x0", "y": "y0"}).hint("merge"), ["image_id", "x0", "y0"])
    fx, fy = F.col("px") - F.col("x0"), F.col("py") - F.col("y0")
    out = [F.when(F.col("inside"), bilinear(F.col(f"q.a.{c}"), F.col(f"q.b.{c}"), F.col(f"q.c.{c}"), F.col(f"q.d.{c}"), fx, fy)).otherwise(0.0).alias(c) for c in channels]
    return met.select("image_id", "x", "y", *out)


def quads(px: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Each pixel with its right, lower and lower right neighbour (a, b, c, d), the border's repeated: both windows lie within one exchange by frame."""
    across, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    rows = px.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.struct(*channels).alias("a")).repartition("image_id")
    rows = rows.withColumn("b", F.coalesce(F.lead("a").over(across), F.col("a"))).withColumn("q", F.struct("a", "b"))
    rows = rows.withColumn("under", F.coalesce(F.lead("q").over(down), F.col("q")))
    return rows.select("image_id", "x", "y", F.struct("a", "b", F.col("under.a").alias("c"), F.col("under.b").alias("d")).alias("q"))


def as_bytes(px: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    return px.withColumns({c: to_byte(F.col(c)) for c in channels})


def resample(plane: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Bilinear at pixel centres, clamped to the edge, halves rounded away from zero."""
    place = lambda c, n, m: clamp((F.col(c) + 0.5) * n / m - 0.5, 0.0, n - 1.0)
    out = sampled(plane, width, height, to_width, to_height, place("x", width, to_width), place("y", height, to_height), ("v",), black=False)
    return out.withColumn("v", F.round("v").cast("int"))


def downscaled_size(width: int, height: int, max_width: int) -> tuple[int, int]:
    """Never larger than the frame; the height is rounded."""
    w = max(1, min(width, max_width))
    return w, max(1, math.floor(w / width * height + 0.5))


def downscale(px: DataFrame, width: int, height: int, max_width: int) -> DataFrame:
    """A preview of at most ``max_width``, bilinear at pixel centres."""
    w, h = downscaled_size(width, height, max_width)
    if (w, h) == (width, height):
        return px
    place = lambda c, n, m: (F.col(c) + 0.5) * n / m - 0.5
    return as_bytes(sampled(px, width, height, w, h, place("x", width, w), place("y", height, h), black=False))


@dataclass(frozen=True)
class Lens:
    """A profile's coefficients; explicit ones override them."""

    profile: str | None = None
    k1: float | None = None
    k2: float | None = None
    k3: float | None = None
    c0: float | None = None
    c1: float | None = None
    c2: float | None = None
    ca_red: float | None = None
    ca_blue: float | None = None

    def coefficients(self) -> list[float]:
        own = (self.k1, self.k2, self.k3, self.c0, self.c1, self.c2, self.ca_red, self.ca_blue)
        return [d if v is None else v for v, d in zip(own, PROFILES[self.profile or "standard-neutral"])]


def undistorted(px: DataFrame, width: int, height: int, lens: Lens) -> DataFrame:
    """Radial distortion inverted by eight Newton steps, and the vignette polynomial's gain."""
    k1, k2, k3, c0, c1, c2, _, _ = lens.coefficients()
    cx, cy, diagonal = (width - 1) / 2, (height - 1) / 2, math.hypot(width, height) / 2
    nx, ny = (F.col("x") - cx) / diagonal, (F.col("y") - cy) / diagonal
    target = F.sqrt(nx * nx + ny * ny)

    def step(r: Column, _: Column) -> Column:
        r2 = r * r
        f = r * (1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2) - target
        return F.greatest(r - f / (1 + 3 * k1 * r2 + 5 * k2 * r2 * r2 + 7 * k3 * r2 * r2 * r2), F.lit(0.0))

    r = F.aggregate(F.sequence(F.lit(1), F.lit(8)), target, step)
    q = F.when(target > 1e-6, r / target).otherwise(1.0)
    out = sampled(px, width, height, width, height, cx + nx * q * diagonal, cy + ny * q * diagonal)
    t2 = target * target
    gain = F.greatest(c0 + c1 * t2 + c2 * t2 * t2, F.lit(0.01))
    return as_bytes(out.withColumns({c: F.col(c) * gain for c in "rgb"}))


def aligned(px: DataFrame, width: int, height: int, lens: Lens) -> DataFrame:
    """Red and blue scaled about the centre against chromatic aberration."""
    *_, red, blue = lens.coefficients()
    cx, cy = (width - 1) / 2, (height - 1) / 2
    out = px
    for c, k in (("r", red), ("b", blue)):
        moved = as_bytes(sampled(px, width, height, width, height, cx + (F.col("x") - cx) * (1 + k), cy + (F.col("y") - cy) * (1 + k), (c,)), (c,))
        out = out.drop(c).join(moved.hint("merge"), ["image_id", "x", "y"])
    return out


@dataclass(frozen=True)
class Perspective:
    vertical: float = 0.0
    horizontal: float = 0.0
    rotation: float = 0.0
    scale: float = 1.0
    aspect_ratio: float = 1.0
    shift_x: float = 0.0
    shift_y: float = 0.0

    def matrix(self) -> list[list[float]]:
        """Shift, rotation, scale, vertical and horizontal keystone, in this order from the left."""
        a = self.rotation * math.pi / 4
        parts = [
            [[1, 0, self.shift_x], [0, 1, self.shift_y], [0, 0, 1]],
            [[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]],
            [[self.scale, 0, 0], [0, self.scale * self.aspect_ratio, 0], [0, 0, 1]],
            [[1, 0, 0], [0, 1, 0], [0, math.tan(self.vertical * math.pi / 4), 1]],
            [[1, 0, 0], [0, 1, 0], [math.tan(self.horizontal * math.pi / 4), 0, 1]],
        ]
        out = parts[0]
        for p in parts[1:]:
            out = [[sum(out[i][k] * p[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
        return out

    def box(self) -> tuple[float, float]:
        """Extent of the projected corners, in half frames."""
        m = self.matrix()
        points = []
        for x in (-1, 1):
            for y in (-1, 1):
                d = m[2][0] * x + m[2][1] * y + m[2][2]
                points.append([(m[i][0] * x + m[i][1] * y + m[i][2]) / d for i in range(2)])
        return tuple(max(p[i] for p in points) - min(p[i] for p in points) for i in range(2))

    def size(self, width: int, height: int) -> tuple[int, int]:
        return tuple(max(1, math.ceil(e * n / 2)) for e, n in zip(self.box(), (width, height)))

    def inverse(self) -> list[list[float]]:
        m = self.matrix()
        minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
        det = sum(m[0][j] * minor(0, j) for j in range(3))
        return [[minor(j, i) / det for j in range(3)] for i in range(3)]


def warped(px: DataFrame, width: int, height: int, p: Perspective) -> DataFrame:
    """The perspective on a centred canvas that holds the projected corners."""
    if p == Perspective():
        return px
    w, h = p.size(width, height)
    ex, ey = p.box()
    nx, ny = -ex / 2 + F.col("x") / max(w - 1, 1) * ex, -ey / 2 + F.col("y") / max(h - 1, 1) * ey
    u, v, d = (a * nx + b * ny + c for a, b, c in p.inverse())
    place = lambda e, n: (e / d / 2 + 0.5) * (n - 1)
    return as_bytes(sampled(px, width, height, w, h, place(u, width), place(v, height)))


def rotated_size(width: int, height: int, degrees: float) -> tuple[int, int]:
    if abs(degrees % 180) < 1e-4:
        return max(1, width), max(1, height)
    if abs((degrees - 90) % 180) < 1e-4:
        return max(1, height), max(1, width)
    c, s = abs(math.cos(math.radians(degrees))), abs(math.sin(math.radians(degrees)))
    return max(1, math.ceil(width * c + height * s)), max(1, math.ceil(width * s + height * c))


def rotated(px: DataFrame, width: int, height: int, degrees: float) -> DataFrame:
    """Quarter turns exactly; any other angle on an enlarged canvas."""
    turns = math.floor(degrees / 90 + 0.5)
    if abs(degrees - 90 * turns) < 1e-4:
        return rotate90(px, width, height, turns % 4)
    w, h = rotated_size(width, height, degrees)
    s, c = math.sin(math.radians(degrees)), math.cos(math.radians(degrees))
    dx, dy = F.col("x") - (w - 1) / 2, F.col("y") - (h - 1) / 2
    return as_bytes(sampled(px, width, height, w, h, c * dx + s * dy + (width - 1) / 2, -s * dx + c * dy + (height - 1) / 2))


def crop_rectangle(width: Column, height: Column, preset: Column) -> Column:
    """Struct (x, y, w, h) of the centred crop with a preset's aspect, in pixels; null for an unknown preset."""
    known = F.create_map(*[F.lit(v) for k, r in ASPECTS.items() if r for v in (k, r)])
    own = width / height
    ratio = F.when(preset == "original", own).otherwise(F.try_element_at(known, preset))
    w = F.when(own > ratio, ratio / own).otherwise(1.0)
    h = F.when(own > ratio, 1.0).otherwise(own / ratio)
    return pixel_rectangle(width, height, (1.0 - w) / 2.0, (1.0 - h) / 2.0, w, h)


def pixel_rectangle(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Struct (x, y, w, h) in pixels of a rectangle in parts of the frame; null if it is empty or reaches beyond the frame."""
    finite = lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = finite(x) & finite(y) & finite(w) & finite(h) & (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x + w <= 1 + 1e-6) & (y + h <= 1 + 1e-6)
    left, top = F.round(x * width).cast("int"), F.round(y * height).cast("int")
    across = F.least(F.greatest(F.round(w * width).cast("int"), F.lit(1)), width.cast("int") - left)
    down = F.least(F.greatest(F.round(h * height).cast("int"), F.lit(1)), height.cast("int") - top)
    return F.when(good, F.struct(left.alias("x"), top.alias("y"), across.alias("w"), down.alias("h")))


@dataclass(frozen=True)
class Geometry:
    """A crop in parts of the frame, a rotation and mirrors."""

    crop: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)
    degrees: float = 0.0
    horizontal: bool = False
    vertical: bool = False

    def pixels(self, width: int, height: int) -> tuple[int, int, int, int]:
        near = lambda v: math.floor(v + 0.5)
        x, y = near(self.crop[0] * width), near(self.crop[1] * height)
        return x, y, min(max(1, near(self.crop[2] * width)), width - x), min(max(1, near(self.crop[3] * height)), height - y)


@dataclass(frozen=True)
class Domain:
    """Size of the output and the part of the (perspective-corrected) source that it shows."""

    width: int
    height: int
    x: float = 0.0
    y: float = 0.0
    across: float = 1.0
    down: float = 1.0


def measurement_domain(width: int, height: int, geometry: Geometry | None = None, perspective: Perspective | None = None) -> Domain:
    """The output's size without rendering, in the same order: perspective, crop, rotation."""
    w, h = perspective.size(width, height) if perspective else (width, height)
    if geometry is None:
        return Domain(w, h)
    x, y, cw, ch = geometry.pixels(w, h)
    return replace(Domain(*rotated_size(cw, ch, geometry.degrees)), x=x / w, y=y / h, across=cw / w, down=ch / h)


def transformed(px: DataFrame, width: int, height: int, geometry: Geometry | None = None, lens: Lens | None = None, perspective: Perspective | None = None) -> DataFrame:
    """Lens, perspective, chromatic aberration, crop, rotation, mirrors, in this order."""
    out = px
    if lens:
        out = undistorted(out, width, height, lens)
    if perspective:
        out, (width, height) = warped(out, width, height, perspective), perspective.size(width, height)
    if lens:
        out = aligned(out, width, height, lens)
    if geometry:
        x, y, w, h = geometry.pixels(width, height)
        out = rotated(crop(out, x, y, w, h), w, h, geometry.degrees)
        out = mirror(out, *rotated_size(w, h, geometry.degrees), geometry.horizontal, geometry.vertical)
    return out


def oriented(px: DataFrame, width: int, height: int, orientation: int) -> DataFrame:
    """A stored frame turned upright by its orientation tag 1..8; 5 to 8 swap the sides."""
    x, y = F.col("x"), F.col("y")
    right, down = width - 1 - x, height - 1 - y
    to = {1: (x, y), 2: (right, y), 3: (right, down), 4: (x, down), 5: (y, x), 6: (down, x), 7: (down, right), 8: (y, right)}[orientation]
    return px.withColumns({"x": to[0], "y": to[1]})
