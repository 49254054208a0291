"""Colour kernels as Column expressions; the tone group is compiled into a lookup table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def to_byte(v: Column) -> Column:
    return clamp(F.round(v), 0.0, 255.0).cast("int")


def luminance(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    """Rec.709 weights on encoded values, 0..1."""
    r, g, b = (F.col(c) if isinstance(c, str) else c for c in (r, g, b))
    return (F.lit(0.2126) * r + F.lit(0.7152) * g + F.lit(0.0722) * b) / F.lit(255.0)


@dataclass(frozen=True)
class Tone:
    """Scalar adjustments; None leaves a stage out."""

    temperature: float | None = None
    tint: float | None = None
    exposure: float | None = None
    contrast: float | None = None
    shadows: float | None = None
    highlights: float | None = None
    whites: float | None = None
    blacks: float | None = None

    def identity(self) -> bool:
        return all(v is None for v in vars(self).values())

    def value(self, channel: int, v: float) -> int:
        """One channel value through all stages, rounded and clamped between them."""
        near = lambda x: float(min(255, max(0, math.floor(x + 0.5))))
        if self.temperature is not None or self.tint is not None:
            warm, tint = ((6500 if self.temperature is None else self.temperature) - 6500) / 5500, self.tint or 0.0
            v = near(v * (1 - 0.35 * warm, 1 - 0.2 * tint, 1 + 0.35 * warm)[channel])
        if self.exposure is not None:
            v = near(v * 2.0**self.exposure)
        if self.contrast is not None:
            v = near((v - 128) * (1 + self.contrast) + 128)
        for amount, upper, power, sign in ((self.shadows, False, 2, 1), (self.highlights, True, 2, 1), (self.whites, True, 1, 1), (self.blacks, False, 1, -1)):
            if amount is not None:
                x = v / 255
                w = max((x - 0.5) / 0.5 if upper else (0.5 - x) / 0.5, 0.0) ** power
                v = near(min(1.0, max(0.0, x + sign * amount * w * 0.25)) * 255)
        return int(v)


def toned(px: DataFrame, tone: Tone) -> DataFrame:
    """The tone group on every pixel: three table lookups, no operator at all for the identity."""
    if tone.identity():
        return px
    luts = [F.lit([tone.value(c, float(v)) for v in range(256)]) for c in range(3)]
    return px.withColumns({c: F.get(luts[i], F.col(c)) for i, c in enumerate("rgb")})


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and lightness of channels 0..1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    light, d = (top + low) / 2.0, top - low
    sat = F.when(d == 0, 0.0).otherwise(d / (1.0 - F.abs(2.0 * light - 1.0)))
    hue = F.when(d == 0, 0.0).when(top == r, 60.0 * F.pmod((g - b) / d, F.lit(6.0))).when(top == g, 60.0 * ((b - r) / d + 2.0)).otherwise(60.0 * ((r - g) / d + 4.0))
    return hue, sat, light


def hsl_to_rgb(h: Column, s: Column, l: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    c = (1.0 - F.abs(2.0 * l - 1.0)) * s
    x = c * (1.0 - F.abs(F.pmod(h / 60.0, F.lit(2.0)) - 1.0))
    m, zero = l - c / 2.0, F.lit(0.0)
    order = [(c, x, zero), (x, c, zero), (zero, c, x), (zero, x, c), (x, zero, c), (c, zero, x)]
    out = []
    for i in range(3):
        e = F.when(h < 60, order[0][i])
        for k in range(1, 5):
            e = e.when(h < 60 * (k + 1), order[k][i])
        out.append(e.otherwise(order[5][i]) + m)
    return tuple(out)


def with_hsl(px: DataFrame) -> DataFrame:
    h, s, l = rgb_to_hsl(*(F.col(c) / 255.0 for c in "rgb"))  # noqa: E741
    return px.withColumns({"h": h, "s": s, "l": l})


def from_hsl(px: DataFrame) -> DataFrame:
    rgb = hsl_to_rgb(F.col("h"), F.col("s"), F.col("l"))
    return px.withColumns({c: to_byte(v * 255.0) for c, v in zip("rgb", rgb)}).drop("h", "s", "l")


def vibrance_saturation(px: DataFrame, vibrance: float, saturation: float) -> DataFrame:
    hue, sat = F.col("h"), F.col("s")
    skin = F.when((hue < 5) | (hue > 65), 1.0).when(hue < 15, (15.0 - hue) / 10.0).when(hue <= 55, 0.0).otherwise((hue - 55.0) / 10.0)
    out = with_hsl(px)
    if vibrance:
        out = out.withColumn("s", clamp(sat + vibrance * ((1.0 - sat) * skin) * ((1.0 - sat) if vibrance >= 0 else sat), 0.0, 1.0))
    return from_hsl(out.withColumn("s", clamp(sat * (1.0 + saturation), 0.0, 1.0)))


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def vignette(px: DataFrame, width: int, height: int, amount: float, midpoint: float, roundness: float, feather: float) -> DataFrame:
    """Darkening towards the edge; a frame's extreme radii follow from its size."""
    if not amount:
        return px
    cx, cy = (width - 1) / 2, (height - 1) / 2
    hw, hh, ry = max(cx, 1.0), max(cy, 1.0), 1 + (1 - roundness) * 0.5
    radius = lambda x, y: math.sqrt(((x - cx) / hw) ** 2 + ((y - cy) / hh * ry) ** 2)
    least, most = radius(width // 2, height // 2), radius(0, 0)
    dx, dy = (F.col("x") - cx) / hw, (F.col("y") - cy) / hh * ry
    rn = (F.sqrt(dx * dx + dy * dy) - least) / max(most - least, 1e-6)
    t = clamp((rn - midpoint) / max(1 - midpoint, 1e-6), 0.0, 1.0)
    wide = 0.15 + feather * 0.7
    factor = 1.0 - amount * smoothstep(0.5 - wide / 2, 0.5 + wide / 2, t)
    return px.withColumns({c: to_byte(clamp(F.col(c) * factor, 0.0, 255.0)) for c in "rgb"})
