"""Curves, hue bands, colour grading, haze and grain as Column expressions over the pixel relation.

Parameters are compiled into literals on the driver (segments, knots, tables of 256), so each is
one projection; only the haze needs a frame's own statistics.
"""

from __future__ import annotations

import colorsys
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .color import clamp, from_hsl, luminance, to_byte, with_hsl

Points = Sequence[tuple[float, float]]
#: Centres of the eight hue bands in degrees (fixed values): red orange yellow green cyan blue violet magenta.
BANDS = {"red": 0.0, "orange": 30.0, "yellow": 60.0, "green": 120.0, "cyan": 180.0, "blue": 240.0, "violet": 270.0, "magenta": 300.0}
WORD = 0xFFFFFFFF


def segments(points: Points) -> list[tuple[float, float, tuple[float, float, float, float]]]:
    """(start, end, cubic in the segment's own 0..1) of the monotone curve through ``points``."""
    (xs, ys), out = zip(*points), []
    ends = list(range(len(xs)))
    slopes = [(ys[min(j + 1, ends[-1])] - ys[max(j - 1, 0)]) / (xs[min(j + 1, ends[-1])] - xs[max(j - 1, 0)]) for j in ends]
    for j in ends[:-1]:
        h, rise = xs[j + 1] - xs[j], ys[j + 1] - ys[j]
        # a falling segment has an empty range of slopes; its points are rejected by validation
        m, n = (h * min(max(s, 0.0), 3 * rise / h) if rise else 0.0 for s in slopes[j : j + 2])
        out.append((xs[j], xs[j + 1], (ys[j], m, 3 * rise - 2 * m - n, m + n - 2 * rise)))
    return out


def on_curve(points: Points, x: Column) -> Column:
    """The curve at ``x``, both within 0..1."""
    at, out = clamp(x, 0.0, 1.0), None
    parts = segments(points)
    for low, high, (a, b, c, d) in parts:
        t = clamp((at - low) / (high - low), 0.0, 1.0)
        y = clamp(((t * d + c) * t + b) * t + a, 0.0, 1.0)
        out = F.when(at <= high, y) if out is None else out.otherwise(y) if high == parts[-1][1] else out.when(at <= high, y)
    return out


def curve_table(points: Points) -> list[float]:
    """The curve at every byte."""
    table = []
    for v in range(256):
        x = v / 255
        low, high, (a, b, c, d) = next((s for s in segments(points) if x <= s[1]), segments(points)[-1])
        t = min(1.0, max(0.0, (x - low) / (high - low)))
        table.append(min(1.0, max(0.0, ((t * d + c) * t + b) * t + a)))
    return table


def curves(px: DataFrame, master: Points, **channels: Points) -> DataFrame:
    """Channel curves (r, g, b) as tables, then all channels scaled by what the master curve does to luminance."""
    light, top = luminance(), on_curve(master, luminance())
    out = {}
    for c in "rgb":
        v = F.get(F.lit(curve_table(channels[c])), F.col(c)) if c in channels else F.col(c) / 255.0
        out[c] = to_byte(clamp(F.when(light > 1e-9, v * top / light).otherwise(top), 0.0, 1.0) * 255.0)
    return px.withColumns(out)


def hue_bands(px: DataFrame, **bands: tuple[float, float, float]) -> DataFrame:
    """(hue, saturation, lightness) shifts of bands; a shift falls linearly to nothing at the centres beside its own, a hue of 1 being 30 degrees.

    Triangles are added up in the bands' order, so that sums round alike wherever they are computed.
    """
    centres = list(BANDS.items())
    turned = lambda e: e - 360.0 * F.floor(e / 360.0)

    def shift(k: int) -> Column:
        out = None
        for i, (name, c) in enumerate(centres):
            if amount := bands.get(name, (0.0, 0.0, 0.0))[k]:
                after, before = (centres[(i + 1) % len(centres)][1] - c) % 360, (c - centres[i - 1][1]) % 360
                ahead, behind = turned(F.col("h") - c), turned(c - F.col("h"))
                term = amount * F.when(ahead <= after, 1.0 - ahead / after).when(behind <= before, 1.0 - behind / before).otherwise(0.0)
                out = term if out is None else out + term
        return F.lit(0.0) if out is None else out

    out = with_hsl(px)
    moved = {"h": turned(F.col("h") + 30.0 * shift(0)), "s": clamp(F.col("s") + shift(1), 0.0, 1.0), "l": clamp(F.col("l") + shift(2), 0.0, 1.0)}
    return from_hsl(out.withColumns(moved))


def color_grade(px: DataFrame, shadows: tuple[float, float], midtones: tuple[float, float], highlights: tuple[float, float], balance: float = 0.0) -> DataFrame:
    """Pulls shadows, midtones and highlights towards a (hue in degrees, saturation) each, one after the other."""
    light, low, high = luminance(), 0.65 - balance * 0.15, 0.35 - balance * 0.15
    ease = lambda t: t * t * (3.0 - 2.0 * t)
    dark = 1.0 - ease(clamp(light / low, 0.0, 1.0))
    bright = ease(clamp((light - high) / (1.0 - high), 0.0, 1.0))
    middle = F.greatest(1.0 - dark - bright, F.lit(0.0))
    total = dark + middle + bright
    out = px.withColumns({"w0": dark / total, "w1": middle / total, "w2": bright / total})
    value = {c: F.col(c) / 255.0 for c in "rgb"}
    for k, (hue, saturation) in enumerate((shadows, midtones, highlights)):
        if saturation:
            tint = colorsys.hls_to_rgb(hue % 360 / 360, 0.5, 1.0)
            value = {c: v + (tint[i] - v) * (F.col(f"w{k}") * saturation) for i, (c, v) in enumerate(value.items())}
    return out.withColumns({c: to_byte(v * 255.0) for c, v in value.items()}).drop("w0", "w1", "w2")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def mixed(z: Column) -> Column:
    """A 32-bit mix of a bigint 0..2^32-1; products are split, as they would overflow."""
    fold = lambda v, n: let(v, lambda a: a.bitwiseXOR(F.shiftright(a, n)))
    times = lambda v, k: let(v, lambda a: (a.bitwiseAND(65535) * k + (F.shiftright(a, 16) * k).bitwiseAND(65535) * 65536).bitwiseAND(WORD))
    z = (z + 0x9E3779B9).bitwiseAND(WORD)
    return fold(times(fold(times(fold(z, 16), 0x85EBCA6B), 13), 0xC2B2AE35), 16)


def mixed_int(z: int) -> int:
    z = (z + 0x9E3779B9) & WORD
    z = (z ^ z >> 16) * 0x85EBCA6B & WORD
    z = (z ^ z >> 13) * 0xC2B2AE35 & WORD
    return z ^ z >> 16


def grain_seed(seed: int, width: int, height: int) -> int:
    s = (seed + (width << 32) + height) & 0xFFFFFFFFFFFFFFFF
    return mixed_int((s ^ s >> 32) * 0x9E3779B9 & WORD)


def grain(px: DataFrame, width: int, height: int, amount: float, size: float, roughness: float, seed: int) -> DataFrame:
    """The same noise on all channels: a pure function of a pixel's cell, so a projection without any exchange."""
    if not amount:
        return px
    cell, start = max(1, 1 + int(size * 7 + 0.5)), grain_seed(seed, width, height)
    unit = lambda n: n / F.lit(4294967296.0) * 2.0 - 1.0
    across = lambda c: mixed((c + start).bitwiseAND(WORD))
    down = lambda c: mixed((c.bitwiseAND(65535) * 0x85EBCA6B + (F.shiftright(c, 16) * 0x85EBCA6B).bitwiseAND(65535) * 65536).bitwiseAND(WORD))
    near = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    zero = F.lit(0).cast("long")
    out = px.withColumns({"xs": F.transform(near, lambda d: across(F.greatest(at("x") + d, zero))), "ys": F.transform(near, lambda d: down(F.greatest(at("y") + d, zero)))})
    field = F.flatten(F.transform("ys", lambda b: F.transform("xs", lambda a: unit(mixed(a.bitwiseXOR(b))))))
    out = out.withColumn("field", field)
    low = F.aggregate("field", F.lit(0.0), lambda s, v: s + v) / 9.0
    delta = F.round((low * (1.0 - roughness) + F.get("field", F.lit(4)) * roughness) * amount * 40.0).cast("int")
    out = out.withColumn("delta", delta)
    return out.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(255), F.col(c) + F.col("delta"))) for c in "rgb"}).drop("xs", "ys", "field", "delta")


def dehaze(dark: DataFrame, amount: float) -> DataFrame:
    """Removes (or adds, if negative) haze; ``dark`` has the dark channel of bytes beside the pixels.

    The air light is the value at 95 % of a frame's sorted dark channel, found in its at most 256 counts.
    """
    if not amount:
        return dark.drop("dark")
    counts = dark.groupBy("image_id", "dark").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image_id")
    run = counts.withColumns({"upto": F.sum("n").over(w.orderBy("dark")), "total": F.sum("n").over(w)})
    rank = F.least(F.floor(F.col("total") * 0.95), F.col("total") - 1)
    air = run.where(F.col("upto") > rank).groupBy("image_id").agg(F.greatest(F.min("dark") / 255.0, F.lit(0.05)).alias("air"))
    base = clamp(1.0 - 0.95 * (F.col("dark") / 255.0) / F.col("air"), 0.05, 1.0)
    t = 1.0 - amount * (1.0 - base) if amount > 0 else 1.0 + -amount * 0.5 * (1.0 - base)
    out = dark.join(air, "image_id").withColumn("t", t)
    return out.withColumns({c: to_byte(clamp((F.col(c) / 255.0 - F.col("air")) / F.col("t") + F.col("air"), 0.0, 1.0) * 255.0) for c in "rgb"}).drop("dark", "air", "t")
