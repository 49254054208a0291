"""Detail: noise reduction, sharpening, texture and clarity, mattes' edges, dither and quantisation.

Denoising and sharpening run on tiles with halos (``sources.tiles``): numpy convolutions in Arrow batches, linear in the
frame's size however it is shaped; edges replicate. Texture and clarity are windows within a frame. The dither's random bits
depend on the pixel's place alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.color import clamp
from ..sources.shared import written
from ..sources.tiles import SIDE, haloed, kernel, pixels_of, stacks, tiles_of
from .masks import inverted, with_density
from .neighbourhood import box_blur


def row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def column() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def rounded_bytes(v: np.ndarray) -> np.ndarray:
    """Rounded to 0..255; how negative halves round does not matter there."""
    out = v + 0.5
    np.floor(out, out=out)
    return np.clip(out, 0.0, 255.0, out=out)


def light(samples: np.ndarray) -> np.ndarray:
    """Rec.709 luminance, 0..255, of stacks (rows, channels, height, width)."""
    return 0.2126 * samples[:, 0] + 0.7152 * samples[:, 1] + 0.0722 * samples[:, 2]


def denoised_tiles(tiles: DataFrame, luminance: float, color: float, side: int = SIDE) -> DataFrame:
    """``denoised`` on tiles: one halo exchange of two samples."""

    def run(samples: np.ndarray) -> np.ndarray:
        v = samples.astype(np.float64)
        l, r, b = light(v), v[:, 0], v[:, 2]  # noqa: E741
        h, w = l.shape[1] - 4, l.shape[2] - 4
        own = l[:, 2 : 2 + h, 2 : 2 + w]
        top, below, red, blue, flat = (np.zeros_like(own) for _ in range(5))
        for j in range(5):
            for i in range(5):
                at = np.s_[:, j : j + h, i : i + w]
                d2, y = (i - 2) ** 2 + (j - 2) ** 2, l[at]
                weight = math.exp(-d2 / 4.5) * np.exp(-((own - y) * (own - y)) / (2.0 * 0.12 * 255.0 * 0.12 * 255.0))
                top += weight * y
                below += weight
                share = math.exp(-d2 / 8.0)
                red += share * (r[at] - y)
                blue += share * (b[at] - y)
                flat += share
        y = own * (1.0 - luminance) + top / below * luminance
        mine = v[:, :, 2 : 2 + h, 2 : 2 + w]
        tinted = lambda k, chroma: y + ((mine[:, k] - own) * (1.0 - color) + chroma / flat * color)
        return np.stack([rounded_bytes(c) for c in (tinted(0, red), y + (mine[:, 1] - own), tinted(2, blue))], axis=1)

    return kernel(haloed(tiles, 2, side=side), 2, run, side=side)


def denoised(px: DataFrame, luminance: float, color: float) -> DataFrame:
    """A 5 x 5 bilateral filter on luminance (sigmas 1.5 places and 0.12 of the range), a Gaussian (2 places) on red's and blue's distance from it; green keeps its own."""
    if not luminance and not color:
        return px
    return pixels_of(denoised_tiles(tiles_of(px), luminance, color))


def gaussian(sigma: float) -> list[float]:
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(k * k) / (2.0 * sigma * sigma)) for k in range(-reach, reach + 1)]
    return [v / sum(kernel) for v in kernel]


def weighted(parts: Iterator[np.ndarray], weights: list[float]) -> np.ndarray:
    """Sum of equal arrays by weight, left to right."""
    out = tmp = None
    for c, part in zip(weights, parts):
        if out is None:
            out, tmp = c * part, np.empty(part.shape)
        else:
            out += np.multiply(part, c, out=tmp)
    return out


def blurred(plane: np.ndarray, weights: list[float], reach: int) -> np.ndarray:
    """Rows, then columns of (rows, height, width) with a halo of ``reach``; the halo goes."""
    n = len(weights) // 2
    h, w = plane.shape[1] - 2 * reach, plane.shape[2] - 2 * reach
    inner = plane[:, reach - n : reach + n + h]
    across = weighted((inner[:, :, reach - n + k : reach - n + k + w] for k in range(len(weights))), weights)
    return weighted((across[:, k : k + h] for k in range(len(weights))), weights)


def edges(l: np.ndarray, reach: int) -> np.ndarray:  # noqa: E741
    """Sum of the differences of a sample's neighbours across and down."""
    h, w = l.shape[1] - 2 * reach, l.shape[2] - 2 * reach
    at = lambda dy, dx: l[:, reach + dy : reach + dy + h, reach + dx : reach + dx + w]
    return np.abs(at(0, 1) - at(0, -1)) + np.abs(at(1, 0) - at(-1, 0))


def strongest_edges(halo: DataFrame, reach: int) -> DataFrame:
    """(image_id, strongest): the frame's largest edge, from haloed tiles; one row a tile is aggregated."""
    kind = halo.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = np.zeros(batch.num_rows)
            for rows, samples in stacks(batch, ("r", "g", "b"), reach):
                most[rows] = edges(light(samples.astype(np.float64)), reach).max(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([batch["image_id"], pa.array(most)], ["image_id", "strongest"])

    return halo.mapInArrow(run, f"image_id {kind}, strongest double").groupBy("image_id").agg(F.max("strongest").alias("strongest"))


def sharpened_tiles(tiles: DataFrame, amount: float, radius: float, detail: float, masking: float, scale: float = 1.0, side: int = SIDE) -> DataFrame:
    """``sharpened`` on tiles: one halo exchange, and the frame's strongest edge where ``masking`` asks for it."""
    fine, coarse = (gaussian(max(max(radius * share, 0.5) * scale, 0.5)) for share in (0.5, 1.5))
    reach = max(len(fine), len(coarse)) // 2
    halo = haloed(tiles, reach, side=side)

    def run(samples: np.ndarray, strongest: np.ndarray | None = None) -> np.ndarray:
        v = samples.astype(np.float64)
        l = light(v)  # noqa: E741
        h, w = l.shape[1] - 2 * reach, l.shape[2] - 2 * reach
        inside = np.s_[..., reach : reach + h, reach : reach + w]
        own = l[inside]
        gone = detail * (own - blurred(l, fine, reach)) + (1.0 - detail) * (own - blurred(l, coarse, reach))
        share = np.float64(1.0 - masking)
        if strongest is not None:
            most = strongest[:, None, None]
            share = share + masking * np.where(most > 0, edges(l, reach) / np.where(most > 0, most, 1.0), 0.0)
        lit = own + amount * share * gone
        np.clip(lit, 0.0, 255.0, out=lit)
        ratio = np.divide(lit, own, out=np.zeros_like(lit), where=own > 1e-6)
        return rounded_bytes(v[inside] * ratio[:, None])

    if not masking:
        return kernel(halo, reach, run, side=side)
    halo = written(halo)  # read twice
    return kernel(halo.join(strongest_edges(halo, reach), "image_id"), reach, run, side=side, extra=("strongest",))


def sharpened(px: DataFrame, amount: float, radius: float, detail: float, masking: float, scale: float = 1.0) -> DataFrame:
    """Adds what a fine and a coarse blur take away, less where ``masking`` finds no edge; colours keep their ratios."""
    if not amount:
        return px
    return pixels_of(sharpened_tiles(tiles_of(px), amount, radius, detail, masking, scale))


def presence(px: DataFrame, texture: float, clarity: float) -> DataFrame:
    """Texture, then clarity: every channel against the mean of a box that shrinks at edges; radii follow from the amounts."""
    out = px.repartition("image_id")
    for amount, radius in ((texture, 1 + math.floor(abs(texture) * 2 + 0.5)), (clarity, 8 + math.floor(abs(clarity) * 24 + 0.5))):
        if amount:
            across, down = row().rowsBetween(-radius, radius), column().rowsBetween(-radius, radius)
            out = out.withColumns({f"{c}s": F.sum(c).over(across) for c in "rgb"} | {"n": F.count(F.lit(1)).over(across)})
            out = out.withColumns({f"{c}s": F.sum(f"{c}s").over(down) for c in "rgb"} | {"n": F.sum("n").over(down)})
            out = out.withColumns({c: F.round(clamp(F.col(c) + amount * (F.col(c) - F.col(f"{c}s") / F.col("n")), 0.0, 255.0)).cast("int") for c in "rgb"})
    return out.select("image_id", "x", "y", "r", "g", "b")


def modulated(plane: DataFrame, width: int, height: int, invert: bool = False, feather: float = 0.0, blur: float = 0.0, density: float = 1.0) -> DataFrame:
    """A layer's plane: inverted, feathered (three box blurs), blurred (one), thinned, in this order."""
    out, side = inverted(plane) if invert else plane, max(width, height)
    out = box_blur(out, int(feather * side / 2), 3) if feather > 0 else out
    out = box_blur(out, int(blur * side / 4), 1) if blur > 0 else out
    return with_density(out, density)


def quantised(px: DataFrame, quality: int) -> DataFrame:
    """Channels in steps for a lossy encoding by a lossless codec; 100 leaves them."""
    step = max((101 - quality) // 10, 1)
    return px if quality >= 100 else px.withColumns({c: (F.floor(F.col(c) / step) * step).cast("int") for c in "rgb"})


def as_tensor(px: DataFrame) -> DataFrame:
    """Channels 0..1."""
    return px.select("image_id", "x", "y", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])


def as_plane(value: Column) -> Column:
    """A model's 0..1 as 0..65535."""
    return F.round(clamp(value, 0.0, 1.0) * 65535.0).cast("int")


SEED = 0x9E3779B97F4A7C15
WORD = (1 << 64) - 1
#: Numbers of a block of the dither's sequence.
BLOCK = 1 << 16


def step(s: int) -> int:
    s ^= s << 13 & WORD
    s ^= s >> 7
    return s ^ (s << 17 & WORD)


@lru_cache(maxsize=1)
def powers() -> list[list[int]]:
    """Images of all 64 bits under 1, 2, 4, ... steps, which are linear in the bits."""
    out = [[step(1 << b) for b in range(64)]]
    for _ in range(47):
        out.append([jumped_by(out[-1], v) for v in out[-1]])
    return out


def jumped_by(images: list[int], s: int) -> int:
    out = 0
    while s:
        out ^= images[(s & -s).bit_length() - 1]
        s &= s - 1
    return out


def jumped(s: int, steps: int) -> int:
    for k, images in enumerate(powers()):
        if steps >> k & 1:
            s = jumped_by(images, s)
    return s


def dither_signs(px: DataFrame, width: int, height: int, seed: int) -> DataFrame:
    """(x, y, r, g, b) of -1 or 1: a xorshift sequence over the channels in place order, made in blocks that jump to their start."""
    numbers = 3 * width * height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["id"].to_pylist():
                s, n = jumped(seed ^ SEED, block * BLOCK * 3), min(3 * BLOCK, numbers - block * BLOCK * 3)
                signs = np.empty(n, dtype=np.int32)
                for i in range(n):
                    s = step(s)
                    signs[i] = 1 if s & 1 else -1
                at = np.arange(n // 3) + block * BLOCK
                yield pa.RecordBatch.from_arrays([pa.array((at % width).astype(np.int32)), pa.array((at // width).astype(np.int32)), *(pa.array(signs[k::3]) for k in range(3))], ["x", "y", "dr", "dg", "db"])

    blocks = -(-width * height // BLOCK)
    return px.sparkSession.range(blocks, numPartitions=min(blocks, 200)).mapInArrow(run, "x int, y int, dr int, dg int, db int")


def dithered(px: DataFrame, width: int, height: int, seed: int) -> DataFrame:
    """One code up or down on every channel; frames of one size share the pattern."""
    met = px.join(dither_signs(px, width, height, seed), ["x", "y"])
    return met.select("image_id", "x", "y", *[F.greatest(F.lit(0), F.least(F.lit(255), F.col(c) + F.col(f"d{c}"))).alias(c) for c in "rgb"])


