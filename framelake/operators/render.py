"""A whole recipe on a frame relation: every stage in the fixed order, from the recipe part of an edit document.

Order: white balance to blacks (three lookup tables), texture, clarity and dehaze, curves, hue bands, vibrance and saturation, colour grading, noise
reduction, sharpening, vignette, grain; then lens, perspective, aberration, crop, rotation and mirrors. A stage that the recipe does not name, or
whose amounts are zero, adds no operator to the plan.

Cases: an empty recipe gives the frames as they are; an unknown adjustment, or a value beyond its range, raises before anything runs; all frames
of one call have one size and one recipe; extra columns go.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color, develop
from . import detail, geometry, neighbourhood
from .recipes import NESTED
from .sidecars import ADJUSTMENTS

TONE = {"wb_temperature": "temperature", "wb_tint": "tint"} | {k: k for k in ("exposure", "contrast", "shadows", "highlights", "whites", "blacks")}
PARTS = ("curves", "hsl", "color_grading", "presence", "noise_reduction", "sharpening")


@dataclass(frozen=True)
class Recipe:
    """A recipe's parts as a document spells them: scalars and nested parts by name."""

    adjustments: dict[str, float] = field(default_factory=dict)
    parts: dict[str, dict] = field(default_factory=dict)
    effects: dict[str, dict] = field(default_factory=dict)
    lens: geometry.Lens | None = None
    perspective: geometry.Perspective | None = None
    geometry: geometry.Geometry | None = None

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        """From a recipe object: nested parts lie among its adjustments, effects, lens and geometry beside them."""
        given = json.loads(text)
        values = given.get("adjustments") or {}
        parts = {k: values[k] for k in PARTS if values.get(k)}
        made = lambda kind, name: kind(**given[name]) if given.get(name) else None
        shape = dict(given.get("geometry") or {})
        if "crop" in shape:
            shape["crop"] = tuple(shape["crop"])
        out = cls({k: v for k, v in values.items() if k not in PARTS}, parts, given.get("effects") or {}, made(geometry.Lens, "lens_correction"), made(geometry.Perspective, "perspective"), geometry.Geometry(**shape) if shape else None)
        out.check()
        return out

    def check(self) -> None:
        bounds = dict(ADJUSTMENTS)
        for k, v in self.adjustments.items():
            if k not in bounds:
                raise ValueError(f"unsupported adjustment {k}")
            within(k, v, bounds[k])
        for part, values in [*self.parts.items(), *self.effects.items()]:
            for k, v in values.items():
                if f"{part}.{k}" in NESTED:
                    within(f"{part}.{k}", v, NESTED[f"{part}.{k}"])


def within(name: str, value: float, bounds: tuple[float, float]) -> None:
    if not isinstance(value, int | float) or not math.isfinite(value) or not bounds[0] <= value <= bounds[1]:
        raise ValueError(f"invalid {name}: {value!r}, allowed {bounds}")


def points(given: list) -> list[tuple[float, float]]:
    return [(float(p["input"]), float(p["output"])) if isinstance(p, dict) else (float(p[0]), float(p[1])) for p in given]


def rendered(px: DataFrame, recipe: Recipe, width: int, height: int) -> DataFrame:
    """image_id, x, y, r, g, b of the frames after the recipe; the size is that of ``rendered_size``."""
    a, parts = recipe.adjustments, recipe.parts
    out = color.toned(px.select("image_id", "x", "y", "r", "g", "b"), color.Tone(**{TONE[k]: float(v) for k, v in a.items() if k in TONE}))
    if p := parts.get("presence"):
        if p.get("texture") or p.get("clarity"):
            out = detail.presence(out, p.get("texture", 0.0), p.get("clarity", 0.0))
        if p.get("dehaze"):
            out = develop.dehaze(neighbourhood.dark_channel(out), p["dehaze"])
    if c := parts.get("curves"):
        named = {k[0]: points(c[k]) for k in ("red", "green", "blue") if c.get(k)}
        out = develop.curves(out, points(c.get("master") or [(0.0, 0.0), (1.0, 1.0)]), **named)
    if h := parts.get("hsl"):
        out = develop.hue_bands(out, **{k: (v.get("hue", 0.0), v.get("saturation", 0.0), v.get("luminance", 0.0)) for k, v in h.items() if isinstance(v, dict)})
    if a.get("vibrance") or a.get("saturation"):
        out = color.vibrance_saturation(out, a.get("vibrance", 0.0), a.get("saturation", 0.0))
    if g := parts.get("color_grading"):
        pull = lambda k: (g.get(k, {}).get("hue_degrees", 0.0), g.get(k, {}).get("saturation", 0.0))
        out = develop.color_grade(out, pull("shadows"), pull("midtones"), pull("highlights"), g.get("balance", 0.0))
    out = out.select("image_id", "x", "y", "r", "g", "b")
    if n := parts.get("noise_reduction"):
        out = detail.denoised(out, n.get("luminance", 0.0), n.get("color", 0.0))
    if s := parts.get("sharpening"):
        out = detail.sharpened(out, s.get("amount", 0.0), s.get("radius", 1.0), s.get("detail", 0.0), s.get("masking", 0.0))
    if v := recipe.effects.get("vignette"):
        out = color.vignette(out, width, height, v.get("amount", 0.0), v.get("midpoint", 0.5), v.get("roundness", 0.0), v.get("feather", 0.5))
    if g := recipe.effects.get("grain"):
        out = develop.grain(out, width, height, g.get("amount", 0.0), g.get("size", 0.0), g.get("roughness", 0.0), int(g.get("seed", 0)))
    out = geometry.transformed(out, width, height, recipe.geometry, recipe.lens, recipe.perspective)
    return out.select("image_id", "x", "y", *[F.col(c).cast("int").alias(c) for c in "rgb"])


def rendered_size(recipe: Recipe, width: int, height: int) -> tuple[int, int]:
    if recipe.perspective:
        width, height = recipe.perspective.size(width, height)
    if recipe.geometry:
        _, _, width, height = recipe.geometry.pixels(width, height)
        width, height = geometry.rotated_size(width, height, recipe.geometry.degrees)
    return width, height
