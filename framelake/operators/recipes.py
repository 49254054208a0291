"""Edit recipes as columns: validation with typed errors, precedence, canonical hashes, render keys, and recipes applied to frames by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import to_byte

#: Least and greatest value of each nested field (fixed values).
NESTED = {
    "lens.distortion_k1": (-1.0, 1.0), "lens.distortion_k2": (-1.0, 1.0), "lens.distortion_k3": (-1.0, 1.0), "lens.vignette_c0": (-1.0, 1.0), "lens.vignette_c1": (-1.0, 1.0), "lens.vignette_c2": (-1.0, 1.0), "lens.ca_red": (-0.05, 0.05), "lens.ca_blue": (-0.05, 0.05),
    "perspective.vertical": (-1.0, 1.0), "perspective.horizontal": (-1.0, 1.0), "perspective.rotation": (-1.0, 1.0), "perspective.shift_x": (-1.0, 1.0), "perspective.shift_y": (-1.0, 1.0), "perspective.scale": (0.1, 10.0), "perspective.aspect_ratio": (0.1, 10.0),
    "geometry.rotation_degrees": (-180.0, 180.0),
    "presence.texture": (-1.0, 1.0), "presence.clarity": (-1.0, 1.0), "presence.dehaze": (-1.0, 1.0),
    "color_grading.balance": (-1.0, 1.0), "color_grading.shadows.hue_degrees": (0.0, 360.0), "color_grading.shadows.saturation": (0.0, 1.0), "color_grading.midtones.hue_degrees": (0.0, 360.0), "color_grading.midtones.saturation": (0.0, 1.0), "color_grading.highlights.hue_degrees": (0.0, 360.0), "color_grading.highlights.saturation": (0.0, 1.0),
    "noise_reduction.luminance": (0.0, 1.0), "noise_reduction.color": (0.0, 1.0),
    "sharpening.amount": (0.0, 3.0), "sharpening.radius": (0.1, 10.0), "sharpening.detail": (0.0, 1.0), "sharpening.masking": (0.0, 1.0),
    "vignette.amount": (-1.0, 1.0), "vignette.midpoint": (0.0, 1.0), "vignette.roundness": (-1.0, 1.0), "vignette.feather": (0.0, 1.0),
    "grain.amount": (0.0, 1.0), "grain.size": (0.0, 1.0), "grain.roughness": (0.0, 1.0),
} | {f"hsl.{c}.{f}": (-1.0, 1.0) for c in ("red", "orange", "yellow", "green", "cyan", "blue", "violet", "magenta") for f in ("hue", "saturation", "luminance")}
#: Keys that a mask's identity does not depend on (fixed values).
DOWNSTREAM = ("crop", "rotation", "mirror", "geometry", "lens_correction", "perspective", "output", "output_profile", "output_width", "output_height", "output_format")
FORMATS = ("png", "jpg", "jpeg", "webp")


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def checked_fields(fields: DataFrame) -> DataFrame:
    """fields (path, version, value) with error: null, or a struct (code, least, most). The bounds are a small literal table, joined by broadcast."""
    names = list(NESTED)
    bounds = fields.sparkSession.range(1).select(F.inline(F.arrays_zip(F.array(*map(F.lit, names)).alias("path"), F.array(*[F.lit(NESTED[n][0]) for n in names]).alias("least"), F.array(*[F.lit(NESTED[n][1]) for n in names]).alias("most"))))
    met = fields.join(F.broadcast(bounds), "path", "left")
    v = F.col("value")
    code = F.when(F.col("least").isNull(), "unsupported").when(F.col("version") != 1, "version").when(~finite(v), "not_finite").when((v < F.col("least")) | (v > F.col("most")), "out_of_range")
    return met.withColumn("error", F.when(code.isNotNull(), F.struct(code.alias("code"), F.col("least"), F.col("most")))).drop("least", "most")


def curve_error(points: Column) -> Column:
    """Of an array of structs (input, output): null for a valid curve, or what is wrong first: points, range, order, start or end."""
    n = F.size(points)
    within = F.forall(points, lambda p: finite(p["input"]) & finite(p["output"]) & p["input"].between(0, 1) & p["output"].between(0, 1))
    rising = F.forall(F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: a["input"] < b["input"]), lambda ok: ok)
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return (
        F.when(points.isNull() | (n < 2) | (n > 32), "points").when(~within, "range").when(~rising, "order")
        .when((first["input"] != 0) | (first["output"] != 0), "start").when((last["input"] != 1) | (last["output"] != 1), "end")
    )


def export_error(format_: Column, quality: Column, bits: Column) -> Column:
    return F.when(~F.coalesce(format_.isin(*FORMATS), F.lit(False)), "format").when(~F.coalesce(quality.between(1, 100), F.lit(False)), "quality").when(F.coalesce(bits, F.lit(8)) != 8, "bits")


def auto_tone_error(target: Column, epsilon: Column, low: Column, high: Column) -> Column:
    """What is wrong with a configuration: the target, the epsilon or bounds that are not in order."""
    return F.when(~(finite(target) & target.between(0, 1)), "target").when(~(finite(epsilon) & (epsilon > 0) & (epsilon <= 1)), "epsilon").when(~(finite(low) & finite(high) & (low <= high)), "bounds")


def canonical(adjustments: Column) -> Column:
    """Keys in order, values to six digits: the same text for the same edits."""
    entries = F.array_sort(F.map_entries(adjustments))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"]))), ",")


def recipe_hash(adjustments: Column) -> Column:
    return F.sha2(canonical(adjustments), 256)


def mask_recipe_hash(adjustments: Column) -> Column:
    return recipe_hash(F.map_filter(adjustments, lambda k, _: ~k.isin(*DOWNSTREAM)))


def render_key(scope: str, source: Column, versions: list[Column], copy: Column, adjustments: Column, artifacts: Column, output: list[Column]) -> Column:
    """Digest of what a scope depends on: decode, mask (without what comes after masks) or render (with the output)."""
    parts = [F.lit(scope), source, *versions, copy]
    if scope != "decode":
        parts += [mask_recipe_hash(adjustments) if scope == "mask" else recipe_hash(adjustments), F.array_join(artifacts, ",")]
    if scope == "render":
        parts += output
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def merged(auto: Column, preset: Column, flags: Column) -> Column:
    """Maps of adjustments: a preset replaces the recipe with its automatic values, explicit flags go on top; null maps count as absent."""
    base, top = F.coalesce(preset, auto, F.create_map().cast("map<string,double>")), F.coalesce(flags, F.create_map().cast("map<string,double>"))
    return F.map_zip_with(base, top, lambda _, a, b: F.coalesce(b, a))


def apply_recipes(px: DataFrame, recipes: DataFrame) -> DataFrame:
    """Each frame with its own recipe row (image_id, exposure, contrast, temperature; null leaves a stage out), rounded and clamped between stages.

    One join by frame; recipes are one short row each, so Spark broadcasts them while they are few.
    """
    met = px.join(recipes, "image_id")
    warm = (F.coalesce("temperature", F.lit(6500.0)) - 6500.0) / 5500.0
    gain = {"r": 1 - 0.35 * warm, "g": F.lit(1.0), "b": 1 + 0.35 * warm}
    out = met.withColumns({c: F.when(F.col("temperature").isNull(), F.col(c)).otherwise(to_byte(F.col(c) * gain[c])) for c in "rgb"})
    out = out.withColumns({c: F.when(F.col("exposure").isNull(), F.col(c)).otherwise(to_byte(F.col(c) * F.pow(F.lit(2.0), F.col("exposure")))) for c in "rgb"})
    out = out.withColumns({c: F.when(F.col("contrast").isNull(), F.col(c)).otherwise(to_byte((F.col(c) - 128) * (1 + F.col("contrast")) + 128)) for c in "rgb"})
    return out.select("image_id", "x", "y", "r", "g", "b")


def upserted(recipes: DataFrame, edits: DataFrame) -> DataFrame:
    """recipes (copy, adjustments) with edits (copy, key, value, ord) on top: later edits win, missing copies are made."""
    latest = edits.groupBy("copy", "key").agg(F.max_by("value", "ord").alias("value"))
    new = latest.groupBy("copy").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("edits"))  # one entry a key
    none = F.create_map().cast("map<string,double>")
    both = recipes.join(new, "copy", "full")
    return both.select("copy", F.map_zip_with(F.coalesce("adjustments", none), F.coalesce("edits", none), lambda _, a, b: F.coalesce(b, a)).alias("adjustments"), F.col("adjustments").isNull().alias("created"))
