"""A whole recipe against its kernels one after the other, and what an empty or wrong recipe does."""

import json

import pytest

from framelake.functions import color, develop
from framelake.operators import detail, geometry, neighbourhood, render
from framelake.sources.frames import carrier_frames

FULL = {
    "adjustments": {
        "wb_temperature": 5200, "exposure": 0.3, "contrast": -0.2, "shadows": 0.2, "vibrance": 0.2, "saturation": 0.1,
        "presence": {"texture": 0.5, "clarity": -0.4, "dehaze": 0.3}, "curves": {"master": [[0, 0], [0.4, 0.5], [1, 1]], "red": [{"input": 0, "output": 0}, {"input": 1, "output": 1}]}, "hsl": {"red": {"hue": 0.3, "saturation": -0.2, "luminance": 0.1}},
        "color_grading": {"shadows": {"hue_degrees": 220, "saturation": 0.3}, "balance": 0.2}, "noise_reduction": {"luminance": 0.6, "color": 0.5}, "sharpening": {"amount": 0.8, "radius": 1.2, "detail": 0.4, "masking": 0.5},
    },
    "effects": {"vignette": {"amount": 0.4, "midpoint": 0.3, "roundness": 0.1, "feather": 0.5}, "grain": {"amount": 0.4, "size": 0.2, "roughness": 0.5, "seed": 7}},
    "lens_correction": {"profile": "tele-light"}, "perspective": {"vertical": 0.1, "scale": 1.2}, "geometry": {"crop": [0.125, 0.25, 0.75, 0.5], "degrees": 90.0, "horizontal": True},
}


@pytest.fixture(scope="module")
def px(spark):
    return carrier_frames(spark, "/root/testdata/sf0.001").where("image_id < 40")


def values(df):
    return sorted(map(tuple, df.select("image_id", "x", "y", "r", "g", "b").collect()))


def test_whole_recipe_is_its_stages_in_order(px):
    out = color.toned(px.drop("a", "folder"), color.Tone(temperature=5200.0, exposure=0.3, contrast=-0.2, shadows=0.2))
    out = develop.dehaze(neighbourhood.dark_channel(detail.presence(out, 0.5, -0.4)), 0.3)
    out = develop.hue_bands(develop.curves(out, [(0.0, 0.0), (0.4, 0.5), (1.0, 1.0)], r=[(0.0, 0.0), (1.0, 1.0)]), red=(0.3, -0.2, 0.1))
    out = develop.color_grade(color.vibrance_saturation(out, 0.2, 0.1), (220, 0.3), (0, 0), (0, 0), 0.2)
    out = detail.sharpened(detail.denoised(out, 0.6, 0.5), 0.8, 1.2, 0.4, 0.5)
    out = develop.grain(color.vignette(out, 8, 8, 0.4, 0.3, 0.1, 0.5), 8, 8, 0.4, 0.2, 0.5, 7)
    out = geometry.transformed(out, 8, 8, geometry.Geometry((0.125, 0.25, 0.75, 0.5), 90.0, True), geometry.Lens("tele-light"), geometry.Perspective(vertical=0.1, scale=1.2))
    recipe = render.Recipe.from_json(json.dumps(FULL))
    got = values(render.rendered(px, recipe, 8, 8))
    assert got == values(out)
    w, h = render.rendered_size(recipe, 8, 8)
    assert len(got) == 40 * w * h and {r[1] for r in got} == set(range(w)) and {r[2] for r in got} == set(range(h))


def test_empty_recipe_changes_nothing(px):
    assert values(render.rendered(px, render.Recipe.from_json("{}"), 8, 8)) == values(px)
    assert values(render.rendered(px.limit(0), render.Recipe.from_json(json.dumps(FULL)), 8, 8)) == []


@pytest.mark.parametrize("adjustments", [{"glow": 1}, {"exposure": 11}, {"contrast": "much"}, {"exposure": float("nan")}, {"sharpening": {"amount": 9}}])
def test_wrong_recipes_raise(adjustments):
    with pytest.raises(ValueError, match="adjustment|invalid"):
        render.Recipe.from_json(json.dumps({"adjustments": adjustments}))
