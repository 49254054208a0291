"""Plans of queries on many frames: no side of a join may pass the driver whole. Results where rounding decides."""

import pytest
from pyspark.sql import functions as F

from framelake.functions import develop
from framelake.operators import geometry, mask_levels, neighbourhood
from framelake.plans.catalogue import QUERIES
from framelake.plans.queries import RGB
from framelake.sources.frames import carrier_frames
from framelake.sources.shared import written

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


WARPS = {
    "resample": lambda px: geometry.resample(px.withColumn("v", F.col("g")), 8, 8, 11, 13),
    "rotate": lambda px: geometry.rotated(px, 8, 8, 30.0),
    "lens": lambda px: geometry.undistorted(px, 8, 8, geometry.Lens("wide-light")),
    "perspective": lambda px: geometry.warped(px, 8, 8, geometry.Perspective(vertical=0.2)),
    "nearest": lambda px: neighbourhood.nearest_resize(px, 8, 8, 5, 5),
}


@pytest.mark.parametrize("name", sorted(WARPS))
def test_warps_send_no_frames_through_the_driver(spark, name):
    """F3 to F7: frames' files are small, their pixels are not."""
    assert "Broadcast" not in plan(WARPS[name](carrier_frames(spark, DIR)))


def test_aberration_sends_no_frames_through_the_driver(spark):
    """nor does the join of a moved channel with the others."""
    assert "Broadcast" not in plan(geometry.aligned(carrier_frames(spark, DIR), 8, 8, geometry.Lens(ca_red=0.04, ca_blue=-0.03)))


def test_hue_bands_round_as_the_sums_of_their_triangles(spark):
    """F8: the shift of a hue between two moved centres, rounded at a half."""
    px = spark.createDataFrame([(2872, 2, 4, 105, 113, 139, 255), (9818, 4, 3, 135, 143, 169, 255)], "image_id long, x int, y int, r int, g int, b int, a int")
    out = develop.hue_bands(px, red=(0.5, 0.2, -0.1), green=(-0.4, 0.0, 0.0), blue=(0.0, -0.3, 0.1)).select(*RGB)
    assert [tuple(r) for r in out.orderBy("image_id").collect()] == [(2872, 2, 4, 142, 142, 142), (9818, 4, 3, 172, 172, 172)]


def test_mask_levels_send_no_tables_through_the_driver(spark, monkeypatch):
    """the rounds' joins, and those of layers and planes with the results."""
    plans = []
    monkeypatch.setattr(mask_levels, "written", lambda df: plans.append(plan(df)) or written(df))
    QUERIES["mask_dag_planes"](spark, DIR)
    plans.append(plan(QUERIES["mask_layers_warn"](spark, DIR)))
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]
