"""Tiles: round trips, halos against whole frames, the store's lookups and what they read."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import detail
from framelake.sources import tiles

SIZES = {"a": (37, 21), "b": (8, 8), "c": (1, 40), "d": (64, 16), "e": (16, 16), "f": (33, 1)}


def frame(name):
    w, h = SIZES[name]
    return np.random.default_rng(ord(name)).integers(0, 256, (3, h, w))


@pytest.fixture(scope="module")
def px(spark):
    rows = []
    for name, (w, h) in SIZES.items():
        f = frame(name)
        rows += [(name, x, y, *map(int, f[:, y, x]), 255) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id string, x int, y int, r int, g int, b int, a int").repartition(7)


def values(df):
    return sorted(map(tuple, df.select("image_id", "x", "y", "r", "g", "b").collect()))


@pytest.mark.parametrize("side", [1, 16, 256])
def test_round_trip(px, side):
    cut = tiles.tiles_of(px, side=side)
    assert values(tiles.pixels_of(cut, side=side)) == values(px)
    if side == 16:
        assert {(r.tx, r.ty, r.width, r.height) for r in cut.where("image_id = 'a'").collect()} == {(0, 0, 16, 16), (1, 0, 16, 16), (2, 0, 5, 16), (0, 1, 16, 5), (1, 1, 16, 5), (2, 1, 5, 5)}


def test_round_trip_of_planes(px):
    plane = px.select("image_id", "x", "y", (F.col("r") * 257).alias("v"))
    back = tiles.pixels_of(tiles.tiles_of(plane, ("v",), 16, "<u2"), ("v",), 16, "<u2")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, plane.collect()))


def test_holes_and_doubles(px):
    for bad in (px.where("NOT (image_id = 'a' AND x = 3 AND y = 3)"), px.union(px.where("image_id = 'a' AND x = 3 AND y = 3"))):
        with pytest.raises(Exception, match="missing or doubled"):
            tiles.tiles_of(bad).collect()
    assert tiles.tiles_of(px.limit(0)).count() == 0


@pytest.mark.parametrize("side,reach", [(16, 3), (16, 16), (4, 9), (256, 5), (1, 2)])
def test_halo_is_the_frames_neighbourhood(px, side, reach):
    for r in tiles.haloed(tiles.tiles_of(px, side=side), reach, side=side).collect():
        whole = np.pad(frame(r.image_id), ((0, 0), (reach, reach), (reach, reach)), mode="edge")
        y, x = r.ty * side, r.tx * side
        want = whole[:, y : y + r.height + 2 * reach, x : x + r.width + 2 * reach]
        got = np.stack([np.frombuffer(r[c], dtype="u1").reshape(r.height + 2 * reach, r.width + 2 * reach) for c in "rgb"])
        assert (got == want).all(), (r.image_id, r.tx, r.ty)


def blurred(plane, weights):
    n = len(weights) // 2
    p = np.pad(plane, n, mode="edge")
    h, w = plane.shape
    across = sum(c * p[n : n + h, k : k + w] for k, c in enumerate(weights))
    down = np.pad(across, ((n, n), (0, 0)), mode="edge")
    return sum(c * down[k : k + h] for k, c in enumerate(weights))


@pytest.mark.parametrize("side,masking", [(16, 0.5), (256, 0.5), (16, 0.0), (4, 1.0)])
def test_sharpening_on_tiles_equals_whole_frames(px, side, masking):
    got = {tuple(r[:3]): tuple(r[3:]) for r in tiles.pixels_of(detail.sharpened_tiles(tiles.tiles_of(px, side=side), 0.8, 1.2, 0.4, masking, side=side), side=side).collect()}
    for name, (w, h) in SIZES.items():
        f = frame(name).astype(float)
        light = 0.2126 * f[0] + 0.7152 * f[1] + 0.0722 * f[2]
        p = np.pad(light, 1, mode="edge")
        edge = np.abs(p[1:-1, 2:] - p[1:-1, :-2]) + np.abs(p[2:, 1:-1] - p[:-2, 1:-1])
        edge = edge / edge.max() if edge.max() > 0 else edge * 0
        gone = 0.4 * (light - blurred(light, detail.gaussian(0.6))) + 0.6 * (light - blurred(light, detail.gaussian(1.2 * 1.5)))
        new = np.clip(light + 0.8 * ((1 - masking) + masking * edge) * gone, 0, 255)
        ratio = np.where(light > 1e-6, new / np.where(light > 1e-6, light, 1), 0)
        want = np.clip(np.floor(f * ratio + 0.5), 0, 255).astype(int)
        for y in range(h):
            for x in range(w):
                assert max(abs(a - b) for a, b in zip(got[name, x, y], want[:, y, x].tolist())) <= (0 if side != 4 else 1)


@pytest.mark.parametrize("side", [4, 16])
def test_denoising_on_tiles_equals_whole_frames(px, side):
    cut = lambda s: values(tiles.pixels_of(detail.denoised_tiles(tiles.tiles_of(px, side=s), 0.6, 0.5, side=s), side=s))
    assert cut(side) == cut(256)


@pytest.fixture(scope="module")
def store(px, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('store')}/tiles"
    tiles.stored(tiles.tiles_of(px, side=16), folder, parts=8)
    return folder


def test_lookup_reads_one_part(spark, store):
    found = tiles.tile(spark, store, "a", 2, 1, parts=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(image_id,a)" in plan
    row = found.collect()
    assert len(row) == 1 and row[0].status == "ok" and (row[0].width, row[0].height) == (5, 5)
    assert row[0].r == frame("a")[0, 16:21, 32:37].astype("u1").tobytes()
    metrics = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    files = spark.read.parquet(store).inputFiles()
    assert metrics.apply("numFiles").value() < len(files)
    assert metrics.apply("numPartitions").value() == 1
    assert tiles.tile(spark, store, "a", 3, 0, parts=8).count() == 0
    assert tiles.tile(spark, store, "zz", 0, 0, parts=8).count() == 0


def test_lookups_of_a_table(spark, store):
    asked = spark.createDataFrame([("a", 2, 1, 7), ("a", 2, 1, 8), ("a", 9, 9, 9), ("none", 0, 0, 10), (None, 0, 0, 11)], "image_id string, tx int, ty int, request int")
    got = {r.request: r.status for r in tiles.looked_up(spark, store, asked, parts=8).collect()}
    assert got == {7: "ok", 8: "ok", 9: "missing", 10: "missing", 11: "missing"}


def test_damaged_records_are_reported(spark, px, tmp_path):
    """A changed byte fails the checksum; a payload of another size fails its dimensions."""
    folder = f"file://{tmp_path}/tiles"
    cut = tiles.tiles_of(px, side=16)
    tiles.stored(cut, folder, parts=2)
    rows = spark.read.parquet(folder)
    short = F.substr("r", F.lit(1), F.lit(3))
    first = (F.col("image_id") == "a") & (F.col("tx") == 0) & (F.col("ty") == 0)
    second = (F.col("image_id") == "e")
    bad = rows.withColumn("r", F.when(first | second, short).otherwise(F.col("r")))
    bad = bad.withColumn("checksum", F.when(second, tiles.payload_digest(F.col("r"), F.col("g"), F.col("b"))).otherwise(F.col("checksum")))
    got = {(r.image_id, r.tx, r.ty): r.status for r in tiles.checked(bad).collect()}
    assert got[("a", 0, 0)] == "checksum" and got[("e", 0, 0)] == "dimensions"
    assert sorted(set(got.values())) == ["checksum", "dimensions", "ok"]
    assert all(r.status == "ok" for r in tiles.scanned(spark, folder).collect())
    assert tiles.scanned(spark, folder).count() == math.prod([1]) * cut.count()
