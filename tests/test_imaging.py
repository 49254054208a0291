"""All imaging queries against their SQL, golden frames, and a stream."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from framelake.operators import catalog, geometry, mask_graph, masks, recipes, tone
from framelake.plans.catalogue import ORACLE, QUERIES
from framelake.sources import images
from framelake.streaming.latest import run_available

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(names, data):
    clean = lambda v: None if v is None or v != v else round(v, 5) if isinstance(v, float) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(str([clean(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    sql = con.execute(ORACLE[name])
    names = [c[0] for c in sql.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, sql.fetchall())


def test_golden_gradient_frame(spark):
    px = spark.range(64).select(F.lit("g").alias("image_id"), (F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"), *[F.col("id").alias(c) for c in "rgb"])
    t = tone.analyze_tone(px)
    r = t.first()
    assert math.isclose(r.mean, 31.5 / 255, abs_tol=1e-9) and math.isclose(r.p99, 62.37 / 255, abs_tol=1e-9)
    a = tone.auto_tone(t).first()
    assert math.isclose(a.exposure, math.log2(255 / 63), abs_tol=0.01) and a.contrast == 1.0


def test_mask_goldens(spark):
    plane = lambda *v: spark.createDataFrame([("i", x, 0, n) for x, n in enumerate(v)], "image_id string, x int, y int, v int")
    a, b = plane(0, 32768), plane(65535, 16384)
    values = lambda d: [r.v for r in d.orderBy("x").collect()]
    assert values(masks.combined([a, b], "union")) == [65535, 32768]
    assert values(masks.combined([a, b], "intersect")) == [0, 16384]
    assert values(masks.subtracted(a, b)) == [0, 24576]
    assert values(masks.inverted(a)) == [65535, 32767]


def test_safe_paths(spark):
    d = spark.createDataFrame([("a/b.png",), ("/a",), ("a/../b",), ("a\\b",), ("a//b",), ("c:x",)], "p string")
    assert [r[0] for r in d.select(catalog.safe_path(F.col("p"))).collect()] == [True, False, False, False, False, False]


def test_stream_keeps_the_newest(spark, tmp_path):
    e = spark.read.parquet(f"{DIR}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    got = run_available(spark, str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out"))
    assert got.count() == e.select("user_id").distinct().count()
    assert {r.user_id: r.event_id for r in got.collect()} == {r[0]: r[1] for r in e.groupBy("user_id").agg(F.max("event_id")).collect()}


def test_closure_of_chains_and_diamonds(spark):
    pairs = lambda edges: {(r.src, r.dst) for r in mask_graph.reached(spark.createDataFrame(edges, "src string, dst string")).collect()}
    chain = [(f"{i:02d}", f"{i + 1:02d}") for i in range(40)]
    assert pairs(chain) == {(f"{i:02d}", f"{j:02d}") for i in range(41) for j in range(i + 1, 41)}
    diamonds = [e for i in range(12) for e in ((f"a{i}", f"b{i}"), (f"a{i}", f"c{i}"), (f"b{i}", f"a{i + 1}"), (f"c{i}", f"a{i + 1}"))]
    assert len(pairs(diamonds)) == sum(3 * (12 - i) for i in range(12)) + 2 * sum(1 + 3 * (11 - i) for i in range(12))


def test_halves_round_away_from_zero(spark):
    plane = spark.createDataFrame([("i", x, y, v) for y, row in enumerate([[0, 1], [0, 1]]) for x, v in enumerate(row)], "image_id string, x int, y int, v int")
    assert [r.v for r in geometry.resample(plane, 2, 2, 1, 1).collect()] == [1]
    assert geometry.downscaled_size(1000, 333, 500) == (500, 167) and geometry.rotated_size(10, 4, 90.0) == (4, 10)


def test_mask_graph_refuses_what_is_wrong(spark):
    plane = spark.createDataFrame([("i", 0, 0, 7)], "image_id string, x int, y int, v int")
    nodes = {"s": ("source", []), "a": ("invert", ["b"]), "b": ("invert", ["a"]), "c": ("union", ["s"]), "d": ("invert", ["gone"])}
    for node, words in (("a", "cycle"), ("c", "operands"), ("d", "missing")):
        with pytest.raises(ValueError, match=words):
            mask_graph.evaluated(nodes, {"s": plane}, node)
    with pytest.raises(ValueError, match="needs"):
        mask_graph.prompted(plane, 1, 1)


def test_quantiles_of_few_values(spark):
    px = spark.createDataFrame([("a", i, 0, v, v, v) for i, v in enumerate([0, 10, 10, 200])] + [("b", 0, 0, 5, 5, 5)], "image_id string, x int, y int, r int, g int, b int")
    got = {r.image_id: r for r in tone.analyze_tone(px).collect()}
    assert math.isclose(got["a"].median, 10 / 255) and math.isclose(got["a"].p99, (10 + 0.97 * 190) / 255) and math.isclose(got["a"].p01, 0.3 / 255) and math.isclose(got["b"].p99, 5 / 255)


def test_later_edits_win_and_missing_copies_are_made(spark):
    own = spark.createDataFrame([("a", {"exposure": 1.0})], "copy string, adjustments map<string,double>")
    edits = spark.createDataFrame([("a", "exposure", 2.0, 1), ("a", "exposure", 3.0, 2), ("b", "tint", 0.5, 1)], "copy string, key string, value double, ord int")
    assert {(r.copy, tuple(r.adjustments.items()), r.created) for r in recipes.upserted(own, edits).collect()} == {("a", (("exposure", 3.0),), False), ("b", (("tint", 0.5),), True)}


def test_image_files_round_trip(spark, tmp_path):
    """Frames to PNG files and back, beside files that are no images."""
    px = spark.createDataFrame([(i, x, y, 10 * i + x, 20 + y, 30, 255 if (x + y) % 2 else 9) for i in (1, 2) for x in range(3) for y in range(2)], "image_id int, x int, y int, r int, g int, b int, a int")
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    for r in images.encoded(px).collect():
        assert (r.width, r.height) == (3, 2)
        (folder / f"{r.image_id}.PNG").write_bytes(r.png)
    (folder / "notes.txt").write_text("no image")
    (folder / "broken.png").write_bytes(b"no image either")
    (folder / "1.lumen.json").write_text('{"version": 2}')
    got = images.image_frames(spark, str(tmp_path / "in")).withColumn("image_id", F.regexp_extract("image_id", r"(\d)\.PNG$", 1).cast("int"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, px.collect()))
    assert sorted(r.path[-6:] for r in images.scanned_images(spark, str(tmp_path / "in")).collect()) == ["/1.PNG", "/2.PNG", "en.png"]
    assert [r.text for r in images.scanned_sidecars(spark, str(tmp_path / "in")).collect()] == ['{"version": 2}']
