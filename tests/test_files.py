"""The JPEG encoder against Spark's decoder, files and batches that run again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.sources import files, images, jpeg


def pictures():
    r = np.random.default_rng(3)
    y, x = np.mgrid[0:40, 0:61]
    yield "waves", np.stack([128 + 100 * np.sin(x / 9 + y / 17), 128 + 90 * np.cos(y / 11), 2.0 * x + 3 * y], axis=-1).clip(0, 255).astype(np.uint8)
    yield "flat", np.full((8, 8, 3), 200, dtype=np.uint8)
    yield "dot", np.zeros((1, 1, 4), dtype=np.uint8)
    yield "line", r.integers(0, 256, (1, 100, 1), dtype=np.uint8).repeat(3, axis=2)
    yield "noise", r.integers(0, 256, (33, 17, 3), dtype=np.uint8)


def test_jpeg_is_read_back(spark, tmp_path):
    want = {}
    for name, samples in pictures():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.jpeg(samples, 100))
        want[name] = samples[..., :3].astype(int)
    back = spark.read.format("image").load(f"file://{tmp_path}").select("image.*").collect()
    assert len(back) == len(want)
    for row in back:
        name = row.origin.rpartition("/")[2][:-4]
        got = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, 3)[..., ::-1].astype(int)
        assert got.shape == want[name].shape and np.abs(got - want[name]).mean() < 3, name


def test_jpeg_quality_and_code_lengths():
    _, samples = next(pictures())
    assert len(jpeg.jpeg(samples, 10)) < len(jpeg.jpeg(samples, 50)) < len(jpeg.jpeg(samples, 95))
    skewed = {i: 2**i for i in range(30)}  # an unlimited code would need 30 bits
    lengths = jpeg.code_lengths(skewed)
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1
    assert sorted(jpeg.codes(lengths).values()) and len({v for v in jpeg.codes(lengths).values()}) == 30
    assert jpeg.code_lengths({7: 5}) == {7: 1}


def test_grey_and_alpha_files(spark, tmp_path):
    px = spark.createDataFrame([("a", x, y, x * 9, y * 7, 5, 255 - x) for x in range(9) for y in range(4)], "image_id string, x int, y int, r int, g int, b int, a int")
    files.files_written(images.encoded(px).select(F.lit("sub/a.png").alias("name"), F.col("png").alias("content")), f"file://{tmp_path}").collect()
    back = images.image_frames(spark, f"file://{tmp_path}").drop("image_id")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.drop("image_id").collect()))


def test_names_that_leave_the_folder(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", bytearray(b"1")), ("../up", bytearray(b"2")), ("/abs", bytearray(b"3")), (None, bytearray(b"4")), ("none", None), ("a/b.txt", bytearray(b"0"))], "name string, content binary")
    got = {r.name: r.status for r in files.files_written(rows, f"file://{tmp_path}/out").collect()}
    assert got == {"a/b.txt": "done", "../up": "unsafe_name", "/abs": "unsafe_name", None: "unsafe_name", "none": "no_content"}
    assert [(p.relative_to(tmp_path).as_posix(), p.read_bytes()) for p in tmp_path.rglob("*") if p.is_file()] == [("out/a/b.txt", b"0")]
    assert files.files_written(rows.limit(0), f"file://{tmp_path}/out").count() == 0


def test_a_batch_goes_on_where_it_stopped(spark, tmp_path):
    folder = f"file://{tmp_path}/batch"
    wanted = spark.createDataFrame([(f"{i}.txt", i) for i in range(6)], "name string, i int")
    made = []

    def render(readable):
        def outputs(left):
            made.append(sorted(r.i for r in left.collect()))
            return left.where(readable).select("name", F.encode(F.col("i").cast("string"), "utf-8").alias("content"))

        return outputs

    first = {r.name: r.status for r in files.batch(spark, wanted, render(F.col("i") < 4), folder).collect()}
    assert first == {f"{i}.txt": "done" if i < 4 else "missing" for i in range(6)}
    kept = (tmp_path / "batch" / "1.txt").stat().st_mtime_ns
    second = {r.name: (r.status, r.run) for r in files.batch(spark, wanted, render(F.lit(True)), folder).collect()}
    assert second == {"4.txt": ("done", 2), "5.txt": ("done", 2)} and made == [[0, 1, 2, 3, 4, 5], [4, 5]]
    assert files.batch(spark, wanted, render(F.lit(True)), folder).count() == 0 and made[-1] == []
    assert (tmp_path / "batch" / "1.txt").stat().st_mtime_ns == kept
    assert sorted((r.name, r.status) for r in files.commits(spark, folder).collect()) == [(f"{i}.txt", "done") for i in range(6)]


@pytest.mark.parametrize("quality", [1, 50, 100])
def test_steps(quality):
    assert all(1 <= v <= 255 for t in jpeg.steps(quality) for v in t)


def test_small_files_are_dealt_by_number(spark, tmp_path):
    """sizes in bytes put all small files into one task, and reading them took a task for every few dozen."""
    n = 600
    rows = spark.range(n).select(F.concat(F.col("id") % 3, F.lit("/"), F.col("id"), F.lit(images.SIDECAR)).alias("name"), F.encode(F.concat(F.lit("s"), F.col("id")), "utf-8").alias("content"))
    done = files.files_written(rows, f"file://{tmp_path}").withColumn("task", F.spark_partition_id()).collect()
    assert len(done) == n and len({r.task for r in done}) > 4
    (tmp_path / "0" / f"empty{images.SIDECAR}").write_bytes(b"")
    (tmp_path / "0" / f"_hidden{images.SIDECAR}").write_bytes(b"x")
    (tmp_path / ".own").mkdir()
    (tmp_path / ".own" / f"a{images.SIDECAR}").write_bytes(b"x")
    (tmp_path / "0" / "other.txt").write_bytes(b"x")
    (tmp_path / "0" / "deep" / "a b%20").mkdir(parents=True)
    (tmp_path / "0" / "deep" / "a b%20" / f"\u00fc{images.SIDECAR}").write_bytes(b"\xef\xbb\xbfx\r\n")
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        back = images.scanned_sidecars(spark, folder)
        got = {r.path[len(folder.rstrip("/")) :]: r.text for r in back.collect()}
        assert got == {f"/{i % 3}/{i}{images.SIDECAR}": f"s{i}" for i in range(n)} | {f"/0/deep/a b%20/\u00fc{images.SIDECAR}": "\ufeffx\r\n"}
        assert back.rdd.getNumPartitions() == files.tasks(spark)
    (tmp_path / "none").mkdir()
    assert images.scanned_sidecars(spark, f"{tmp_path}/none").count() == 0 and images.scanned_images(spark, str(tmp_path / "none")).count() == 0


def test_small_frames_are_dealt_by_number(spark, tmp_path):
    """F16: frames of a few pixels were encoded by one task, and their files read by a task for every few dozen."""
    n = 700
    px = spark.range(n).select(F.col("id").alias("image_id"), F.explode(F.expr("sequence(0, 5)")).alias("i")).selectExpr("image_id", "i % 3 AS x", "i div 3 AS y", "CAST(image_id % 256 AS int) AS r", "i AS g", "CAST(image_id div 256 AS int) AS b", "255 AS a")
    done = images.encoded(px).withColumn("task", F.spark_partition_id())
    made = done.collect()
    assert len(made) == n and len({r.task for r in made}) > 4
    files.files_written(done.select(F.concat("image_id", F.lit(".png")).alias("name"), F.col("png").alias("content")), f"file://{tmp_path}").collect()
    back = images.image_frames(spark, f"file://{tmp_path}")
    assert back.rdd.getNumPartitions() <= files.tasks(spark)
    back = back.withColumn("image_id", F.regexp_extract("image_id", r"(\d+)[.]png$", 1).cast("long"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.collect()))
