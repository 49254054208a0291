"""Queries through files: frames of the carrier tables are written, scanned and decoded; batches run twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..sources import files, images
from ..sources.frames import carrier_frames, table
from ..sources.shared import shared_folder
from .queries import PX, register

#: Consecutive ids whose files share a folder, so that no folder grows with the table.
FILES = 4000


def file_name(path: Column, ending: str) -> Column:
    return F.regexp_extract(path, rf"(\d+){ending}$", 1).cast("long")


def png_folder(spark: SparkSession, d: str) -> str:
    folder = shared_folder(spark)
    outputs = images.encoded(carrier_frames(spark, d)).select(F.concat(F.lit("f"), F.col("image_id") % 7, F.lit("/"), F.floor(F.col("image_id") / FILES), F.lit("/"), F.col("image_id"), F.lit(".png")).alias("name"), F.col("png").alias("content"))
    files.files_written(outputs, folder).write.format("noop").mode("overwrite").save()
    return folder


@register(f"{PX} SELECT image_id, x, y, r, g, b, a FROM px")
def png_files(spark: SparkSession, d: str) -> DataFrame:
    """Frames to files in folders and back."""
    px = images.image_frames(spark, png_folder(spark, d))
    return px.withColumn("image_id", file_name(F.col("image_id"), "[.]png"))


@register("SELECT vec_id AS image_id, 'png' AS extension, true AS has_bytes FROM embeddings")
def image_scan(spark: SparkSession, d: str) -> DataFrame:
    """The files of a folder tree, contents unread."""
    found = images.scanned_images(spark, png_folder(spark, d))
    return found.select(file_name(F.col("path"), "[.]png").alias("image_id"), F.lower(F.element_at(F.split("path", "[.]"), -1)).alias("extension"), (F.col("length") > 0).alias("has_bytes"))


@register("SELECT doc_id, 'rating ' || doc_id % 6 AS text FROM documents")
def sidecar_scan(spark: SparkSession, d: str) -> DataFrame:
    """Sidecar files written beside others and scanned whole."""
    folder = shared_folder(spark)
    docs = table(spark, d, "documents").select(F.concat(F.col("doc_id") % 5, F.lit("/"), F.floor(F.col("doc_id") / FILES), F.lit("/"), F.col("doc_id")).alias("stem"), F.concat(F.lit("rating "), F.col("doc_id") % 6).alias("text"))
    outputs = docs.select(F.concat("stem", F.lit(images.SIDECAR)).alias("name"), F.encode("text", "utf-8").alias("content")).union(docs.select(F.concat("stem", F.lit(".txt")), F.encode(F.lit("other"), "utf-8")))
    files.files_written(outputs, folder).write.format("noop").mode("overwrite").save()
    return images.scanned_sidecars(spark, folder).select(file_name(F.col("path"), images.SIDECAR.replace(".", "[.]")).alias("doc_id"), "text")


@register(f"{PX} SELECT image_id, CAST(count(*) AS BIGINT) AS pixels, true AS near FROM px GROUP BY image_id")
def jpeg_files(spark: SparkSession, d: str) -> DataFrame:
    """Frames to JPEG files and back: the mean difference of a frame's samples stays under six of 255 at the highest quality."""
    px, folder = carrier_frames(spark, d), shared_folder(spark)
    outputs = images.encoded_jpeg(px, 100).select(F.concat(F.floor(F.col("image_id") / FILES), F.lit("/"), F.col("image_id"), F.lit(".jpg")).alias("name"), F.col("jpeg").alias("content"))
    files.files_written(outputs, folder).write.format("noop").mode("overwrite").save()
    back = images.image_frames(spark, folder).select(file_name(F.col("image_id"), "[.]jpg").alias("image_id"), "x", "y", *[F.col(c).alias(f"{c}1") for c in "rgb"])
    met = px.join(back, ["image_id", "x", "y"])
    apart = sum((F.abs(F.col(c) - F.col(f"{c}1")) for c in "rgb"), F.lit(0))
    return met.groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), (F.avg(apart) / 3 < 6).alias("near"))


@register("SELECT doc_id, CAST((n_chars * 257 % 65536) // 256 AS BIGINT) AS eight, n_chars % 256 AS same FROM documents")
def sample_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Decoded samples of 16 bits as 8 bits; those of 8 bits stay."""
    rows = table(spark, d, "documents")
    return rows.select("doc_id", images.promoted(F.col("n_chars") * 257 % 65536, 16).alias("eight"), images.promoted(F.col("n_chars") % 256, 8).alias("same"))


BATCH = "CASE WHEN vec_id % 10 = 0 THEN 'missing' WHEN vec_id % 11 = 0 THEN 'unsafe_name' ELSE 'done' END"


RUNS_SQL = f"r AS (SELECT vec_id AS image_id, 1 AS run, {BATCH} AS status FROM embeddings UNION ALL SELECT vec_id, 2, CASE WHEN vec_id % 10 = 0 THEN CASE WHEN vec_id % 11 = 0 THEN 'unsafe_name' ELSE 'done' END ELSE 'unsafe_name' END FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 11 = 0)"


def two_runs(spark: SparkSession, d: str) -> DataFrame:
    """Render, encode and write as one job, run twice: a tenth of the inputs cannot be read at first, some names are refused; the second run does only what is left."""
    folder, px = shared_folder(spark), carrier_frames(spark, d)
    name = F.concat(F.when(F.col("vec_id") % 11 == 0, "../").otherwise(""), F.col("vec_id"), F.lit(".png"))
    wanted = table(spark, d, "embeddings").select("vec_id", name.alias("name"))

    def render(readable: Column):
        def made(left: DataFrame) -> DataFrame:
            frames = px.join(left.where(readable).select(F.col("vec_id").alias("image_id")), "image_id")
            return images.encoded(color.toned(frames, color.Tone(exposure=0.5)), alpha=False).join(left.select(F.col("vec_id").alias("image_id"), "name"), "image_id").select("name", F.col("png").alias("content"))

        return made

    first = files.batch(spark, wanted, render(F.col("vec_id") % 10 != 0), folder)
    second = files.batch(spark, wanted, render(F.lit(True)), folder)
    return first.union(second)


@register(f"WITH {RUNS_SQL} SELECT * FROM r")
def batch_runs(spark: SparkSession, d: str) -> DataFrame:
    return two_runs(spark, d).select(F.regexp_extract("name", r"(\d+)[.]png$", 1).cast("long").alias("image_id"), F.col("run").cast("int").alias("run"), "status")


@register(f"WITH {RUNS_SQL} SELECT run, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status <> 'done') AS failed FROM r GROUP BY run")
def batch_report(spark: SparkSession, d: str) -> DataFrame:
    """What each run of the batch has done, from its commits."""
    return files.summary(two_runs(spark, d)).select(F.col("run").cast("int").alias("run"), "done", "failed")
