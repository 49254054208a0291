"""Frames as a pixel relation (image_id, x, y, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte(v: Column) -> Column:
    """A vector component as a channel value 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + F.lit(0.55)) * F.lit(232.0)))).cast("int")


def carrier_frames(spark: SparkSession, sf_dir: str, repeat: int = 1) -> DataFrame:
    """8x8 frames from ``embeddings``: one row a pixel, folder = label; each frame ``repeat`` times, under ids of its own."""
    e = F.col("embedding")
    at = lambda k: F.get(e, (F.col("i") + k) % 64)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    if repeat > 1:
        rows = rows.repartition(4 * spark.sparkContext.defaultParallelism).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).withColumn("vec_id", F.col("vec_id") * repeat + F.col("copy"))
    rows = rows.select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return rows.select(
        F.col("vec_id").alias("image_id"), F.col("label").alias("folder"), (F.col("i") % SIDE).cast("int").alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"),
        byte(at(0)).alias("r"), byte(at(21)).alias("g"), byte(at(42)).alias("b"), F.lit(255).alias("a"),
    )


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """All (x, y) of a width x height raster."""
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
