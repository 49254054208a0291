"""Streams of edit events: stale results are dropped, the newest generation of each image stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_generation(events: DataFrame, key: str = "user_id", generation: str = "event_id") -> DataFrame:
    """The newest event of each key, on a static table or a stream (state: one row a key)."""
    return events.groupBy(key).agg(F.max(F.struct(generation, "event_type", "value")).alias("m")).select(key, f"m.{generation}", "m.event_type", "m.value")


def run_available(spark: SparkSession, folder: str, checkpoint: str, out: str) -> DataFrame:
    """Read what ``folder`` holds as a stream, once; each batch's newest state replaces the table at ``out``."""
    schema = spark.read.parquet(folder).schema
    stream = latest_generation(spark.readStream.schema(schema).parquet(folder))
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
