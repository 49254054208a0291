"""Editing sessions folded action by action: which image is loaded, and what actions on it give.

    actions(session, at, action, image)      action: load, edit or save; at orders a session's actions

``load`` makes its image the current one and forgets the edits; ``edit`` and ``save`` need the current image and count on it. Failures are
rows: no_image_loaded before the first load, unknown_image for any other id, unknown_action. A static table is folded by windows, a stream by
``transformWithState`` with one small value a session; both give equal rows if a session's actions arrive in order.

Cases: a null session is one session; a null image never is the current one; actions with equal ``at`` go by action, then image; an empty
table gives no rows; extra columns go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ORDER = ["at", "action", "image"]
RESULT = "session long, at long, action string, image long, outcome string, edits long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded(actions: DataFrame) -> DataFrame:
    """session, at, action, image, outcome and edits (on the current image, this action included) of every action."""
    rows = actions.select("session", "at", "action", "image")
    line = Window.partitionBy("session").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_load = F.coalesce(F.col("action") == "load", F.lit(False))
    rows = rows.withColumn("_n", F.count_if(is_load).over(line)).withColumn("_now", F.last(F.when(is_load, F.struct("image")), ignorenulls=True).over(line))
    fits = F.coalesce(F.col("image") == F.col("_now.image"), F.lit(False))
    outcome = F.when(is_load, "ok").when(~F.coalesce(F.col("action").isin("edit", "save"), F.lit(False)), "unknown_action").when(F.col("_n") == 0, "no_image_loaded").when(~fits, "unknown_image").otherwise("ok")
    rows = rows.withColumn("outcome", outcome)
    since = Window.partitionBy("session", "_n").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("edits", F.count_if((F.col("action") == "edit") & (F.col("outcome") == "ok")).over(since)).drop("_n", "_now")


class Fold(StatefulProcessor):
    """The same for a stream: the state is the current image and its number of edits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "image long, edits long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        actions = pd.concat(list(rows)).sort_values(ORDER, kind="stable", na_position="first")
        loaded = self.now.exists()
        image, edits = self.now.get() if loaded else (None, 0)
        out = []
        for at, action, of in zip(actions["at"], actions["action"], actions["image"]):
            of = None if pd.isna(of) else int(of)
            if action == "load":
                loaded, image, edits, outcome = True, of, 0, "ok"
            elif action not in ("edit", "save"):
                outcome = "unknown_action"
            elif not loaded:
                outcome = "no_image_loaded"
            elif of is None or of != image:
                outcome = "unknown_image"
            else:
                edits, outcome = edits + (action == "edit"), "ok"
            out.append((key[0], int(at), action, of, outcome, edits))
        if loaded:
            self.now.update((image, edits))
        made = pd.DataFrame(out, columns=["session", "at", "action", "image", "outcome", "edits"])
        yield made.astype({"session": "Int64", "image": "Int64"})

    def close(self) -> None:
        pass


def folded_stream(actions: DataFrame) -> DataFrame:
    rows = actions.select("session", "at", "action", "image")
    return rows.groupBy("session").transformWithStateInPandas(statefulProcessor=Fold(), outputStructType=RESULT, outputMode="Append", timeMode="None")


def run_available(spark: SparkSession, folder: str, checkpoint: str, out: str) -> DataFrame:
    """Folds the action files in ``folder`` that earlier runs have not seen, one file a batch in order of their times, and appends the rows to ``out``."""
    former = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema("session long, at long, action string, image long").option("maxFilesPerTrigger", 1).parquet(folder)
        folded_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if former:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", former)
    return spark.read.schema(RESULT).parquet(out)
