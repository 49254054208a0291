"""Files from tables, file lists and contents as tables, and batches that can be run again: what is written is recorded, a second run does only what is missing or has failed.

    outputs(name, content)           one file each; name is a relative path below the folder

A task writes a file under a name of its own and moves it into place, so a task that is repeated leaves the same file. The commit table is
a folder of Parquet beside the outputs; a run adds its rows when its files are there.

A tree of folders is listed by tasks, level by level, a folder at a time, and read by tasks that get equal numbers of files; no list passes the driver. One
folder's names are listed by one task, so writers of many files deal them over folders.

Cases: a null or unsafe name fails (its row says so) and writes nothing; a null content fails; of repeated names one is written (the smallest
content); an empty table writes nothing; extra columns go. As in Spark's readers, lists leave out empty files and names that begin with a dot or underscore.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import safe_path
from .shared import written

LISTED = "path string, length long, modificationTime timestamp, is_folder boolean"
#: Rows of a batch of a list, and bytes of contents after which a batch ends.
ROWS, BYTES = 1 << 14, 1 << 24
STATUS = "name string, status string, bytes long, sha256 string"


def tasks(spark: SparkSession) -> int:
    """Into how many tasks files are dealt: by number, as Spark's own sizes of tasks count bytes and put a hundred thousand small files into one."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def files_written(outputs: DataFrame, folder: str) -> DataFrame:
    """(name, status, bytes, sha256) of the files written below ``folder`` (a URI): done, unsafe_name, no_content or the error. Lazy: each action writes."""
    rows = outputs.repartition(tasks(outputs.sparkSession), "name").groupBy("name").agg(F.min("content").alias("content"))
    rows = rows.withColumn("safe", F.coalesce(safe_path(F.col("name")), F.lit(False))).withColumn("sha256", F.sha2("content", 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        ready, attempt = set(), uuid.uuid4().hex
        for batch in batches:
            states = []
            for name, content, safe in zip(batch["name"].to_pylist(), batch["content"], batch["safe"].to_pylist()):
                if not safe or not content.is_valid:
                    states.append("no_content" if safe else "unsafe_name")
                    continue
                path = f"{root}/{name}"
                try:
                    parent = path.rpartition("/")[0]
                    if parent not in ready:
                        store.create_dir(parent, recursive=True)
                        ready.add(parent)
                    own = f"{path}.{attempt}.part"
                    with store.open_output_stream(own) as out:
                        out.write(content.as_buffer())
                    store.move(own, path)
                    states.append("done")
                except OSError as e:
                    states.append(f"error: {e}"[:200])
            sizes = [len(c.as_buffer()) if c.is_valid else None for c in batch["content"]]
            yield pa.RecordBatch.from_arrays([batch["name"], pa.array(states), pa.array(sizes, pa.int64()), batch["sha256"]], ["name", "status", "bytes", "sha256"])

    return rows.mapInArrow(run, STATUS)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of all files below ``folder`` (a path or URI, which paths begin with)."""
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch["path"].to_pylist():
                found = store.get_file_info(fs.FileSelector(base + path[len(root) :]))
                found = [f for f in found if f.base_name[0] != "." and (f.base_name[0] != "_" or "=" in f.base_name) and (f.type == fs.FileType.Directory or f.size)]
                for at in range(0, len(found), ROWS):
                    part = found[at : at + ROWS]
                    columns = [pa.array([f"{path}/{f.base_name}" for f in part], pa.string()), pa.array([f.size for f in part], pa.int64()), pa.array([f.mtime for f in part], pa.timestamp("us", "UTC")), pa.array([f.type == fs.FileType.Directory for f in part])]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "length", "modificationTime", "is_folder"])

    level, levels = spark.createDataFrame([(root,)], "path string"), []
    while not level.isEmpty():
        levels.append(written(level.repartition(tasks(spark)).mapInArrow(run, LISTED)))
        level = levels[-1].where("is_folder").select("path")
    return reduce(DataFrame.union, levels).where("NOT is_folder").drop("is_folder")


def contents(files: DataFrame, folder: str) -> DataFrame:
    """(path, content) of listed files below ``folder``."""
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        made = lambda paths, data: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(data, pa.binary())], ["path", "content"])
        for batch in batches:
            paths, data, size = [], [], 0
            for path in batch["path"].to_pylist():
                with store.open_input_file(base + path[len(root) :]) as file:
                    data.append(file.read())
                paths.append(path)
                size += len(data[-1])
                if size >= BYTES:
                    yield made(paths, data)
                    paths, data, size = [], [], 0
            yield made(paths, data)

    return files.select("path").repartition(tasks(files.sparkSession)).mapInArrow(run, "path string, content binary")


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """The commit table: the last status of every name."""
    try:
        rows = spark.read.parquet(f"{folder}/_commits")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STATUS + ", run long")
    return rows.groupBy("name").agg(F.max_by(F.struct("status", "bytes", "sha256", "run"), "run").alias("c")).select("name", "c.*")


def batch(spark: SparkSession, wanted: DataFrame, made: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Runs ``made`` (wanted rows to outputs) for the rows of ``wanted`` whose name has no committed file, writes and records the files; returns this run's rows.

    A name without an output (its input could not be read or rendered) is recorded as missing and tried again by the next run.
    """
    before = commits(spark, folder)
    run = (before.agg(F.max("run")).first()[0] or 0) + 1
    left = wanted.join(before.where("status = 'done'").select("name"), "name", "left_anti")
    done = files_written(made(left), folder)
    rows = left.select("name").distinct().join(done, "name", "left").withColumns({"status": F.coalesce("status", F.lit("missing")), "run": F.lit(run).cast("long")})
    rows.write.mode("append").parquet(f"{folder}/_commits")
    return spark.read.schema(rows.schema).parquet(f"{folder}/_commits").where(F.col("run") == run)


def summary(rows: DataFrame) -> DataFrame:
    """(run, done, failed, bytes) of commit rows."""
    done = F.col("status") == "done"
    return rows.groupBy("run").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("failed"), F.coalesce(F.sum(F.when(done, F.col("bytes"))), F.lit(0)).alias("bytes"))
