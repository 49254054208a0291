"""Image files: folder scans, decoding to the pixel relation, PNG and JPEG files from it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import SCANNED, extension
from .files import contents, listed, tasks
from .jpeg import jpeg

SIDECAR = ".lumen.json"
#: Pixels of a batch.
ROWS = 1 << 16


def scanned_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modificationTime of all image files below a folder; contents are not read."""
    return listed(spark, folder).where(extension(F.col("path")).isin(*SCANNED))


def scanned_sidecars(spark: SparkSession, folder: str, suffix: str = SIDECAR) -> DataFrame:
    """path and text of all sidecar files below a folder."""
    return contents(listed(spark, folder).where(F.col("path").endswith(suffix)), folder).select("path", F.col("content").cast("string").alias("text"))


def image_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The pixel relation of all files that Spark's image source decodes; image_id is the path. Files that cannot be decoded give no rows.

    Its bytes come as blue, green, red (and alpha), or one grey value.
    """
    image = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder).select("image.*").where("height > 0 and width > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # small files share batches
        for batch in batches:
            for i in range(batch.num_rows):
                name, w, h, n = (batch[c][i].as_py() for c in ("origin", "width", "height", "nChannels"))
                samples = np.frombuffer(batch["data"][i].as_buffer(), dtype=np.uint8).reshape(h * w, n)
                planes = [samples[:, 0]] * 3 if n == 1 else [samples[:, 2], samples[:, 1], samples[:, 0]]
                planes.append(samples[:, 3] if n == 4 else np.full(h * w, 255))
                for at in range(0, h * w, ROWS):
                    place = np.arange(at, min(at + ROWS, h * w))
                    columns = [pa.array((place % w).astype(np.int32)), pa.array((place // w).astype(np.int32)), *(pa.array(p[place].astype(np.int32)) for p in planes)]
                    held.append(pa.RecordBatch.from_arrays([pa.array([name] * len(place)), *columns], ["image_id", "x", "y", "r", "g", "b", "a"]))
                    size += len(place)
                    if size >= ROWS:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    # Spark reads a few dozen small files a task
    return image.select("origin", "width", "height", "nChannels", "data").coalesce(tasks(spark)).mapInArrow(run, "image_id string, x int, y int, r int, g int, b int, a int")


def png(width: int, height: int, samples: np.ndarray) -> bytes:
    """An RGBA or RGB file from (height, width, channels) bytes."""
    lines = np.zeros((height, 1 + width * samples.shape[2]), dtype=np.uint8)
    lines[:, 1:] = samples.reshape(height, -1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if samples.shape[2] == 4 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def frame_arrays(px: DataFrame, names: list[str], made: Callable[[int, int, np.ndarray], bytes], column: str) -> DataFrame:
    """image_id, width, height and ``column``: a file of every frame. A frame meets in one task, as its file is one value."""

    def encode(t: pa.Table) -> pa.Table:
        x, y = t["x"].to_numpy(), t["y"].to_numpy()
        w, h = int(x.max()) + 1, int(y.max()) + 1
        samples = np.zeros((h, w, len(names)), dtype=np.uint8)
        for k, c in enumerate(names):
            samples[y, x, k] = t[c].to_numpy()
        return pa.table({"image_id": t["image_id"].slice(0, 1), "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32()), column: pa.array([made(w, h, samples)], pa.binary())})

    kind = px.schema["image_id"].dataType.simpleString()
    return px.select("image_id", "x", "y", *names).repartition(tasks(px.sparkSession), "image_id").groupBy("image_id").applyInArrow(encode, f"image_id {kind}, width int, height int, {column} binary")


def encoded(px: DataFrame, alpha: bool = True) -> DataFrame:
    """image_id, width, height and png of every frame."""
    return frame_arrays(px, ["r", "g", "b", "a"][: 4 if alpha else 3], png, "png")


def encoded_jpeg(px: DataFrame, quality: int = 90) -> DataFrame:
    """image_id, width, height and jpeg of every frame; alpha goes."""
    return frame_arrays(px, ["r", "g", "b"], lambda w, h, samples: jpeg(samples, quality), "jpeg")


def promoted(value: Column, bits: int) -> Column:
    """A decoder's 16-bit sample as 8 bits; 8-bit samples stay."""
    return F.shiftright(value, 8) if bits == 16 else value
