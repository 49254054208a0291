"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder as shared_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: bytes.translate table that lower-cases A-Z; in UTF-8 it leaves every other character alone.
LOWER_BYTES = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lets Spark send texts to Python in batches of 8 MB, unless the session has a bound of its own (Spark's is 64 MB, several times over in each task)."""
    if spark.conf.get(BATCH_BYTES, str(64 << 20)).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_BYTES, str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Batches of more bytes reach a task's function in slices of about so many.
SLICE = 4 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: mallopt's names for the number of arenas and for the size from which blocks are given back at once.
ARENAS, AT_ONCE = -8, -3


@lru_cache(maxsize=1)
def thrifty(at_once: int) -> ctypes.CDLL:
    """In a worker: Arrow takes memory from the system's allocator, which keeps one arena and gives blocks of ``at_once`` bytes and more back as they are freed."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # glibc only
        libc.mallopt(ARENAS, 1)
        libc.mallopt(AT_ONCE, at_once)
        pa.set_memory_pool(pa.system_memory_pool())
    return libc


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], at_once: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow on slices of bounded size, giving freed memory back to the system at a task's end: Python workers serve many tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = thrifty(at_once)
        yield from run(slices(batches))
        gc.collect()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return task


def words_of(raw: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8, A-Z lower-cased: what bytes.split() takes for white space is just these."""
    return raw.translate(LOWER_BYTES).split()


SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWERED = np.frombuffer(LOWER_BYTES, dtype=np.uint8)


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words (as ``words_of`` gives them; unchanged unless ``lower``) of an array of texts in UTF-8 without nulls, and how many each text has."""
    places = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[places[0] : places[-1]]
    places = places - places[0]
    inside = ~SPACES[raw]
    opening = np.zeros(len(raw) + 1, dtype=bool)  # a text's first byte, or one after a space
    opening[places] = True
    opening[1:] |= ~inside
    starts = np.flatnonzero(inside & opening[:-1])
    ends = np.flatnonzero(inside & (opening[1:] | np.append(~inside[1:], True))) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWERED[raw[inside]] if lower else raw[inside])])
    return words, np.diff(np.searchsorted(starts, places))


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (or over what ``path`` holds) and read it back.

    Cuts the lineage: lost executors cost no recomputation of what lies before,
    and jobs that use the result more than once read it instead.
    """
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc32_mod(column: str, divisor: int) -> Column:
    """crc32 of the column's value as text, modulo ``divisor`` (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few rows as a JVM-side relation (no Python RDD behind it)."""
    items = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))
