"""Media columns: content-addressed payloads in tar shards.

Texts become greyscale PNG images (8-bit samples, ``width`` pixels a line), so storing
is lossless and compressed. A member of a shard is named by the SHA-256 of its payload;
rows carry digest, shard, offset and length. The metadata columns width, height and bits are filled by
``image_headers``, which reads only the 33 bytes of signature and IHDR of each member; ``read_back`` reads the members themselves.

A task stores a payload once however many of its rows share it, and rows that
share a place are read and decoded once. Tasks do not share: a payload met by several is stored by each, under the
same name, so no payload is shuffled and no digest is a hot key. A retried task
writes a new shard; the index names only those of committed tasks.

Cases: a null text counts as empty and gives one line of spaces; repeated rows
share their payload within a task; texts of any length are stored whole; null ids are kept; an empty table gives an empty index;
extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, shared_dir, tidy

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, length and type of IHDR, its 13 bytes, its checksum.
HEADER_BYTES = 33
SHARD_BYTES = 128 << 20

INDEX = "id {id}, n_bytes long, digest string, shard string, offset long, length long"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, width: int) -> bytes:
    height = len(payload) // width
    lines = np.zeros((height, width + 1), dtype=np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(height, width)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample from the first bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, packed = HEADER_BYTES, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    return np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def described(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256).astype(np.float64)
    p, v = counts / counts.sum(), np.arange(256)
    mean = float(p @ v)
    nz = p[p > 0]
    return f"mean={mean:.4f};std={math.sqrt(max(0.0, float(p @ (v - mean) ** 2))):.4f};entropy={-float((nz * np.log2(nz)).sum()):.4f}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Shards:
    """Writes members one after the other, a new tar file every SHARD_BYTES."""

    def __init__(self, folder: str) -> None:
        self.folder, self.stream, self.name, self.at = folder, None, "", 0

    def add(self, digest: str, data: bytes) -> tuple[str, int]:
        if self.stream is None or self.at > SHARD_BYTES:
            self.close()
            system, path = opened(self.folder)
            system.create_dir(path, recursive=True)
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.stream = system.open_output_stream(f"{path}/{self.name}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.stream.write(head + data + bytes(-len(data) % 512))
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % 512
        return self.name, offset

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(bytes(1024))
            self.stream.close()
            self.stream = None


def store_media(rows: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 192) -> tuple[DataFrame, str]:
    """Store every text; the index (id, n_bytes, digest, shard, offset, length) and the shards' folder."""
    folder = f"{shared_dir(rows.sparkSession)}/shards"
    data = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, places = Shards(folder), {}
        try:
            for batch in batches:
                out = []
                for raw in batch["t"]:
                    raw = raw.as_py()
                    payload = raw + b" " * (max(width, -(-len(raw) // width) * width) - len(raw))
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in places:
                        image = to_png(payload, width)
                        places[digest] = (*shards.add(digest, image), len(image))
                    out.append((len(raw), digest, *places[digest]))
                cols = list(zip(*out)) or [[]] * 5
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            shards.close()

    return saved(data.mapInArrow(tidy(write), INDEX.format(id=data.schema["id"].dataType.simpleString()))), folder


def dealt(index: DataFrame) -> DataFrame:
    """``index`` dealt by shard and sorted by place, so that each member is read once."""
    n = max(1, index.select("shard").distinct().count())
    return index.repartition(n, "shard").sortWithinPartitions("shard", "offset")


def ranged(index: DataFrame, folder: str, made: Callable[[bytes], tuple], names: list[str], kinds: list[pa.DataType], most: int | None = None) -> DataFrame:
    """Rows of ``index`` (as ``dealt`` gives them) with the columns that ``made(bytes)`` gives for each member.

    ``most``: read so many bytes of a member at most.
    """
    sql = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    schema = T.StructType([*index.schema.fields, *(T.StructField(a, sql[b]) for a, b in zip(names, kinds))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = stream = place = value = None
        system, path = opened(folder)
        try:
            for batch in batches:
                out = []
                for shard, offset, length in zip(*(batch[c].to_pylist() for c in ("shard", "offset", "length"))):
                    if shard != name:
                        if stream is not None:
                            stream.close()
                        name, stream = shard, system.open_input_file(f"{path}/{shard}")
                    if (shard, offset) != place:
                        stream.seek(offset)
                        place, value = (shard, offset), made(stream.read(min(length, most or length)))
                    out.append(value)
                cols = list(zip(*out)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], [*batch.schema.names, *names])
        finally:
            if stream is not None:
                stream.close()

    return index.mapInArrow(tidy(read), schema)


def image_headers(index: DataFrame, folder: str) -> DataFrame:
    """Width, height and bits of every member, by reading its header's bytes only."""
    return ranged(index, folder, png_header, ["width", "height", "bits"], [pa.int64()] * 3, HEADER_BYTES)


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Payload digest, checksum of its last 16 bytes, digest of the stored form and features of the samples, from the stored bytes."""

    def made(data: bytes) -> tuple:
        payload = from_png(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), described(payload)

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "samples"]
    return ranged(index, folder, made, names, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])


def media_columns(rows: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored payloads with their metadata columns and what reading them back gives; ``feature`` joins both."""
    index, folder = store_media(rows, id_col=id_col, text=text)
    found: Column = F.col("id").alias(id_col)
    feature = F.format_string("%dx%dx%d;%s", "width", "height", "bits", "samples").alias("feature")
    read = read_back(image_headers(dealt(index), folder), folder)
    return read.select(found, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature, "width", "height", "bits", "shard", "offset", "length")
