"""Frames and planes as tiles: one row for each square of a frame, a binary of little-endian samples for each channel.

    tiles(image_id, tx, ty, width, height, <channel> binary, ...)

Tile (tx, ty) starts at (tx * side, ty * side). Tiles come from the pixel relation by one exchange on (image_id, tx, ty) and a sort;
samples then lie in order and are cut, not gathered. Kernels that look at neighbours get them by a halo exchange: a tile
sends copies of its borders to the tiles beside it, a few rows for each tile instead of one for each pixel; no frame meets in one task.

A tile store is a folder of tiles with checksums in ``part=`` folders by image; within a part rows are sorted, so a lookup's
predicates leave out folders by name and row groups by their least and greatest keys.

Cases: a null id or coordinate raises, as does a tile with holes or doubled pixels; an empty relation gives no tiles; columns beside the channels go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 256
KEYS = ["image_id", "tx", "ty"]
#: Parts of a store, and rows of a row group's sort order.
PARTS = 64


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group of equal ``keys`` ends, of rows that come sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        cut = starts_of(t, keys)[-1] if t.num_rows else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def starts_of(t: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the groups of a sorted table."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        codes = t[k].combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        if codes.null_count:
            raise ValueError(f"null {k}")
        c = codes.indices.to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def cut_binary(samples: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Consecutive runs of a flat array as binaries; no copy of the samples."""
    offsets = (np.append(starts, len(samples)) * samples.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(samples))])


def tiles_of(px: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), side: int = SIDE, sample: str = "u1") -> DataFrame:
    """Tiles of a pixel relation; ``sample`` is numpy's name of a sample's type (u1, or <u2 for masks)."""
    kind = px.schema["image_id"].dataType.simpleString()
    own = [F.floor(F.col("x") / side).cast("int").alias("tx"), F.floor(F.col("y") / side).cast("int").alias("ty")]
    rows = px.select("image_id", *own, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(c).cast("int").alias(c) for c in channels])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, KEYS):
            starts = starts_of(t, KEYS)
            x, y = (t[c].to_numpy() for c in "xy")
            tx, ty = (t[c].to_numpy()[starts] for c in ("tx", "ty"))
            ends = np.append(starts[1:], len(x)) - 1
            width, height = np.maximum.reduceat(x, starts) - tx * side + 1, y[ends] - ty * side + 1
            size = ends - starts + 1
            at = np.arange(len(x)) - np.repeat(starts, size)
            w = np.repeat(width, size)
            if (size != width * height).any() or (x != np.repeat(tx * side, size) + at % w).any() or (y != np.repeat(ty * side, size) + at // w).any():
                raise ValueError("a frame has missing or doubled pixels")
            planes = [cut_binary(t[c].to_numpy().astype(sample), starts) for c in channels]
            ids = t["image_id"].combine_chunks().take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(tx), pa.array(ty), pa.array(width.astype(np.int32)), pa.array(height.astype(np.int32)), *planes], [*KEYS, "width", "height", *channels])

    planes = ", ".join(f"{c} binary" for c in channels)
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "y", "x").mapInArrow(run, f"image_id {kind}, tx int, ty int, width int, height int, {planes}")


def pixels_of(tiles: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), side: int = SIDE, sample: str = "u1") -> DataFrame:
    """The pixel relation of tiles; no exchange."""
    kind = tiles.schema["image_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, height = (batch[c].to_numpy().astype(np.int64) for c in ("width", "height"))
            size = width * height
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            x, y = (batch["tx"].to_numpy()[row] * side + at % width[row]).astype(np.int32), (batch["ty"].to_numpy()[row] * side + at // width[row]).astype(np.int32)
            planes = [pa.array(np.frombuffer(b"".join(batch[c].to_pylist()), dtype=sample).astype(np.int32)) for c in channels]
            yield pa.RecordBatch.from_arrays([batch["image_id"].take(pa.array(row)), pa.array(x), pa.array(y), *planes], ["image_id", "x", "y", *channels])

    return tiles.select(*KEYS, "width", "height", *channels).mapInArrow(run, f"image_id {kind}, x int, y int, " + ", ".join(f"{c} int" for c in channels))


def haloed(tiles: DataFrame, reach: int, channels: tuple[str, ...] = ("r", "g", "b"), side: int = SIDE, sample: str = "u1") -> DataFrame:
    """Tiles whose planes go ``reach`` samples beyond the tile; beyond the frame its border repeats.

    ``width`` and ``height`` stay the tile's own. A tile that fills its square may have neighbours and sends them its borders (whole tiles, if
    ``reach`` is longer than a side).
    """
    kind = tiles.schema["image_id"].dataType.simpleString()
    far = -(-reach // side)
    size = np.dtype(sample).itemsize
    names = [*KEYS, "dx", "dy", "left", "top", "width", "height", *channels]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each tile's piece for itself and for each neighbour, with the piece's place seen from the receiver's first sample."""
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                tx, ty, w, h = (batch[c][i].as_py() for c in ("tx", "ty", "width", "height"))
                planes = [np.frombuffer(batch[c][i].as_py(), dtype=sample).reshape(h, w) for c in channels]
                for dy in range(-far if ty else 0, (far if h == side else 0) + 1):
                    for dx in range(-far if tx else 0, (far if w == side else 0) + 1):
                        if tx + dx < 0 or ty + dy < 0:
                            continue
                        left, top = -dx * side, -dy * side  # of this tile, for the receiver
                        a, b = max(0, -reach - left), min(w, side + reach - left)
                        c, d = max(0, -reach - top), min(h, side + reach - top)
                        if a < b and c < d:
                            rows.append((i, tx + dx, ty + dy, dx, dy, left + a, top + c, b - a, d - c, [p[c:d, a:b].tobytes() for p in planes]))
            if not rows:
                continue
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch["image_id"].take(pa.array(columns[0])), *(pa.array(c, pa.int32()) for c in columns[1:9]), *(pa.array([r[9][k] for r in rows], pa.binary()) for k in range(len(channels)))], names)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, KEYS):
            starts = starts_of(t, KEYS)
            place = {c: t[c].to_numpy() for c in ("dx", "dy", "left", "top", "width", "height")}
            held = {c: t[c].to_pylist() for c in channels}
            centre, planes = [], [[] for _ in channels]
            for a, b in zip(starts, np.append(starts[1:], t.num_rows)):
                own = [i for i in range(a, b) if not place["dx"][i] and not place["dy"][i]]
                if not own:
                    continue  # no such tile: a border sent beyond the frame
                w, h = int(place["width"][own[0]]), int(place["height"][own[0]])
                centre.append(own[0])
                # how far the pieces reach on each side; what is missing there lies beyond the frame
                lo_x, lo_y = min(place["left"][a:b].min(), 0), min(place["top"][a:b].min(), 0)
                hi_x, hi_y = max((place["left"] + place["width"])[a:b].max(), w), max((place["top"] + place["height"])[a:b].max(), h)
                lo_x, lo_y, hi_x, hi_y = max(lo_x, -reach), max(lo_y, -reach), min(hi_x, w + reach), min(hi_y, h + reach)
                for k, c in enumerate(channels):
                    canvas = np.empty((hi_y - lo_y, hi_x - lo_x), dtype=sample)
                    for i in range(a, b):
                        x, y, pw, ph = (int(place[n][i]) for n in ("left", "top", "width", "height"))
                        piece = np.frombuffer(held[c][i], dtype=sample).reshape(ph, pw)
                        x1, y1 = min(x + pw, hi_x), min(y + ph, hi_y)
                        if x < x1 and y < y1:
                            canvas[y - lo_y : y1 - lo_y, x - lo_x : x1 - lo_x] = piece[: y1 - y, : x1 - x]
                    canvas = np.pad(canvas, ((reach + lo_y, h + reach - hi_y), (reach + lo_x, w + reach - hi_x)), mode="edge")
                    planes[k].append(canvas.tobytes())
            if centre:
                at = pa.array(centre)
                yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks().take(at) for c in (*KEYS, "width", "height")), *(pa.array(p, pa.binary()) for p in planes)], [*KEYS, "width", "height", *channels])

    assert size
    binaries = ", ".join(f"{c} binary" for c in channels)
    pieces = tiles.select(*KEYS, "width", "height", *channels).mapInArrow(sent, f"image_id {kind}, tx int, ty int, dx int, dy int, left int, top int, width int, height int, {binaries}")
    return pieces.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(met, f"image_id {kind}, tx int, ty int, width int, height int, {binaries}")


def stacks(batch: pa.RecordBatch, channels: tuple[str, ...], reach: int, sample: str = "u1") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and samples (rows, channels, height, width) of the tiles of each size in a batch of haloed tiles, about as many samples at once as one tile has."""
    width, height = batch["width"].to_numpy(), batch["height"].to_numpy()
    size = width.astype(np.int64) << 32 | height
    held = {c: batch[c] for c in channels}
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        w, h = int(width[rows[0]]) + 2 * reach, int(height[rows[0]]) + 2 * reach
        step = max(1, SIDE * SIDE // (w * h))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            planes = [np.frombuffer(b"".join(held[c].take(pa.array(some)).to_pylist()), dtype=sample).reshape(len(some), h, w) for c in channels]
            yield some, np.stack(planes, axis=1)


def kernel(tiles: DataFrame, reach: int, run: Callable[..., np.ndarray], channels: tuple[str, ...] = ("r", "g", "b"), side: int = SIDE, extra: tuple[str, ...] = ()) -> DataFrame:
    """``run`` on stacks of haloed tiles: (samples with halo as float64, extra columns' values) to (rows, channels, height, width) bytes.

    Tiles of one size go through numpy together, so small frames cost no call each.
    """
    kind = tiles.schema["image_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[None] * batch.num_rows for _ in channels]
            values = [batch[c].to_numpy(zero_copy_only=False) for c in extra]
            for rows, samples in stacks(batch, channels, reach):
                done = run(samples, *[v[rows] for v in values]).astype(np.uint8)
                for k in range(len(channels)):
                    for i, row in enumerate(rows):
                        out[k][row] = done[i, k].tobytes()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*KEYS, "width", "height")), *(pa.array(p, pa.binary()) for p in out)], [*KEYS, "width", "height", *channels])

    return tiles.select(*KEYS, "width", "height", *channels, *extra).mapInArrow(task, f"image_id {kind}, tx int, ty int, width int, height int, " + ", ".join(f"{c} binary" for c in channels))


def payload_digest(*planes: Column) -> Column:
    """The checksum of a record: SHA-256 of its planes one after the other."""
    return F.sha2(F.concat(*planes), 256)


def stored(tiles: DataFrame, folder: str, channels: tuple[str, ...] = ("r", "g", "b"), parts: int = PARTS) -> None:
    """Writes a tile store: checksums added, images dealt to ``part=`` folders by hash, rows of a file sorted by key."""
    part = F.pmod(F.xxhash64(F.col("image_id").cast("string")), F.lit(parts)).cast("int")
    rows = tiles.select(part.alias("part"), *KEYS, "width", "height", *channels, payload_digest(*[F.col(c) for c in channels]).alias("checksum"))
    # a hot image goes to many files of its part: the range is over the whole key
    rows.repartitionByRange("part", *KEYS).sortWithinPartitions("part", *KEYS).write.mode("overwrite").partitionBy("part").parquet(folder)


def checked(rows: DataFrame, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """``rows`` of a store with status: ok, checksum or dimensions."""
    samples = F.octet_length(channels[0])
    sized = (F.col("width") > 0) & (F.col("height") > 0) & (samples % (F.col("width") * F.col("height")) == 0)
    good = F.col("checksum") == payload_digest(*[F.col(c) for c in channels])
    return rows.withColumn("status", F.when(~good | good.isNull(), "checksum").when(~sized, "dimensions").otherwise("ok"))


def tile(spark: SparkSession, folder: str, image_id: int | str, tx: int, ty: int, channels: tuple[str, ...] = ("r", "g", "b"), parts: int = PARTS) -> DataFrame:
    """One tile of a store, verified: folders and row groups that cannot hold it are not read. No row: no such tile."""
    part = F.pmod(F.xxhash64(F.lit(image_id).cast("string")), F.lit(parts)).cast("int")
    wanted = spark.range(1).select(part).first()[0]
    rows = spark.read.parquet(folder).where((F.col("part") == wanted) & (F.col("image_id") == F.lit(image_id)) & (F.col("tx") == tx) & (F.col("ty") == ty))
    return checked(rows, channels).drop("part")


def looked_up(spark: SparkSession, folder: str, requests: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), parts: int = PARTS) -> DataFrame:
    """``requests`` (image_id, tx, ty, ...) with the tile asked for and status: ok, checksum, dimensions or missing. One join by key for any number of requests."""
    asked = requests.withColumn("part", F.pmod(F.xxhash64(F.col("image_id").cast("string")), F.lit(parts)).cast("int"))
    met = asked.join(checked(spark.read.parquet(folder), channels), ["part", *KEYS], "left").drop("part")
    return met.withColumn("status", F.coalesce("status", F.lit("missing")))


def scanned(spark: SparkSession, folder: str, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Every record of a store, verified."""
    return checked(spark.read.parquet(folder), channels).drop("part")
