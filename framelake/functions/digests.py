"""Digests that Spark has no function for: BLAKE3 of values, and FNV-1a over the samples of a frame.

BLAKE3 is a tree of 1024-byte leaves; a task compresses a slice of many values' leaves at once as columns of
numpy words, then pairs the nodes of all values level by level. FNV-1a is a chain, so a frame's samples come sorted, the state goes from
Arrow batch to Arrow batch, and no array of a frame is made.

Cases: a null value has a null digest, an empty one the digest of no bytes; values of any length go through in slices of leaves; repeated
rows give equal digests; a frame of no pixels has no row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published function's initial words, message order and flags (fixed values).
INITIAL = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
FIRST, LAST, PARENT, ROOT = 1, 2, 4, 8
LEAF, BLOCK = 1024, 64
#: Leaves that are compressed together.
TOGETHER = 4096


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def mix(v: list[np.ndarray], a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    for word, s, t in ((x, 16, 12), (y, 8, 7)):
        v[a] = v[a] + v[b] + word
        v[d] = turned(v[d] ^ v[a], s)
        v[c] = v[c] + v[d]
        v[b] = turned(v[b] ^ v[c], t)


def compressed(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chain values (8, n) of blocks (16, n)."""
    n = chain.shape[1]
    v = [*chain, *(np.full(n, w, dtype=np.uint32) for w in INITIAL[:4]), counter.astype(np.uint32), (counter >> 32).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words)
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))):
            mix(v, a, b, c, d, m[2 * k], m[2 * k + 1])
        m = [m[i] for i in ORDER]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def leaves(data: np.ndarray, size: np.ndarray, number: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chain values (8, n) of leaves: ``data`` (n, 1024) padded with zeros, with their sizes and numbers; ``alone``: the value's only leaf."""
    blocks = np.maximum(-(-size // BLOCK), 1)
    words = data.reshape(len(data), 16, 16, 4).view("<u4")[..., 0]
    chain = np.repeat(INITIAL[:, None], len(data), axis=1)
    for k in range(int(blocks.max(initial=0))):
        at = np.flatnonzero(blocks > k)
        last = blocks[at] == k + 1
        flags = FIRST * (k == 0) + LAST * last + ROOT * (last & alone[at])
        chain[:, at] = compressed(chain[:, at], words[at, k].T, number[at], np.minimum(size[at] - BLOCK * k, BLOCK), flags)
    return chain


def blake3_digests(values: list[bytes]) -> list[bytes]:
    counts = np.array([max(-(-len(v) // LEAF), 1) for v in values], dtype=np.int64)
    owner = np.repeat(np.arange(len(values)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    chain = np.empty((8, len(owner)), dtype=np.uint32)
    for at in range(0, len(owner), TOGETHER):
        some = slice(at, at + TOGETHER)
        data, size = np.zeros((len(owner[some]), LEAF), dtype=np.uint8), np.zeros(len(owner[some]), dtype=np.int64)
        for i, (o, k) in enumerate(zip(owner[some], number[some])):
            part = values[o][LEAF * k : LEAF * (k + 1)]
            data[i, : len(part)], size[i] = np.frombuffer(part, dtype=np.uint8), len(part)
        chain[:, some] = leaves(data, size, number[some].astype(np.uint64), counts[owner[some]] == 1)
    while len(owner) > len(values):
        # neighbours pair up; a last one without a partner waits for the next level
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < counts[owner]))
        flags = np.where(counts[owner[left]] == 2, PARENT | ROOT, PARENT)
        words = np.concatenate([chain[:, left], chain[:, left + 1]])
        zero = np.zeros(len(left), dtype=np.uint64)
        chain[:, left] = compressed(np.repeat(INITIAL[:, None], len(left), axis=1), words, zero, np.full(len(left), BLOCK), flags)
        keep = place % 2 == 0
        chain, owner, counts = chain[:, keep], owner[keep], -(-counts // 2)
    return [c.astype("<u4").tobytes() for c in chain.T]


def blake3(value: Column) -> Column:
    """Lowercase hex BLAKE3 of a string's UTF-8 or a binary's bytes."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = pd.Series([None] * len(values), dtype=object)
        out[known] = [d.hex() for d in blake3_digests([bytes(v) for v in values[known]])]
        return out

    return digest(value.cast("binary"))


START, STEP, WORD = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def chained(state: int, data: bytes) -> int:
    for b in data:
        state = (state ^ b) * STEP & WORD
    return state


def sample_fingerprints(px: DataFrame, numbers: list[float], prefix: str = "tone-rgba8-rec709:") -> DataFrame:
    """(image_id, fingerprint): FNV-1a over ``numbers`` (64-bit floats), the frame's width and height (32 bits) and its RGBA samples row by row.

    Frames are dealt by id and sorted; small frames of a batch advance side by side, and a frame that ends in a later batch takes its state along.
    """
    kind = px.schema["image_id"].dataType.simpleString()
    head = chained(START, b"".join(struct.pack("<d", v) for v in numbers))
    sizes = px.groupBy("image_id").agg((F.max("x") + 1).cast("long").alias("width"), (F.max("y") + 1).cast("long").alias("height"))
    rows = px.select("image_id", "y", "x", "r", "g", "b", "a").join(sizes, "image_id").repartition("image_id").sortWithinPartitions("image_id", "y", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, state = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch["image_id"].to_pylist()
            raw = np.stack([batch[c].to_numpy() for c in "rgba"], axis=1).astype(np.uint8)
            starts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])]
            done: list[tuple] = []
            whole: list[tuple[int, int, int]] = []
            for a, b in zip(starts, [*starts[1:], len(ids)]):
                if ids[a] != image:
                    if image is not None:
                        done.append((image, state))
                    image = ids[a]
                    state = chained(head, struct.pack("<II", batch["width"][a].as_py(), batch["height"][a].as_py()))
                if b < len(ids):  # ends in this batch
                    whole.append((a, b, state))
                    image = None
                else:
                    state = chained(state, raw[a:b].tobytes())
            lanes = np.array([s for *_, s in whole], dtype=np.uint64)
            length = np.array([4 * (b - a) for a, b, _ in whole], dtype=np.int64)
            flat, first = raw.ravel(), np.array([4 * a for a, *_ in whole], dtype=np.int64)
            for k in range(int(length.max(initial=0))):
                at = np.flatnonzero(length > k)
                lanes[at] = (lanes[at] ^ flat[first[at] + k].astype(np.uint64)) * np.uint64(STEP)
            done += [(ids[a], int(s)) for (a, *_), s in zip(whole, lanes)]
            yield from frames(done)
        if image is not None:
            yield from frames([(image, state)])

    def frames(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done]), pa.array([f"{prefix}{s:016x}" for _, s in done])], ["image_id", "fingerprint"])

    return rows.mapInArrow(run, f"image_id {kind}, fingerprint string")
