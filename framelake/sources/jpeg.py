"""A baseline JPEG encoder in numpy: colour transform, 8 x 8 cosine transform, quantisation and Huffman codes fitted to the picture.

Channels are not subsampled. Runs, sizes, codes and bits are arrays over all blocks; nothing is done block by block.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Quantisation steps of the standard's annex, for luminance and chrominance (fixed values).
LIGHT = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
COLOUR = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
#: Places of a block along its diagonals, and the orthonormal cosine basis.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
LONG_RUN, BLOCK_END = 0xF0, 0x00


def steps(quality: int) -> list[np.ndarray]:
    """Both tables scaled for a quality of 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LIGHT, COLOUR)]


def coefficients(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised blocks (n, 64) in zigzag order, row by row of blocks."""
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
    blocks = padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    return np.rint((BASIS @ blocks @ BASIS.T).reshape(-1, 64) / table).astype(np.int64)[:, ZIGZAG]


def sizes(v: np.ndarray) -> np.ndarray:
    """Bits of a value's magnitude."""
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def low_bits(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, v, v + (1 << n) - 1)


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman lengths of at most 16 bits, with one code of the longest kept free (it would be all ones)."""
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))] + [(0, -1, [-1])]
    heapq.heapify(heap)
    length = dict.fromkeys([*counts, -1], 0)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], tie, a[2] + b[2]))
        tie += 1
    number = [0] * (max(length.values()) + 1)
    for n in length.values():
        number[n] += 1
    for n in range(len(number) - 1, 16, -1):
        while number[n]:  # a pair moves up, and a shorter code makes room
            k = n - 2
            while not number[k]:
                k -= 1
            number[n] -= 2
            number[n - 1] += 1
            number[k + 1] += 2
            number[k] -= 1
    by_use = sorted(length, key=lambda s: (s == -1, length[s], s))
    given = [n for n in range(1, len(number)) for _ in range(number[n])]
    return {s: n for s, n in zip(by_use, given) if s != -1}


def codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    out, code, last = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        last = lengths[s]
        out[s] = code, last
        code += 1
    return out


def segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def packed(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Bits one after the other, filled up with ones; a zero byte follows each byte of ones."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    down = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(owner)) - 1
    bits = (values[owner] >> down & 1).astype(np.uint8)
    out = np.packbits(np.append(bits, np.ones(-len(bits) % 8, dtype=np.uint8)))
    return np.insert(out, np.flatnonzero(out == 255) + 1, 0).tobytes()


def jpeg(samples: np.ndarray, quality: int = 90) -> bytes:
    """A file of (height, width, 3 or 4) bytes; alpha goes."""
    h, w = samples.shape[:2]
    r, g, b = (samples[..., k].astype(np.float64) for k in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    tables = steps(quality)
    # events in file order: block, component, place; a long run's part comes before the value it leads to
    events: list[tuple[np.ndarray, ...]] = []
    for k, plane in enumerate(planes):
        z = coefficients(plane, tables[min(k, 1)])
        n = len(z)
        step = np.diff(z[:, 0], prepend=0)
        kind = 2 * min(k, 1)
        own = np.arange(n) * 3 + k
        bits = sizes(step)
        events.append((own, np.zeros(n, dtype=np.int64), np.full(n, kind), bits, low_bits(step, bits), bits))
        block, place = np.nonzero(z[:, 1:])
        v = z[:, 1:][block, place]
        before = np.where(np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, dtype=bool), -1, np.concatenate([[-1], place[:-1]]) if len(block) else place)
        run, bits = place - before - 1, sizes(v)
        events.append((block * 3 + k, 4 * place + 4, np.full(len(v), kind + 1), run % 16 << 4 | bits, low_bits(v, bits), bits))
        far = np.repeat(np.arange(len(v)), run // 16)
        zero = np.zeros(len(far), dtype=np.int64)
        events.append((block[far] * 3 + k, 4 * place[far] + 3, np.full(len(far), kind + 1), np.full(len(far), LONG_RUN), zero, zero))
        short = np.flatnonzero(z[:, 63] == 0)
        zero = np.zeros(len(short), dtype=np.int64)
        events.append((short * 3 + k, np.full(len(short), 1000), np.full(len(short), kind + 1), np.full(len(short), BLOCK_END), zero, zero))
    unit, place, kind, symbol, extra, bits = (np.concatenate(c) for c in zip(*events))
    order = np.lexsort((place, unit))
    kind, symbol, extra, bits = kind[order], symbol[order], extra[order], bits[order]
    trees, value, length = [], np.zeros(len(kind), dtype=np.int64), np.zeros(len(kind), dtype=np.int64)
    for t in range(4):
        at = kind == t
        found, n = np.unique(symbol[at], return_counts=True)
        tree = code_lengths(dict(zip(found.tolist(), n.tolist())))
        look = np.zeros((256, 2), dtype=np.int64)
        for s, (c, m) in codes(tree).items():
            look[s] = c, m
        value[at], length[at] = look[symbol[at], 0], look[symbol[at], 1]
        listed = sorted(tree, key=lambda s: (tree[s], s))
        trees.append(bytes([(t % 2) << 4 | t // 2, *(sum(m == n for m in tree.values()) for n in range(1, 17)), *listed]))
    data = packed(value << bits | extra, length + bits)
    head = segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    head += b"".join(segment(0xDB, bytes([i, *t[ZIGZAG].tolist()])) for i, t in enumerate(tables))
    head += segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    head += b"".join(segment(0xC4, t) for t in trees)
    return b"\xff\xd8" + head + segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + data + b"\xff\xd9"
