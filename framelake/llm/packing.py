"""Best-fit packing of documents into sequences by patterns of lengths.

What is packed is a histogram of lengths (at most ``capacity`` numbers, all that the driver
sees). Patterns of lengths that fill a sequence, but for ``SLACK`` tokens at most, are enumerated: few unlike lengths,
and runs of like ones. Non-negative least squares (coordinate descent) fits how often to repeat each, and the fit is
rounded; what the counts allow is used, and the rest is fitted again as long as that places a share of the sequences. What
remains is packed by best fit, long pieces first, into the room left in used patterns and into
new sequences, all repeats of a pattern at a time. So patterns are few however many documents
there are. Pieces are numbered within their length in parallel (counts by length
and bucket, then a sum over buckets), and the number tells a piece's sequence and place.

Cases: a null text counts as empty and is its end token alone; documents longer
than a sequence are cut into full pieces and a rest, whole texts of any length being read; repeated rows are packed each;
an empty table gives no sequences; extra columns are left out unless in ``keep``.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from .common import saved, tidy

CAPACITY = 4096
#: Chunks and parts that a task remembers, and those, the first met, that a worker keeps for its next task.
CACHED, KEPT = 500_000, 50_000
#: Room that a fitted pattern may leave, and the least share of the sequences that a fit must place to be followed by another.
SLACK, WORTH = 64, 0.01
#: Letters whose lower case is one letter of this range, too; a chunk with any other (such as U+0130, U+018F) is left to the library whole.
LATIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1 and 0xC0 <= ord(c.lower()) < 0x250)
#: Chunks of these characters alone split into the same parts before as after normalising.
PLAIN = re.compile(f"[!-~{LATIN}]+")
#: The tokenizer's own parts, for lower-case plain chunks, one on each line.
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|\n|[^0-9a-z{LATIN}\n]+")
#: Stands for the line end among ids.
BREAK = 0xFFFFFFFF
#: Special tokens are found in the raw text; a chunk that may hold one is left to the library whole.
SPECIAL = "<|"


class ChunkEncoder:
    """Ids of whole texts from the ids of their white-space-free chunks, which repeat.

    Splitting at ASCII white space changes no ids: the tokenizer drops it, and its parts never span it.
    Plain chunks are split further into the tokenizer's parts, which repeat more; the parts
    go to the BPE model in long lists, and a token with the end-of-word suffix closes each.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # bytes as the vocabulary writes them; those from 0x80 on occur in two-byte characters only
        self.written = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in map(ord, LATIN)}
        self.cached = CACHED
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def learn_parts(self, wanted: set[str]) -> None:
        new = list(wanted.difference(self.parts, "\n"))
        if len(self.parts) + len(new) > self.cached:
            self.parts, new = {}, list(wanted.difference("\n"))
        self.parts["\n"] = np.array([BREAK], dtype="<u4").tobytes()
        new.sort(key=str.isascii)  # lists of ASCII parts need no translation
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            text = " ".join(part)
            ids = np.array(self.model.encode_batch_fast([text if text.isascii() else text.translate(self.written)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = 4 * np.flatnonzero(self.closes[ids]) + 4
            if len(ends) != len(part):
                raise ValueError("a part does not end with one closing token in this vocabulary")
            raw, ends = ids.tobytes(), ends.tolist()
            self.parts.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends))))

    def learn(self, texts_chunks: list[list[bytes]]) -> None:
        new = set().union(*texts_chunks).difference(self.known)
        if len(self.known) + len(new) > self.cached:
            self.known = {}
            new = set().union(*texts_chunks)
        raw = list(new)
        spelled = b"\n".join(raw).decode("utf-8", "replace").split("\n") if raw else []
        is_plain = [PLAIN.fullmatch(s) is not None and SPECIAL not in s for s in spelled]
        plain = list(compress(spelled, is_plain))
        if plain:
            parts = PARTS.findall("\n".join(plain).lower())
            self.learn_parts(set(parts))
            ids = b"".join(map(self.parts.__getitem__, parts))
            breaks = 4 * np.flatnonzero(np.frombuffer(ids, dtype="<u4") == BREAK)
            self.known.update(zip(compress(raw, is_plain), map(ids.__getitem__, map(slice, [0, *(breaks + 4).tolist()], [*breaks.tolist(), len(ids)]))))
        rest = [(r, s) for r, s, p in zip(raw, spelled, is_plain) if not p]
        for (r, _), e in zip(rest, self.tokenizer.encode_batch_fast([s for _, s in rest], add_special_tokens=False)):
            self.known[r] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids, as little-endian 32-bit numbers, of each text (in UTF-8)."""
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < 4 << 20:
                text = texts[at]
                split.append((text if SPECIAL.encode() in text else text.lower()).split())  # it lower-cases, too
                size += len(text)
                at += 1
            self.learn(split)
            for chunks in split:
                yield b"".join(map(self.known.__getitem__, chunks))


    def shrink(self) -> None:
        self.known, self.parts = dict(islice(self.known.items(), KEPT)), dict(islice(self.parts.items(), KEPT))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def token_pieces(rows: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", end: int = 1, capacity: int = CAPACITY, cached: int = CACHED) -> DataFrame:
    """The columns ``keep`` in ``own``, piece, start, length and ids_crc32; a task remembers up to ``cached`` chunks and as many parts."""
    data = rows.select(F.struct(*keep).alias("own"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        tokens.cached = cached
        for batch in batches:
            row, out = [], []
            for i, raw in enumerate(tokens.encode(batch["t"].to_pylist())):
                raw += tail
                n = len(raw) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = raw[4 * start : 4 * (start + capacity)]
                    row.append(i)
                    out.append((piece, start, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [[]] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["own"].take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["own", "piece", "start", "length", "ids_crc32"])
        tokens.shrink()

    return data.mapInArrow(tidy(run, 1 << 24 if cached >= CACHED else 1 << 20), f"own {data.schema['own'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, capacity: int, few: int = 4, alike: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16)) -> list[tuple[int, ...]]:
    """Patterns of lengths with at most SLACK tokens of room: up to ``few`` unlike lengths, one length with like ones, or one with ``alike`` equal parts of the rest."""
    have = [int(x) for x in lengths]
    found: set[tuple[int, ...]] = set()
    spread = [have[int(i)] for i in np.unique(np.linspace(0, len(have) - 1, 24).astype(int))]

    def add(chosen: list[int], parts: int) -> None:
        """Fill the room with ``parts`` lengths, each the next to an equal part of what is left; the last is the best fit."""
        room = capacity - sum(chosen)
        for k in range(parts, 0, -1):
            i = bisect_right(have, room // k)
            if not i:
                break
            chosen.append(have[i - 1])
            room -= have[i - 1]
        if 0 <= room <= SLACK:
            found.add(tuple(sorted(chosen, reverse=True)))

    for a in have:
        for k in {min(capacity // a - 1, 64), 0, *alike}:
            add([a], k)
        for s in spread:
            for k in range(few - 1):
                add([a, s], k)
        for s in spread[::4]:
            for t in spread[::6]:
                for k in range(few - 2):
                    add([a, s, t], k)
        # the longest that fits, again and again
        chosen = [a]
        while len(chosen) < few and (i := bisect_right(have, capacity - sum(chosen))):
            chosen.append(have[i - 1])
        add(chosen, 0)
    return sorted(found)


def fitted(found: list[tuple[int, ...]], histogram: dict[int, int], capacity: int, passes: int = 4) -> list[float]:
    """Non-negative least squares: repeats whose lengths make up the histogram, by coordinate descent, fuller patterns first."""
    left = {v: float(n) for v, n in histogram.items()}
    columns = [list(Counter(p).items()) for p in found]
    norms = [sum(m * m for _, m in c) for c in columns]
    order = sorted(range(len(found)), key=lambda j: (capacity - sum(found[j]), len(found[j]), j))
    x = [0.0] * len(found)
    for _ in range(passes):
        for j in order:
            gap = 0.0
            for v, m in columns[j]:
                gap += m * left[v]
            change = max(gap / norms[j], -x[j])
            if change:
                x[j] += change
                for v, m in columns[j]:
                    left[v] -= m * change
    return x


Plan = list[tuple[int, dict[int, int]]]


def fit_plan(left: dict[int, int], capacity: int) -> Plan:
    """Patterns with their repeats, taken from ``left``, by one fit after the other."""
    plan: Plan = []
    enough = WORTH * sum(v * n for v, n in left.items()) / capacity
    while lengths := sorted(v for v, n in left.items() if n):
        found = patterns(np.array(lengths), capacity)
        x = fitted(found, {v: left[v] for v in lengths}, capacity)
        placed = 0
        for j in sorted(range(len(found)), key=lambda j: (-x[j], j)):
            parts = Counter(found[j])
            repeats = min(max(1, round(x[j])), *(left[v] // n for v, n in parts.items())) if x[j] > 0 else 0
            if repeats:
                plan.append((repeats, dict(parts)))
                placed += repeats
                for v, n in parts.items():
                    left[v] -= repeats * n
        if placed <= enough:
            break
    return plan


def packed(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """(repeats, number of pieces of each length) of every pattern used; together they use the histogram up."""
    left = {v: n for v, n in histogram.items() if n > 0}
    groups = [[repeats, parts] for repeats, parts in fit_plan(left, capacity)]
    room_of = lambda parts: capacity - sum(v * n for v, n in parts.items())
    rooms = sorted((room_of(g[1]), i) for i, g in enumerate(groups))
    for v in sorted((v for v, n in left.items() if n), reverse=True):
        n = left[v]
        while n:
            at = bisect_left(rooms, (v, -1))
            if at == len(rooms):  # no sequence has room: new ones, as many as are needed at this length
                groups.append([-(-n // (capacity // v)), {}])
                rooms.append((capacity, len(groups) - 1))
            room, i = rooms.pop(at)
            each = min(room // v, n)
            repeats = min(groups[i][0], n // each)
            if repeats < groups[i][0]:  # the others keep their room
                groups.append([groups[i][0] - repeats, dict(groups[i][1])])
                insort(rooms, (room, len(groups) - 1))
                groups[i][0] = repeats
            groups[i][1][v] = groups[i][1].get(v, 0) + each
            insort(rooms, (room - each * v, i))
            n -= repeats * each
    return [(repeats, parts) for repeats, parts in groups if parts]


def places(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, numbers, per sequence, first sequence, offset): where the pieces of a length go, by number."""
    out, used, sequence = [], {}, 0
    for repeats, parts in plan:
        offset = 0
        for v, n in parts.items():
            out.append((v, used.get(v, 0), repeats * n, n, sequence, offset))
            used[v] = used.get(v, 0) + repeats * n
            offset += v * n
        sequence += repeats
    return sorted(out)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_bucket: int = 2000) -> DataFrame:
    """``pieces`` (a written table with a column length) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = np.array(places(packed(histogram, capacity)), dtype=np.int64).reshape(-1, 6)
    buckets = max(1, -(-sum(histogram.values()) // per_bucket))
    # monotonically_increasing_id deals rows evenly, so a length that a third of all pieces share is no hot group
    dealt = saved(pieces.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row for each bucket and length
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).select("length", "bucket", "before")
    numbered = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("ids_crc32", "start")) - 1)  # any order will do
    numbered = numbered.join(before, ["bucket", "length"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "bucket")
    shared = spark.sparkContext.broadcast(plan)  # bounded by the number of patterns, so by capacity
    kept = [f for f in numbered.schema.fields if f.name != "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] << 40 | table[:, 1]
        for batch in batches:
            length, nth = batch["length"].to_numpy(), batch["nth"].to_numpy()
            p = table[np.searchsorted(keys, length << 40 | nth, side="right") - 1]
            k = nth - p[:, 1]
            cols = [batch[f.name] for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p[:, 4] + k // p[:, 3]), pa.array(p[:, 5] + k % p[:, 3] * length)], [*(f.name for f in kept), "sequence_id", "offset"])

    return numbered.withColumn("nth", F.col("nth").cast("long")).mapInArrow(run, T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(rows: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", capacity: int = CAPACITY, cached: int = CACHED) -> DataFrame:
    """The columns ``keep`` of each piece, piece, start, length, ids_crc32, sequence_id and offset."""
    done = pack(saved(token_pieces(rows, path, keep=keep, text=text, capacity=capacity, cached=cached)), capacity)
    return done.select("own.*", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
