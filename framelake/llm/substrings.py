"""Substring deduplication by compaction of a de Bruijn graph of words.

Edges of the graph are the windows (``window`` consecutive words), nodes what neighbouring windows share. A repeated window is
removed where its words also start in a document with a smaller id. Single edges never travel: neighbouring windows whose least hash of
``inner`` words is the same form a path, and all copies of a window choose the same least hash, so paths of two
documents meet under it. A path's name is a 128-bit digest of its words.

1. Each document gives its paths: first word, number of windows, name, least hash, and the paths before and after it.
2. Paths are grouped by name: the smallest document that has it (the source) and where, and whether it has one follower
   and one leader only. Paths of other documents than their source are repeated as a whole.
3. Repeated paths are compacted: joined with their names' rows, paths that follow each other in a document, whose link does not
   branch on either side, and whose coordinates in the source document continue, too, become one span. So a long span is
   checked against its source's coordinates at every step.
4. Where paths branch, two of them share some windows: least hashes that several names from several documents share are
   looked up again, and only there windows are compared one by one, each named by its least hash and its own; a document's path counts there
   unless step 2 has removed it.
5. A document's spans meet its text, and the words outside of them remain.

Names and least hashes are joined and aggregated in Spark with partial sums; common passages are groups whose members are joined with one row,
never with each other. Rows are kept apart by id and a hash of the text.

Cases: null, empty and short texts (fewer words than a window) keep all words; rows with a null id neither lose words nor are a
source; repeated rows of one id are no smaller than each other and give equal rows; repeats inside one document stay; a text of any length is
read whole; an empty table gives no rows; columns named like the result's go unless in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, split_words, tidy

#: Up to so many least hashes are broadcast (one number each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
KEY = ["doc", "tag"]
PATH = "doc long, tag long, start int, n int, least long, name long, name2 long, leader long, follower long"


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: the scrambled sum of its letters' numbers by place."""
    n = len(words)
    at = np.frombuffer(words.buffers()[1], dtype=np.int32)[: n + 1].astype(np.int64)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    letters = LETTERS[np.frombuffer(words.buffers()[2], dtype=np.uint8)]
    place = (np.arange(len(letters)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(letters + place * np.uint64(0x9E3779B97F4A7C15)), at[:-1]))


def chained(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    """The hash of each run that is a run of ``a`` and, ``by`` places on, one of ``b``."""
    n = max(len(b) - by, 0)
    return mixed(a[:n] * np.uint64(0x9FB21C651E98DF25) + b[by:])


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, from runs of powers of two."""
    out, covered, power, size = None, 0, h, 1
    while True:
        if length & size:
            out = power if out is None else chained(out, power, covered)
            covered += size
        size *= 2
        if size > length:
            return out
        power = chained(power, power, size // 2)


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    out, size = h, 1
    while size * 2 <= width:
        out = np.minimum(out[: max(len(out) - size, 0)], out[size:])
        size *= 2
    return np.minimum(out[: max(len(out) - (width - size), 0)], out[width - size :])


def long(h: np.ndarray) -> pa.Array:
    return pa.array(h.astype(np.uint64).view(np.int64))


def paths(rows: DataFrame, window: int, inner: int, hashes: bool = False) -> DataFrame:
    """All paths of rows (doc, tag, text); with ``hashes``: those of their windows, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = split_words(batch["text"].cast(pa.binary()), lower=False)
            ends = np.cumsum(counts)
            first = ends - counts
            fit = np.maximum(counts - window + 1, 0)  # windows of each text
            total = int(fit.sum())
            if not total:
                continue
            h = word_hashes(words)
            of = np.repeat(np.arange(len(counts)), fit)
            at = np.arange(total) - np.repeat(np.cumsum(fit) - fit, fit)  # a window's first word in its text
            place = first[of] + at
            least = least_of(run_hashes(h, inner), window - inner + 1)[place]
            opens = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (of[1:] != of[:-1])]))
            closes = np.append(opens[1:], total)
            n, doc = closes - opens, of[opens]
            bytes_ = np.frombuffer(words.buffers()[2], dtype=np.uint8)
            offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[: len(words) + 1]
            lengths = np.diff(offsets)
            names = np.empty((len(opens), 2), dtype=np.uint64)
            view, sizes = memoryview(bytes_), memoryview(lengths.view(np.uint8))
            for i, (a, b) in enumerate(zip(place[opens].tolist(), (place[opens] + n + window - 1).tolist())):
                d = xxhash.xxh3_128(view[offsets[a] : offsets[b]])
                d.update(sizes[4 * a : 4 * b])
                names[i] = divmod(d.intdigest(), 1 << 64)
            same = doc[1:] == doc[:-1]
            follower, leader = np.zeros(len(opens), dtype=np.uint64), np.zeros(len(opens), dtype=np.uint64)
            follower[:-1][same], leader[1:][same] = names[1:, 0][same], names[:-1, 0][same]
            arrays = [batch["doc"].take(pa.array(doc)), batch["tag"].take(pa.array(doc)), pa.array(at[opens].astype(np.int32)), pa.array(n.astype(np.int32)), long(least[opens]), long(names[:, 0]), long(names[:, 1]), long(leader), long(follower)]
            columns = ["doc", "tag", "start", "n", "least", "name", "name2", "leader", "follower"]
            if hashes:
                every = run_hashes(h, window)[place]
                arrays.append(pa.Array.from_buffers(pa.binary(), len(opens), [None, pa.py_buffer(np.append(8 * opens, 8 * total).astype(np.int32)), pa.py_buffer(every.astype(np.uint64))]))
                columns.append("hashes")
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return rows.mapInArrow(tidy(run), PATH + (", hashes binary" if hashes else ""))


def windows(branching: DataFrame) -> DataFrame:
    """(doc, tag, start, least, h): the single windows of paths with hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            h = np.frombuffer(b"".join(batch["hashes"].to_pylist()), dtype=np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch["doc"].take(take), batch["tag"].take(take), pa.array((batch["start"].to_numpy()[row] + at).astype(np.int32)), batch["least"].take(take), pa.array(h)], ["doc", "tag", "start", "least", "h"])

    return branching.mapInArrow(tidy(run), "doc long, tag long, start int, least long, h long")


def named(found: DataFrame) -> DataFrame:
    """Names that several documents have: the source, its coordinates, and the only follower and leader (null: several)."""
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    groups = found.groupBy("name", "name2").agg(F.min("doc").alias("source"), F.max("doc").alias("_last"), F.min_by("start", "doc").alias("there"), only("leader").alias("only_leader"), only("follower").alias("only_follower"))
    return groups.where("source < _last").drop("_last")


def compacted(found: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, tag, start, end, source, there): repeated paths joined along links that do not branch and whose source coordinates continue; end is the last window's first word + 1."""
    met = found.select(*KEY, "start", "n", "name", "name2").join(names, ["name", "name2"]).where("doc > source")
    line = Window.partitionBy(*KEY).orderBy("start")
    before = lambda c: F.lag(c).over(line)
    link = (before("only_follower") == F.col("name")) & (F.col("only_leader") == before("name"))
    straight = (before("start") + before("n") == F.col("start")) & (before("source") == F.col("source")) & (before("there") + before("n") == F.col("there"))
    met = met.withColumn("opens", F.when(link & straight, 0).otherwise(1)).withColumn("span", F.sum("opens").over(line))
    return met.groupBy(*KEY, "span").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.min("source").alias("source"), F.min("there").alias("there")).drop("span")


def branch_spans(rows: DataFrame, found: DataFrame, names: DataFrame, window: int, inner: int) -> DataFrame:
    """(doc, tag, start, end) of repeated windows where paths of different names share some."""
    several = found.groupBy("least").agg((F.min("name") != F.max("name")).alias("several"), (F.min("doc") != F.max("doc")).alias("apart")).where("several AND apart").select("least")
    several = saved(several)
    several = F.broadcast(several) if several.count() <= MOST_BROADCAST else several
    again = paths(rows, window, inner, hashes=True).select(*KEY, "start", "n", "least", "name", "name2", "hashes").join(several, "least", "left_semi")
    again = again.join(names.select("name", "name2", "source"), ["name", "name2"], "left").where("source IS NULL OR doc = source")
    single = saved(windows(again.select(*KEY, "start", "n", "least", "hashes")))
    groups = single.groupBy("least", "h").agg(F.min("doc").alias("source"), F.max("doc").alias("_last")).where("source < _last").drop("_last")
    return single.join(groups, ["least", "h"]).where("doc > source").select(*KEY, "start", (F.col("start") + 1).alias("end"))


def repeated_spans(rows: DataFrame, window: int = 50, inner: int = 8) -> DataFrame:
    """(doc, tag, spans) of rows (doc, tag, text): arrays of (start, end) of windows' first words; one row for each (doc, tag) that has any."""
    found = saved(paths(rows, window, inner))
    names = saved(named(found))
    spans = compacted(found, names).select(*KEY, "start", "end").union(branch_spans(rows, found, names, window, inner))
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = 50, inner: int = 8) -> DataFrame:
    """``keep``'s columns, n_words, n_removed, kept_text (words joined by one space) and removed (word spans, ends exclusive)."""
    source = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *keep).withColumn("_tag", F.xxhash64("_text"))
    rows = source.where("_doc IS NOT NULL").select(F.col("_doc").alias("doc"), F.col("_tag").alias("tag"), F.col("_text").alias("text"))
    spans = repeated_spans(rows, window, inner)
    met = source.join(spans.withColumnsRenamed({"doc": "_doc", "tag": "_tag"}), ["_doc", "_tag"], "left").select(*keep, "_text", "spans")
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, texts, where = [], [], [], []
            for t, s in zip(batch["_text"].cast(pa.binary()).to_pylist(), batch["spans"].to_pylist()):
                words = t.split()
                merged: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"] + window - 1) for x in s or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                left, last = [], 0
                for a, b in merged:
                    left += words[last:a]
                    last = b
                left += words[last:]
                counts.append(len(words))
                gone.append(len(words) - len(left))
                texts.append(b" ".join(left).decode())
                where.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string()), pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [*keep, "n_words", "n_removed", "kept_text", "removed"])

    return met.mapInArrow(tidy(run), f"{kinds}, n_words long, n_removed long, kept_text string, removed array<struct<start: int, end: int>>")
