"""Near-duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A 64-bit fingerprint has three segments of 21, 21 and 22 bits. Decoding a segment with
the perfect (23, 12) Golay code gives the indices of all codewords within
distance 4: one, or six where the nearest is at distance 3. Two segments that
differ in up to two bits share an index. Three differing bits spread over three
segments leave either the first two with at most two errors each (they share a
pair of indices), or all errors in one of these two (the remaining segments are
equal). So each fingerprint has up to 36 + 2 keys, and fingerprints that link share one.

Keys are dealt over the cluster and sorted; pairs under a key are verified by
the bits that differ. Only links that connect what the task has not connected
are passed on (a forest, never all pairs of a group). A key with more than
``hot`` fingerprints is put off: its fingerprints are dealt in blocks, and each pair of
blocks is a task's unit of its own. Copies meet before: only
distinct fingerprints take part.

With ``similarity`` texts link by the Jaccard similarity of their sets of distinct shingles, and no
link is missed. The fingerprints of the sets propose first: their links of up to three bits are checked
on the sets and join most near copies. What they leave apart is found by prefixes. Shingles have one
order for all texts: those frequent in a sample of texts
come last, the others by hash (the sample decides the cost alone; any order is exact). Of two sets of
similarity s each has a shared shingle among its first n - ceil(s n) + 1 (the prefix), so texts are
joined on the shingles of their prefixes. Two steps keep large groups of near copies from
giving all pairs: first each text is checked against the first text of each of its shingles'
groups; then, a forest of the nearest pairs of what is still apart is checked; then, in groups whose texts these checked links leave apart, all pairs that are
still apart and whose sizes and places in the order allow the similarity are
checked, large groups in blocks. Of shingles that the very same texts have in their prefixes only the first counts. Before a pair is
checked on the sets it must pass a bound: the bits in which parity maps of the sets differ (one bit for
the shingles of each hash class, set if they are odd in number) are no more than the sets' differing shingles. Pairs are only left out if a checked link connects their texts already
or if they cannot be similar. Texts of equal sets are one node from the start. Only prefixes are
written; the sets of texts that take part in a proposed pair are made again from the texts.

Cases: a null or wordless text has fingerprint zero and links like any other; a text
with fewer words than a shingle is one shingle; a text of any length is read whole; repeated rows and
texts share fingerprint and component; null ids are kept, and a component of null ids alone has a null component_id;
an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, tidy, words_of
from .components import connected_components

#: Generator polynomial of the binary Golay code.
GENERATOR = 0b101011100011
BITS = (21, 21, 22)
#: Buckets of more rows are searched for a spanning forest, not pair by pair.
WIDE = 64
#: Similarity mode: how many frequent shingles are told apart in the order of shingles, which changes the work but no link.
FREQUENT = 200_000
#: Texts of a block, in groups that are checked pair by pair.
BLOCK = 1000
#: Bits of a set's parity map: as many as it has shingles, rounded up to a power of two, within these.
LEAST_MAP, MOST_MAP = 1024, 65_536
#: Pairs of one node that meet its set in one group.
PAIRS = 1000
#: Turns (a pass over the cells each) in which only a forest of each group's nearest pairs is checked, while so large a share of them are links.
TURNS, LEAST_FOUND = 1, 0.1
#: Up to so many ids of texts whose sets are needed are broadcast (two numbers each); more are joined by a shuffle.
MOST_BROADCAST = 2_000_000


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of each 12-bit index; per syndrome the leader's upper bits and the indices of near codewords (-1: none)."""
    parity = np.zeros(4096, dtype=np.int64)
    for m in range(4096):
        r = m << 11
        for i in range(22, 10, -1):
            if r >> i & 1:
                r ^= GENERATOR << (i - 11)
        parity[m] = r
    codes = (np.arange(4096) << 11) | parity
    near = np.full((2048, 6), -1, dtype=np.int64)
    single = [1 << i for i in range(23)]
    errors = [0, *single, *[a | b for i, a in enumerate(single) for b in single[:i]]]
    errors += [a | b | c for i, a in enumerate(single) for j, b in enumerate(single[:i]) for c in single[:j]]
    leader = np.zeros(2048, dtype=np.int64)
    for e in errors:
        s = (e & 2047) ^ parity[e >> 11]
        leader[s] = e >> 11
        found = np.nonzero(np.bitwise_count(codes ^ e) <= 4)[0]
        near[s, : len(found)] = found
    return parity, leader, near


def near_indices(segment: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of each value, -1 where there are fewer than six."""
    parity, leader, near = golay()
    top = segment >> 11
    s = (segment & 2047) ^ parity[top]
    nearest = top ^ leader[s]
    return np.where(near[s] >= 0, near[s] ^ nearest[:, None], -1)


def keys_of(fp: np.ndarray, rest: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of unsigned fingerprints; ``rest``: with the two keys for errors that all fall in one segment."""
    f = fp.astype(np.uint64)
    a, b, c = ((f >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in zip((43, 22, 0), BITS))
    ka, kb = near_indices(a), near_indices(b)
    pair = np.where((ka[:, :, None] >= 0) & (kb[:, None, :] >= 0), ka[:, :, None] << 12 | kb[:, None, :], -1).reshape(len(f), 36)
    row, col = np.nonzero(pair >= 0)
    if not rest:
        return row, pair[row, col]
    every = np.arange(len(f))
    return np.concatenate([row, every, every]), np.concatenate([pair[row, col], (1 << 60) | (b << 22) | c, (2 << 60) | (a << 22) | c])


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words of a text in UTF-8, repeats included."""
    w = words_of(text)
    if not w:
        return np.zeros(0, dtype=np.uint64)
    raw = b" ".join(w)
    n = max(1, len(w) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(raw[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(words, len(w)) - 1 :].tolist())), dtype=np.uint64, count=n)


def fingerprints(rows: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """id and node, the fingerprint (bigint) of every text."""
    data = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in batch["t"]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(fp)], ["id", "node"])

    return data.mapInArrow(tidy(run), f"id {data.schema['id'].dataType.simpleString()}, node long")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def parity_map(shingles: np.ndarray) -> bytes:
    """One bit for each class of hashes (their lower bits): whether the set has an odd number of them."""
    bits = max(LEAST_MAP, min(MOST_MAP, 1 << max(0, len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def narrowed(bits: np.ndarray, size: int) -> np.ndarray:
    """The map (bytes) that a smaller number of classes gives: halves are laid over each other."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def may_be_similar(x: np.ndarray, y: np.ndarray, n: int, similarity: float) -> bool:
    """By the maps of two sets that have ``n`` shingles together."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(narrowed(x, size) ^ narrowed(y, size)).sum(dtype=np.int64)) * (1 + similarity) <= (1 - similarity) * n + 1e-6


def set_sketches(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray], similarity: float, *, id_col: str, text: str, words: int) -> DataFrame:
    """id, node (hash of the set of distinct shingles), fp (fingerprint of the set), n (its size), map (its parity map) and prefix (64-bit numbers) of every text."""
    data = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    shared = rows.sparkSession.sparkContext.broadcast(frequent)  # bounded by FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[tuple] = []
                for t in part["t"]:
                    h = shingle_set(t.as_py(), words)
                    out.append((xxhash.xxh3_64_intdigest(h.tobytes()), fingerprint(h), len(h), parity_map(h), prefix(h, shared.value, similarity).tobytes() if len(h) else b""))
                node, fp, n, bits, start = zip(*out)
                signed = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part["id"], signed(node), signed(fp), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(start, pa.binary())], ["id", "node", "fp", "n", "map", "prefix"])

    return data.mapInArrow(tidy(run), f"id {data.schema['id'].dataType.simpleString()}, node long, fp long, n int, map binary, prefix binary")


class Forest:
    """Joins nodes; tells which links were new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of one or more 64-bit words (counted unsigned: of signed numbers numpy counts the absolute value's bits)."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(1, dtype=np.int64)


def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links among rows of equal key (sorted by key); wide buckets give a spanning forest."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(cut)
    narrow = np.repeat(sizes <= WIDE, sizes)
    i = np.flatnonzero(narrow)
    step = 1
    while len(i):
        i = i[i + step < len(key)]
        i = i[key[i + step] == key[i]]
        hit = i[apart(fp[i], fp[i + step]) <= distance]
        yield from zip(node[hit].tolist(), node[hit + step].tolist())
        step += 1
    for start, n in zip(cut[:-1][sizes > WIDE].tolist(), sizes[sizes > WIDE].tolist()):
        f, x = fp[start : start + n], node[start : start + n]
        left = np.arange(n)
        queue: list[int] = []
        while len(left):
            if not queue:
                queue.append(int(left[0]))
                left = left[1:]
            u = queue.pop()
            near = apart(f[left], f[u]) <= distance
            for v in left[near].tolist():
                yield int(x[u]), int(x[v])
                queue.append(v)
            left = left[~near]


def linked(keyed: DataFrame, distance: int, hot: int | None) -> DataFrame:
    """Links (a, b) among rows (key, fp, node) of equal key; (null, key) for keys put off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, n_held = Forest(), [], 0
        late: set[int] = set()

        def search(key, fp, node) -> tuple[list, list]:
            a, b = [], []
            for x, y in links(key, fp, node, distance):
                if x != y and forest.join(x, y):
                    a.append(x)
                    b.append(y)
            return a, b

        def packed(a: list, b: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch["key"].to_numpy()
            held.append((key, batch["fp"].to_numpy()[:, None], batch["node"].to_numpy()))
            n_held += len(key)
            cols = [np.concatenate(c) for c in zip(*held)]
            last = np.searchsorted(cols[0], cols[0][-1])  # rows of the last key wait for the next batch
            if hot and n_held - last > hot:
                late.add(int(cols[0][-1]))
            tail = [c[last:] for c in cols]
            cols = [c[:last] for c in cols]
            keep = ~np.isin(cols[0], list(late)) if late else slice(None)
            a, b = search(*(c[keep] for c in cols)) if len(cols[0]) else ([], [])
            if a:
                yield packed(a, b)
            if late and int(tail[0][0]) in late:
                tail = [c[:1] for c in tail]
            held, n_held = [tail], len(tail[0])
        if n_held and int(held[0][0][0]) not in late:
            key = held[0][0]
            if hot and n_held > hot:
                late.add(int(key[0]))
            else:
                a, b = search(*held[0])
                if a:
                    yield packed(a, b)
        if late:
            yield packed([None] * len(late), sorted(late))

    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(run), "a long, b long")


def near_links(nodes: DataFrame, distance: int = 3, hot: int = 20_000) -> DataFrame:
    """Links among the distinct rows (node, fp), enough to connect all whose fingerprints differ in up to ``distance`` <= 3 bits.

    ``hot`` bounds the rows of a key that a task holds; it decides how pairs are dealt, not which.
    """
    if distance > 3:
        raise ValueError("segments are decoded for up to three differing bits")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part["fp"].to_numpy()
                row, key = keys_of(np.ascontiguousarray(fp).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(part["node"].to_numpy()[row])], ["key", "fp", "node"])

    keyed = nodes.select("node", "fp").mapInArrow(tidy(expand), "key long, fp long, node long")
    found = saved(linked(keyed, distance, hot))
    edges = found.where("a is not null")
    late = found.where("a is null").select(F.col("b").alias("key")).distinct()
    if not late.isEmpty():
        rows = saved(keyed.join(late, "key", "left_semi"))
        blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (hot / 2)).cast("int").alias("n"))
        dealt = rows.join(blocks, "key").withColumn("x", F.pmod(F.xxhash64("node", "fp"), F.col("n")).cast("int"))
        dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        # a cell's number may collide with another's; that only adds pairs, which are verified
        cells = dealt.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "fp", "node")
        edges = edges.union(saved(linked(cells, distance, None)))
    return edges


def frequent_shingles(rows: DataFrame, *, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of ``rows``, sorted, and in how many of all texts they are; at most ``FREQUENT`` rows reach the driver."""
    part = rows.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [shingle_set(t.as_py(), words) for t in batch["t"].slice(at, 1000)]
                shingle, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)], ["shingle", "n"])

    counts = part.mapInArrow(tidy(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where("n > 3").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    shingle, n = top["shingle"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def prefix(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a sorted set in the common order, of which two sets of this similarity share one."""
    n = len(shingles)
    known, counts = frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        shingles = shingles[np.argsort(np.where(known[at] == shingles, counts[at], 0), kind="stable")]
    return shingles[: n - math.ceil(similarity * n - 1e-6) + 1]


def prefixes(sketches: DataFrame) -> DataFrame:
    """key (shingle), node, n (the set's size) and pos (the shingle's place in the order) of the prefixes' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for i, x in enumerate(batch["node"].to_pylist()):
                if x not in seen:  # copies that the task has met
                    seen.add(x)
                    fresh.append(i)
            if len(seen) > 100_000:
                seen.clear()
            part = batch.take(pa.array(fresh, pa.int64()))
            raw = part["prefix"].to_pylist()
            k = np.array([len(p) // 8 for p in raw], dtype=np.int64)
            pos = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            keys = np.frombuffer(b"".join(raw), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part["node"].to_numpy(), k)), pa.array(np.repeat(part["n"].to_numpy(), k)), pa.array(pos.astype(np.int32))], ["key", "node", "n", "pos"])

    return sketches.select("node", "n", "prefix").mapInArrow(tidy(run), "key long, node long, n int, pos int")


def can_be_similar(n: Column, pos: Column, m: Column, at: Column, similarity: float) -> Column:
    """At the first shingle that two sets share, no more than the rest of either is common."""
    return F.least(n - pos, m - at) * (1 + similarity) >= similarity * (n + m) - F.lit(1e-6)


def apart_pairs(cells: DataFrame, similarity: float, forest: bool = False) -> DataFrame:
    """Pairs (a, b) in rows (key, node, root, n, pos, map) of equal key that have different roots and may be similar.

    ``forest``: of each key only as many as connect its roots, those of the nearest maps first.
    """

    def pairs(node: np.ndarray, root: np.ndarray, n: np.ndarray, pos: np.ndarray, maps: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, found, size = n - pos, [], 0
        whole = [np.frombuffer(m, dtype=np.uint8) for m in maps]
        small = np.stack([narrowed(m, LEAST_MAP // 8) for m in whole]).view(np.uint64) if len(whole) else np.zeros((0, LEAST_MAP // 64), dtype=np.uint64)
        for i in range(len(node) - 1):
            m = n[i + 1 :]
            # at the first shingle that two sets share, no more than the rest of either is common
            ok = (root[i + 1 :] != root[i]) & (np.minimum(left[i], left[i + 1 :]) * (1 + similarity) >= similarity * (n[i] + m) - 1e-6)
            j = i + 1 + np.flatnonzero(ok)
            j = j[np.bitwise_count(small[j] ^ small[i]).sum(1, dtype=np.int64) * (1 + similarity) <= (1 - similarity) * (n[i] + n[j]) + 1e-6]
            j = np.array([k for k in j.tolist() if may_be_similar(whole[i], whole[k], int(n[i] + n[k]), similarity)], dtype=np.int64)
            if len(j):
                near = np.bitwise_count(small[j] ^ small[i]).sum(1, dtype=np.int64) if forest else j
                found.append((np.full(len(j), i), j, near))
                size += len(j)
            if not forest and (size > 50_000 or (found and i == len(node) - 2)):
                x, y, _ = (np.concatenate(c) for c in zip(*found))
                yield pairs_of(node[x], node[y])
                found, size = [], 0
        if found:
            x, y, near = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(near, kind="stable")
            tree = Forest()
            keep = [k for k in order.tolist() if tree.join(int(root[x[k]]), int(root[y[k]]))]
            yield pairs_of(node[x[keep]], node[y[keep]])

    def pairs_of(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch[c].to_numpy() for c in ("key", "node", "root", "n", "pos")]
            cols.append(np.array(batch["map"].to_pylist(), dtype=object))
            held = cols if held is None else [np.concatenate(c) for c in zip(held, cols)]
            cut = np.concatenate([[0], np.flatnonzero(held[0][1:] != held[0][:-1]) + 1])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                yield from pairs(*(c[a:b] for c in held[1:]))
            held = [c[cut[-1] :] for c in held]  # rows of the last key wait for the next batch
        if held is not None:
            yield from pairs(*held[1:])

    return cells.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "a long, b long").distinct()


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose parity maps and sizes allow the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["n"].to_pylist()
            keep = [may_be_similar(np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8), k, similarity) for x, y, k in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c, m, n: nodes.select(F.col("node").alias(c), F.col("map").alias(m), F.col("n").cast("long").alias(n))
    both = pairs.join(of("b", "y", "ny"), "b").join(of("a", "x", "nx"), "a")
    return both.select("a", "b", "x", "y", (F.col("nx") + F.col("ny")).alias("n")).mapInArrow(tidy(check), "a long, b long")


def sets_of(used: DataFrame, nodes: DataFrame, rows: DataFrame, *, id_col: str, text: str, words: int) -> DataFrame:
    """node and shingles (the set, sorted 64-bit numbers) of the nodes in ``used``, made from the text of one row each."""
    ids = saved(used.join(nodes, "node").select("node", F.col("least").alias("id")))
    if ids.count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part["node"], pa.array([shingle_set(t.as_py(), words).tobytes() for t in part["t"]], pa.binary())], ["node", "shingles"])

    texts = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).join(ids, "id").select("node", "t")
    return texts.mapInArrow(tidy(run), "node long, shingles binary")


def checked_links(proposed: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Those of the distinct proposed pairs (a, b; a written table) whose sets have this Jaccard similarity or more.

    ``sets`` gives node and shingles for a table of nodes. The pairs of a node with very many of them are dealt to several groups.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([p, q]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= similarity * (len(p) + len(q) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    used = proposed.select(F.col("a").alias("node")).union(proposed.select(F.col("b").alias("node"))).distinct()
    known = saved(sets(used))
    hubs = proposed.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("k")).where("k > 1")
    dealt = proposed.join(hubs, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
    of_a = known.withColumnRenamed("node", "a").join(hubs, "a", "left").select("a", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)).alias("salt"), F.col("shingles").alias("x"))
    both = dealt.join(known.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(of_a, ["a", "salt"])
    return both.select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long")


def merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` (node, root) after the links ``found``: only their ends' roots go through the component search."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    ends = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    moved = saved(connected_components(ends))
    fresh = moved.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return roots.union(fresh).join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def apart_cells(keyed: DataFrame, roots: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """The rows of ``apart_pairs``: those of keys whose nodes have several roots, large keys in pairs of blocks."""
    marked = keyed.drop("first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = marked.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.hash("node")).alias("y"), F.min(F.struct("node", "pos")).alias("first")).where("r != s")
    # keys of the very same nodes: the one that comes first in the order
    groups = groups.groupBy("n", "x", "y").agg(F.min_by("key", F.struct("first.pos", "key")).alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("k"))
    dealt = marked.join(groups, "key").join(nodes.select("node", "map"), "node").withColumn("x", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    # a cell's number may collide with another's; that only adds pairs, which are checked
    return dealt.select(F.when(F.col("k") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y"))).alias("key"), "node", "root", "n", "pos", "map")


def similar_links(sketches: DataFrame, nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, hot: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all nodes whose sets are similar, and no others.

    ``sketches`` has node, n and prefix (copies may repeat), ``nodes`` the distinct node with fp, map and n.
    """
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    near = saved(near_links(nodes, 3, hot).select(*ordered).distinct())
    links = saved(checked_links(near, sets, similarity))
    roots = saved(connected_components(links))

    def with_roots(pairs: DataFrame) -> DataFrame:
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")

    by_key = Window.partitionBy("key")
    first = F.min(F.struct("node", "n", "pos")).over(by_key)
    keyed = saved(prefixes(sketches).withColumn("first", first).withColumn("last", F.max("node").over(by_key)).where("first.node != last").drop("last"))
    stars = keyed.where("first.node != node").where(can_be_similar(F.col("n"), F.col("pos"), F.col("first.n"), F.col("first.pos"), similarity)).select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
    tried = saved(possible(with_roots(stars).join(near, ["a", "b"], "left_anti"), nodes, similarity))
    found = saved(checked_links(tried, sets, similarity))
    links, roots = saved(links.union(found)), saved(merged(roots, found))
    cells = apart_cells(keyed, roots, nodes, block)
    for _ in range(TURNS):
        more = saved(apart_pairs(cells, similarity, forest=True).join(near.union(tried), ["a", "b"], "left_anti"))
        n = more.count()
        if not n:
            break
        found = saved(checked_links(more, sets, similarity))
        tried, m = saved(tried.union(more)), found.count()
        if m:
            links, roots = saved(links.union(found)), saved(merged(roots, found))
            cells = apart_cells(keyed, roots, nodes, block)
        if m <= LEAST_FOUND * n:
            break
    left = saved(apart_pairs(cells, similarity).join(near.union(tried), ["a", "b"], "left_anti"))
    return links.union(checked_links(left, sets, similarity))


def near_duplicates(rows: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3, similarity: float | None = None, hot: int = 20_000) -> DataFrame:
    """``id_col``, fingerprint (hex) and component_id, the smallest id that links reach.

    With ``similarity`` texts link whose sets of shingles are that similar or more, and none is missed; ids are then unique, not null, and the same whenever ``rows`` is read.
    """
    if similarity is None:
        marked = saved(fingerprints(rows, id_col=id_col, text=text, words=words)).withColumn("fp", F.col("node"))
        nodes = saved(marked.groupBy("node", "fp").agg(F.min("id").alias("least")))
        edges = near_links(nodes, distance, hot)
    else:
        of = {"id_col": id_col, "text": text, "words": words}
        marked = saved(set_sketches(rows, frequent_shingles(rows, text=text, words=words), similarity, **of))
        nodes = saved(marked.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("map").alias("map"), F.first("n").alias("n")))
        edges = similar_links(marked, nodes, lambda used: sets_of(used, nodes, rows, **of), similarity, hot, min(BLOCK, hot))
    roots = saved(connected_components(edges))
    best = nodes.join(roots, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    moved = roots.join(best, "root").select("node", "component_id")
    final = saved(nodes.join(moved, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")))
    return marked.select("id", "node", "fp").join(final, "node").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
