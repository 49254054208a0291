"""Byte-level BPE by speculation and verification.

Words (as the tokenizer's own pattern splits them) are proposed a segmentation by
greedy longest match in the vocabulary. A segmentation is the one that BPE
gives if and only if each adjacent pair of its tokens is what BPE makes of these two
tokens' bytes alone. That test walks down the merges of the two tokens beside
their border and looks for a merge across it that would have come first; it runs
for all pairs of a batch of words at once, in numpy. Words with a
failing pair are merged exactly, by rank.

Each task keeps what it found for a word; the cache is emptied when it holds
CACHED words. Texts are processed whole. The tokenizer file is a parameter and is
read on each worker.

Cases: null texts count as empty (no tokens); strings of special tokens in a text give
that token's id, as the library's encoder does; repeated rows and long
texts need nothing special; null ids are kept; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

CACHED = 500_000
#: Words of up to so many bytes are merged together, longer ones one by one.
SHORT = 32
#: The splitting pattern that the byte-level pre-tokenizer fixes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII characters only.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Characters of text whose new words are looked at together.
TOGETHER = 4 << 20
NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Tables of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of = {bytes(letters[c] for c in s): i for s, i in model["vocab"].items() if s not in self.special}
        self.ids = of
        self.entries = ahocorasick.Automaton()
        for b, i in of.items():
            self.entries.add_word(b.decode("latin-1"), i)
        self.entries.add_word("\u0100", -1)
        self.entries.make_automaton()
        size = max([*of.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in of.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        # per token: the rank of the merge that makes it, and that merge's halves (itself if none)
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = (bytes(letters[c] for c in s) for s in (a, b))
            i, j, k = of[a], of[b], of[a + b]
            self.merges.setdefault((i, j), (r, k))
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        self.made_by = np.zeros(len(model["merges"]) + 1, dtype=np.int64)
        for r, k in self.merges.values():
            self.made_by[r] = k
        pairs = np.array([i * size + j for i, j in self.merges], dtype=np.int64)
        order = np.argsort(pairs)
        self.size, self.pairs = size, pairs[order]
        self.pair_rank = np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order]
        self.words = regex.compile(PATTERN)
        self.ascii_words = re.compile(ASCII_PATTERN)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # what is known of words: their ids in decimal, and the bytes of these ids
        self.ids_text = {s: str(i) for s, i in self.special.items()}
        self.raw = {s: s.encode() for s in self.special}

    def merged_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER if there is none."""
        if not len(self.pairs):
            return np.full(len(a), NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between each two tokens.

        Undo, again and again, whichever of the two tokens at the border was merged
        later. A merge across the border then would have won if its rank is lower than
        those of all merges undone on the side that it takes away from.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), dtype=bool)
        limit_a = np.full(len(a), NEVER)  # rank of the merge that next used the present left token
        limit_b = np.full(len(a), NEVER)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            across = self.merged_at(x, y)
            # the left token is taken by its own merge at limit_a before limit_b, and so on: first come; equal ranks go left to right
            bad = (across < NEVER) & (across <= limit_b[todo]) & (across < limit_a[todo])
            good[todo[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_x = rx >= ry
            stop = bad | ((rx < 0) & (ry < 0))
            go_x, go_y = todo[undo_x & ~stop], todo[~undo_x & ~stop]
            limit_a[go_x], a[go_x] = self.rank[a[go_x]], self.right[a[go_x]]
            limit_b[go_y], b[go_y] = self.rank[b[go_y]], self.left[b[go_y]]
            todo = todo[~stop]
        return good

    def proposed(self, raw: list[bytes]) -> list[list[int]]:
        """Greedy segmentation of each word: the longest vocabulary entry first, from the left."""
        border = "\u0100"  # beyond the 256 letters that stand for bytes
        text = border.join([w.decode("latin-1") for w in raw]) + border
        out: list[list[int]] = []
        now: list[int] = []
        for _, i in self.entries.iter_long(text):
            if i < 0:
                out.append(now)
                now = []
            else:
                now.append(i)
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first, with a heap over linked places."""
        import heapq

        ids = [self.ids[bytes([c])] for c in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.merges[p], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.merges]
        heapq.heapify(heap)
        while heap:
            _, k, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = k, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for s in (before[i], i):
                if s >= 0 and (t := after[s]) < n and (p := (ids[s], ids[t])) in self.merges:
                    heapq.heappush(heap, (*self.merges[p], s, *p))
        return [i for i in ids if i >= 0]

    def merged_together(self, raw: list[bytes]) -> list[list[int]]:
        """``exact`` for many short words: each round makes the first best merge of every word."""
        width = max(map(len, raw))
        ids = np.full((len(raw), width), -1, dtype=np.int64)
        byte_id = np.array([self.ids[bytes([c])] for c in range(256)], dtype=np.int64)
        for n in {len(w) for w in raw}:
            rows = [i for i, w in enumerate(raw) if len(w) == n]
            ids[rows, :n] = byte_id[np.frombuffer(b"".join(raw[i] for i in rows), dtype=np.uint8).reshape(len(rows), n)]
        ranks = np.where(ids[:, 1:] >= 0, self.merged_at(np.maximum(ids[:, :-1], 0), ids[:, 1:]), NEVER)
        ranks = np.concatenate([ranks, np.full((len(raw), 1), NEVER)], axis=1)
        made_by = self.made_by
        todo, columns = np.arange(len(raw)), np.arange(width)
        while len(todo):
            r = ranks[todo]
            at = r.argmin(1)
            least = r[np.arange(len(todo)), at]
            todo, at, least = todo[least < NEVER], at[least < NEVER], least[least < NEVER]
            if not len(todo):
                break
            x = np.concatenate([ids[todo], np.full((len(todo), 1), -1)], axis=1)
            r = np.concatenate([ranks[todo], np.full((len(todo), 1), NEVER)], axis=1)
            source = columns[None, :] + (columns[None, :] > at[:, None])
            x, r = np.take_along_axis(x, source, 1), np.take_along_axis(r, source, 1)
            every = np.arange(len(todo))
            x[every, at] = made_by[least]
            for near in (at - 1, at):
                ok = (near >= 0) & (near < width - 1)
                e, c = every[ok], near[ok]
                r[e, c] = np.where(x[e, c + 1] >= 0, self.merged_at(x[e, c], np.maximum(x[e, c + 1], 0)), NEVER)
            if len(ok) and (last := at == width - 1).any():
                r[every[last], at[last]] = NEVER
            ids[todo], ranks[todo] = x, r
        return [row[: n].tolist() for row, n in zip(ids, (ids >= 0).sum(1))]

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Ids of each word, and how many words failed the test."""
        raw = [w.encode() for w in words]
        got = self.proposed(raw)
        sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        flat = np.fromiter((i for g in got for i in g), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(got)), sizes)
        inside = owner[1:] == owner[:-1]
        wrong = ~self.compatible(flat[:-1][inside], flat[1:][inside])
        failed = np.unique(owner[1:][inside][wrong]).tolist()
        short = sorted((i for i in failed if len(raw[i]) <= SHORT), key=lambda i: len(raw[i]))  # like lengths together
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            for i, ids in zip(part, self.merged_together([raw[i] for i in part])):
                got[i] = ids
        for i in failed:
            if len(raw[i]) > SHORT:
                got[i] = self.exact(raw[i])
        return got, len(failed)

    def learn(self, texts_words: list[list[str]]) -> None:
        """Put the words that are not yet known into the cache."""
        new = list(set().union(*texts_words).difference(self.ids_text, self.special))
        if len(self.ids_text) + len(new) > CACHED:
            self.ids_text, self.raw = {s: str(i) for s, i in self.special.items()}, {s: s.encode() for s in self.special}
            new = list(set().union(*texts_words).difference(self.special))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            for w, ids in zip(part, self.encode_words(part)[0]):
                self.ids_text[w] = ",".join(map(str, ids))
                self.raw[w] = b"".join(map(self.bytes_of.__getitem__, ids))

    def split(self, text: str) -> list[str]:
        """Words and special tokens in order."""
        find = self.ascii_words.findall if text.isascii() else self.words.findall
        if self.parts is None or not any(map(text.__contains__, self.special)):
            return find(text)
        out: list[str] = []
        for piece in self.parts.split(text):
            if piece in self.special:
                out.append(piece)
            elif piece:
                out += find(piece)
        return out

    def encode_decode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each text's ids in decimal, joined by commas, and the bytes that the ids stand for."""
        at = 0
        while at < len(texts):
            words, size = [], 0
            while at < len(texts) and size < TOGETHER:
                words.append(self.split(texts[at]))
                size += len(texts[at])
                at += 1
            self.learn(words)
            ids_text, raw = self.ids_text.__getitem__, self.raw.__getitem__
            for w in words:
                yield ",".join(map(ids_text, w)), b"".join(map(raw, w))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, joined.split(","))) if joined else [] for joined, _ in self.encode_decode(texts)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_ids(rows: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ids (array<int>) of every text."""
    data = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(model.encode_batch(batch["t"].to_pylist()), pa.list_(pa.int32()))], ["id", "ids"])

    return data.mapInArrow(tidy(run), f"id {data.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def token_digests(rows: DataFrame, path: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, digest of the ids and of the text decoded from them."""
    data = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            n, ids, back = [], [], []
            for joined, raw in model.encode_decode(batch["t"].to_pylist()):
                n.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return data.mapInArrow(tidy(run), f"id {data.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
