"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a word from both ends and labels every position with a
distribution over languages; a document's probabilities are the mean over all its
labelled positions. White space, ASCII digits and punctuation are not positions: words are runs of characters that are neither white space nor
ASCII digits or punctuation, and are cut after ``LONGEST`` bytes (the rest is
labelled as further pieces). The network starts anew at each word, so a label depends on its word alone, and each task runs the
network once for a word that it meets again and again.

Training is numpy: cross-entropy at every position, gradients by backpropagation
through time, Adam. It uses at most ``max_train`` documents of each language,
those whose hash of the id is smallest.

Cases: null texts and texts without a letter give ``und`` with score 0; so does every
text if there is nothing to learn from; ties go to the language first in order; texts of any length are
read whole; repeated rows get equal results, and each learns from its own text and lang, whatever ids repeat; rows with a null id
are labelled and learned from like others; an empty table gives no rows; extra columns are left out unless in ``keep``.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

LONGEST = 32
CACHED = 300_000
#: In UTF-8, ASCII punctuation and digits become spaces and all else stays.
SPACE = bytes.maketrans((string.punctuation + string.digits).encode(), b" " * len(string.punctuation + string.digits))


def pieces(text: str) -> list[str]:
    return text.lower().encode("utf-8", "replace").translate(SPACE).decode().split()


def cut(word: bytes) -> list[bytes]:
    """A word in the pieces that the network reads."""
    return [word[a : a + LONGEST] for a in range(0, len(word), LONGEST)]


@dataclass
class Network:
    """Two gated layers of width h, one for each direction; a gate has columns for update, reset and candidate."""

    langs: list[str]
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(langs: list[str], h: int, seed: int) -> Network:
        r = np.random.default_rng(seed)
        p = {"out": r.normal(0, 0.1, (2 * h, len(langs))), "bias": np.zeros(len(langs))}
        for d in "fb":
            p |= {f"{d}x": r.normal(0, 0.3, (256, 3 * h)), f"{d}h": r.normal(0, h**-0.5, (h, 3 * h)), f"{d}c": np.zeros(h)}
        return Network(langs, {k: v.astype(np.float32) for k, v in p.items()})

    def run(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each position, (time, words, h), in the order of the text."""
        wx, wh, c = self.p[f"{d}x"], self.p[f"{d}h"], self.p[f"{d}c"]
        n, steps, h = x.shape[0], x.shape[1], wh.shape[0]
        out = np.empty((steps, n, h), dtype=np.float32)
        state = np.zeros((n, h), dtype=np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, b = wx[x[:, t]], state @ wh
            gate = 0.5 * np.tanh(0.5 * (a[:, : 2 * h] + b[:, : 2 * h])) + 0.5
            z, r = gate[:, :h], gate[:, h:]
            inner = b[:, 2 * h :] + c
            g = np.tanh(a[:, 2 * h :] + r * inner)
            new = g + z * (state - g)
            if keep is not None:
                keep.append((t, state, z, r, g, inner))
            out[t] = state = new
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Distribution over languages at each position: (time, words, languages)."""
        s = np.concatenate([self.run("f", x), self.run("b", x)], axis=2) @ self.p["out"] + self.p["bias"]
        e = np.exp(s - s.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over positions of words of equal length."""
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.run(d, x, kept[d]) for d in "fb"], axis=2)
        s = both @ self.p["out"] + self.p["bias"]
        e = np.exp(s - s.max(2, keepdims=True))
        delta = e / e.sum(2, keepdims=True)
        delta[:, np.arange(len(y)), y] -= 1
        delta /= delta.shape[0] * delta.shape[1]
        h = both.shape[2] // 2
        grad = {"out": np.einsum("tnh,tnl->hl", both, delta), "bias": delta.sum((0, 1))}
        back = delta @ self.p["out"].T
        for d, own in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            wh = self.p[f"{d}h"]
            gx, gh, gc = np.zeros_like(self.p[f"{d}x"]), np.zeros_like(wh), np.zeros(h, dtype=np.float32)
            carried = np.zeros_like(own[0])
            for t, state, z, r, g, inner in reversed(kept[d]):
                dh = own[t] + carried
                dg = dh * (1 - z) * (1 - g * g)
                dz = dh * (state - g) * z * (1 - z)
                dinner = dg * r
                dr = dg * inner * r * (1 - r)
                da = np.concatenate([dz, dr, dg], axis=1)
                db = np.concatenate([dz, dr, dinner], axis=1)
                np.add.at(gx, x[:, t], da)
                gh += state.T @ db
                gc += dinner.sum(0)
                carried = dh * z + db @ wh.T
            grad |= {f"{d}x": gx, f"{d}h": gh, f"{d}c": gc}
        return grad

    def train(self, words: list[bytes], labels: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> None:
        by: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by[len(w)].append(i)
        sizes = sorted(by)
        share = np.array([len(by[n]) for n in sizes], dtype=float)
        r = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            n = sizes[r.choice(len(sizes), p=share / share.sum())]
            rows = r.choice(by[n], size=min(batch, len(by[n])))
            x = np.frombuffer(b"".join(words[i] for i in rows), dtype=np.uint8).reshape(len(rows), n)
            now = rate * min(1.0, 4 * (1 - step / (steps + 1)))
            for k, g in self.gradients(x, labels[rows]).items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                self.p[k] -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


class Labeller:
    """Sums of position probabilities by word, kept from batch to batch."""

    def __init__(self, net: Network) -> None:
        self.net, self.at = net, {}
        self.sums = np.zeros((0, len(net.langs) + 1), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        parts: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for i, w in enumerate(raw):
            for p in cut(w):
                parts[len(p)].append((i, p))
        new = np.zeros((len(words), self.sums.shape[1]), dtype=np.float32)
        for n, items in parts.items():
            for a in range(0, len(items), 8192):
                some = items[a : a + 8192]
                x = np.frombuffer(b"".join(p for _, p in some), dtype=np.uint8).reshape(len(some), n)
                owner = np.array([i for i, _ in some])
                np.add.at(new[:, :-1], owner, self.net.positions(x).sum(0))
                np.add.at(new[:, -1], owner, n)
        start = len(self.sums)
        self.at.update(zip(words, range(start, start + len(words))))
        self.sums = np.concatenate([self.sums, new])

    def label(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < 4 << 20:
                words = pieces(texts[at] or "")
                split.append(words)
                size += len(texts[at] or "")
                at += 1
            new = set().union(*split).difference(self.at)
            if len(self.at) + len(new) > CACHED:
                self.at, self.sums = {}, self.sums[:0]
                new = set().union(*split)
            if new:
                self.learn(list(new))
            for words in split:
                rows = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
                total = self.sums[rows].sum(0, dtype=np.float64)
                if not len(rows) or not any(map(has_letter, words)):
                    yield "und", 0.0
                else:
                    best = int(total[:-1].argmax())
                    yield self.net.langs[best], float(min(1.0, total[best] / total[-1]))


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def learn(docs: DataFrame, *, usable: Column | None = None, max_train: int = 150, hidden: int = 16, steps: int = 500, batch: int = 256, rate: float = 0.02, seed: int = 7) -> Network | None:
    """Fit a network to text and lang of usable rows; None if there are none.

    At most ``max_train`` documents of each language (all languages that occur take part), with all their words. Documents are those whose hash of id and language is smallest, then of the text.
    """
    rows = docs.where((F.lit(True) if usable is None else usable) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "lang").alias("h"))
    first = lambda *order: F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    # one row a language; each task passes on max_train rows of a language at most
    last = rows.select("lang", "h").withColumn("n", first("h")).where(F.col("n") <= max_train).groupBy("lang").agg(F.max("h").alias("last"))
    near = rows.join(F.broadcast(last), "lang").where("h <= last")
    sample = near.withColumn("n", first("h", F.xxhash64("text"), "text")).where(F.col("n") <= max_train)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(lang, w) for t, lang in zip(b["text"], b["lang"].to_pylist()) for w in set(pieces(t.as_py() or "")) if has_letter(w)]
            cols = list(zip(*out)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["lang", "word"])

    pairs = sample.select("text", "lang").mapInArrow(words, "lang string, word string").groupBy("lang", "word").count()
    rows = pairs.orderBy("lang", F.desc("count"), F.xxhash64("word"), "word").toArrow()  # the words of at most max_train documents of each language
    names = sorted(set(rows["lang"].to_pylist()))
    if not names:
        return None
    net = Network.fresh(names, hidden, seed)
    parts = [cut(w.encode("utf-8", "replace")) for w in rows["word"].to_pylist()]
    spelled, number = [p for w in parts for p in w], {v: i for i, v in enumerate(names)}
    repeats = list(map(len, parts))
    of = np.repeat([number[v] for v in rows["lang"].to_pylist()], repeats)
    # languages count alike, and frequent words more than rare ones
    weight = np.sqrt(np.repeat(rows["count"].to_numpy(), repeats).astype(float))
    for i in range(len(names)):
        weight[of == i] /= weight[of == i].sum()
    r = np.random.default_rng(seed)
    drawn = r.choice(len(spelled), size=steps * batch, p=weight / weight.sum())
    net.train([spelled[i] for i in drawn], of[drawn], steps, batch, rate, seed)
    return net


def languages(rows: DataFrame, net: Network | None, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score of every row."""
    if net is None:
        return rows.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    inside = text in keep  # then it travels once
    data = rows.select(F.struct(*keep).alias("own"), *([] if inside else [F.col(text).alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net)
        for b in batches:
            cols = list(zip(*labeller.label((b["own"].field(text) if inside else b["text"]).to_pylist()))) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), b["own"]], ["lang_pred", "score", "own"])

    return data.mapInArrow(tidy(run), f"lang_pred string, score double, own {data.schema['own'].dataType.simpleString()}").select("own.*", "lang_pred", "score")
