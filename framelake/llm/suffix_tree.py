"""Language-model scores by a probabilistic suffix tree.

Symbols are the UTF-8 bytes of words, one that ends a word and one that ends the text. The
context of a symbol is what precedes it: within a word up to ``DEPTH`` symbols back
to the word's start; for a word's first two symbols (or the text's end) it
reaches over that start into the last ``TAIL`` bytes of the word before. A context is kept
if it occurs at least ``least`` times, a fixed number, so the tree grows with the corpus, and its next-symbol
distribution diverges from that of its longest kept suffix: count times Kullback-
Leibler divergence is at least ``min_gain`` nats. Each distribution is smoothed with its
suffix's (Witten-Bell). Every symbol is scored by the longest kept suffix of its context.

A text is a bag of units: its words, each with the symbols from the third on, and its borders, each a
word's first two symbols after the tail before them (or the text's end). A Spark aggregate counts the
distinct units of all texts, which also serves the unigram base. The tree is grown and units are scored in parts:
contexts of up to one symbol, not counting the word's start, are a small table (at most 780 contexts), and all longer
contexts with the same last two or three symbols lie in one part, as do the units' symbols there. A part holds distinct
units, so a frequent word or text makes none larger, and no part of the tree passes the driver.

``blended`` weighs a text's probability under the tree with the one under the unigram base, text by text, so that small corpora, whose
trees are shallow, score no worse than their words.

Texts are then scored by their units. Units that make up at least ``frequent`` of all units of their kind (so
at most 1/frequent of each) reach the tasks as a table; all others are joined.

Cases: null and empty texts consist of the end alone; repeated rows get equal results;
a text of any length is scored whole; extra columns are left out unless in ``keep``; an empty table gives no rows;
with no training text every count is zero and symbols are uniform.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, split_words, tidy

DEPTH, TAIL = 6, 3
BITS = 9
LOW = (1 << BITS) - 1
#: Symbols: byte + 1, then these. Zero means that there is none.
START, WORD_END, TEXT_END = 257, 258, 259
#: All but START can come next.
KINDS = 258
SPACE = 0x20
#: Distinct words that a task holds at once, and border codes that it merges at once.
FLUSH, MERGE = 300_000, 2_000_000
#: Bytes of text of a step, about.
STEP = 6 << 20
#: Units are numbered from zero in each of their table's partitions, above these bits.
ID_BITS = 33
#: Symbols of units in a part, about, and the least number of parts.
PART, PARTS = 400_000, 256


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about STEP bytes in column t."""
    ends = np.cumsum(pc.binary_length(batch["t"]).to_numpy())
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Numbers of the words met so far, with their last ``TAIL`` bytes and first two symbols as codes."""

    def __init__(self) -> None:
        self.at: defaultdict[bytes, int] = defaultdict()
        self.at.default_factory = self.at.__len__
        self.tails = self.heads = np.zeros(0, dtype=np.int64)

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers, text after text, and how many words each text has."""
        known = len(self.at)
        words, sizes = split_words(texts)
        distinct = words.dictionary_encode()
        spelled = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        out = np.fromiter(map(self.at.__getitem__, spelled), dtype=np.int64, count=len(spelled))[distinct.indices.to_numpy()]
        if len(self.at) > known:
            raw = list(islice(self.at, known, None))
            size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
            first = np.frombuffer(b"".join([w[:2].ljust(2) for w in raw]), dtype=np.uint8).reshape(-1, 2).astype(np.int64) + 1
            last = np.frombuffer(b"".join([w[-TAIL:].rjust(TAIL) for w in raw]), dtype=np.uint8).reshape(-1, TAIL).astype(np.int64) + 1
            tail = np.zeros(len(raw), dtype=np.int64)
            for k in range(TAIL):
                tail = tail << BITS | np.where(size >= TAIL - k, last[:, k], 0)
            self.tails = np.concatenate([self.tails, tail])
            self.heads = np.concatenate([self.heads, first[:, 0] << BITS | np.where(size > 1, first[:, 1], WORD_END)])
        return out, sizes

    def borders(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code (tail, s1, s2; nine bits a symbol) of each word's beginning and each text's end, and the text it lies in; s2 is zero after TEXT_END."""
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(ids) + len(sizes), dtype=bool)
        inside[ends] = False
        head, tail = np.full(len(inside), TEXT_END << BITS), np.zeros(len(inside), dtype=np.int64)
        head[inside] = self.heads[ids]
        tail[1:][inside[:-1]] = self.tails[ids]
        return tail << 2 * BITS | head, np.repeat(np.arange(len(sizes)), sizes + 1)


def border_unit(codes: np.ndarray) -> list[bytes]:
    """Borders as units: a space, which no word has, and the code."""
    return [b" %d" % c for c in codes.tolist()]


def counted(rows: DataFrame, text: str, train: Column) -> DataFrame:
    """(unit, n, n_all): how often each unit occurs in the training rows and in all rows."""

    def packed(units: list, n: np.ndarray, n_all: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(n, pa.int64()), pa.array(n_all, pa.int64())], ["unit", "n", "n_all"])

    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, n, n_all = (np.concatenate(c) for c in zip(*parts))
        some, back = np.unique(code, return_inverse=True)
        return some, np.bincount(back, weights=n, minlength=len(some)), np.bincount(back, weights=n_all, minlength=len(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, borders, held = Words(), [], 0
        n = n_all = np.zeros(0)

        def flushed() -> Iterator[pa.RecordBatch]:
            if words.at:
                yield packed(list(words.at), n.astype(np.int64), n_all.astype(np.int64))
            if borders:
                code, m, m_all = merged(borders)
                yield packed(border_unit(code), m.astype(np.int64), m_all.astype(np.int64))

        for whole in batches:
            for batch in steps(whole):
                known = batch["train"].to_numpy(zero_copy_only=False).astype(float)
                ids, sizes = words.numbers(batch["t"])
                k = len(words.at)
                n, n_all = (np.concatenate([v, np.zeros(k - len(v))]) for v in (n, n_all))
                n += np.bincount(ids, weights=np.repeat(known, sizes), minlength=k)
                n_all += np.bincount(ids, minlength=k)
                code, owner = words.borders(ids, sizes)
                borders.append(merged([(code, known[owner], np.ones(len(code)))]))
                held += len(borders[-1][0])
                if held > MERGE and len(borders) > 1:
                    borders = [merged(borders)]
                    held = len(borders[0][0])
                if k > FLUSH or held > MERGE:
                    yield from flushed()
                    words, borders, held = Words(), [], 0
                    n = n_all = np.zeros(0)
        yield from flushed()

    data = rows.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    return data.mapInArrow(tidy(run), "unit string, n long, n_all long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def word_symbols(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, context, symbol) of each word's symbols from the third on, with the longest context."""
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 2
    ends = np.cumsum(sizes)
    x = np.full(int(sizes.sum()), START, dtype=np.int64)
    place = np.ones(len(x), dtype=bool)
    place[ends - 1] = place[ends - sizes] = False
    x[place] = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64) + 1
    x[ends - 1] = WORD_END
    owner = np.repeat(np.arange(len(raw)), sizes)
    room = np.arange(len(x)) - (ends - sizes)[owner]  # symbols before it, START included
    i = np.flatnonzero(room >= 3)
    context = np.zeros(len(i), dtype=np.int64)
    for k in range(1, DEPTH + 1):
        context |= np.where(room[i] >= k, x[np.maximum(i - k, 0)], 0) << BITS * (k - 1)
    return owner[i], context, x[i]


def border_symbols(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, context, symbol) of both symbols of each border, with the longest context."""
    s2, s1, tail = code & LOW, code >> BITS & LOW, code >> 2 * BITS
    two = np.flatnonzero(s2)
    context = tail << BITS | START
    return np.concatenate([np.arange(len(code)), two]), np.concatenate([context, context[two] << BITS | s1[two]]), np.concatenate([s1, s2[two]])


def unit_symbols(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, context, symbol) of all units."""
    is_border = np.fromiter((u[0] == SPACE for u in units), dtype=bool, count=len(units))
    a, b = np.flatnonzero(~is_border), np.flatnonzero(is_border)
    parts = []
    if len(a):
        row, context, symbol = word_symbols([units[i] for i in a.tolist()])
        parts.append((a[row], context, symbol))
    if len(b):
        row, context, symbol = border_symbols(np.array([int(units[i]) for i in b.tolist()], dtype=np.int64))
        parts.append((b[row], context, symbol))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64),) * 3


def extended(context: np.ndarray, symbol: np.ndarray, n: np.ndarray, before: np.ndarray, least: int, min_gain: float) -> np.ndarray:
    """Each symbol's probability once the given contexts (one of each symbol) are added to the tree, if they are kept.

    ``before`` is the probability by the longest kept proper suffix. Rows may repeat a context and symbol; n adds up.
    """
    pair, first, back = np.unique(context << BITS | symbol, return_index=True, return_inverse=True)
    c, p = np.bincount(back, weights=n, minlength=len(pair)), before[first]
    state, of = np.unique(pair >> BITS, return_inverse=True)
    total, kinds = np.bincount(of, weights=c, minlength=len(state)), np.bincount(of, weights=c > 0, minlength=len(state))
    share = np.where(c > 0, c, 1) / np.maximum(total, 1)[of]
    gain = np.bincount(of, weights=np.where(c > 0, c * np.log(share / p), 0.0), minlength=len(state))
    kept = (total >= least) & (gain >= min_gain)
    new = (c + kinds[of] * p) / np.maximum(total + kinds, 1)[of]
    return np.where(kept[of], new, p)[back]


def group_of(context: np.ndarray) -> np.ndarray:
    """The number of the shallow context: the last symbol; with 260 added to it the symbol before START, and with 520 the symbol after START."""
    last, before = context & LOW, context >> BITS & LOW
    return np.where((last == START) & (before > 0), 260 + before, np.where(before == START, 520 + last, last))


def shallow(group: np.ndarray, symbols: np.ndarray, n: np.ndarray, least: int, min_gain: float) -> np.ndarray:
    """Probabilities (780, 260) of all symbols by all shallow contexts, from the counts by ``group_of``."""
    counts = np.zeros((780, 260))
    np.add.at(counts, (group, symbols), n)
    every = np.arange(780)
    last = np.where(every < 260, every, np.where(every < 520, START, every - 520))
    possible = np.array([s for s in range(1, 260) if s != START])
    single = np.zeros((260, 260))
    np.add.at(single, last, counts)
    c = single.sum(0)[possible]
    root = (c + np.count_nonzero(c) / KINDS) / (c.sum() + np.count_nonzero(c)) if c.sum() else np.full(KINDS, 1 / KINDS)

    def grown(contexts: np.ndarray, table: np.ndarray, before: np.ndarray) -> np.ndarray:
        out = np.ones_like(table)
        symbol = np.tile(possible, len(table))
        out[:, possible] = extended(np.repeat(contexts, KINDS), symbol, table[:, possible].ravel(), before.ravel(), least, min_gain).reshape(len(table), KINDS)
        return out

    first = grown(np.arange(260), single, np.tile(root, 260))
    pairs = every >= 260
    two = np.where(every < 520, (every - 260) << BITS | START, START << BITS | (every - 520))[pairs]
    return np.concatenate([first, grown(two, counts[pairs], first[last[pairs]][:, possible])])


def probabilities(context: np.ndarray, symbol: np.ndarray, n: np.ndarray, first: np.ndarray, least: int, min_gain: float) -> np.ndarray:
    """Each symbol's probability by the longest kept suffix of its context, from ``first`` (those by shallow contexts) on.

    The rows must be all of their parts (``part_of``).
    """
    group = group_of(context)
    p = first[group, symbol]
    for d in range(2, DEPTH + 1):
        i = np.flatnonzero((context >> BITS * (d - 1) > 0) & ((d > 2) | (group < 260)))
        if len(i):
            p[i] = extended(context[i] & ((1 << BITS * d) - 1), symbol[i], n[i], p[i], least, min_gain)
    return p


def part_of(context: np.ndarray, parts: int) -> np.ndarray:
    """Contexts that share their last two symbols, three if START is one of these two, are in the same part."""
    three = group_of(context) >= 260
    key = context & np.where(three, (1 << 3 * BITS) - 1, (1 << 2 * BITS) - 1)
    return (key * 0x9E3779B1 >> 7) % parts


def unit_scores(units: DataFrame, least: int, min_gain: float) -> DataFrame:
    """``units`` (id, unit, n and more; a written table) with ``rest``: the log10 probability of the unit's symbols."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, context, symbol = unit_symbols(b["unit"].to_pylist())
            code, back = np.unique(group_of(context) << BITS | symbol, return_inverse=True)
            n = np.bincount(back, weights=b["n"].to_numpy()[row], minlength=len(code)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    named = units.select("id", F.col("unit").cast("binary").alias("unit"), "n")
    # at most 780 times 258 rows
    small = named.select("unit", "n").mapInArrow(tidy(pairs), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code = small["code"].to_numpy()
    first = units.sparkSession.sparkContext.broadcast(shallow(code >> BITS, code & LOW, small["n"].to_numpy(), least, min_gain))
    parts = max(PARTS, 6 * units.count() // PART)

    def sliced(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
        """One row for each value of ``part``, with the columns' values as bytes."""
        order = np.argsort(part, kind="stable")
        key, start = np.unique(part[order], return_index=True)
        ends = [*start[1:].tolist(), len(part)]
        cols = [[c[a:b].tobytes() for a, b in zip(start.tolist(), ends)] for c in (c[order] for c in columns)]
        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c, pa.binary()) for c in cols)], ["part", *names])

    def joined(t: pa.Table, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(t[name].to_pylist()), dtype=kind)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            ids, context, symbol, n = (np.concatenate(c) for c in zip(*held))
            yield from sliced(part_of(context, parts), [ids, context, symbol.astype(np.int16), n], ["ids", "context", "symbol", "n"])

        for b in batches:
            row, context, symbol = unit_symbols(b["unit"].to_pylist())
            held.append((b["id"].to_numpy()[row], context, symbol, b["n"].to_numpy()[row]))
            size += len(row)
            if size > PART:
                yield from flushed()
                held, size = [], 0
        if size:
            yield from flushed()

    def scored(t: pa.Table) -> pa.Table:
        ids, context, n = (joined(t, c, np.int64) for c in ("ids", "context", "n"))
        logs = np.log10(probabilities(context, joined(t, "symbol", np.int16).astype(np.int64), n, first.value, least, min_gain))
        some, back = np.unique(ids, return_inverse=True)
        return pa.Table.from_batches(sliced(some >> ID_BITS, [some, np.bincount(back, weights=logs, minlength=len(some))], ["ids", "logs"]))

    def summed(t: pa.Table) -> pa.Table:
        some, back = np.unique(joined(t, "ids", np.int64), return_inverse=True)
        return pa.table({"id": some, "rest": np.bincount(back, weights=joined(t, "logs", np.float64), minlength=len(some))})

    by_part = named.mapInArrow(tidy(items), "part long, ids binary, context binary, symbol binary, n binary").groupBy("part").applyInArrow(scored, "part long, ids binary, logs binary")
    found = by_part.groupBy("part").applyInArrow(summed, "id long, rest double")  # here a part is a range of ids
    return units.join(found, "id", "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))


@dataclass(frozen=True)
class Corpus:
    """What is learned: the table (unit, n, rest) of all distinct units, the totals, and (unit, n, rest) of the frequent ones."""

    units: DataFrame
    total: int
    distinct: int
    texts: int
    frequent: pa.Table


def learn(rows: DataFrame, train: Column, *, text: str = "text", least: int = 20, min_gain: float = 6.0, frequent: float = 1e-6) -> Corpus:
    """Learn from the rows that ``train`` marks; the other rows' units are listed with count zero."""
    is_word = ~F.startswith(F.col("unit"), F.lit(" "))
    of = saved(counted(rows, text, train).withColumn("id", F.monotonically_increasing_id()))
    texts = rows.where(train).count()
    n, v, words, borders = of.agg(
        F.coalesce(F.sum(F.when(is_word, F.col("n"))), F.lit(0)), F.count_if(is_word & (F.col("n") > 0)), F.coalesce(F.sum(F.when(is_word, F.col("n_all"))), F.lit(0)), F.coalesce(F.sum(F.when(~is_word, F.col("n_all"))), F.lit(0))
    ).first()
    units = saved(unit_scores(of, least, min_gain).select("unit", "n", "rest", "n_all"))
    # at most 1/frequent units of each kind
    often = units.where(F.col("n_all") >= frequent * F.when(is_word, F.lit(words)).otherwise(F.lit(borders))).drop("n_all").toArrow()
    return Corpus(units.drop("n_all"), n + texts, v + (texts > 0), texts, often)


def scores(rows: DataFrame, corpus: Corpus, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens, n_known, base_score and score of rows that ``learn`` has read."""
    model = rows.sparkSession.sparkContext.broadcast(corpus.frequent)
    bottom, texts = corpus.total + 0.1 * (corpus.distinct + 1), corpus.texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = model.value
        unit, n, rest = often["unit"].cast(pa.binary()).to_pylist(), often["n"].to_numpy(), often["rest"].to_numpy()
        is_border = np.fromiter((u[0] == SPACE for u in unit), dtype=bool, count=len(unit))
        code = np.array([int(u) for u in unit if u[0] == SPACE], dtype=np.int64)
        order = np.argsort(code)
        code, across = code[order], rest[is_border][order]
        place = {u: i for i, u in enumerate(u for u in unit if u[0] != SPACE)}
        n, rest = n[~is_border], rest[~is_border]
        base = np.log10((n + 0.1) / bottom)
        end = math.log10((texts + 0.1) / bottom)
        part, row = TaskContext.get().partitionId() << 40, 0
        words = Words()
        where = np.zeros(0, dtype=np.int64)  # the frequent word of each word met, -1 if it is rare
        for whole in batches:
            for batch in steps(whole):
                if len(words.at) > FLUSH:
                    words, where = Words(), where[:0]
                ids, sizes = words.numbers(batch["t"])
                if len(words.at) > len(where):
                    where = np.concatenate([where, np.array([place.get(w, -1) for w in list(words.at)[len(where) :]], dtype=np.int64)])
                docs = len(sizes)
                owner, at = np.repeat(np.arange(docs), sizes), where[ids]
                hit = np.flatnonzero(at >= 0)
                owner_hit, at_hit = owner[hit], at[hit]
                sums = [np.bincount(owner_hit, weights=v[at_hit], minlength=docs) for v in (base, rest, n > 0)]
                rare: list[Counter] = [Counter() for _ in range(docs)]
                spelled = list(words.at)
                for d, w in zip(owner[at < 0].tolist(), ids[at < 0].tolist()):
                    rare[d][spelled[w]] += 1
                border, owner = words.borders(ids, sizes)
                found = np.minimum(np.searchsorted(code, border), max(0, len(code) - 1))
                hit = code[found] == border if len(code) else np.zeros(len(border), dtype=bool)
                sums[1] = sums[1] + np.bincount(owner[hit], weights=across[found[hit]], minlength=docs)
                for d, u in zip(owner[~hit].tolist(), border_unit(border[~hit])):
                    rare[d][u] += 1
                listed = pa.array([list(c) for c in rare], pa.list_(pa.string())), pa.array([list(c.values()) for c in rare], pa.list_(pa.int32()))
                rows_ = pa.array(np.arange(row, row + docs) | part)
                row += docs
                cols = [rows_, pa.array(sizes + 1), pa.array(sums[2].astype(np.int64) + int(texts > 0)), pa.array(sums[0] + end, pa.float64()), pa.array(sums[1], pa.float64()), *listed, batch["own"]]
                yield pa.RecordBatch.from_arrays(cols, ["row", "n_tokens", "known", "base", "score", "rare", "times", "own"])

    data = rows.select(F.struct(*keep).alias("own"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    kind = data.schema["own"].dataType.simpleString()
    done = saved(data.mapInArrow(tidy(run), f"row long, n_tokens long, known long, base double, score double, rare array<string>, times array<int>, own {kind}"))
    rare = done.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("unit"), F.col("x.times").alias("c"))
    joined = rare.join(corpus.units, "unit")  # every unit of every row is in the table
    is_word = ~F.startswith(F.col("unit"), F.lit(" "))
    sums = joined.groupBy("row").agg(
        F.sum(F.when(is_word, F.col("c") * F.log10((F.col("n") + F.lit(0.1)) / F.lit(bottom)))).alias("base_more"), F.sum(F.when(is_word & (F.col("n") > 0), F.col("c")).otherwise(0)).alias("known_more"), F.sum(F.col("c") * F.col("rest")).alias("more")
    )
    both = done.drop("rare", "times").join(sums, "row", "left")
    return both.select("own.*", "n_tokens", (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def blended(found: DataFrame, prior: float = 0.5) -> DataFrame:
    """``scores`` with ``score`` the log10 probability of a text that comes from the tree (``tree_score``), or with ``prior`` from the words' base.

    The tree and the base are weighed text by text: no text's score is lower than the better one's by more than log10 of the smaller share.
    """
    tree, base = F.col("score") + F.lit(math.log10(1 - prior)), F.col("base_score") + F.lit(math.log10(prior))
    best = F.greatest(tree, base)
    return found.withColumns({"tree_score": F.col("score"), "score": best + F.log10(1 + F.pow(F.lit(10.0), F.least(tree, base) - best))})
