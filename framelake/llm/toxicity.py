"""Toxicity by a weighted lexicon.

Texts are brought to compatibility form (NFKC: full-width and mathematical letters become plain
ones), lower-cased and folded: look-alike letters of other scripts and digits
standing for letters become the plain letter (``1`` and ``l`` count as ``i``). Capitals are
folded before lower-casing, as their small letters can look otherwise. An
Aho-Corasick automaton finds the lexicon's entries at word borders: whole words, and
stems that open many toxic words. Hits inside an exception phrase do not count. The
sum of weights, alone and per 1000 words, goes through a fitted logistic function.

Lexicon, exceptions and function are learned from at most ``max_train``
labelled rows (those whose hash of the id is smallest); term counts are a Spark
aggregate, what reaches the driver is bounded by the terms of ``max_train`` labelled rows.

Cases: null and empty texts have no hits and the score of such texts; without both
labels in the training rows ``DEFAULT_TERMS`` serve; repeated rows get equal scores, and of
documents that share an id one text is learned from; null ids are scored and not learned from; texts of any length are read
whole; an empty table gives no rows; extra columns are left out unless in ``keep``.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, tidy

#: Homoglyphs (Cyrillic, Greek, Armenian, Latin) and digit substitutions, each with the plain letter it is read as.
FOLD = dict(zip("0134578" "аеорсухіјѕԁһ" "вкмнтԛԝӏүԍ" "αοεικνρτυ" "βηχγω" "օսհոցզ" "ıɑɡ" "l", "oieastb" "aeopcyxijsdh" "bkmhtqwiyg" "aoeiknptu" "bnxyw" "ouhngq" "iag" "i"))
#: Capitals (Cyrillic, Greek, Cherokee) by their own shape, and letters that NFKC would turn into others.
CAPITALS = dict(zip("АВЕКМНОРСТУХІЈЅԀԚԜӀҮԌ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏔᏃ" "ϲϹϳ", "abekmhopctyxijsdqwiyg" "abezhikmnoptyx" "abcdeghjklmprstvwz" "ccj"))
#: Tables for bytes are fast on every text; other characters are replaced one by one where there are any.
FOLD_BYTES = bytes.maketrans(*("".join(c).encode() for c in zip(*((k, v) for k, v in FOLD.items() if k.isascii()))))
FOLD_OTHERS, ANY_CAPITAL = re.compile("[" + "".join(k for k in FOLD if not k.isascii()) + "]"), re.compile("[" + "".join(CAPITALS) + "]")
SYMBOLS = re.compile(r"(?<=\w)[@$](?=\w)")
WORDS = re.compile(r"[^\W_]+")
STEM = 5
#: A stem stands for itself only if it opens at least so many different toxic words.
STEM_WORDS = 4
DEFAULT_TERMS = {"idiot": 4.0, "moron": 4.0, "stupid": 3.0, "scum": 4.0}
#: Harmless uses known beforehand.
DEFAULT_EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish")


def folded(text: str) -> str:
    if not text.isascii():
        shaped = lambda t: ANY_CAPITAL.sub(lambda m: CAPITALS[m[0]], t)
        text = shaped(unicodedata.normalize("NFKC", shaped(text)))
    text = text.lower()
    if "@" in text or "$" in text:
        text = SYMBOLS.sub(lambda m: "a" if m[0] == "@" else "s", text)
    if not text.isascii():
        text = FOLD_OTHERS.sub(lambda m: FOLD[m[0]], text)
    return text.encode("utf-8", "replace").translate(FOLD_BYTES).decode()


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...] = ()
    #: Intercept, slope of log(1 + sum), slope of log(1 + sum per 1000 words).
    line: tuple[float, float, float] = (-4.0, 1.5, 0.5)
    key: str = field(default="")


@lru_cache(maxsize=1)
def automaton(key: tuple) -> ahocorasick.Automaton:
    words, stems, exceptions = key
    a = ahocorasick.Automaton()
    for kind, items in ((2, exceptions), (1, stems), (0, words)):
        for term, weight in items:
            old = a.get(term, ())
            a.add_word(term, (*old, (kind, len(term), weight)))
    if len(a):
        a.make_automaton()
    return a


def machine(model: Model) -> ahocorasick.Automaton:
    return automaton((tuple(model.words.items()), tuple(model.stems.items()), tuple((folded(e), 0.0) for e in model.exceptions)))


def hits(text: str, found: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """start, end and weight of each counted hit in a folded text; a word hit replaces a stem hit at its place."""
    if not len(found):
        return []
    words: dict[int, tuple[int, float]] = {}
    stems: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    n = len(text)
    for last, entries in found.iter(text):
        for kind, size, weight in entries:
            start, end = last - size + 1, last + 1
            if start and text[start - 1].isalnum():
                continue
            if kind == 1:
                stems[start] = (end, weight)
            elif end == n or not text[end].isalnum():
                if kind == 2:
                    spared.append((start, end))
                else:
                    words[start] = (end, weight)
    out, spared, farthest, at = [], sorted(spared), 0, 0
    for s, (e, w) in sorted({**stems, **words}.items()):
        while at < len(spared) and spared[at][0] <= s:  # the farthest end of the exceptions that begin by here
            farthest = max(farthest, spared[at][1])
            at += 1
        if e > farthest:
            out.append((s, e, w))
    return out


def features(text: str, found: ahocorasick.Automaton) -> tuple[float, float]:
    """log(1 + sum of weights), alone and per 1000 words."""
    t = folded(text)
    total = sum(w for _, _, w in hits(t, found))
    if not total:
        return 0.0, 0.0
    return math.log1p(total), math.log1p(1000 * total / (len(t.split()) + 1))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a ridge."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, keep = np.zeros(3), np.diag([1e-3, ridge, ridge])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + keep, a.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, max_train: int) -> DataFrame:
    """text and toxic of at most ``max_train`` labelled rows."""
    ids = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y"))
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # at most max_train rows of two numbers: a bounded broadcast; of documents of one id the text whose hash is smallest
    known = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    return known.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "y")


FOLDS = 2


def lexicon(counts: DataFrame, folds: tuple[int, ...], least: int, exceptions: tuple[str, ...]) -> Model | None:
    """The terms that ``counts`` (term, y, fold, n) of these folds give; None if one of the classes is missing. The labelled rows bound their number."""
    of = lambda y: F.sum(F.when((F.col("y") == 1) == bool(y), F.col("n")).otherwise(0))
    some = counts.where(F.col("fold").isin(*folds)).groupBy("term").agg(of(1).alias("n1"), of(0).alias("n0"))
    total = some.where("term = ''").first()
    if total is None or not total.n1 or not total.n0:
        return None
    weight = F.log((F.col("n1") + 0.5) / (total.n1 + 1)) - F.log((F.col("n0") + 0.5) / (total.n0 + 1))
    single = some.where("term != '' and instr(term, ' ') = 0")
    toxic = single.withColumn("w", weight).where((F.col("n1") >= least) & (F.col("w") > 3.0)).select("term", "w")
    stems = (
        single.where(F.length("term") > STEM).groupBy(F.substring("term", 1, STEM).alias("stem"))
        .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count_if(F.col("n1") > 1).alias("k"))
        .where((F.col("k") >= STEM_WORDS) & (F.col("n1") >= 4 * least)).withColumn("w", weight).where("w > 4.0").orderBy("stem").collect()
    )
    # harmless words behind a toxic one
    behind = some.where((F.instr("term", " ") > 0) & (F.col("n0") >= least)).withColumn("first", F.split("term", " ")[0])
    pairs = behind.join(toxic.select(F.col("term").alias("first")), "first", "left_semi").orderBy("term").collect()
    return Model({r.term: float(r.w) for r in toxic.orderBy("term").collect()}, {r.stem: float(r.w) for r in stems}, (*exceptions, *(r.term for r in pairs)))


def learn(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, max_train: int = 6000, least: int = 5, exceptions: tuple[str, ...] = DEFAULT_EXCEPTIONS) -> Model:
    """Fit a model. ``usable``: which rows of ``labels`` (doc_id, toxic) may be used.

    The logistic line is fitted to features that a lexicon of the other fold gives, so that it sees texts as new ones are seen; the lexicon then comes from both.
    """
    train = saved(training_rows(docs, labels, F.lit(True) if usable is None else usable, max_train).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[int, int], Counter] = {}
        for batch in batches:
            for t, y, fold in zip(batch["text"], batch["y"].to_pylist(), batch["fold"].to_pylist()):
                words = WORDS.findall(folded(t.as_py()))
                terms = set(words)
                terms |= {f"{a} {b}" for a, b in zip(words, words[1:])} if y == 0 else set()
                own = n.setdefault((int(y == 1), fold), Counter())
                own.update(terms)
                own[""] += 1
        rows = [(t, y, fold, c) for (y, fold), found in n.items() for t, c in found.items()]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["term", "y", "fold", "n"])

    counts = train.mapInArrow(count, "term string, y int, fold int, n long").groupBy("term", "y", "fold").agg(F.sum("n").alias("n"))
    counts = saved(counts)
    every = lexicon(counts, tuple(range(FOLDS)), least, exceptions)
    if every is None:
        return Model({folded(w): v for w, v in DEFAULT_TERMS.items()}, {}, exceptions)
    x, y = [], []
    for fold in range(FOLDS):
        others = lexicon(counts, tuple(f for f in range(FOLDS) if f != fold), least, exceptions) or every
        rows = train.where(F.col("fold") == fold).mapInArrow(featured(others, ["y"]), "a double, b double, y int").toArrow()  # three numbers for each labelled row
        x.append(np.stack([rows["a"].to_numpy(), rows["b"].to_numpy()], axis=1))
        y.append(rows["y"].to_numpy().astype(float))
    return Model(every.words, every.stems, every.exceptions, fitted(np.concatenate(x), np.concatenate(y)))


def featured(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = machine(model)
        for batch in batches:
            f = [features(t.as_py() or "", found) for t in batch["text"]]
            cols = list(zip(*f)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), *(batch[k] for k in keep)], ["a", "b", *keep])

    return run


def toxic_scores(rows: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and score of every row."""
    data = rows.select(F.struct(*keep).alias("own"), F.col(text).alias("text"))
    kind = data.schema["own"].dataType.simpleString()
    w0, w1, w2 = model.line
    scored = data.mapInArrow(tidy(featured(model, ["own"])), f"a double, b double, own {kind}")
    return scored.select("own.*", (1 / (1 + F.exp(-(F.lit(w0) + w1 * F.col("a") + w2 * F.col("b"))))).alias("score"))
