"""The manifest, clustering and substring operators against brute force on odd rows, and against their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import centroids, merkle, oracle, queries, simhash, substrings, suffix_tree, top_k

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, tree int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tower(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i - i % 16 : i - i % 16 + 16]
        out.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        i //= 16
    return out


def brute_manifest(rows):
    by = defaultdict(list)
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    for r in rows:
        text = r["text"]
        leaf = H(*[field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")], field(text))
        if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        now = H(*[field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")], field(text))
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, now))
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tower([x[2] for x in sorted(by[s])]) for s in groups}
    top = tower([trees[s][-1][0] for s in groups])
    out = []
    for k, s in enumerate(groups):
        for i, (has, d, leaf, now) in enumerate(sorted(by[s])):
            proof = siblings(trees[s], i) + siblings(top, k)
            fold = now
            for place, others in proof:
                fold = H(*others[:place], fold, *others[place:])
            out.append((d if has else None, leaf, trees[s][-1][0], top[-1][0], H(*[x for _, others in proof for x in others]), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(spark, rows, levels):
    docs = spark.createDataFrame(rows, DOCS)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    found = merkle.manifest(docs, fields=fields, tree="source", order="doc_id", keep={"now": merkle.leaf_digest(*[F.col(c) for c in fields[:-1]], changed)}, levels=levels)
    fold = merkle.folded(F.col("now"), F.col("proof"))
    return sorted([tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")), fold, fold == F.col("root")).collect()], key=str)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_against_brute_force(spark, levels):
    """Null groups and ids, repeated rows, a hot group of over 16 ** 2 rows, a lone leaf, groups that differ bytewise, a long text."""
    r = random.Random(4)
    rows = [(i, f"Text {r.random()}", "en", "hot", i, "clash", 1) for i in range(300)]
    rows += [(1000 + i, None if i % 3 else "", None, f"s{i % 40}", None, "clash", 1) for i in range(200)]
    rows += [(5, "x", "en", None, 1, "c", 1), (5, "x", "en", None, 1, "c", 1), (None, "N", "en", None, 1, "c", 1), (7, "LONG " * 200_000, "en", "one", 1, "c", 1), (8, "ü", "de", "Zürich", 2, "c", 1), (9, "ü", "de", "é", 2, "c", 1)]
    want = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), x)) for x in rows]
    got = manifest_rows(spark, rows, levels)
    assert got == brute_manifest(want)
    assert any(not x[-1] for x in got) and any(x[-1] for x in got)


def test_manifest_small(spark):
    assert manifest_rows(spark, [], 2) == []
    one = [(1, "a", "en", "s", 1, "c", 1)]
    assert manifest_rows(spark, one, 2) == brute_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), one[0]))])


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [min(max(math.floor(1024 * float(x)), -(1 << 27)), 1 << 27) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (*name(r[0]), r[1]))[:k]]
    x = np.array([v for _, v in kept], dtype=np.int64)

    def nearest():
        far = np.stack([((x - np.array(c)) ** 2).sum(1) for c in centres], 1)
        return far.argmin(1), far.min(1)

    for _ in range(rounds):
        a, _d = nearest()
        centres = [[int(s) // int((a == c).sum()) for s in x[a == c].sum(0)] if (a == c).any() else centres[c] for c in range(len(centres))]
    a, d = nearest()
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, int(a[n]), int(d[n]), int(d[a == a[n]].sum()), int(d.sum()), names[a[n]]) for n, (i, _) in enumerate(kept)], key=str)


def clusters(spark, rows, k, rounds, dims, bounds):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, v int")
    found, centres = centroids.clustered(table, k, dims=dims, rounds=rounds, bounds=bounds)
    out = centroids.with_inertia(found, centres).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted([tuple(r) for r in out.collect()], key=str)


@pytest.mark.parametrize("k,bounds", [(8, 3), (8, 1), (1, 3), (2, 0), (30, 5)])
def test_clustering_against_brute_force(spark, k, bounds):
    """Ties between equal centroids, repeated ids and vectors, vectors that take no part, values beyond the range."""
    r = random.Random(k)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f(r.gauss(3 * (i % 5), 1.0) for _ in range(4))) for i in range(200)]
    rows += [(7, f([0.5] * 4))] * 30 + [(300 + i, f([0.5] * 4)) for i in range(20)] + [(None, f([1, 2, 3, 4])), (400, f([1e30, -1e30, 0, 0]))]
    odd = [(500, None), (501, [1.0]), (502, [1.0, None, 2.0, 3.0]), (503, [float("nan")] * 4), (504, [float("inf"), 0.0, 0.0, 0.0]), (505, [])]
    assert clusters(spark, [(*x, "clash", 1) for x in rows + odd], k, 4, 4, bounds) == brute_clusters(rows, k, 4, 4)


def test_clustering_few(spark):
    assert clusters(spark, [], 8, 3, 4, 3) == []
    rows = [(1, [0.0] * 4), (2, [1.0] * 4)]
    assert clusters(spark, [(*x, "c", 1) for x in rows], 8, 3, 4, 3) == brute_clusters(rows, 8, 3, 4)


def test_bounds_spare_distances(spark):
    """On separated clouds most vectors keep their cluster by the bounds alone."""
    r = random.Random(3)
    rows = [(i, [r.gauss(40.0 * (i % 6), 1.0) for _ in range(4)], "c", 1) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, v int")
    found, _ = centroids.clustered(table, 6, dims=4, rounds=8)
    assert found.where("place = 0").count() > 500


def brute_substrings(rows, window):
    first, docs = {}, [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, words in docs:
        for k in range(len(words) - window + 1 if i is not None else 0):
            run = tuple(words[k : k + window])
            first[run] = min(i, first.get(run, i))
    out = []
    for i, words in docs:
        gone = set()
        for k in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,inner", [(50, 8), (12, 4), (5, 5), (3, 1)])
def test_substrings_against_brute_force(spark, window, inner):
    """Shared passages in the middle, at ends, overlapping, nested, repeated inside a document, over few words; repeated ids with other texts."""
    r = random.Random(window)
    word = lambda n: [r.choice("abcdefghij") + str(r.randrange(n)) for _ in range(r.randrange(40, 160))]
    shared = [word(50) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            s = r.choice(shared)
            a = r.randrange(len(s))
            parts += [word(50), s[a : a + r.randrange(10, 150)]]
        rows.append((i, "".join(w + r.choice([" ", "  ", "\n", "\t\x0b"]) for p in parts for w in p)))
    rows += [(100, rows[3][1]), (100, rows[4][1]), (100, rows[4][1]), (None, rows[5][1]), (101, None), (102, ""), (103, " \n "), (104, "a b " * 5000), (105, "x a b " + "a b " * 900), (106, "a " * 300), (2, "a " * 400), (107, "é\u0085ü x " * 120), (108, "y é\u0085ü x " * 120)]
    docs = spark.createDataFrame([(*x, "en", "s", 1, "clash", 1) for x in rows], DOCS.replace("digest", "n_words").replace("tree", "n_removed")).repartition(5)
    got = substrings.deduplicated(docs, window=window, inner=inner).collect()
    assert sorted([(x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got], key=str) == brute_substrings(rows, window)
    assert all(x.n_removed == sum(s.end - s.start for s in x.removed) for x in got)
    assert substrings.deduplicated(docs.limit(0)).count() == 0


def test_substrings_shuffled_lookup(spark, monkeypatch):
    """The same without a broadcast of least hashes."""
    monkeypatch.setattr(substrings, "MOST_BROADCAST", -1)
    monkeypatch.setattr(merkle, "MOST_BROADCAST", -1)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    got = sorted([(x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in substrings.deduplicated(docs).collect()], key=str)
    assert got == brute_substrings(rows, 50)


def test_long_passages_become_one_span(spark):
    """A copied passage is one span with its source's coordinates, however many paths it has."""
    words = [f"w{i}" for i in range(2000)]
    docs = spark.createDataFrame([(1, 0, "p " * 3 + " ".join(words)), (2, 0, " ".join(words[100:1900])), (3, 0, "q " + " ".join(words))], "doc long, tag long, text string")
    found = substrings.paths(docs, 50, 8)
    spans = substrings.compacted(found, substrings.named(found)).collect()
    assert found.where("doc = 2").count() > 40
    assert len([s for s in spans if s.doc == 2]) <= 3
    assert all(s.source == 1 and s.there - s.start == {2: 103, 3: 2}[s.doc] for s in spans)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_centroid_clustering", "op13_substring_dedup"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    found = con.execute(queries.ORACLE[name])
    names = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(n) for n in names]
    want = sorted([tuple(r[k] for k in at) for r in found.fetchall()], key=str)
    got = sorted([tuple(r) for r in queries.QUERIES[name](spark, DIR).select(*names).collect()], key=str)
    assert got == want
    assert oracle.merkle_sql(1, 1)


def test_bounds_search_every_block():
    """Blocks of a few rows, and numbers whose products float64 cannot hold, go through the bounds and give the plain result."""
    r = np.random.default_rng(5)
    for n, size in ((6, 300), (21, 300), (60, 1 << 27), (200, 1 << 40)):
        x, q = r.integers(-size, size, (n, 3)), r.integers(-size, size, (4, 3))
        ids, q_ids = np.arange(n), np.array([0, 1, 2, -1])
        seen = {}
        for row, found, scores, _ in top_k.nra(ids, x, q_ids, q, 5):
            seen[row] = list(zip(found.tolist(), scores.tolist()))
        for row in range(4):
            want = sorted(((-sum(int(a) * int(b) for a, b in zip(v, q[row])), i) for i, v in enumerate(x) if i != q_ids[row]))[:5]
            assert [i for i, _ in seen[row]] == [i for _, i in want], n
            if size < 1 << 30:
                assert [s for _, s in seen[row]] == [-s for s, _ in want]


def test_forests_of_pairs_are_no_more_than_rows(spark):
    """Thirty sets that may all be similar: a forest has 29 pairs, all pairs are 435."""
    cells = spark.createDataFrame([(1, i, i, 1000, 0, bytearray(simhash.LEAST_MAP // 8)) for i in range(30)], "key long, node long, root long, n int, pos int, map binary")
    tree = [(r.a, r.b) for r in simhash.apart_pairs(cells, 0.8, forest=True).collect()]
    assert len(tree) == 29 and simhash.apart_pairs(cells, 0.8).count() == 435
    forest = simhash.Forest()
    assert all(forest.join(a, b) for a, b in tree)


def test_components_grow_by_new_links(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "node long, root long")
    found = spark.createDataFrame([(2, 6), (8, 9), (1, 5)], "a long, b long")
    got = {r.node: r.root for r in simhash.merged(roots, found).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8}


def test_texts_are_weighed_between_tree_and_base(spark):
    rows = spark.createDataFrame([(1, -10.0, -12.0), (2, -500.0, -300.0), (3, -5.0, -5.0)], "doc_id long, base_score double, score double")
    got = {r.doc_id: (r.score, r.tree_score) for r in suffix_tree.blended(rows).collect()}
    for i, base, tree in ((1, -10.0, -12.0), (2, -500.0, -300.0), (3, -5.0, -5.0)):
        top = max(base, tree)
        assert math.isclose(got[i][0], top + math.log10(0.5 * (10 ** (base - top) + 10 ** (tree - top)))) and got[i][1] == tree
        assert got[i][0] >= top - 0.302


def test_held_out_has_a_value_for_null_ids(spark, tmp_path):
    words = "the cat sat on the mat and ran away".split()
    docs = [(i if i else None, " ".join(words[i % 5 :] * 3), ["en", "de"][i % 2], "s", 9) for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 3 // 2) for i in range(1, 24)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op5_language_id", "op6_toxicity", "op8_lm_scoring"):
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(rows) == 24 and all(r.held_out is not None for r in rows), name
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
