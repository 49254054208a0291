"""Operators of the contract against its own words."""

import public_tokenizers

from framelake.llm import packing, queries, simhash


def test_url_rules_are_the_contracts(spark, tmp_path):
    """Each rule's word as the contract lists it, on a host of its own, a subdomain and a path below."""
    rules = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    want = {}
    for rule in rules.split(", "):
        verdict, place = rule.split(" ")
        for n, url in enumerate((f"http://{place}", f"http://a.{place}1?x", f"http://A.b.{place}#y")):
            want[f"{url}"] = (place, verdict)
    pages = [(i, u, "h") for i, u in enumerate(want)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op1_url_filters(spark, str(tmp_path)).collect()}
    assert [got[i] for i, _, _ in pages] == list(want.values())


def test_shingles_are_counted_in_all_texts(spark):
    """200000 rows would have been one in sixteen; a shingle of few texts among many has its full count."""
    rows = spark.range(60_000).selectExpr("id", "CASE WHEN id % 6000 = 0 THEN 'one passage that ten texts share' ELSE concat('w', id, ' x', id, ' y', id, ' z', id, ' v', id) END AS text")
    shingle, n = simhash.frequent_shingles(rows, text="text", words=5)
    assert len(shingle) == 2 and n.tolist() == [10, 10]


def test_small_caches_change_no_piece(spark):
    """The pipeline's packing remembers less: bounds are met, pieces stay."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 7 + k} naïve" for k in range(40))) for i in range(300)], "doc_id long, text string")
    got = [sorted(map(tuple, packing.token_pieces(docs, path, cached=c).collect())) for c in (500, 500_000)]
    assert got[0] == got[1]
    encoder = packing.ChunkEncoder(path)
    encoder.cached = 50
    for _ in encoder.encode([" ".join(f"w{i}{k}" for k in range(30)).encode() for i in range(9)] * 3):
        pass
    assert len(encoder.known) <= 270
