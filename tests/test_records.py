"""Documents, edits, lens lookup and digests against published values and cases by hand."""

import json
import random
import struct

import pytest

from framelake.functions import digests
from framelake.operators import lens_lookup, sidecars

#: Published digests of the bytes 0, 1, ... 250, 0, 1, ... by length (fixed values).
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def data(n):
    return bytes(i % 251 for i in range(n))


def test_blake3_vectors(spark):
    rows = spark.createDataFrame([(n, bytearray(data(n))) for n in VECTORS] + [(-1, None)], "n int, v binary")
    got = {r.n: r.d for r in rows.select("n", digests.blake3(rows.v).alias("d")).collect()}
    assert got == VECTORS | {-1: None}


def test_blake3_slices(monkeypatch):
    """The same whichever leaves are compressed together, and in any company."""
    sizes = [0, 1, 5000, 1024, 3 * 1024 + 1, 7 * 1024, 40_000]
    alone = [digests.blake3_digests([data(n)])[0] for n in sizes]
    monkeypatch.setattr(digests, "TOGETHER", 3)
    assert digests.blake3_digests([data(n) for n in sizes]) == alone
    assert digests.blake3_digests([]) == []


def test_sample_fingerprints_of_any_batches(spark):
    """Frames of many sizes in Arrow batches of seven rows, against a plain chain."""
    r = random.Random(2)
    frames = {f"f{i}": (r.randrange(1, 9), r.randrange(1, 6)) for i in range(12)}
    values = {(f, x, y): tuple(r.randrange(256) for _ in range(4)) for f, (w, h) in frames.items() for x in range(w) for y in range(h)}
    px = spark.createDataFrame([(f, x, y, *v) for (f, x, y), v in values.items()], "image_id string, x int, y int, r int, g int, b int, a int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {x.image_id: x.fingerprint for x in digests.sample_fingerprints(px, [0.5, -1.0], "p:").collect()}
        assert digests.sample_fingerprints(px.limit(0), []).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for f, (w, h) in frames.items():
        state = 0xCBF29CE484222325
        for b in struct.pack("<ddII", 0.5, -1.0, w, h) + bytes(c for y in range(h) for x in range(w) for c in values[f, x, y]):
            state = (state ^ b) * 0x100000001B3 % 2**64
        assert got[f] == f"p:{state:016x}"


def document(**changes):
    base = {
        "format": sidecars.FORMAT, "schema_version": 2, "pipeline_version": "1", "source": {"relative_name": "a.raw", "orientation": 1},
        "virtual_copies": [{"id": "a", "name": "A", "is_default": True, "recipe": {"recipe_version": "1", "adjustments": {"exposure": 1}}, "mask_library": [{"id": "m", "name": "M", "operation": "source", "references": []}], "mask_layers": [{"id": "l", "mask": {"copy_id": "a", "mask_id": "m"}}]}],
    }
    return json.dumps(base | changes)


def found(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {}
    for r in sidecars.violations(rows).collect():
        out.setdefault(r.id, set()).add((r.path, r.code))
    return [out.get(i, set()) for i in range(len(texts))]


def test_violations_by_hand(spark):
    copy = json.loads(document())["virtual_copies"][0]
    two = [copy, copy | {"is_default": False, "mask_library": [{"id": "m", "name": " ", "operation": "blend"}, {"id": "m", "name": "x", "operation": "subtract", "references": [{"copy_id": "a"}]}]}]
    got = found(
        spark, document(), None, "[1]", "{", document(virtual_copies=[]), document(virtual_copies=two, extra={"deep": [1]}), document(schema_version="x", source={}),
        document(presets=[{"id": "p"}, {"id": "p"}, {"id": ""}], deleted_virtual_copies=[copy]), document(virtual_copies=[copy | {"recipe": {"recipe_version": "", "adjustments": {"exposure": 11, "contrast": "no", "free": 1e9}}}]),
        document(virtual_copies=[copy | {"export_records": [{"id": "e", "format": "png", "relative_path": "../up"}], "mask_layers": [{"id": "l", "mask": {"copy_id": "z", "mask_id": "m"}}, {"id": "l"}]}]),
    )
    assert got[0] == set()
    assert got[1] == got[2] == got[3] == {("$", "not_json")}
    assert got[4] == {("$.virtual_copies", "no_copy"), ("$.virtual_copies", "defaults")}
    c = "$.virtual_copies[1]"
    assert got[5] == {(f"{c}.id", "duplicate"), (f"{c}.mask_library[0].name", "blank"), (f"{c}.mask_library[0].operation", "unknown_operation"), (f"{c}.mask_library[1].id", "duplicate"), (f"{c}.mask_library[1].references", "arity"), (f"{c}.mask_library[1].references[0].mask_id", "blank")}
    assert got[6] == {("$.schema_version", "version"), ("$.source.relative_name", "blank"), ("$.source.orientation", "orientation")}
    assert got[7] == {("$.presets[1].id", "duplicate"), ("$.presets[2].id", "blank"), ("$.deleted_virtual_copies[0].id", "duplicate")}
    r = "$.virtual_copies[0].recipe"
    assert got[8] == {(f"{r}.recipe_version", "blank"), (f"{r}.adjustments.exposure", "out_of_range"), (f"{r}.adjustments.contrast", "out_of_range")}
    a = "$.virtual_copies[0]"
    assert got[9] == {(f"{a}.export_records[0].relative_path", "unsafe_path"), (f"{a}.mask_layers[0].mask", "unknown_mask"), (f"{a}.mask_layers[1].mask", "unknown_mask"), (f"{a}.mask_layers[1].id", "duplicate")}


def test_edits_keep_unknown_fields_and_refuse_stale_ones(spark):
    rows = spark.createDataFrame([(1, '{"rating": 1, "own": {"deep": [1, 2]}}', None), (2, "{", None)], "id long, text string, history array<struct<revision: string, field: string, edit: bigint>>")
    first = {r.id: r.r for r in rows.select("id", sidecars.revision(rows.text).alias("r")).collect()}
    edits = spark.createDataFrame([(10, 1, "rating", "5", first[1]), (11, 1, "rating", "4", first[1]), (12, 1, "rating", "3", "stale"), (13, 9, "rating", "3", "x"), (14, 2, "rating", "3", "x"), (15, 1, "rating", "{", first[1]), (16, 1, "rating", "2", None)], "edit long, id long, field string, value string, base string")
    docs, log = sidecars.edited(rows, edits)
    assert {r.edit: r.outcome for r in log.collect()} == {10: "applied", 11: "conflict", 12: "conflict", 13: "missing", 14: "invalid", 15: "invalid", 16: "conflict"}
    one = docs.where("id = 1").first()
    assert json.loads(one.text) == {"rating": 5, "own": {"deep": [1, 2]}}
    assert [tuple(h) for h in one.history] == [(first[1], "rating", 10)] and one.revision != first[1]
    again, log = sidecars.edited(docs.select("id", "text", "history"), spark.createDataFrame([(20, 1, "name", '"x"', one.revision)], "edit long, id long, field string, value string, base string"))
    two = again.where("id = 1").first()
    assert log.first().outcome == "applied" and len(two.history) == 2 and json.loads(two.text)["name"] == "x"


def test_lens_lookup_by_hand(spark):
    entries = spark.createDataFrame([(1, "Canon", "EF 50mm f/1.8"), (2, "Canon", "EF 85mm f/1.8"), (3, "Nikon", "50mm f/1.8"), (4, "Canon", "EF 50mm f/1.8")], "entry long, make string, model string")
    queries = spark.createDataFrame([(1, "CANON", "ef50mm F1.8"), (2, None, "50mm f/1.8"), (3, "Sony", "50mm"), (4, "Canon", None), (5, "Canon", "zzz"), (6, "Canon", "ef50mm F1.8"), (7, "Canon Inc.", "85")], "query long, make string, model string")
    got = {r.query: (r.entry, r.score) for r in lens_lookup.looked_up(queries, entries).collect()}
    assert got == {1: (1, 100), 2: (3, 100), 3: (None, None), 4: (None, None), 5: (None, None), 6: (1, 100), 7: (2, 16)}
    assert lens_lookup.looked_up(queries.limit(0), entries).count() == 0
    assert lens_lookup.looked_up(queries, entries.limit(0)).where("entry IS NOT NULL").count() == 0


@pytest.mark.parametrize("texts", [[], ["{}"]])
def test_violations_of_empty_input(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    codes = {r.code for r in sidecars.violations(rows).collect()}
    assert codes == ({"format", "version", "blank", "orientation", "no_copy", "defaults"} if texts else set())


def test_violations_of_repeated_ids_and_odd_lists(spark):
    """rows of one id are documents of their own, lists may be objects, and many layers share a missing mask."""
    copy = json.loads(document())["virtual_copies"][0]
    layers = [{"id": f"l{i}", "mask": {"copy_id": "a", "mask_id": m}} for i, m in enumerate(["m", "x", "x", "y", "m", None])]
    lost = document(virtual_copies=[copy | {"mask_layers": layers}])
    fine = document(virtual_copies=[copy | {"mask_library": [{"id": n, "name": "M", "operation": "source", "references": []} for n in "mxy"]}])
    odd = document(virtual_copies={"one": copy, "two": copy | {"is_default": False, "history": {"h": {"id": 5}, "k": {"id": "5"}, "n": None}}}, presets=7)
    rows = spark.createDataFrame([(1, document()), (1, document()), (2, lost), (2, fine), (2, lost), (3, odd), (4, "null"), (None, "{")], "id long, text string")
    got = sorted((r.id or 0, r.path, r.code) for r in sidecars.violations(rows).collect())
    a = "$.virtual_copies"
    assert got == sorted(
        [(0, "$", "not_json"), (4, "$", "not_json"), *[(2, f"{a}[0].mask_layers[{i}].mask", "unknown_mask") for i in (1, 2, 3, 5)]]
        + [(3, f"{a}.two.id", "duplicate"), (3, f"{a}.two.history.k.id", "duplicate"), (3, f"{a}.two.history.n.id", "blank")]
    )


def test_violations_shuffle_only_what_is_found(spark):
    """a scan and a shuffle for each rule read and parsed every document a score of times."""
    frame = sidecars.violations(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "text"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and "Join" not in plan
