"""Edit documents as VARIANT: every violation with its JSON path, fields that nobody knows kept, and versioned edits in bulk.

    documents(id, text)              id of any type, text a JSON document

A document is parsed once; copies, masks, layers, history, exports, presets and adjustments are arrays of elements beside it, rules are predicates over
elements, and repeated names are neighbours in a sorted array, so nothing is shuffled but what is found. Only documents with layers whose mask is
in no library are walked a second time, where an aggregate says which layers these are. The work on a document of n elements is n log n.

Cases: null text, or text that is no JSON object, is one violation (``$``, not_json) and nothing else is checked; a missing or mistyped field counts as
blank; repeated rows of one id are one document each only if their texts differ; an empty table has no violations; extra columns go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import safe_path
from .mask_graph import ARITY

FORMAT, NEWEST, MOST_COPIES = "framelake-sidecar", 2, 10_000
#: Least and greatest value of the scalar adjustments; others are not checked (fixed values).
ADJUSTMENTS = {"exposure": (-10.0, 10.0), "wb_temperature": (1500.0, 12000.0)} | {k: (-1.0, 1.0) for k in ("contrast", "highlights", "shadows", "whites", "blacks", "wb_tint", "vibrance", "saturation")}
ELEMENTS = "array<struct<at: string, key: string, value: variant>>"
KNOWN = ("format", "schema_version", "source", "analysis_fingerprint", "pipeline_version", "virtual_copies", "deleted_virtual_copies", "presets")


def got(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def parsed(documents: DataFrame) -> DataFrame:
    """id and v, the document as VARIANT; null where it is no JSON object."""
    v = F.try_parse_json("text")
    return documents.select("id", F.when(F.schema_of_variant(v).startswith("OBJECT"), v).alias("v"))


def bound(value: Column, used: Callable[[Column], Column]) -> Column:
    """``used`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), used), F.lit(0))


def entries(of: Column, path: str, at: Column) -> Column:
    """Elements of an array (or fields of an object) in ``of``, as an array of ``ELEMENTS``; ``at`` is the JSON path of ``of``."""
    element = lambda place, key, value: F.struct(F.concat(at, F.lit("." + path), *place).alias("at"), key.cast("string").alias("key"), value.alias("value"))
    listed = F.transform(got(of, "$." + path, "array<variant>"), lambda e, i: element([F.lit("["), i, F.lit("]")], F.lit(None), e))
    fields = F.transform(F.map_entries(got(of, "$." + path, "map<string, variant>")), lambda e: element([F.lit("."), e["key"]], e["key"], e["value"]))
    return F.coalesce(listed, fields, F.array().cast(ELEMENTS))


def each(elements: Column, found: Callable[[Column], Column]) -> Column:
    """What is found at each element, in one array."""
    return F.flatten(F.transform(elements, found))


def broken(at: Column, *rules: tuple[str, Column, str]) -> Column:
    """(path, code) of the rules (path below ``at``, what is wrong, code) that are broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.concat(at, F.lit(path)).alias("path"), F.lit(code).alias("code"))) for path, wrong, code in rules]))


def repeated(elements: Column) -> Column:
    """Elements whose id an earlier element of the same list has."""
    named = F.transform(elements, lambda e: F.struct(got(e["value"], "$.id").alias("id"), F.length(e["at"]).alias("n"), e["at"].alias("at")))
    again = lambda s: F.filter(s, lambda e, i: (i > 0) & (F.get(s, i - 1)["id"] == e["id"]))
    met = bound(F.array_sort(F.filter(named, lambda e: e["id"].isNotNull())), again)
    return F.transform(met, lambda e: F.struct(F.concat(e["at"], F.lit(".id")).alias("path"), F.lit("duplicate").alias("code")))


def names(*fields: str, of: Column) -> list[tuple[str, Column, str]]:
    return [("." + f, blank(got(of, "$." + f)), "blank") for f in fields]


def unsafe(of: Column, field: str) -> Column:
    return ~F.coalesce(safe_path(got(of, "$." + field)), F.lit(False))


def of_copy(copy: Column) -> Column:
    at, value = copy["at"], copy["value"]
    number = lambda a: got(a["value"], "$", "double")
    low, high = (F.create_map(*[x for k, b in ADJUSTMENTS.items() for x in (F.lit(k), F.lit(b[i]))]) for i in (0, 1))
    inside = lambda a: (number(a) >= F.try_element_at(low, a["key"])) & (number(a) <= F.try_element_at(high, a["key"]))
    adjustments = each(entries(value, "recipe.adjustments", at), lambda a: broken(a["at"], ("", F.try_element_at(low, a["key"]).isNotNull() & ~F.coalesce(inside(a), F.lit(False)), "out_of_range")))
    return F.concat(broken(at, *names("id", "name", "recipe.recipe_version", of=value)), adjustments)


def of_mask(mask: Column) -> Column:
    at, value = mask["at"], mask["value"]
    operation, operands = got(value, "$.operation"), F.coalesce(F.size(got(value, "$.references", "array<variant>")), F.lit(0))
    wrong = F.lit(False)
    for op, (least, most) in ARITY.items():
        wrong = F.when(operation == op, (operands < least) | (operands > most if most is not None else F.lit(False))).otherwise(wrong)
    own = broken(at, *names("id", "name", of=value), (".operation", ~F.coalesce(operation.isin(*ARITY), F.lit(False)), "unknown_operation"), (".references", wrong, "arity"))
    return F.concat(own, each(entries(value, "references", at), lambda r: broken(r["at"], *names("copy_id", "mask_id", of=r["value"]))))


def mask_key(copy: Column, mask: Column) -> Column:
    """Both names as one string; null if one is missing."""
    return F.concat(F.length(copy), F.lit(":"), copy, mask)


def walked(documents: DataFrame) -> DataFrame:
    """Documents with their copies (``live`` and ``gone``), ``presets``, each living copy's lists (``parts``), their ``layers`` (path and mask) and the masks in no library (``missing``)."""
    root, value = F.lit("$"), F.col("v")
    docs = documents.withColumn("p", F.try_parse_json("text")).select("id", "text", F.when(F.schema_of_variant("p").startswith("OBJECT"), F.col("p")).alias("v"))
    docs = docs.withColumns({"live": entries(value, "virtual_copies", root), "gone": entries(value, "deleted_virtual_copies", root), "presets": entries(value, "presets", root)})
    lists = lambda c: [entries(c["value"], part, c["at"]).alias(part) for part in ("mask_library", "mask_layers", "history", "export_records")]
    docs = docs.withColumn("parts", F.transform("live", lambda c: F.struct(got(c["value"], "$.id").alias("copy_id"), *lists(c))))
    layer = lambda e: F.struct(mask_key(got(e["value"], "$.mask.copy_id"), got(e["value"], "$.mask.mask_id")).alias("key"), F.concat(e["at"], F.lit(".mask")).alias("path"))
    docs = docs.withColumn("layers", each(F.col("parts"), lambda p: F.transform(p["mask_layers"], layer)))
    library = each(F.col("parts"), lambda p: F.transform(p["mask_library"], lambda m: mask_key(p["copy_id"], got(m["value"], "$.id"))))
    return docs.withColumn("missing", F.array_except(F.transform("layers", lambda e: e["key"]), F.array_compact(library)))


def violations(documents: DataFrame) -> DataFrame:
    """(id, path, code) of everything that is wrong, in no order."""
    docs, root, v = walked(documents), F.lit("$"), F.col("v")
    path = got(v, "$.source.relative_name")
    defaults = F.size(F.filter("live", lambda c: F.coalesce(got(c["value"], "$.is_default", "boolean"), F.lit(False))))
    own = broken(
        root, (".format", ~F.coalesce(got(v, "$.format") == FORMAT, F.lit(False)), "format"), (".schema_version", ~F.coalesce(got(v, "$.schema_version", "long").between(1, NEWEST), F.lit(False)), "version"),
        (".pipeline_version", blank(got(v, "$.pipeline_version")), "blank"), (".source.relative_name", blank(path), "blank"), (".source.relative_name", unsafe(v, "source.relative_name") & ~blank(path), "unsafe_path"),
        (".source.orientation", ~F.coalesce(got(v, "$.source.orientation", "long").between(1, 8), F.lit(False)), "orientation"),
        (".virtual_copies", F.size("live") == 0, "no_copy"), (".virtual_copies", F.size("live") + F.size("gone") > MOST_COPIES, "too_many"), (".virtual_copies", defaults != 1, "defaults"),
    )
    item = lambda *fields: lambda e: broken(e["at"], *names(*fields, of=e["value"]))
    export = lambda e: broken(e["at"], *names("id", "format", of=e["value"]), (".relative_path", unsafe(e["value"], "relative_path"), "unsafe_path"))
    rules = {"mask_library": of_mask, "mask_layers": item("id"), "history": item("id"), "export_records": export}
    nameless = F.filter("layers", lambda e: e["key"].isNull())
    copies = F.concat("live", "gone")
    found = F.concat(
        own, each(copies, of_copy), repeated(copies), each(F.col("presets"), item("id")), repeated(F.col("presets")),
        each(F.col("parts"), lambda p: F.concat(*[f for part, rule in rules.items() for f in (each(p[part], rule), repeated(p[part]))])),
        each(nameless, lambda e: broken(e["path"], ("", F.lit(True), "unknown_mask"))),
    )
    found = F.when(v.isNull(), F.array(F.struct(root.alias("path"), F.lit("not_json").alias("code")))).otherwise(found)
    # outer, as a filter on the array's size would be inferred otherwise, and walk every document once more
    out = docs.select("id", found.alias("found")).select("id", F.inline_outer("found")).where("path IS NOT NULL")
    # a layer's mask must be in the library of a living copy
    lost = F.when(F.size("missing") > 0, F.concat(F.transform("missing", lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("path"))), F.col("layers")))
    asked = docs.select("id", F.when(F.size("missing") > 0, F.sha2("text", 256)).alias("document"), lost.alias("lost")).select("id", "document", F.inline_outer("lost")).where("key IS NOT NULL")
    lost = asked.groupBy("id", "document", "key").agg(F.collect_list("path").alias("paths"), F.count_if(F.col("path").isNull()).alias("n")).where("n > 0")
    return out.union(lost.select("id", F.explode("paths"), F.lit("unknown_mask"))).distinct()


def unknown_fields(documents: DataFrame) -> DataFrame:
    """(id, field, value): root fields beyond the schema, as JSON; they stay in the document through every edit."""
    docs = parsed(documents).where("v IS NOT NULL")
    fields = docs.sparkSession.sql("SELECT t.id, e.key AS field, to_json(e.value) AS value FROM {t} AS t, LATERAL variant_explode(t.v) AS e", t=docs)
    return fields.where(~F.col("field").isin(*KNOWN))


def revision(text: Column) -> Column:
    """A document's revision: the digest of its canonical form (one spelling of white space, keys sorted)."""
    return F.sha2(F.to_json(F.try_parse_json(text)), 256)


def with_field(text: Column, field: Column, value: Column) -> Column:
    """The document with one root field set to a JSON value; all other fields stay, known or not."""
    old = F.from_json(F.to_json(F.try_parse_json(text)), "map<string, variant>")
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != field), F.map_from_arrays(F.array(field), F.array(F.try_parse_json(value)))))


def edited(documents: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bulk edits with optimistic revisions: the new documents (id, text, revision, history) and (edit, id, outcome).

    ``documents`` has id, text and history, an array of (revision, field, edit); ``edits`` has edit (their order), id, field, value (JSON) and base, the
    revision that the editor has seen. Of the edits of one document that name its revision the first is applied, and its history gains an
    entry in the same write; later ones see another revision by then (conflict), as do stale ones; edits of absent documents are missing, of
    documents that are no JSON or with values that are none: invalid.
    """
    now = documents.select("id", "text", "history", revision(F.col("text")).alias("revision"))
    asked = edits.join(now.select("id", "revision", F.lit(True).alias("there")), "id", "left")
    valid = F.col("revision").isNotNull() & F.try_parse_json("value").isNotNull() & F.col("field").isNotNull()
    state = F.when(F.col("there").isNull(), "missing").when(~valid, "invalid").when(~F.coalesce(F.col("base") == F.col("revision"), F.lit(False)), "conflict")
    asked = asked.withColumn("state", state)
    first = asked.where("state IS NULL").groupBy("id").agg(F.min_by(F.struct("edit", "field", "value"), "edit").alias("e"))
    met = now.join(first, "id", "left")
    text = F.when(F.col("e").isNotNull(), with_field(F.col("text"), F.col("e.field"), F.col("e.value"))).otherwise(F.col("text"))
    entry = F.struct(F.col("revision"), F.col("e.field").alias("field"), F.col("e.edit").alias("edit"))
    out = met.select("id", text.alias("text"), F.when(F.col("e").isNotNull(), F.array_append(F.coalesce("history", F.array().cast("array<struct<revision: string, field: string, edit: bigint>>")), entry)).otherwise(F.col("history")).alias("history"))
    chosen = first.select("id", F.col("e.edit").alias("edit"), F.lit("applied").alias("applied"))
    log = asked.join(chosen, ["id", "edit"], "left").select("edit", "id", F.coalesce("applied", "state", F.lit("conflict")).alias("outcome"))
    return out.withColumn("revision", revision(F.col("text"))), log
