"""Queries on edit documents, lens lookup and digests, from the given tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..operators import lens_lookup, render, sidecars
from ..sources.frames import SIDE, carrier_frames, table
from ..streaming import sessions
from .queries import PX, register

# documents: one for each row of ``documents``, with faults that its numbers decide

DOCUMENT = """concat('{"format": "framelake-sidecar", "schema_version": ', CASE WHEN doc_id % 19 = 0 THEN 3 ELSE 2 END, ', "pipeline_version": "1", "source": {"relative_name": "', CASE WHEN doc_id % 23 = 0 THEN '../x' ELSE 'a/b.raw' END, '", "orientation": ', doc_id % 10, '}, "virtual_copies": [{"id": "a", "name": "', CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'A' END, '", "is_default": ', CASE WHEN doc_id % 11 = 0 THEN 'false' ELSE 'true' END,
 ', "recipe": {"recipe_version": "1", "adjustments": {"contrast": 0.5, "exposure": ', n_chars % 25 - 12, ', "own": 99}}, "mask_library": [{"id": "m0", "name": "M", "operation": "source", "references": []}, {"id": "m1", "name": "N", "operation": "', CASE WHEN doc_id % 3 = 0 THEN 'union' ELSE 'invert' END, '", "references": [{"copy_id": "a", "mask_id": "m0"}]}], "mask_layers": [{"id": "l", "mask": {"copy_id": "a", "mask_id": "', CASE WHEN doc_id % 13 = 0 THEN 'm9' ELSE 'm1' END, '"}}],
 "history": [{"id": "h"}, {"id": "', CASE WHEN doc_id % 29 = 0 THEN 'h' ELSE 'h2' END, '"}], "export_records": [{"id": "e", "format": "png", "relative_path": "', CASE WHEN doc_id % 6 = 0 THEN '/abs' ELSE 'o.png' END, '"}]}, {"id": "', CASE WHEN doc_id % 7 = 0 THEN 'a' ELSE 'b' END, '", "name": "B", "is_default": false, "recipe": {"recipe_version": "1"}}], "presets": [], "rating": ', doc_id % 6, CASE WHEN doc_id % 17 = 0 THEN '' ELSE '}' END)"""
FAULTS = [
    ("$.source.orientation", "orientation", "doc_id % 10 IN (0, 9)"), ("$.schema_version", "version", "doc_id % 19 = 0"), ("$.source.relative_name", "unsafe_path", "doc_id % 23 = 0"), ("$.virtual_copies[0].name", "blank", "doc_id % 5 = 0"), ("$.virtual_copies", "defaults", "doc_id % 11 = 0"),
    ("$.virtual_copies[0].recipe.adjustments.exposure", "out_of_range", "abs(n_chars % 25 - 12) > 10"), ("$.virtual_copies[0].mask_library[1].references", "arity", "doc_id % 3 = 0"), ("$.virtual_copies[0].mask_layers[0].mask", "unknown_mask", "doc_id % 13 = 0"), ("$.virtual_copies[0].history[1].id", "duplicate", "doc_id % 29 = 0"),
    ("$.virtual_copies[0].export_records[0].relative_path", "unsafe_path", "doc_id % 6 = 0"), ("$.virtual_copies[1].id", "duplicate", "doc_id % 7 = 0"),
]


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id AS id", f"{DOCUMENT} AS text")


@register("SELECT doc_id AS id, '$' AS path, 'not_json' AS code FROM documents WHERE doc_id % 17 = 0" + "".join(f" UNION ALL SELECT doc_id, '{p}', '{c}' FROM documents WHERE doc_id % 17 <> 0 AND {w}" for p, c, w in FAULTS))
def sidecar_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every violation of every document with its path."""
    return sidecars.violations(documents(spark, d))


@register("SELECT doc_id AS id, 'rating' AS field, CAST(doc_id % 6 AS VARCHAR) AS value FROM documents WHERE doc_id % 17 <> 0")
def sidecar_unknown_fields(spark: SparkSession, d: str) -> DataFrame:
    return sidecars.unknown_fields(documents(spark, d))


def short_sql(n: str, r: str) -> str:
    """The canonical spelling of an edited document."""
    return "concat('{\"own\":', " + n + ", ',\"rating\":', " + r + ", '}')"


START_SQL = short_sql("n_chars", "doc_id % 6")
EDITS_SQL = f"""WITH s AS (SELECT doc_id AS id, {START_SQL} AS text, n_chars FROM documents), e AS (SELECT event_id AS edit, event_id * 7 % 1200 AS id, user_id FROM events),
c AS (SELECT edit, e.id, user_id, s.text, n_chars, CASE WHEN s.id IS NULL THEN 'missing' WHEN edit % 31 = 0 THEN 'invalid' WHEN edit % 3 = 0 THEN 'conflict' END AS state FROM e LEFT JOIN s ON s.id = e.id),
f AS (SELECT id, min(edit) AS edit FROM c WHERE state IS NULL GROUP BY id)"""


def edit_results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").selectExpr("doc_id AS id", f"concat('{{ \"rating\": ', doc_id % 6, ', \"own\" :', n_chars, '}}') AS text", "CAST(NULL AS array<struct<revision: string, field: string, edit: bigint>>) AS history")
    base = docs.select("id", sidecars.revision(F.col("text")).alias("seen"))
    edits = table(spark, d, "events").selectExpr("event_id AS edit", "event_id * 7 % 1200 AS id", "'rating' AS field", "CASE WHEN event_id % 31 = 0 THEN '{' ELSE CAST(user_id AS STRING) END AS value")
    edits = edits.join(base, "id", "left").withColumn("base", F.when(F.col("edit") % 3 == 0, "stale").otherwise(F.col("seen"))).drop("seen")
    return sidecars.edited(docs, edits)


@register(f"{EDITS_SQL} SELECT c.edit, c.id, coalesce(CASE WHEN f.edit IS NOT NULL THEN 'applied' END, state, 'conflict') AS outcome FROM c LEFT JOIN f ON f.id = c.id AND f.edit = c.edit")
def sidecar_edit_log(spark: SparkSession, d: str) -> DataFrame:
    """Edits by events, a third of them stale; of those that agree on a revision the first wins."""
    return edit_results(spark, d)[1]


@register(f"""{EDITS_SQL}, r AS (SELECT s.id, s.text AS old, CASE WHEN f.edit IS NULL THEN s.text ELSE {short_sql("s.n_chars", "c.user_id")} END AS text, f.edit FROM s LEFT JOIN f ON f.id = s.id LEFT JOIN c ON c.edit = f.edit)
SELECT id, sha256(text) AS revision, CASE WHEN edit IS NULL THEN 0 ELSE 1 END AS entries, CASE WHEN edit IS NOT NULL THEN sha256(old) END AS former, edit FROM r""")
def sidecar_edit_state(spark: SparkSession, d: str) -> DataFrame:
    """Documents after the edits: revision, and the history entry written with it."""
    docs = edit_results(spark, d)[0]
    return docs.select("id", "revision", F.when(F.col("history").isNull(), 0).otherwise(F.size("history")).alias("entries"), F.get("history", F.lit(0))["revision"].alias("former"), F.get("history", F.lit(0))["edit"].alias("edit"))


# lenses: distinct part names are the database, parts and their makers' spellings the queries

WORDS_SQL = "list_distinct(regexp_extract_all(lower({}), '[a-z]+|[0-9]+'))"


@register(f"""WITH b AS (SELECT min(p_partkey) AS entry, p_brand AS make, p_name AS model FROM part GROUP BY p_brand, p_name), e AS (SELECT entry, {WORDS_SQL.format('make')} AS em, {WORDS_SQL.format('model')} AS et FROM b),
q AS (SELECT p_partkey AS query, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE upper(p_brand) END AS make, CASE WHEN p_partkey % 9 = 0 THEN '--' WHEN p_partkey % 10 = 0 THEN p_type || ' zoom' ELSE p_name || ' ' || p_size || 'mm ' || split_part(p_name, ' ', 1) END AS model FROM part),
t AS (SELECT query, {WORDS_SQL.format("coalesce(make, '')")} AS qm, {WORDS_SQL.format('model')} AS qt FROM q),
s AS (SELECT query, entry, CAST(floor(100 * len(list_intersect(qt, et)) / greatest(len(qt), len(et))) AS INTEGER) AS score FROM t, e WHERE len(list_intersect(qt, et)) > 0 AND (len(qm) = 0 OR len(list_intersect(qm, em)) > 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entry) AS place FROM s)
SELECT q.query, entry, score FROM q LEFT JOIN r ON r.query = q.query AND place = 1""")
def lens_matches(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    entries = parts.groupBy(F.col("p_brand").alias("make"), F.col("p_name").alias("model")).agg(F.min("p_partkey").alias("entry"))
    queries = parts.selectExpr("p_partkey AS query", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE upper(p_brand) END AS make", "CASE WHEN p_partkey % 9 = 0 THEN '--' WHEN p_partkey % 10 = 0 THEN concat(p_type, ' zoom') ELSE concat(p_name, ' ', p_size, 'mm ', split_part(p_name, ' ', 1)) END AS model")
    return lens_lookup.looked_up(queries, entries)


# digests


@register()
def content_blake3(spark: SparkSession, d: str) -> DataFrame:
    """BLAKE3 of every whole text; tests hold it against the published vectors."""
    return table(spark, d, "documents").select("doc_id", digests.blake3(F.col("text")).alias("blake3"))


CONFIG = [0.5, 0.001, -5.0, 5.0, -1.0, 1.0]
FNV = "list_reduce(list_prepend({start}::UBIGINT, {bytes}), lambda h, b: CAST((CAST(xor(h, b) AS UHUGEINT) * 1099511628211) % 18446744073709551616 AS UBIGINT))"


def head() -> int:
    return digests.chained(digests.START, b"".join(struct.pack("<d", v) for v in CONFIG) + struct.pack("<II", 8, 8))


@register(f"""{PX}, b AS (SELECT image_id, flatten(list([r, g, b, a] ORDER BY y, x)) AS v FROM px GROUP BY image_id)
SELECT image_id, 'tone-rgba8-rec709:' || printf('%016x', {FNV.format(start=head(), bytes="list_transform(v, lambda n: CAST(n AS UBIGINT))")}) AS fingerprint FROM b""")
def tone_fingerprint_fnv(spark: SparkSession, d: str) -> DataFrame:
    """The chained fingerprint of configuration, size and samples, its state carried from batch to batch."""
    return digests.sample_fingerprints(carrier_frames(spark, d), CONFIG)


# sessions: a conversation's turns are actions

ACTION = "CASE WHEN turn % 5 = CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END THEN 'load' WHEN turn % 7 = 6 THEN 'close' WHEN turn % 2 = 0 THEN 'save' ELSE 'edit' END"
IMAGE = "CASE WHEN turn % 11 = 3 THEN -1 ELSE conv_id * 10 + {} END"


def image_of(divide: str) -> str:
    return IMAGE.format(f"(turn + {{}}) {divide} 5".replace("{}", "CASE WHEN conv_id % 3 = 0 THEN 4 ELSE 0 END"))


@register(f"""WITH a AS (SELECT conv_id AS session, turn AS at_turn, {ACTION} AS action, {image_of('//')} AS image FROM conversations),
b AS (SELECT *, count(*) FILTER (WHERE action = 'load') OVER w AS n, last_value(CASE WHEN action = 'load' THEN image END IGNORE NULLS) OVER w AS now FROM a WINDOW w AS (PARTITION BY session ORDER BY at_turn, action, image ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, CASE WHEN action = 'load' THEN 'ok' WHEN action NOT IN ('edit', 'save') THEN 'unknown_action' WHEN n = 0 THEN 'no_image_loaded' WHEN image <> now THEN 'unknown_image' ELSE 'ok' END AS outcome FROM b)
SELECT session, at_turn, action, image, outcome, count(*) FILTER (WHERE action = 'edit' AND outcome = 'ok') OVER (PARTITION BY session, n ORDER BY at_turn, action, image ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS edits FROM c""")
def session_fold(spark: SparkSession, d: str) -> DataFrame:
    actions = table(spark, d, "conversations").selectExpr("conv_id AS session", "turn AS at", f"{ACTION} AS action", f"{image_of('DIV')} AS image")
    return sessions.folded(actions).withColumnRenamed("at", "at_turn")


# a whole recipe

RECIPE = """{"adjustments": {"wb_temperature": 5200, "exposure": 0.3, "contrast": -0.2, "vibrance": 0.2, "presence": {"texture": 0.5, "dehaze": 0.3}, "curves": {"master": [[0, 0], [0.4, 0.5], [1, 1]]}, "color_grading": {"shadows": {"hue_degrees": 220, "saturation": 0.3}},
 "noise_reduction": {"luminance": 0.6, "color": 0.5}, "sharpening": {"amount": 0.8, "radius": 1.2, "detail": 0.4, "masking": 0.5}}, "effects": {"vignette": {"amount": 0.4, "midpoint": 0.3}, "grain": {"amount": 0.4, "size": 0.2, "roughness": 0.5, "seed": 7}}, "geometry": {"degrees": 90.0}}"""


@register()
def recipe_render(spark: SparkSession, d: str) -> DataFrame:
    """Frames through all stages of a recipe; tests hold it against the kernels one after the other, each of which has SQL."""
    return render.rendered(carrier_frames(spark, d), render.Recipe.from_json(RECIPE), SIDE, SIDE)
