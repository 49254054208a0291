"""Queries on tiles, prompts and mask graphs, all from the given tables, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mask_graph, mask_levels, prompts
from ..sources import tiles
from ..sources.frames import carrier_frames, table
from ..sources.shared import shared_folder
from .queries import PX, register

# tiles

TILE = 4
CHANNELS = ("r", "g", "b")
HEXED = " || ".join(f"string_agg(printf('%02x', {c}), '' ORDER BY y, x)" for c in CHANNELS)
TILE_SQL = f"{PX}, t AS (SELECT image_id, x // 4 AS tx, y // 4 AS ty, max(x) % 4 + 1 AS width, max(y) % 4 + 1 AS height, sha256(unhex({HEXED})) AS checksum, sum(r) AS light FROM px GROUP BY ALL)"


def store(spark: SparkSession, d: str) -> str:
    folder = shared_folder(spark)
    tiles.stored(tiles.tiles_of(carrier_frames(spark, d), CHANNELS, TILE), folder, CHANNELS)
    return folder


@register(f"""{TILE_SQL}, q AS (SELECT event_id AS request, event_id % 3000 AS image_id, CAST(event_id % 3 AS INTEGER) AS tx, CAST(user_id % 2 AS INTEGER) AS ty FROM events)
SELECT request, q.image_id, q.tx, q.ty, width, height, checksum, CASE WHEN checksum IS NULL THEN 'missing' ELSE 'ok' END AS status FROM q LEFT JOIN t ON q.image_id = t.image_id AND q.tx = t.tx AND q.ty = t.ty""")
def tile_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Tiles asked for by events, verified; a third of the requests lies beyond the frames."""
    asked = table(spark, d, "events").select(F.col("event_id").alias("request"), (F.col("event_id") % 3000).alias("image_id"), (F.col("event_id") % 3).cast("int").alias("tx"), (F.col("user_id") % 2).cast("int").alias("ty"))
    found = tiles.looked_up(spark, store(spark, d), asked, CHANNELS)
    return found.select("request", "image_id", "tx", "ty", "width", "height", "checksum", "status")


@register(f"{TILE_SQL} SELECT image_id, tx, ty, width, height, checksum, 'ok' AS status FROM t")
def tile_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every record of a store, verified."""
    return tiles.scanned(spark, store(spark, d), CHANNELS).select("image_id", "tx", "ty", "width", "height", "checksum", "status")


REGION_SQL = f"""{PX}, t AS (SELECT image_id, 0 AS tx, 0 AS ty, 8 AS width, 8 AS height, string_agg(printf('%02x%02x', (g * 257) % 256, (g * 257) // 256), '' ORDER BY y, x) AS v, {HEXED.replace(" || ", " AS a_r, ", 1).replace(" || ", " AS a_g, ", 1)} AS a_b, sum(CASE WHEN g * 257 >= 32768 THEN 1 ELSE 0 END) AS covered FROM px GROUP BY image_id)"""


@register(f"{REGION_SQL}, q AS (SELECT DISTINCT doc_id % 700 AS image_id FROM documents) SELECT q.image_id, covered, sha256(unhex(v || a_r || a_g || a_b)) AS checksum, CASE WHEN v IS NULL THEN 'missing' ELSE 'ok' END AS status FROM q LEFT JOIN t ON q.image_id = t.image_id")
def region_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Repair regions (a plane of 16 bits and its replacement) by image, verified; images beyond the store are missing."""
    px = carrier_frames(spark, d)
    plane = tiles.tiles_of(px.withColumn("v", F.col("g") * 257), ("v",), sample="<u2")
    both = plane.join(tiles.tiles_of(px, CHANNELS).drop("width", "height"), tiles.KEYS)
    folder, channels = shared_folder(spark), ("v", *CHANNELS)
    tiles.stored(both, folder, channels)
    asked = table(spark, d, "documents").select((F.col("doc_id") % 700).alias("image_id"), F.lit(0).alias("tx"), F.lit(0).alias("ty")).distinct()
    found = tiles.looked_up(spark, folder, asked, channels)
    # little-endian samples: the high byte decides
    high = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.hex(F.substr("v", 2 * i, F.lit(1))), 16, 10).cast("int"))
    return found.select("image_id", F.when(F.col("v").isNotNull(), F.size(F.filter(high, lambda b: b >= 128))).alias("covered").cast("long").alias("covered"), "checksum", "status")


# prompts of each image's own, from its vector

RASTER = """WITH s AS (SELECT vec_id AS image_id, CAST(5 + vec_id % 9 AS INTEGER) AS width, CAST(4 + vec_id % 7 AS INTEGER) AS height, list_transform(embedding, lambda v: 0.5::DOUBLE + CAST(v AS DOUBLE)) AS u FROM embeddings),
f AS (SELECT *, unnest(range(width * height)) AS i FROM s), g AS (SELECT *, CAST(i % width AS INTEGER) AS x, CAST(i // width AS INTEGER) AS y, (i % width + 0.5::DOUBLE) / width AS nx, (i // width + 0.5::DOUBLE) / height AS ny FROM f)"""


def prompted(spark: SparkSession, d: str, kind: str, column: str, shape: str) -> DataFrame:
    """A prompt for each vector, its shape an expression over u, the vector's components about one half."""
    rows = table(spark, d, "embeddings").selectExpr("vec_id AS image_id", "CAST(5 + vec_id % 9 AS INT) AS width", "CAST(4 + vec_id % 7 AS INT) AS height", "transform(embedding, v -> CAST(0.5 AS DOUBLE) + CAST(v AS DOUBLE)) AS u")
    return rows.select("image_id", "width", "height", F.lit(kind).alias("kind"), *[(F.expr(shape) if c == column else F.lit(None)).cast(t).alias(c) for c, t in prompts.SHAPES.items()])


def inside(test: str) -> str:
    return f"{RASTER} SELECT image_id, x, y, CASE WHEN {test} THEN 65535 ELSE 0 END AS v FROM g"


@register(inside("x >= greatest(floor(u[1] * width), 0) AND x < least(ceil((u[1] + abs(u[2])) * width), width) AND y >= greatest(floor(u[3] * height), 0) AND y < least(ceil((u[3] + abs(u[4])) * height), height)"))
def prompt_box(spark: SparkSession, d: str) -> DataFrame:
    return prompts.planes(prompted(spark, d, "box", "box", "struct(u[0], u[2], abs(u[1]), abs(u[3]))"))


@register(inside("((nx - u[1]) / (abs(u[3]) + 0.01::DOUBLE)) * ((nx - u[1]) / (abs(u[3]) + 0.01::DOUBLE)) + ((ny - u[2]) / (abs(u[4]) + 0.01::DOUBLE)) * ((ny - u[2]) / (abs(u[4]) + 0.01::DOUBLE)) <= 1"))
def prompt_ellipse(spark: SparkSession, d: str) -> DataFrame:
    return prompts.planes(prompted(spark, d, "ellipse", "ellipse", "struct(u[0], u[1], abs(u[2]) + 0.01D, abs(u[3]) + 0.01D)"))


CROSSES = "list_sum(list_transform(range(1, 8), lambda k: CASE WHEN (u[2 * k] > ny) <> (u[2 * (1 + (k + 5) % 7)] > ny) AND nx < (u[2 * (1 + (k + 5) % 7) - 1] - u[2 * k - 1]) * (ny - u[2 * k]) / (u[2 * (1 + (k + 5) % 7)] - u[2 * k]) + u[2 * k - 1] THEN 1 ELSE 0 END)) % 2 = 1"


@register(inside(CROSSES))
def prompt_polygon(spark: SparkSession, d: str) -> DataFrame:
    """A polygon of seven corners for each vector, crossing itself as it comes."""
    return prompts.planes(prompted(spark, d, "polygon", "points", "transform(sequence(0, 6), k -> struct(u[2 * k], u[2 * k + 1]))"))


@register(f"""{RASTER}, a AS (SELECT *, cos(radians(floor(u[3] * 8) * 30)) AS dx, sin(radians(floor(u[3] * 8) * 30)) AS dy, 0.5::DOUBLE / width AS l, 1 - 0.5::DOUBLE / width AS r, 0.5::DOUBLE / height AS t, 1 - 0.5::DOUBLE / height AS b FROM g),
m AS (SELECT *, least(l * dx + t * dy, l * dx + b * dy, r * dx + t * dy, r * dx + b * dy) AS low, greatest(l * dx + t * dy, l * dx + b * dy, r * dx + t * dy, r * dx + b * dy) AS high FROM a)
SELECT image_id, x, y, CAST(floor(greatest(0, least(1, u[1] + greatest(0, least(1, (nx * dx + ny * dy - low) / greatest(high - low, 1.1920928955078125e-07))) * (u[2] - u[1]))) * 65535 + 0.5) AS INTEGER) AS v FROM m""")
def prompt_gradient(spark: SparkSession, d: str) -> DataFrame:
    return prompts.planes(prompted(spark, d, "gradient", "gradient", "struct(floor(u[2] * 8) * 30, u[0], u[1])"))


MARKS = [(1, 2, 3, True), (4, 5, 6, True), (7, 8, 9, False), (10, 11, 12, True)]


@register(inside("CASE " + " ".join(f"WHEN (nx - u[{x}]) * (nx - u[{x}]) + (ny - u[{y}]) * (ny - u[{y}]) <= (u[{r}] / 2) * (u[{r}] / 2) AND u[{r}] > 0 THEN {adds}" for x, y, r, adds in reversed(MARKS)) + " ELSE false END"))
def prompt_brush(spark: SparkSession, d: str) -> DataFrame:
    """Four marks for each vector, the third one erasing; the last mark on a pixel wins."""
    marks = ", ".join(f"struct(u[{x - 1}], u[{y - 1}], u[{r - 1}] / 2, {str(adds).lower()})" for x, y, r, adds in MARKS)
    return prompts.planes(prompted(spark, d, "brush", "marks", f"array({marks})"))


# mask graphs: forty events are a copy's graph, every five of them start with two sources

OPS = "CASE WHEN event_id % 5 < 2 THEN 'source' WHEN event_id % 41 = 0 THEN 'blend' WHEN event_type = 'signup' THEN 'intersect' WHEN event_type = 'purchase' THEN 'subtract' WHEN event_type = 'error' THEN 'invert' ELSE 'union' END"
FAULTS = [("event_id % 17 = 0", "event_id"), ("event_id % 19 = 0", "-1"), ("event_id % 29 = 0", "event_id + 1"), ("event_id % 37 = 0", "event_id - 40")]
SECOND = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in FAULTS) + " ELSE event_id - 2 END"
#: Some sources have no plane, some are of another size.
PAYLOAD = "event_id % 5 < 2 AND event_id % 13 <> 0"
WIDTH = "CASE WHEN event_id % 43 = 0 THEN 4 ELSE 3 END"
VALUE = "(event_id * 2654435761 + x * 40503 + y * 9973) % 65536"


def refs(array: str) -> str:
    one, two, none = (f"{array}({x})" if array else f"[{x}]" for x in ("event_id - 1", f"event_id - 1, {SECOND}", ""))
    none = "CAST(array() AS array<bigint>)" if array else "CAST([] AS BIGINT[])"
    lone = f"{array}({SECOND})" if array else f"[{SECOND}]"
    return f"CASE WHEN {OPS} = 'source' THEN CASE WHEN event_id % 31 = 0 THEN {one} ELSE {none} END WHEN {OPS} = 'invert' THEN {lone} WHEN event_id % 23 = 0 THEN {one} ELSE {two} END"


def graph(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id AS node", f"{OPS} AS op", f"{refs('array')} AS refs")


def payloads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(PAYLOAD).selectExpr("event_id AS node", f"{WIDTH} AS width", "2 AS height")


GRAPH_SQL = f"""n AS MATERIALIZED (SELECT event_id AS node, event_id, {OPS} AS op, {refs('')} AS refs, ({PAYLOAD}) AS loaded, {WIDTH} AS w FROM events),
own AS MATERIALIZED (SELECT *, CASE WHEN op NOT IN ('source', 'union', 'intersect', 'subtract', 'invert') THEN 'unknown_operation' WHEN op = 'source' AND len(refs) <> 0 OR op IN ('union', 'intersect') AND len(refs) < 2 OR op = 'subtract' AND len(refs) <> 2 OR op = 'invert' AND len(refs) <> 1 THEN 'arity' WHEN op = 'source' AND NOT loaded THEN 'missing_payload' END AS error FROM n),
e AS MATERIALIZED (SELECT node, op, unnest(refs) AS ref, unnest(range(len(refs))) AS ord, len(refs) AS k FROM own WHERE error IS NULL)"""
DEPTH = 10


def levels_sql() -> str:
    """done{DEPTH} has node, level, w of all nodes that can be evaluated; own sizes that differ fail."""
    parts = ["done0 AS MATERIALIZED (SELECT node, 0 AS level, w FROM own WHERE op = 'source' AND error IS NULL)"]
    for k in range(1, DEPTH + 1):
        parts.append(f"done{k} AS MATERIALIZED (SELECT * FROM done{k - 1} UNION ALL SELECT e.node, {k}, min(d.w) FROM e JOIN done{k - 1} d ON e.ref = d.node WHERE e.node NOT IN (SELECT node FROM done{k - 1}) GROUP BY e.node, e.k HAVING count(*) = e.k AND min(d.w) = max(d.w))")
    return ", ".join(parts)


WALK = f"""lost AS MATERIALIZED (SELECT own.node, coalesce(own.error, CASE WHEN m.node IS NOT NULL THEN 'dimension_mismatch' END) AS error, f.ref FROM own LEFT JOIN
 (SELECT node, arg_min(ref, ord) AS ref, min(ord) AS ord FROM e WHERE ref NOT IN (SELECT node FROM done{DEPTH}) GROUP BY node) f USING (node) LEFT JOIN
 (SELECT e.node FROM e JOIN done{DEPTH} d ON e.ref = d.node LEFT JOIN (SELECT node, min(ord) AS ord FROM e WHERE ref NOT IN (SELECT node FROM done{DEPTH}) GROUP BY node) g ON g.node = e.node WHERE g.ord IS NULL OR e.ord < g.ord GROUP BY e.node HAVING min(d.w) <> max(d.w)) m USING (node)
 WHERE own.node NOT IN (SELECT node FROM done{DEPTH})),
ends AS MATERIALIZED (SELECT * FROM lost UNION ALL SELECT DISTINCT ref, 'missing_mask', NULL::BIGINT FROM lost WHERE ref NOT IN (SELECT node FROM own)),
walk(node, at_node, error, seen) AS (SELECT node, node, error, [node] FROM ends UNION ALL SELECT w.node, e.node, CASE WHEN list_contains(w.seen, e.node) THEN 'cycle' ELSE e.error END, list_append(w.seen, e.node) FROM walk w JOIN ends s ON s.node = w.at_node JOIN ends e ON e.node = s.ref WHERE w.error IS NULL)"""


@register(f"WITH RECURSIVE {GRAPH_SQL}, {levels_sql()}, {WALK} SELECT node, level, NULL AS error, NULL AS at_node FROM done{DEPTH} UNION ALL SELECT node, NULL, error, at_node FROM walk WHERE error IS NOT NULL")
def mask_graph_levels(spark: SparkSession, d: str) -> DataFrame:
    """Each event's node with its level, or the failure that its evaluation meets first and where."""
    fine, failed = mask_levels.levels(graph(spark, d), payloads(spark, d))
    return fine.select("node", "level", F.lit(None).cast("string").alias("error"), F.lit(None).cast("long").alias("at_node")).union(failed.select("node", F.lit(None).cast("int"), "error", "at"))


def planes_sql() -> str:
    parts = [f"p0 AS MATERIALIZED (SELECT node, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST({VALUE} AS INTEGER) AS v FROM (SELECT node, node AS event_id, w, unnest(range(w)) AS x FROM done0), range(2) r(y))"]
    for k in range(1, DEPTH + 1):
        v = "CASE e.op WHEN 'union' THEN max(v) WHEN 'intersect' THEN min(v) WHEN 'invert' THEN 65535 - min(v) ELSE CAST((CAST(arg_min(v, ord) AS BIGINT) * (65535 - arg_max(v, ord)) + 32767) // 65535 AS INTEGER) END"
        parts.append(f"p{k} AS MATERIALIZED (SELECT * FROM p{k - 1} UNION ALL SELECT e.node, x, y, {v} FROM e JOIN done{DEPTH} d ON d.node = e.node AND d.level = {k} JOIN p{k - 1} p ON p.node = e.ref GROUP BY e.node, e.op, x, y)")
    return ", ".join(parts)


@register(f"WITH RECURSIVE {GRAPH_SQL}, {levels_sql()}, {planes_sql()} SELECT node, x, y, v FROM p{DEPTH}")
def mask_dag_planes(spark: SparkSession, d: str) -> DataFrame:
    """All planes of all copies' graphs, one aggregate a level."""
    fine, _ = mask_levels.levels(graph(spark, d), payloads(spark, d))
    cells = payloads(spark, d).selectExpr("node", "node AS event_id", "explode(sequence(0, width - 1)) AS x", "height").selectExpr("*", "explode(sequence(0, height - 1)) AS y")
    return mask_levels.evaluated(graph(spark, d), fine, cells.selectExpr("node", "x", "y", f"CAST({VALUE} AS INT) AS v"))


STATUS = "CASE WHEN event_id % 11 = 0 THEN 'Pending' WHEN event_id % 47 = 0 THEN 'Failed' ELSE 'Valid' END"
LAYERS_SQL = f"outcomes AS (SELECT l.event_id // 40 AS copy, l.event_id AS layer, coalesce(CASE WHEN s.status IS NULL OR s.status <> 'Valid' THEN 'unavailable' END, CASE WHEN w.error IS NOT NULL THEN 'evaluation' END, 'ok') AS outcome, CASE WHEN s.status IS NULL THEN 'Missing' WHEN s.status <> 'Valid' THEN s.status ELSE w.error END AS reason FROM events l LEFT JOIN (SELECT event_id AS node, {STATUS} AS status FROM events) s ON s.node = l.event_id + 3 LEFT JOIN (SELECT node, error FROM walk WHERE error IS NOT NULL) w ON w.node = l.event_id + 3 WHERE l.event_id % 5 = 0)"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    layers = events.where("event_id % 5 = 0").selectExpr("event_id DIV 40 AS copy", "event_id AS layer", "event_id AS ord", "event_id + 3 AS node")
    _, failed = mask_levels.levels(graph(spark, d), payloads(spark, d))
    return mask_levels.layer_outcomes(layers, events.selectExpr("event_id AS node", f"{STATUS} AS status"), failed)


@register(f"WITH RECURSIVE {GRAPH_SQL}, {levels_sql()}, {WALK}, {LAYERS_SQL} SELECT copy, layer, outcome, reason FROM outcomes")
def mask_layers_warn(spark: SparkSession, d: str) -> DataFrame:
    """Layers, each on the last node of a group of five: what a warning renderer draws and what it skips."""
    return outcomes(spark, d).select("copy", "layer", "outcome", "reason")


@register(f"WITH RECURSIVE {GRAPH_SQL}, {levels_sql()}, {WALK}, {LAYERS_SQL} SELECT copy, count(*) AS layers, min(layer) FILTER (WHERE outcome <> 'ok') AS failed_layer, arg_min(outcome, layer) FILTER (WHERE outcome <> 'ok') AS outcome, arg_min(reason, layer) FILTER (WHERE outcome <> 'ok') AS reason FROM outcomes GROUP BY copy")
def mask_layers_strict(spark: SparkSession, d: str) -> DataFrame:
    return mask_levels.strict(outcomes(spark, d))


# the graph's checks on the same table

REACHED_SQL = f"WITH RECURSIVE {GRAPH_SQL}, every AS (SELECT node, unnest(refs) AS ref FROM n), r(src, dst) AS (SELECT node, ref FROM every UNION SELECT r.src, every.ref FROM r JOIN every ON r.dst = every.node)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).select(F.col("node").alias("src"), F.explode("refs").alias("dst"))


@register(f"{REACHED_SQL} SELECT src, dst, src = dst AS on_cycle FROM r")
def mask_closure(spark: SparkSession, d: str) -> DataFrame:
    return mask_graph.reached(edges(spark, d)).withColumn("on_cycle", F.col("src") == F.col("dst"))


@register(f"{REACHED_SQL} SELECT src, dst FROM r")
def mask_reachability(spark: SparkSession, d: str) -> DataFrame:
    return mask_graph.reached(edges(spark, d))


@register(f"""{REACHED_SQL}, loops AS (SELECT src FROM r WHERE src = dst), lost AS (SELECT DISTINCT node FROM every WHERE ref NOT IN (SELECT node FROM n))
SELECT node AS id, CASE WHEN op NOT IN ('source', 'union', 'intersect', 'subtract', 'invert') THEN 'unknown_operation' WHEN op = 'source' AND len(refs) <> 0 OR op IN ('union', 'intersect') AND len(refs) < 2 OR op = 'subtract' AND len(refs) <> 2 OR op = 'invert' AND len(refs) <> 1 THEN 'arity'
WHEN node IN (SELECT node FROM lost) THEN 'dangling' WHEN node IN (SELECT src FROM loops) THEN 'cycle' END AS error FROM n""")
def mask_definition_errors(spark: SparkSession, d: str) -> DataFrame:
    return mask_graph.definition_errors(graph(spark, d).withColumnRenamed("node", "id")).select("id", "error")


@register(f"""{REACHED_SQL}, bad AS (SELECT DISTINCT ref AS id FROM every WHERE ref NOT IN (SELECT node FROM n) UNION SELECT node FROM n WHERE len(refs) = 0 AND NOT loaded UNION SELECT src FROM r WHERE src = dst),
onto AS (SELECT src AS id FROM r WHERE dst IN (SELECT id FROM bad) UNION SELECT id FROM bad)
SELECT node AS id, node NOT IN (SELECT id FROM onto) AS blessed FROM n""")
def mask_blessing(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph(spark, d).withColumnRenamed("node", "id")
    loaded = payloads(spark, d).select(F.col("node").alias("id"), F.lit(True).alias("valid"))
    return mask_graph.blessed(nodes.join(loaded, "id", "left").withColumn("valid", F.coalesce("valid", F.lit(False))))
