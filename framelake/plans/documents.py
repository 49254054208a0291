"""Recipe, catalog and mask-graph queries over the carrier tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import luminance
from ..operators import catalog, mask_graph, recipes
from ..sources.frames import SIDE, carrier_frames, grid, table
from .queries import KEY, KEY_SQL, ORACLE, PX, QUERIES, grid_sql, plane, register, rounded

__all__ = ["ORACLE", "QUERIES"]

PATHS = ["sharpening.amount", "lens.ca_red", "geometry.rotation_degrees", "hsl.cyan.hue", "perspective.scale", "curves.none"]
BOUNDS = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in recipes.NESTED.items())


@register(f"""WITH e AS (SELECT event_id, ({PATHS!r})[event_id % 6 + 1] AS path, event_id % 13 % 12 + 1 AS version, value / 7 AS value FROM events), b(path, least, most) AS (VALUES {BOUNDS})
SELECT event_id, CASE WHEN least IS NULL THEN 'unsupported' WHEN version <> 1 THEN 'version' WHEN value IS NULL OR NOT isfinite(value) THEN 'not_finite' WHEN value < least OR value > most THEN 'out_of_range' END AS code,
CASE WHEN least IS NULL OR version <> 1 OR value IS NULL OR NOT isfinite(value) OR value < least OR value > most THEN least END AS least, CASE WHEN least IS NULL OR version <> 1 OR value IS NULL OR NOT isfinite(value) OR value < least OR value > most THEN most END AS most
FROM e LEFT JOIN b USING (path)""")
def nested_validate(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "events").selectExpr("event_id", f"element_at(array({', '.join(map(repr, PATHS))}), CAST(event_id % 6 AS INT) + 1) AS path", "event_id % 13 % 12 + 1 AS version", "value / 7 AS value")
    return recipes.checked_fields(fields).select("event_id", "error.code", "error.least", "error.most")


@register("""WITH p AS (SELECT doc_id, CAST(n_chars % 5 AS INTEGER) + 1 AS n, doc_id % 3 AS kind FROM documents), c AS (SELECT doc_id, kind, list_transform(range(n), lambda i: {'input': CASE WHEN kind = 2 AND i = 1 THEN 0.0::DOUBLE ELSE i / greatest(n - 1, 1)::DOUBLE END, 'output': CASE WHEN kind = 1 AND i = n - 1 THEN 1.5::DOUBLE ELSE i / greatest(n - 1, 1)::DOUBLE END}) AS pts FROM p),
f AS (SELECT doc_id, pts, len(pts) AS n, len(list_filter(pts, lambda p: p.input NOT BETWEEN 0 AND 1 OR p.output NOT BETWEEN 0 AND 1)) AS outside, len(list_filter(range(2, len(pts) + 1), lambda i: pts[i].input <= pts[i - 1].input)) AS falls FROM c)
SELECT doc_id, CASE WHEN n < 2 OR n > 32 THEN 'points' WHEN outside > 0 THEN 'range' WHEN falls > 0 THEN 'order' WHEN pts[1].input <> 0 OR pts[1].output <> 0 THEN 'start' WHEN pts[n].input <> 1 OR pts[n].output <> 1 THEN 'end' END AS error FROM f""")
def curve_validate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").selectExpr("doc_id", "CAST(n_chars % 5 AS INT) + 1 AS n", "doc_id % 3 AS kind")
    at = F.expr("transform(sequence(0, n - 1), i -> struct(CASE WHEN kind = 2 AND i = 1 THEN 0.0D ELSE i / greatest(n - 1, 1) END AS input, CASE WHEN kind = 1 AND i = n - 1 THEN 1.5D ELSE i / greatest(n - 1, 1) END AS output))")
    return p.select("doc_id", recipes.curve_error(at).alias("error"))


EXPORTS = "doc_id, (['png', 'jpg', 'webp', 'tiff', NULL])[doc_id % 5 + 1] AS format, n_chars % 110 AS quality, CASE WHEN doc_id % 7 = 0 THEN 16 ELSE 8 END AS bits"


@register(f"SELECT doc_id, CASE WHEN format IS NULL OR format NOT IN ('png', 'jpg', 'jpeg', 'webp') THEN 'format' WHEN quality NOT BETWEEN 1 AND 100 THEN 'quality' WHEN bits <> 8 THEN 'bits' END AS error FROM (SELECT {EXPORTS} FROM documents)")
def export_validate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").selectExpr("doc_id", "element_at(array('png', 'jpg', 'webp', 'tiff', NULL), CAST(doc_id % 5 AS INT) + 1) AS format", "n_chars % 110 AS quality", "CASE WHEN doc_id % 7 = 0 THEN 16 ELSE 8 END AS bits")
    return rows.select("doc_id", recipes.export_error(F.col("format"), F.col("quality"), F.col("bits")).alias("error"))


@register("SELECT event_id, CASE WHEN t NOT BETWEEN 0 AND 1 THEN 'target' WHEN e <= 0 OR e > 1 THEN 'epsilon' WHEN lo > hi THEN 'bounds' END AS error FROM (SELECT event_id, value / 100 AS t, event_id % 5 / 4.0::DOUBLE AS e, event_id % 7 AS lo, event_id % 9 AS hi FROM events)")
def auto_tone_config(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    number = lambda x: F.expr(x).cast("double")
    return e.select("event_id", recipes.auto_tone_error(F.col("value") / 100, number("event_id % 5 / 4.0D"), number("event_id % 7"), number("event_id % 9")).alias("error"))


USER_SQL = f"r AS (SELECT user_id, {KEY_SQL} AS key, max_by(value, event_id) / 10 AS value FROM events GROUP BY ALL)"


def user_recipes(spark: SparkSession, d: str) -> DataFrame:
    """user_id and adjustments: the newest value of each of four keys."""
    latest = table(spark, d, "events").groupBy("user_id", F.expr(KEY).alias("key")).agg((F.max_by("value", "event_id") / 10).alias("value"))
    return latest.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("adjustments"))  # at most four entries


CANON = "coalesce(string_agg(key || '=' || printf('%.6f', value), ',' ORDER BY key), '')"


@register(f"WITH {USER_SQL} SELECT user_id, sha256({CANON}) AS recipe_hash, sha256(coalesce(string_agg(key || '=' || printf('%.6f', value), ',' ORDER BY key) FILTER (WHERE key NOT IN {recipes.DOWNSTREAM!r}), '')) AS mask_hash FROM r GROUP BY user_id")
def recipe_hash(spark: SparkSession, d: str) -> DataFrame:
    return user_recipes(spark, d).select("user_id", recipes.recipe_hash(F.col("adjustments")).alias("recipe_hash"), recipes.mask_recipe_hash(F.col("adjustments")).alias("mask_hash"))


@register(f"""WITH {USER_SQL}, k AS (SELECT user_id, key, value FROM r UNION ALL SELECT DISTINCT user_id, 'crop', user_id / 10.0::DOUBLE FROM events), h AS (SELECT user_id, 'sha256:' || user_id AS src, sha256({CANON}) AS whole, sha256(coalesce(string_agg(key || '=' || printf('%.6f', value), ',' ORDER BY key) FILTER (WHERE key <> 'crop'), '')) AS mask FROM k GROUP BY user_id)
SELECT user_id, sha256(concat_ws(chr(0), 'decode', src, 'd1', 'p1', 'vc-original')) AS decode_key, sha256(concat_ws(chr(0), 'mask', src, 'd1', 'p1', 'vc-original', mask, 'a,b')) AS mask_key, sha256(concat_ws(chr(0), 'render', src, 'd1', 'p1', 'vc-original', whole, 'a,b', 'srgb', 'png', '640', '480')) AS render_key FROM h""")
def render_key(spark: SparkSession, d: str) -> DataFrame:
    """Keys of three scopes; the crop changes only the last."""
    rows = user_recipes(spark, d).withColumn("adjustments", F.map_concat("adjustments", F.create_map(F.lit("crop"), F.col("user_id") / 10.0)))
    of = lambda scope: recipes.render_key(scope, F.concat(F.lit("sha256:"), F.col("user_id")), [F.lit("d1"), F.lit("p1")], F.lit("vc-original"), F.col("adjustments"), F.array(F.lit("a"), F.lit("b")), [F.lit("srgb"), F.lit("png"), F.lit(640), F.lit(480)])
    return rows.select("user_id", *[of(s).alias(f"{s}_key") for s in ("decode", "mask", "render")])


@register(f"""WITH {USER_SQL}, u AS (SELECT DISTINCT user_id FROM r), base AS (SELECT user_id, key, value FROM r WHERE user_id % 3 <> 0 UNION ALL SELECT user_id, k, v FROM u, (VALUES ('contrast', 0.3::DOUBLE), ('tint', -0.2::DOUBLE)) p(k, v) WHERE user_id % 3 = 0), flag AS (SELECT user_id, 'exposure' AS key, 0.7::DOUBLE AS value FROM u WHERE user_id % 2 = 0)
SELECT coalesce(b.user_id, f.user_id) AS user_id, coalesce(b.key, f.key) AS key, round(coalesce(f.value, b.value), 6) AS value FROM base b FULL JOIN flag f ON b.user_id = f.user_id AND b.key = f.key""")
def recipe_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Automatic values, replaced by a preset for every third user, with a flag on top for every second."""
    preset = F.when(F.col("user_id") % 3 == 0, F.create_map(F.lit("contrast"), F.lit(0.3), F.lit("tint"), F.lit(-0.2)))
    flags = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("exposure"), F.lit(0.7)))
    return rounded(user_recipes(spark, d).select("user_id", F.explode(recipes.merged(F.col("adjustments"), preset, flags)).alias("key", "value")))


BYTE = "CAST(greatest(0, least(255, round({}))) AS INTEGER)"


def applied_sql(c: str, gain: str) -> str:
    warm = "(4000 + image_id % 5 * 1500 - 6500) / 5500.0::DOUBLE"
    t = f"CASE WHEN image_id % 3 = 0 THEN {c} ELSE {BYTE.format(f'{c} * ({gain.format(warm)})')} END"
    e = f"CASE WHEN image_id % 4 = 0 THEN t{c} ELSE {BYTE.format(f't{c} * pow(2.0::DOUBLE, image_id % 7 / 4.0::DOUBLE - 0.75)')} END"
    k = f"CASE WHEN image_id % 5 = 0 THEN e{c} ELSE {BYTE.format(f'(e{c} - 128) * (1 + (image_id % 9 / 8.0::DOUBLE - 0.5)) + 128')} END"
    return t, e, k


PARTS = {c: applied_sql(c, g) for c, g in (("r", "1 - 0.35::DOUBLE * ({})"), ("g", "1.0::DOUBLE + 0 * ({})"), ("b", "1 + 0.35::DOUBLE * ({})"))}


@register(f"{PX}, t AS (SELECT *, {', '.join(f'{PARTS[c][0]} AS t{c}' for c in 'rgb')} FROM px), e AS (SELECT *, {', '.join(f'{PARTS[c][1]} AS e{c}' for c in 'rgb')} FROM t) SELECT image_id, x, y, {', '.join(f'{PARTS[c][2]} AS {c}' for c in 'rgb')} FROM e")
def recipe_apply(spark: SparkSession, d: str) -> DataFrame:
    """Every frame developed with its own recipe row."""
    px = carrier_frames(spark, d)
    own = px.select("image_id").distinct().select(
        "image_id", F.expr("CASE WHEN image_id % 3 <> 0 THEN 4000D + image_id % 5 * 1500D END").alias("temperature"), F.expr("CASE WHEN image_id % 4 <> 0 THEN image_id % 7 / 4.0D - 0.75D END").alias("exposure"), F.expr("CASE WHEN image_id % 5 <> 0 THEN image_id % 9 / 8.0D - 0.5D END").alias("contrast")
    )
    return recipes.apply_recipes(px, own)


@register(f"WITH {USER_SQL}, e AS (SELECT user_id + 100 AS user_id, 'contrast' AS key, max_by(value, event_id) / 50 AS value FROM events GROUP BY ALL), b AS (SELECT user_id, key, value FROM r) SELECT coalesce(b.user_id, e.user_id) AS copy, coalesce(b.key, e.key) AS key, round(coalesce(e.value, b.value), 6) AS value, coalesce(b.user_id, e.user_id) NOT IN (SELECT user_id FROM r) AS created FROM b FULL JOIN e ON b.user_id = e.user_id AND b.key = e.key")
def develop_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The newest contrast of each user goes to copy user + 100, which may not exist yet."""
    edits = table(spark, d, "events").select((F.col("user_id") + 100).alias("copy"), F.lit("contrast").alias("key"), (F.col("value") / 50).alias("value"), F.col("event_id").alias("ord"))
    out = recipes.upserted(user_recipes(spark, d).withColumnRenamed("user_id", "copy"), edits)
    return rounded(out.select("copy", F.explode("adjustments").alias("key", "value"), "created"))


# masks

NODES = [("s1", "source", []), ("s2", "source", []), ("s3", "source", []), ("u", "union", ["s1", "s2"]), ("i", "intersect", ["u", "s3"]), ("n", "invert", ["i"]), ("m", "subtract", ["u", "n"])]


@register(f"""{PX}, v AS (SELECT image_id, x, y, greatest(r, g) * 257 AS u, 65535 - least(greatest(r, g), b) * 257 AS n FROM px)
SELECT image_id, x, y, CAST((CAST(u AS BIGINT) * (65535 - n) + 32767) // 65535 AS INTEGER) AS v FROM v""")
def mask_dag(spark: SparkSession, d: str) -> DataFrame:
    px = carrier_frames(spark, d)
    return mask_graph.evaluated({i: (op, refs) for i, op, refs in NODES}, {f"s{k + 1}": plane(px, c) for k, c in enumerate("rgb")}, "m")


ALPHA = "CAST(round(greatest(0, least(1, {})) * 65535) AS INTEGER)"


@register(grid_sql(16, 12, ALPHA.format("1 - sqrt(((x - 7.5::DOUBLE) / 8) * ((x - 7.5::DOUBLE) / 8) + ((y - 5.5::DOUBLE) / 6) * ((y - 5.5::DOUBLE) / 6))")))
def matte_radial(spark: SparkSession, d: str) -> DataFrame:
    return mask_graph.radial_matte(grid(spark, 16, 12), 16, 12)


@register(grid_sql(64, 32, ALPHA.format("1 - sqrt(pow(greatest(20 - x, x - 40, 0), 2) + pow(greatest(8 - y, y - 20, 0), 2)) / 4.0::DOUBLE")))
def matte_box(spark: SparkSession, d: str) -> DataFrame:
    return mask_graph.prompted(grid(spark, 64, 32), 64, 32, box=(20, 8, 40, 20), points=[(1, 1, True)])


def disc(px: int, py: int) -> str:
    return f"greatest(0, least(1, 1 - sqrt((x - {px}) * (x - {px}) + (y - {py}) * (y - {py})) / 8.0::DOUBLE))"


@register(grid_sql(64, 32, ALPHA.format(f"greatest(greatest(0, greatest({disc(20, 10)}, {disc(30, 16)}) - {disc(25, 12)}), {disc(50, 20)})")))
def matte_points(spark: SparkSession, d: str) -> DataFrame:
    return mask_graph.prompted(grid(spark, 64, 32), 64, 32, points=[(20, 10, True), (30, 16, True), (25, 12, False), (50, 20, True)])


@register(f"SELECT event_id, {ALPHA.format('1 / (1 + exp(-(value / 20 - 2)))')} AS v FROM events")
def matte_logits(spark: SparkSession, d: str) -> DataFrame:
    return mask_graph.logit_matte(table(spark, d, "events").select("event_id", (F.col("value") / 20 - 2).alias("logit"))).select("event_id", "v")


@register("SELECT user_id, CASE WHEN user_id % 11 = 0 THEN 'large' WHEN user_id % 24 < 4 THEN 'tiny' WHEN user_id % 24 < 8 THEN 'small' WHEN user_id % 24 < 16 THEN 'base_plus' ELSE 'large' END AS variant FROM (SELECT DISTINCT user_id FROM events)")
def model_selection(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", mask_graph.variant(F.col("user_id") % 24, F.when(F.col("user_id") % 11 == 0, "large")).alias("variant"))


FACTS_SQL = """l AS (SELECT event_id AS layer, user_id % 20 AS copy, event_id % 7 AS mask FROM events), df AS (SELECT c.i AS copy, m.i AS mask, CASE WHEN (c.i + m.i) % 4 = 0 THEN 'Pending' ELSE 'Valid' END AS status, 8 AS width, 8 AS height FROM range(20) c(i), range(6) m(i)), pl AS (SELECT c.i AS copy, m.i AS mask, CASE WHEN c.i = 3 THEN 4 ELSE 8 END AS pw, 8 AS ph FROM range(20) c(i), range(5) m(i))"""


@register(f"WITH {FACTS_SQL} SELECT layer, copy, mask, CASE WHEN status IS NULL THEN 'missing_definition' WHEN status <> 'Valid' THEN 'not_valid' WHEN pw IS NULL THEN 'missing_plane' WHEN pw <> width OR ph <> height THEN 'size' END AS warning FROM l LEFT JOIN df USING (copy, mask) LEFT JOIN pl USING (copy, mask)")
def layer_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Layers against their definitions and loaded planes; failures are rows, not exceptions."""
    layers = table(spark, d, "events").selectExpr("event_id AS layer", "user_id % 20 AS copy", "event_id % 7 AS mask")
    cells = lambda n: spark.range(20 * n).selectExpr(f"id % 20 AS copy", f"id div 20 AS mask")  # noqa: E731, F541
    definitions = cells(6).selectExpr("*", "CASE WHEN (copy + mask) % 4 = 0 THEN 'Pending' ELSE 'Valid' END AS status", "8 AS width", "8 AS height")
    return mask_graph.layered(layers, definitions, cells(5).selectExpr("*", "CASE WHEN copy = 3 THEN 4 ELSE 8 END AS width", "8 AS height"))


@register(f"{PX} SELECT image_id, x, y, CASE WHEN image_id % 3 = 0 THEN r * 257 WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN 65535 ELSE 0 END AS v FROM px")
def mask_source(spark: SparkSession, d: str) -> DataFrame:
    """A loaded plane wins, else the prompt's raster."""
    px = carrier_frames(spark, d)
    loaded = plane(px, "r").where("image_id % 3 = 0").withColumnRenamed("v", "loaded")
    prompt = F.when(F.col("x").between(2, 5) & F.col("y").between(2, 5), 65535).otherwise(0)
    return px.select("image_id", "x", "y").join(loaded, ["image_id", "x", "y"], "left").select("image_id", "x", "y", F.coalesce("loaded", prompt).alias("v"))


@register(f"{PX} SELECT image_id, x, y, " + ", ".join(f"CASE WHEN b * 257 >= 32768 THEN {c} // 2 WHEN r * 257 >= 32768 THEN 255 - {c} ELSE {c} END AS {c}" for c in "rgb") + " FROM px")
def source_actions_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Two regions with their replacements; of the actions that cover a pixel the last in the list wins."""
    px = carrier_frames(spark, d)
    first = px.where("r * 257 >= 32768").select("image_id", "x", "y", F.lit(1).alias("ord"), F.struct(*[(255 - F.col(c)).alias(c) for c in "rgb"]).alias("p"))
    second = px.where("b * 257 >= 32768").select("image_id", "x", "y", F.lit(2).alias("ord"), F.struct(*[F.floor(F.col(c) / 2).cast("int").alias(c) for c in "rgb"]).alias("p"))
    last = first.union(second).groupBy("image_id", "x", "y").agg(F.max_by("p", "ord").alias("p"))
    return px.join(last, ["image_id", "x", "y"], "left").select("image_id", "x", "y", *[F.coalesce(F.col(f"p.{c}"), F.col(c)).alias(c) for c in "rgb"])


# frames' statistics that the report lacks


@register(f"{PX} SELECT image_id, round(stddev_pop(l), 6) AS stddev FROM lum GROUP BY image_id")
def luminance_stddev(spark: SparkSession, d: str) -> DataFrame:
    return rounded(carrier_frames(spark, d).groupBy("image_id").agg(F.stddev_pop(luminance()).alias("stddev")))


@register(f"{PX}, h AS (SELECT image_id, CAST(least(floor(l * 256), 255) AS INTEGER) AS bin, count(*) AS n FROM lum GROUP BY 1, 2), z AS (SELECT i.image_id, b.i AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM h) i CROSS JOIN range(256) b(i) LEFT JOIN h ON h.image_id = i.image_id AND h.bin = b.i) SELECT image_id, sha256('8x8:' || string_agg(n::VARCHAR, ',' ORDER BY bin)) AS digest FROM z GROUP BY image_id")
def histogram_digest(spark: SparkSession, d: str) -> DataFrame:
    """Of the frame's size and all 256 bins, in one pass: counts by bin in a map, zeros filled in from it."""
    level = F.least(F.floor(luminance() * 256), F.lit(255)).cast("int")
    counts = carrier_frames(spark, d).groupBy("image_id", level.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = counts.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # at most 256 entries
    every = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("string"))
    return bins.select("image_id", F.sha2(F.concat(F.lit(f"{SIDE}x{SIDE}:"), F.array_join(every, ",")), 256).alias("digest"))


@register(f"{PX} SELECT image_id, 'tone-rgba8-rec709:' || sha256('0.5|8x8|' || string_agg(r || '.' || g || '.' || b || '.' || a, ',' ORDER BY y, x)) AS fingerprint FROM px GROUP BY image_id")
def tone_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Configuration, size and pixels: rows' digests would do for large frames; these are small."""
    px = carrier_frames(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", F.concat_ws(".", "r", "g", "b", "a").alias("p")))).alias("p"))
    return px.select("image_id", F.concat(F.lit("tone-rgba8-rec709:"), F.sha2(F.concat(F.lit(f"0.5|{SIDE}x{SIDE}|"), F.array_join(F.transform("p", lambda v: v["p"]), ",")), 256)).alias("fingerprint"))


# catalog


@register("SELECT page_id, lower(url) = lower(replace(url, 'http:', 'https:')) AS same_path FROM pages")
def overwrite_guard(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose output would overwrite their input."""
    out = F.replace("url", F.lit("http:"), F.lit("https:"))
    return table(spark, d, "pages").select("page_id", catalog.same_path(F.col("url"), out).alias("same_path"))


@register("SELECT doc_id, CASE WHEN w::HUGEINT * h * 4 > 9223372036854775807 THEN 'overflow' WHEN w::HUGEINT * h * 4 > 4000000000 THEN 'too_large' ELSE 'ok' END AS decode FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 4000000000 ELSE n_chars * 10 END AS w, CASE WHEN doc_id % 13 = 0 THEN 4000000000 ELSE n_chars + doc_id * 50 END AS h FROM documents)")
def memory_guard(spark: SparkSession, d: str) -> DataFrame:
    """Sizes checked before anything is decoded; an overflow is a result, not an exception."""
    rows = table(spark, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 13 = 0 THEN 4000000000 ELSE n_chars * 10 END AS w", "CASE WHEN doc_id % 13 = 0 THEN 4000000000 ELSE n_chars + doc_id * 50 END AS h")
    return rows.select("doc_id", catalog.decode_error(F.col("w"), F.col("h")).alias("decode"))


@register("SELECT source, count(*) FILTER (WHERE n_chars % 5 <> 0) AS ok, count(*) FILTER (WHERE n_chars % 5 = 0) AS failed FROM documents GROUP BY source")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    failed = F.col("n_chars") % 5 == 0
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"))


@register("WITH c AS (SELECT user_id, event_id, event_type AS model, event_id % 4 = 0 AS missing FROM events) SELECT user_id, count(*) AS copies, count(DISTINCT model) FILTER (WHERE missing) AS missing_models, count(*) FILTER (WHERE event_id % 9 = 0) AS defaults, count(*) FILTER (WHERE event_id % 9 = 0) = 1 AS one_default FROM c GROUP BY user_id")
def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    """Copies, missing models and default copies of each image."""
    copies = table(spark, d, "events").select("user_id", F.col("event_type").alias("model"), (F.col("event_id") % 4 == 0).alias("missing"), (F.col("event_id") % 9 == 0).alias("is_default"))
    return catalog.copy_summary(copies, "user_id")


@register("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality * 1000 + l.toxic <> d.n_chars % 2 * 1000 + d.n_chars % 3 THEN 'changed' ELSE 'same' END AS status FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def source_changed(spark: SparkSession, d: str) -> DataFrame:
    """A source counts as the same only if both of its facts are equal."""
    known = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    met = table(spark, d, "documents").join(known, "doc_id", "left")
    return met.select("doc_id", F.when(F.col("q").isNull(), "missing").when((F.col("q") != F.col("n_chars") % 2) | (F.col("t") != F.col("n_chars") % 3), "changed").otherwise("same").alias("status"))


@register("SELECT doc_id, json_extract_string(j, '$.id') AS id, CAST(json_extract_string(j, '$.version') AS BIGINT) AS version, json_array_length(j, '$.copies') AS copies, CASE WHEN CAST(json_extract_string(j, '$.version') AS BIGINT) > 2 THEN 'too_new' WHEN CAST(json_extract_string(j, '$.version') AS BIGINT) < 2 THEN 'migrated' ELSE 'current' END AS state FROM (SELECT doc_id, '{\"id\": \"doc-' || doc_id || '\", \"version\": ' || (n_chars % 4) || ', \"copies\": [' || CASE WHEN doc_id % 2 = 0 THEN '{\"name\": \"a\"}, {\"name\": \"b\"}' ELSE '{\"name\": \"a\"}' END || ']}' AS j FROM documents)")
def sidecar_parse(spark: SparkSession, d: str) -> DataFrame:
    """Sidecar documents as JSON: parsed by schema, older versions stamped as migrated, newer ones refused."""
    text = F.concat(F.lit('{"id": "doc-'), F.col("doc_id"), F.lit('", "version": '), F.col("n_chars") % 4, F.lit(', "copies": ['), F.when(F.col("doc_id") % 2 == 0, '{"name": "a"}, {"name": "b"}').otherwise('{"name": "a"}'), F.lit("]}"))
    j = F.from_json(text, "id string, version long, copies array<struct<name: string>>")
    rows = table(spark, d, "documents").select("doc_id", j.alias("j"))
    state = F.when(F.col("j.version") > 2, "too_new").when(F.col("j.version") < 2, "migrated").otherwise("current")
    return rows.select("doc_id", "j.id", "j.version", F.size("j.copies").cast("long").alias("copies"), state.alias("state"))


@register("WITH c AS (SELECT user_id, event_type AS name, count(*) AS n, min(event_id) AS id FROM events GROUP BY ALL) SELECT user_id, name, id, n > 1 AS duplicate, CAST(row_number() OVER (PARTITION BY user_id ORDER BY name, id) AS INTEGER) AS place FROM c")
def copies_sorted(spark: SparkSession, d: str) -> DataFrame:
    """An image's copies by name, then id; names that occur twice are marked."""
    c = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.min("event_id").alias("id"), (F.count(F.lit(1)) > 1).alias("duplicate"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("name", "id")).cast("int"))


@register("SELECT event_id, epoch_us(ts) // 1000 AS millis, ts < (SELECT max(ts) FROM events) - INTERVAL 30 SECOND AS stale FROM events")
def lock_age(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds since the epoch, and what is older than thirty seconds at the newest event."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"), (F.col("ts") < F.col("last") - F.expr("INTERVAL 30 SECONDS")).alias("stale"))


@register("WITH s AS (SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) SELECT user_id, count(*) FILTER (WHERE next IS NOT NULL AND next <> event_type) AS breaks FROM s GROUP BY user_id")
def stage_contract(spark: SparkSession, d: str) -> DataFrame:
    """Where a stage's output format is not the next stage's input."""
    s = table(spark, d, "events").withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return s.groupBy("user_id").agg(F.count_if(F.col("next").isNotNull() & (F.col("next") != F.col("event_type"))).alias("breaks"))


@register("""WITH m AS (SELECT event_type AS metric, value AS median, event_id % 2 AS run FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id % 2 DESC, event_id) = 1),
b AS (SELECT event_type AS metric, avg(value) AS base FROM events GROUP BY 1) SELECT metric, round(median, 6) AS median, round(base, 6) AS base, CASE WHEN median > base * 1.2 THEN 'violation' ELSE 'ok' END AS verdict FROM m JOIN b USING (metric)""")
def perf_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The new run's measure of each metric (else the base run's) against a baseline with a tolerance of a fifth."""
    e = table(spark, d, "events")
    m = e.groupBy(F.col("event_type").alias("metric")).agg(F.min_by("value", F.struct(-(F.col("event_id") % 2), "event_id")).alias("median"), F.avg("value").alias("base"))
    return rounded(m.withColumn("verdict", F.when(F.col("median") > F.col("base") * 1.2, "violation").otherwise("ok")))


@register(f"{PX} SELECT image_id, x // 4 AS tx, y // 4 AS ty, sha256(string_agg(r || ',' || g || ',' || b, ';' ORDER BY y, x)) AS checksum FROM px GROUP BY ALL")
def tile_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Frames as tiles of four by four, each with the checksum that a point lookup verifies."""
    px = carrier_frames(spark, d)
    tiles = px.groupBy("image_id", F.floor(F.col("x") / 4).alias("tx"), F.floor(F.col("y") / 4).alias("ty")).agg(F.array_sort(F.collect_list(F.struct("y", "x", F.concat_ws(",", "r", "g", "b").alias("p")))).alias("p"))  # sixteen entries
    return tiles.select("image_id", F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), F.sha2(F.array_join(F.transform("p", lambda v: v["p"]), ";"), 256).alias("checksum"))


COPIES = "SELECT user_id, event_id AS id, event_type AS name, event_id = min(event_id) OVER (PARTITION BY user_id) AS is_default, event_id % 5 = 0 AS in_trash FROM events"


def user_copies(spark: SparkSession, d: str) -> DataFrame:
    first = F.min("event_id").over(Window.partitionBy("user_id"))
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("name"), (F.col("event_id") == first).alias("is_default"), (F.col("event_id") % 5 == 0).alias("in_trash"))


@register(f"WITH c AS ({COPIES}), o AS (SELECT id, in_trash, CASE WHEN id % 3 <> 0 THEN 'kept' WHEN is_default THEN 'default' WHEN in_trash THEN 'already' ELSE 'deleted' END AS outcome FROM c) SELECT id, outcome, in_trash OR outcome = 'deleted' AS in_trash FROM o")
def copy_delete(spark: SparkSession, d: str) -> DataFrame:
    """Every third copy is to go to the trash; a default one stays."""
    return catalog.deleted(user_copies(spark, d), F.col("id") % 3 == 0).select("id", "outcome", "in_trash")


@register(f"WITH c AS ({COPIES}) SELECT id, name || ' copy ' || row_number() OVER (PARTITION BY user_id, name ORDER BY id) AS copy_name, count(*) OVER (PARTITION BY user_id, name) = 1 AS \"unique\" FROM c")
def copy_duplicate(spark: SparkSession, d: str) -> DataFrame:
    return catalog.duplicated(user_copies(spark, d), "user_id", "name").select("id", "copy_name", "unique")


@register("""WITH t AS (SELECT user_id, value > 40 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), p AS (SELECT * FROM t WHERE n <= 3)
SELECT user_id, CASE WHEN min(n) FILTER (WHERE ok) IS NULL THEN 'failed' ELSE 'ok' END AS status, CAST(coalesce(min(n) FILTER (WHERE ok), max(n)) AS INTEGER) AS used FROM p GROUP BY user_id""")
def batch_retry(spark: SparkSession, d: str) -> DataFrame:
    """Two retries for each job."""
    return catalog.attempts(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") > 40, 2)


@register("SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.c <> d.n_chars % 2 THEN 'mismatch' ELSE 'ok' END AS status FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS c FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id")
def artifact_checks(spark: SparkSession, d: str) -> DataFrame:
    bundle = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("checksum"))
    return catalog.artifacts(table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 2).alias("checksum")), bundle).select("id", "status")


@register("WITH s AS (SELECT user_id, max(event_id) AS f, max_by(value, event_id) AS v FROM events GROUP BY 1), a AS (SELECT user_id, max(event_id) - user_id % 2 AS f, sum(event_id)::DOUBLE AS v FROM events GROUP BY 1) SELECT a.user_id AS image_id, round(CASE WHEN a.f = s.f THEN s.v ELSE a.v END, 6) AS value, a.f = s.f AS reused FROM a JOIN s USING (user_id)")
def auto_tone_reuse(spark: SparkSession, d: str) -> DataFrame:
    """A saved analysis serves as long as its fingerprint is the present one."""
    e = table(spark, d, "events").withColumnRenamed("user_id", "image_id")
    saved = e.groupBy("image_id").agg(F.max("event_id").alias("fingerprint"), F.max_by("value", "event_id").alias("value"))
    now = e.groupBy("image_id").agg((F.max("event_id") - F.col("image_id") % 2).alias("fingerprint"), F.sum("event_id").cast("double").alias("value"))
    return rounded(catalog.reused(now, saved))


@register("SELECT doc_id, CAST(pos AS INTEGER) AS pos, (n_chars + pos * 7) % 65536 AS value FROM (SELECT doc_id, n_chars, unnest(range(doc_id % 4 + 1)) AS pos FROM documents)")
def region_source(spark: SparkSession, d: str) -> DataFrame:
    """A region's values as a JSON array: parsed, then one row for each value with its place."""
    text = F.to_json(F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 4), lambda i: (F.col("n_chars") + i * 7) % 65536))
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.from_json(text, "array<long>")).alias("pos", "value"))


@register(f"WITH {USER_SQL} SELECT user_id, key, round(value, 6) AS value FROM r WHERE key IN ('exposure', 'contrast')")
def preset_source(spark: SparkSession, d: str) -> DataFrame:
    """Recipes as JSON files would hold them: written, parsed and cut down to a preset's keys."""
    text = F.to_json(F.create_map(F.lit("adjustments"), F.col("adjustments")))
    parsed = F.from_json(text, "adjustments map<string,double>")["adjustments"]
    return rounded(user_recipes(spark, d).select("user_id", F.explode(F.map_filter(parsed, lambda k, _: k.isin("exposure", "contrast"))).alias("key", "value")))


@register("SELECT doc_id, to_json({'id': doc_id, 'status': CASE WHEN n_chars % 5 = 0 THEN 'failed' ELSE 'ok' END, 'size': n_chars})::VARCHAR AS result FROM documents")
def result_rows(spark: SparkSession, d: str) -> DataFrame:
    """One JSON object a document, as a batch reports them."""
    status = F.when(F.col("n_chars") % 5 == 0, "failed").otherwise("ok")
    return table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), status.alias("status"), F.col("n_chars").alias("size"))).alias("result"))


@register("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'Pending' ELSE 'Valid' END AS status FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def masks_pending(spark: SparkSession, d: str) -> DataFrame:
    """Masks whose artifact is missing wait for inference."""
    return catalog.mask_states(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")
