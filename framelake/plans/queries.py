"""The imaging and catalog queries over the carrier tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color, develop
from ..operators import catalog, mask_graph, masks, neighbourhood, tone
from ..sources.frames import SIDE, carrier_frames, grid, table
from ..streaming.latest import latest_generation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def byte_sql(shift: int) -> str:
    return f"CAST(least(255, greatest(0, floor((e[1 + (i + {shift}) % 64] + 0.55::DOUBLE) * 232.0::DOUBLE))) AS INTEGER)"


#: Common table expressions for the pixel relation and luminance.
PX = f"""WITH src AS (SELECT vec_id AS image_id, CAST(embedding AS DOUBLE[]) AS e, unnest(range(64)) AS i FROM embeddings),
px AS (SELECT image_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, {byte_sql(0)} AS r, {byte_sql(21)} AS g, {byte_sql(42)} AS b, 255 AS a FROM src),
lum AS (SELECT *, (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255.0::DOUBLE AS l FROM px)"""


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


RGB = ["image_id", "x", "y", "r", "g", "b"]


@register(f"{PX} SELECT * FROM px")
def px_scan(spark: SparkSession, d: str) -> DataFrame:
    return carrier_frames(spark, d).drop("folder")


def near(e: str) -> str:
    return f"greatest(0, least(255, round({e})))"


def staged(stages: list[str]) -> str:
    """Nested SQL for one channel: each stage has {v} for what came before."""
    out = "{c}::DOUBLE"
    for s in stages:
        out = near(s.replace("{v}", f"({out})"))
    return f"CAST({out} AS INTEGER)"


WEC = ["{v} * {gain}::DOUBLE", "{v} * 1.2311444133449163::DOUBLE", "({v} - 128) * 0.8::DOUBLE + 128"]
WARM = (5200 - 6500) / 5500
GAINS = dict(r=1 - 0.35 * WARM, g=1 - 0.2 * -0.1, b=1 + 0.35 * WARM)


@register(f"{PX} SELECT image_id, x, y, " + ", ".join(staged(WEC).replace("{c}", c).replace("{gain}", repr(GAINS[c])) + f" AS {c}" for c in "rgb") + " FROM px")
def wb_exposure_contrast_lut(spark: SparkSession, d: str) -> DataFrame:
    return color.toned(carrier_frames(spark, d), color.Tone(temperature=5200, tint=-0.1, exposure=0.3, contrast=-0.2)).select(*RGB)


REGIONS = [
    "(greatest(0, least(1, {v} / 255 + 0.3::DOUBLE * pow(greatest((0.5::DOUBLE - {v} / 255) / 0.5::DOUBLE, 0), 2) * 0.25::DOUBLE))) * 255",
    "(greatest(0, least(1, {v} / 255 + -0.4::DOUBLE * pow(greatest(({v} / 255 - 0.5::DOUBLE) / 0.5::DOUBLE, 0), 2) * 0.25::DOUBLE))) * 255",
    "(greatest(0, least(1, {v} / 255 + 0.2::DOUBLE * greatest(({v} / 255 - 0.5::DOUBLE) / 0.5::DOUBLE, 0) * 0.25::DOUBLE))) * 255",
    "(greatest(0, least(1, {v} / 255 - 0.15::DOUBLE * greatest((0.5::DOUBLE - {v} / 255) / 0.5::DOUBLE, 0) * 0.25::DOUBLE))) * 255",
]


@register(f"{PX} SELECT image_id, x, y, " + ", ".join(staged(REGIONS).replace("{c}", c) + f" AS {c}" for c in "rgb") + " FROM px")
def tone_regions_lut(spark: SparkSession, d: str) -> DataFrame:
    return color.toned(carrier_frames(spark, d), color.Tone(shadows=0.3, highlights=-0.4, whites=0.2, blacks=0.15)).select(*RGB)


HSL = f"""{PX}, hs0 AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS mx, least(r, g, b) / 255.0::DOUBLE AS mn, r / 255.0::DOUBLE AS fr, g / 255.0::DOUBLE AS fg, b / 255.0::DOUBLE AS fb FROM px),
hs1 AS (SELECT *, mx - mn AS d, (mx + mn) / 2.0::DOUBLE AS l FROM hs0),
hsl AS (SELECT image_id, x, y, l, CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs(2 * l - 1)) END AS s,
  CASE WHEN d = 0 THEN 0 WHEN mx = fr THEN 60 * (((fg - fb) / d) - 6 * floor(((fg - fb) / d) / 6)) WHEN mx = fg THEN 60 * ((fb - fr) / d + 2) ELSE 60 * ((fr - fg) / d + 4) END AS h FROM hs1)"""


def rgb_sql(hsl: str) -> str:
    return f"""SELECT image_id, x, y, {', '.join(f"CAST(greatest(0, least(255, round((m + CASE WHEN h < 60 THEN {a} WHEN h < 120 THEN {b} WHEN h < 180 THEN {c} WHEN h < 240 THEN {e} WHEN h < 300 THEN {f} ELSE {g} END) * 255))) AS INTEGER) AS {n}"
    for n, a, b, c, e, f, g in (("r", "c", "z", "0", "0", "z", "c"), ("g", "z", "c", "c", "z", "0", "0"), ("b", "0", "0", "z", "c", "c", "z")))}
  FROM (SELECT *, l - c / 2 AS m, c * (1 - abs((h / 60 - 2 * floor(h / 120)) - 1)) AS z FROM (SELECT *, (1 - abs(2 * l - 1)) * s AS c FROM ({hsl})))"""


@register(f"{HSL} {rgb_sql('SELECT * FROM hsl')}")
def rgb_hsl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return color.from_hsl(color.with_hsl(carrier_frames(spark, d))).select(*RGB)


SKIN = "CASE WHEN h < 5 OR h > 65 THEN 1 WHEN h < 15 THEN (15 - h) / 10 WHEN h <= 55 THEN 0 ELSE (h - 55) / 10 END"


@register(f"{HSL} " + rgb_sql(f"SELECT image_id, x, y, h, l, greatest(0, least(1, greatest(0, least(1, s + 0.2::DOUBLE * ((1 - s) * {SKIN}) * (1 - s))) * (1 + 0.1::DOUBLE))) AS s FROM hsl"))
def vibrance_saturation(spark: SparkSession, d: str) -> DataFrame:
    return color.vibrance_saturation(carrier_frames(spark, d), 0.2, 0.1).select(*RGB)


VIG = """t0 AS (SELECT *, sqrt(((x - 3.5::DOUBLE) / 3.5::DOUBLE) * ((x - 3.5::DOUBLE) / 3.5::DOUBLE) + ((y - 3.5::DOUBLE) / 3.5::DOUBLE * 1.25::DOUBLE) * ((y - 3.5::DOUBLE) / 3.5::DOUBLE * 1.25::DOUBLE)) AS rad FROM px),
t1 AS (SELECT *, (rad - min(rad) OVER ()) / greatest(max(rad) OVER () - min(rad) OVER (), 1e-6) AS rn FROM t0),
t2 AS (SELECT *, greatest(0, least(1, (greatest(0, least(1, (rn - 0.3::DOUBLE) / 0.7::DOUBLE)) - 0.25::DOUBLE) / 0.5::DOUBLE)) AS t FROM t1),
t3 AS (SELECT *, 1 - 0.6::DOUBLE * (t * t * (3 - 2 * t)) AS f FROM t2)"""


@register(f"{PX}, {VIG} SELECT image_id, x, y, " + ", ".join(f"CAST(round(greatest(0, least(255, {c} * f))) AS INTEGER) AS {c}" for c in "rgb") + " FROM t3")
def vignette(spark: SparkSession, d: str) -> DataFrame:
    return color.vignette(carrier_frames(spark, d), SIDE, SIDE, 0.6, 0.3, 0.5, 0.5).select(*RGB)


TONE = "tone AS (SELECT image_id, avg(l) AS mean, quantile_cont(l, 0.5) AS median, quantile_cont(l, 0.01) AS p01, quantile_cont(l, 0.99) AS p99, count(*) AS samples FROM lum GROUP BY image_id)"


@register(f"{PX}, {TONE} SELECT image_id, round(mean, 6) AS mean, round(median, 6) AS median, round(p01, 6) AS p01, round(p99, 6) AS p99, samples FROM tone")
def tone_analysis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tone.analyze_tone(carrier_frames(spark, d)))


@register(f"""{PX}, {TONE} SELECT image_id, round(CASE WHEN median <= 1e-6 THEN 5 WHEN median >= 1 - 1e-6 THEN -5 ELSE greatest(-5, least(5, log2(0.5::DOUBLE / median))) END, 6) AS exposure,
round(CASE WHEN p99 - p01 <= 1e-6 THEN 0 ELSE greatest(-1, least(1, 0.8::DOUBLE / (p99 - p01) - 1)) END, 6) AS contrast FROM tone""")
def auto_tone(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tone.auto_tone(tone.analyze_tone(carrier_frames(spark, d))))


@register(f"{PX} SELECT image_id, round(CASE WHEN avg(l) <= 1e-6 THEN 10 ELSE greatest(-10, least(10, log2(0.45::DOUBLE / avg(l)))) END, 6) AS exposure FROM lum GROUP BY image_id")
def match_exposure(spark: SparkSession, d: str) -> DataFrame:
    mean = carrier_frames(spark, d).groupBy("image_id").agg(F.avg(color.luminance()).alias("m"))
    return rounded(mean.select("image_id", tone.exposure_to(0.45, F.col("m")).alias("exposure")))


@register(f"""{PX}, w AS (SELECT *, (r * 257 / 65535.0::DOUBLE) * (g * 257 / 65535.0::DOUBLE) AS w FROM lum), m AS (SELECT image_id, CASE WHEN sum(w) > 1e-6 THEN sum(l * w) / sum(w) END AS m FROM w GROUP BY image_id)
SELECT image_id, round(CASE WHEN m IS NULL THEN 0 WHEN m <= 1e-6 THEN 10 ELSE greatest(-10, least(10, log2(0.45::DOUBLE / m))) END, 6) AS exposure FROM m""")
def match_exposure_masked(spark: SparkSession, d: str) -> DataFrame:
    px = carrier_frames(spark, d)
    mean = masks.weighted_mean_of(px, [F.col("r") * 257, F.col("g") * 257], color.luminance())
    return rounded(mean.select("image_id", F.when(F.col("mean").isNull(), 0.0).otherwise(tone.exposure_to(0.45, F.col("mean"))).alias("exposure")))


HIST = "hist AS (SELECT image_id, CAST(least(floor(l * 256), 255) AS INTEGER) AS bin, count(*) AS n FROM lum GROUP BY 1, 2)"


@register(f"{PX}, {HIST} SELECT * FROM hist")
def luma_histogram(spark: SparkSession, d: str) -> DataFrame:
    return tone.luma_histogram(carrier_frames(spark, d))


@register(f"""{PX}, {HIST}, run AS (SELECT *, CAST(sum(n) OVER (PARTITION BY image_id ORDER BY bin) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY image_id) AS BIGINT) AS total FROM hist)
SELECT image_id, max(total) AS samples, round(sum((bin + 0.5::DOUBLE) / 256 * n) / max(total), 6) AS mean, """ + ", ".join(f"round(max(CASE WHEN upto - n <= {q}::DOUBLE * (total - 1) AND {q}::DOUBLE * (total - 1) < upto THEN (bin + ({q}::DOUBLE * (total - 1) - (upto - n)) / n) / 256 END), 6) AS q{round(q * 100):02d}" for q in (0.01, 0.5, 0.99)) + " FROM run GROUP BY image_id")
def histogram_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tone.histogram_stats(tone.luma_histogram(carrier_frames(spark, d))))


@register(f"{PX}, {HIST} SELECT image_id, round(sum(CASE WHEN bin < 89 THEN n WHEN bin = 89 THEN n * 0.6::DOUBLE ELSE 0 END) / sum(n), 6) AS cdf FROM hist GROUP BY image_id")
def cdf_at(spark: SparkSession, d: str) -> DataFrame:
    edge = 0.35 * 256
    part = F.when(F.col("bin") < int(edge), F.col("n")).when(F.col("bin") == int(edge), F.col("n") * (edge - int(edge))).otherwise(0)
    return rounded(tone.luma_histogram(carrier_frames(spark, d)).groupBy("image_id").agg((F.sum(part) / F.sum("n")).alias("cdf")))


CHAN = "chan AS (SELECT image_id, 'r' AS channel, r AS v FROM px UNION ALL SELECT image_id, 'g', g FROM px UNION ALL SELECT image_id, 'b', b FROM px)"


@register(f"{PX}, {CHAN} SELECT image_id, channel, v, count(*) AS n FROM chan GROUP BY ALL")
def channel_histogram(spark: SparkSession, d: str) -> DataFrame:
    return tone.channel_histogram(carrier_frames(spark, d))


STATS = f"{CHAN}, stats AS (SELECT image_id, channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS stddev, min(v) AS minimum, max(v) AS maximum FROM chan GROUP BY ALL)"


@register(f"{PX}, {STATS} SELECT * FROM stats")
def channel_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tone.channel_stats(carrier_frames(spark, d)))


TOP = """top AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, key) AS INTEGER) AS rank, key, n, round(n / sum(n) OVER (PARTITION BY image_id), 6) AS frequency
FROM (SELECT image_id, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) AS key, count(*) AS n FROM px GROUP BY ALL))"""


@register(f"{PX}, {TOP} SELECT * FROM top WHERE rank <= 5")
def dominant_colors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tone.dominant_colors(carrier_frames(spark, d)))


@register(f"""{PX}, {TONE}, {STATS}, {TOP}
SELECT t.image_id, round(mean, 6) AS mean, round(median, 6) AS median, round(p01, 6) AS p01, round(p99, 6) AS p99, r_mean, r_stddev, g_mean, g_stddev, b_mean, b_stddev, key AS first_color,
round(CASE WHEN median <= 1e-6 THEN 10 ELSE greatest(-10, least(10, log2(0.5::DOUBLE / median))) END, 6) AS exposure_estimate
FROM tone t JOIN (SELECT image_id, {', '.join(f"max(CASE WHEN channel = '{c}' THEN {m} END) AS {c}_{m}" for c in 'rgb' for m in ('mean', 'stddev'))} FROM stats GROUP BY image_id) s USING (image_id) JOIN (SELECT image_id, key FROM top WHERE rank = 1) USING (image_id)""")
def analyze_report(spark: SparkSession, d: str) -> DataFrame:
    """Tone, channels and palette of every frame; the flagship query."""
    px = carrier_frames(spark, d)
    first = tone.dominant_colors(px, 1).select("image_id", F.col("key").alias("first_color"))
    # all else comes from one aggregate by frame and luminance
    return rounded(tone.report(px).join(first, "image_id").withColumn("exposure_estimate", tone.exposure_to(0.5, F.col("median"))))


def plane(px: DataFrame, channel: str) -> DataFrame:
    """A 16-bit matte from a channel."""
    return px.select("image_id", "x", "y", (F.col(channel) * 257).alias("v"))


@register(f"""{PX}, h AS (SELECT image_id, x, y, CAST(floor(sum(r * 257) OVER w / count(*) OVER w) AS INTEGER) AS v FROM px WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT image_id, x, y, CAST(floor(sum(v) OVER w / count(*) OVER w) AS INTEGER) AS v FROM h WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def box_blur(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.box_blur(plane(carrier_frames(spark, d), "r"), 2)


@register(f"{PX} SELECT a.image_id, a.x, a.y, min(least(b.r, b.g, b.b)) AS dark FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL")
def dark_channel(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.dark_channel(carrier_frames(spark, d)).select("image_id", "x", "y", "dark")


@register(f"""{PX}, g AS (SELECT image_id, x, y, (coalesce(lead(l) OVER h, l) - coalesce(lag(l) OVER h, l)) / 2 AS dx, (coalesce(lead(l) OVER v, l) - coalesce(lag(l) OVER v, l)) / 2 AS dy
FROM lum WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y)) SELECT image_id, x, y, round(sqrt(dx * dx + dy * dy), 6) AS magnitude FROM g""")
def gradient(spark: SparkSession, d: str) -> DataFrame:
    return rounded(neighbourhood.gradient(carrier_frames(spark, d)))


@register(f"{PX} SELECT image_id, x - 1 AS x, y - 2 AS y, r, g, b FROM px WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 5")
def crop(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.crop(carrier_frames(spark, d), 1, 2, 5, 4).select(*RGB)


@register(f"{PX} SELECT image_id, 7 - x AS x, y, r, g, b FROM px")
def mirror(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.mirror(carrier_frames(spark, d), SIDE, SIDE, True, False).select(*RGB)


@register(f"{PX} SELECT image_id, 7 - y AS x, x AS y, r, g, b FROM px")
def rotate90(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.rotate90(carrier_frames(spark, d), SIDE, SIDE, 1).select(*RGB)


@register(f"{PX}, t AS (SELECT image_id, unnest(range(5)) AS x FROM (SELECT DISTINCT image_id FROM px)), u AS (SELECT image_id, x, unnest(range(3)) AS y FROM t) SELECT u.image_id, CAST(u.x AS INTEGER) AS x, CAST(u.y AS INTEGER) AS y, r, g, b FROM u JOIN px ON px.image_id = u.image_id AND px.x = u.x * 8 // 5 AND px.y = u.y * 8 // 3")
def nearest_resize(spark: SparkSession, d: str) -> DataFrame:
    return neighbourhood.nearest_resize(carrier_frames(spark, d), SIDE, SIDE, 5, 3).select(*RGB)


@register(f"{PX} SELECT image_id, x, y, greatest(r, g) * 257 AS v FROM px")
def mask_union(spark: SparkSession, d: str) -> DataFrame:
    px = carrier_frames(spark, d)
    return masks.combined([plane(px, "r"), plane(px, "g")], "union")


@register(f"{PX} SELECT image_id, x, y, least(r, g, b) * 257 AS v FROM px")
def mask_intersect(spark: SparkSession, d: str) -> DataFrame:
    px = carrier_frames(spark, d)
    return masks.combined([plane(px, c) for c in "rgb"], "intersect")


@register(f"{PX} SELECT image_id, x, y, CAST((CAST(r * 257 AS BIGINT) * (65535 - g * 257) + 32767) // 65535 AS INTEGER) AS v FROM px")
def mask_subtract(spark: SparkSession, d: str) -> DataFrame:
    px = carrier_frames(spark, d)
    return masks.subtracted(plane(px, "r"), plane(px, "g"))


@register(f"{PX} SELECT image_id, x, y, 65535 - r * 257 AS v FROM px")
def mask_invert(spark: SparkSession, d: str) -> DataFrame:
    return masks.inverted(plane(carrier_frames(spark, d), "r"))


@register(f"{PX} SELECT image_id, x, y, CAST(floor((65535 - r * 257) * 0.75::DOUBLE) AS INTEGER) AS v FROM px")
def mask_modulate(spark: SparkSession, d: str) -> DataFrame:
    return masks.with_density(masks.inverted(plane(carrier_frames(spark, d), "r")), 0.75)


def grid_sql(w: int, h: int, value: str) -> str:
    return f"WITH g AS (SELECT CAST(i % {w} AS INTEGER) AS x, CAST(i // {w} AS INTEGER) AS y, (i % {w} + 0.5::DOUBLE) / {w} AS nx, (i // {w} + 0.5::DOUBLE) / {h} AS ny FROM range({w * h}) t(i)) SELECT x, y, {value} AS v FROM g"


@register(f"{PX} SELECT image_id, x, y, " + ", ".join(f"CASE WHEN r * 257 >= 32768 THEN 255 - {c} ELSE {c} END AS {c}" for c in "rgb") + " FROM px")
def source_action_composite(spark: SparkSession, d: str) -> DataFrame:
    px = carrier_frames(spark, d)
    return masks.composite(px, plane(px, "r"), px.select("image_id", "x", "y", *[(255 - F.col(c)).alias(c) for c in "rgb"]))


KEY = "element_at(array('exposure', 'contrast', 'temperature', 'sharpness'), CAST(event_id % 4 AS INT) + 1)"
KEY_SQL = "(['exposure', 'contrast', 'temperature', 'sharpness'])[event_id % 4 + 1]"


@register(f"""WITH e AS (SELECT event_id, {KEY_SQL} AS key, value / 10 AS value FROM events)
SELECT event_id, key, CASE WHEN key = 'sharpness' THEN 'unknown' WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 'not_finite' WHEN value < CASE key WHEN 'exposure' THEN -10 WHEN 'temperature' THEN 1500 ELSE -1 END OR value > CASE key WHEN 'exposure' THEN 10 WHEN 'temperature' THEN 12000 ELSE 1 END THEN 'out_of_range' ELSE 'ok' END AS status FROM e""")
def recipe_validate(spark: SparkSession, d: str) -> DataFrame:
    edits = table(spark, d, "events").select("event_id", F.expr(KEY).alias("key"), (F.col("value") / 10).alias("value"))
    return catalog.validated(edits).select("event_id", "key", "status")


@register("SELECT user_id, event_id, CAST(row_number() OVER w AS INTEGER) AS step, value, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def recipe_history(spark: SparkSession, d: str) -> DataFrame:
    return catalog.history(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "step", "value", "before")


@register("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def latest_events(spark: SparkSession, d: str) -> DataFrame:
    return latest_generation(table(spark, d, "events"))


@register("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS content_hash, sha256(source || chr(0) || doc_id::VARCHAR) AS preview FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", catalog.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), catalog.preview_key(F.col("source"), F.col("doc_id").cast("string")).alias("preview"))


PATH = "regexp_replace(url, '^https?://', '')"


@register(f"""WITH p AS (SELECT page_id, {PATH} AS path FROM pages) SELECT page_id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension,
NOT (regexp_matches(path, '^[/\\\\]|[\\\\:]') OR len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) > 0) AS safe FROM p""")
def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.expr(PATH)
    return table(spark, d, "pages").select("page_id", catalog.extension(path).alias("extension"), catalog.safe_path(path).alias("safe"))


@register("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_cache(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@register("""WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS name FROM documents), b AS (SELECT CAST(doc_id AS VARCHAR) AS name FROM labels)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'no_sidecar' WHEN a.name IS NULL THEN 'orphan_sidecar' ELSE 'paired' END AS status FROM a FULL JOIN b ON a.name = b.name""")
def catalog_status(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("doc_id").cast("string").alias("name")
    return catalog.catalog_status(table(spark, d, "documents").select(name), table(spark, d, "labels").select(name))


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events))")
def batch_resume(spark: SparkSession, d: str) -> DataFrame:
    """Work left: documents without a finished job."""
    events = table(spark, d, "events")
    done = events.join(events.agg(F.min("event_type").alias("event_type")), "event_type", "left_semi").select(F.col("user_id").alias("doc_id"))
    return table(spark, d, "documents").join(done, "doc_id", "left_anti").select("doc_id")


@register("""WITH v(stage, void) AS (VALUES ('decode', 'decode'), ('decode', 'mask'), ('decode', 'preview'), ('decode', 'histogram'), ('decode', 'export'), ('mask', 'preview'), ('mask', 'histogram'), ('mask', 'export')),
e AS (SELECT user_id, CASE event_id % 3 WHEN 0 THEN 'decode' WHEN 1 THEN 'mask' ELSE 'export' END AS stage FROM events) SELECT user_id, void, count(*) AS n FROM e JOIN v USING (stage) GROUP BY ALL""")
def cache_invalidate(spark: SparkSession, d: str) -> DataFrame:
    stage = F.when(F.col("event_id") % 3 == 0, "decode").when(F.col("event_id") % 3 == 1, "mask").otherwise("export")
    void = F.create_map(*[x for k, v in catalog.VOID.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = table(spark, d, "events").select("user_id", F.explode(F.try_element_at(void, stage)).alias("void"))
    return rows.groupBy("user_id", "void").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH s AS (SELECT doc_id, source, doc_id % 10 AS depth, CASE WHEN doc_id % 4 = 0 THEN n_chars END AS setting FROM documents)
SELECT doc_id, coalesce(last_value(setting IGNORE NULLS) OVER (PARTITION BY source ORDER BY depth, doc_id ROWS UNBOUNDED PRECEDING), -1) AS inherited FROM s""")
def settings_inherit(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 10).alias("depth"), F.when(F.col("doc_id") % 4 == 0, F.col("n_chars")).alias("setting"))
    return catalog.carried(s, "source", ["depth", "doc_id"], "setting", "inherited").select("doc_id", F.coalesce("inherited", F.lit(-1)).alias("inherited"))


def hermite_sql(points: list[tuple[float, float]], x: str) -> str:
    """The curve in the textbook's basis functions."""
    cases = []
    for j, ((a, p), (b, q)) in enumerate(zip(points, points[1:])):
        h, d = b - a, (q - p) / (b - a)
        left = points[j - 1] if j else points[j]
        right = points[j + 2] if j + 2 < len(points) else points[j + 1]
        m = min(max((q - left[1]) / (b - left[0]), 0), 3 * d)
        n = min(max((right[1] - p) / (right[0] - a), 0), 3 * d)
        t = f"(({x}) - {a}::DOUBLE) / {h}::DOUBLE"
        cases.append(f"WHEN ({x}) <= {b}::DOUBLE THEN (2 * pow({t}, 3) - 3 * pow({t}, 2) + 1) * {p}::DOUBLE + (pow({t}, 3) - 2 * pow({t}, 2) + {t}) * {h * m}::DOUBLE + (3 * pow({t}, 2) - 2 * pow({t}, 3)) * {q}::DOUBLE + (pow({t}, 3) - pow({t}, 2)) * {h * n}::DOUBLE")
    return f"greatest(0, least(1, CASE {' '.join(cases)} END))"


MASTER, RED = [(0.0, 0.0), (0.25, 0.18), (0.7, 0.8), (1.0, 1.0)], [(0.0, 0.0), (0.5, 0.6), (1.0, 1.0)]


@register(f"{PX}, m AS (SELECT *, {hermite_sql(MASTER, 'l')} AS m, {hermite_sql(RED, 'r / 255.0::DOUBLE')} AS cr, g / 255.0::DOUBLE AS cg, b / 255.0::DOUBLE AS cb FROM lum) SELECT image_id, x, y, " + ", ".join(f"CAST(round(greatest(0, least(1, CASE WHEN l > 1e-9 THEN c{c} * m / l ELSE m END)) * 255) AS INTEGER) AS {c}" for c in "rgb") + " FROM m")
def tone_curve(spark: SparkSession, d: str) -> DataFrame:
    return develop.curves(carrier_frames(spark, d), MASTER, r=RED).select(*RGB)


SHIFTS = {"red": (0.5, 0.2, -0.1), "green": (-0.4, 0.0, 0.0), "blue": (0.0, -0.3, 0.1)}


def band_sql(k: int) -> str:
    """Weights of triangles around the centres, added up."""
    centres = list(develop.BANDS.items())
    terms = []
    for i, (name, c) in enumerate(centres):
        if name in SHIFTS and SHIFTS[name][k]:
            after, before = (centres[(i + 1) % 8][1] - c) % 360, (c - centres[i - 1][1]) % 360
            ahead, behind = (f"(({e}) - 360 * floor(({e}) / 360))" for e in (f"h - {c}::DOUBLE", f"{c}::DOUBLE - h"))
            terms.append(f"{SHIFTS[name][k]}::DOUBLE * CASE WHEN {ahead} <= {after} THEN 1 - {ahead} / {after} WHEN {behind} <= {before} THEN 1 - {behind} / {before} ELSE 0 END")
    return " + ".join(terms)


@register(f"{HSL} " + rgb_sql(f"SELECT image_id, x, y, h - 360 * floor(h / 360) AS h, greatest(0, least(1, s)) AS s, greatest(0, least(1, l)) AS l FROM (SELECT image_id, x, y, h + 30 * ({band_sql(0)}) AS h, s + {band_sql(1)} AS s, l + {band_sql(2)} AS l FROM hsl)"))
def hsl_mix(spark: SparkSession, d: str) -> DataFrame:
    return develop.hue_bands(carrier_frames(spark, d), **SHIFTS).select(*RGB)


EASE = "{t} * {t} * (3 - 2 * {t})"
#: Full tints at hues 220, 30 and 50.
TINTS = dict(r=(0.0, 1.0, 1.0), g=(1 / 3, 0.5, 5 / 6), b=(1.0, 0.0, 0.0))


def graded_sql(c: str) -> str:
    e = f"({c} / 255.0::DOUBLE)"
    for k, s in enumerate((0.3, 0.1, 0.25)):
        e = f"({e} + ({TINTS[c][k]}::DOUBLE - {e}) * (w{k} / (w0 + w1 + w2) * {s}::DOUBLE))"
    return f"CAST(greatest(0, least(255, round({e} * 255))) AS INTEGER) AS {c}"


@register(f"""{PX}, t AS (SELECT *, least(1, l / 0.62::DOUBLE) AS ts, greatest(0, (l - 0.32::DOUBLE) / 0.68::DOUBLE) AS th FROM lum),
w AS (SELECT *, 1 - {EASE.format(t='ts')} AS w0, {EASE.format(t='th')} AS w2 FROM t), v AS (SELECT *, greatest(0, 1 - w0 - w2) AS w1 FROM w) SELECT image_id, x, y, {', '.join(map(graded_sql, 'rgb'))} FROM v""")
def color_grade(spark: SparkSession, d: str) -> DataFrame:
    return develop.color_grade(carrier_frames(spark, d), (220, 0.3), (30, 0.1), (50, 0.25), 0.2).select(*RGB)


@register(f"""{PX}, k AS (SELECT a.image_id, a.x, a.y, a.r, a.g, a.b, min(least(b.r, b.g, b.b)) AS dark FROM px a JOIN px b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL),
air AS (SELECT image_id, greatest(list_sort(list(dark))[CAST(floor(count(*) * 0.95::DOUBLE) AS INTEGER) + 1] / 255.0::DOUBLE, 0.05::DOUBLE) AS air FROM k GROUP BY image_id),
t AS (SELECT *, 1 - 0.3::DOUBLE * (1 - greatest(0.05::DOUBLE, least(1, 1 - 0.95::DOUBLE * (dark / 255.0::DOUBLE) / air))) AS t FROM k JOIN air USING (image_id))
SELECT image_id, x, y, """ + ", ".join(f"CAST(round(greatest(0, least(1, ({c} / 255.0::DOUBLE - air) / t + air)) * 255) AS INTEGER) AS {c}" for c in "rgb") + " FROM t")
def dehaze(spark: SparkSession, d: str) -> DataFrame:
    return develop.dehaze(neighbourhood.dark_channel(carrier_frames(spark, d)), 0.3).select(*RGB)


def mix_sql(source: str, into: str, column: str) -> str:
    """Table ``into``: the 32-bit mix of a column as column z."""
    return f"""{into}0 AS (SELECT *, ({column} + 2654435769) % 4294967296 AS z0 FROM {source}), {into}1 AS (SELECT * EXCLUDE z0, CAST((CAST(xor(z0, z0 >> 16) AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT) AS z1 FROM {into}0),
{into}2 AS (SELECT * EXCLUDE z1, CAST((CAST(xor(z1, z1 >> 13) AS HUGEINT) * 3266489909) % 4294967296 AS BIGINT) AS z2 FROM {into}1), {into} AS (SELECT * EXCLUDE z2, xor(z2, z2 >> 16) AS z FROM {into}2)"""


@register(f"""{PX}, axis AS (SELECT i AS c, (i + {develop.grain_seed(7, SIDE, SIDE)}) % 4294967296 AS a, CAST((CAST(i AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT) AS d FROM range(5) t(i)),
{mix_sql('axis', 'ax', 'a')}, {mix_sql('axis', 'dn', 'd')}, pair AS (SELECT ax.c AS cx, dn.c AS cy, xor(ax.z, dn.z) AS n FROM ax, dn), {mix_sql('pair', 'mx', 'n')}, noise AS (SELECT cx, cy, z / 4294967296.0::DOUBLE * 2 - 1 AS v FROM mx),
o AS (SELECT unnest([-1, 0, 1]) AS o), delta AS (SELECT c.cx, c.cy, CAST(round((sum(n.v) / 9 * 0.5::DOUBLE + any_value(c.v) * 0.5::DOUBLE) * 0.4::DOUBLE * 40) AS INTEGER) AS delta
FROM noise c, o p, o q JOIN noise n ON n.cx = greatest(0, c.cx + p.o) AND n.cy = greatest(0, c.cy + q.o) GROUP BY c.cx, c.cy)
SELECT image_id, x, y, """ + ", ".join(f"greatest(0, least(255, {c} + delta)) AS {c}" for c in "rgb") + " FROM px JOIN delta ON cx = x // 2 AND cy = y // 2")
def grain(spark: SparkSession, d: str) -> DataFrame:
    return develop.grain(carrier_frames(spark, d), SIDE, SIDE, 0.4, 0.2, 0.5, 7).select(*RGB)


def blurred_sql(source: str, radius: int, passes: int) -> str:
    """Nested windows: rows, then columns, each pass floored."""
    out = source
    for _ in range(passes):
        for line, place in (("y", "x"), ("x", "y")):
            w = f"(PARTITION BY image_id, {line} ORDER BY {place} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
            out = f"(SELECT image_id, x, y, CAST(floor(sum(v) OVER {w} / count(*) OVER {w}) AS INTEGER) AS v FROM {out})"
    return out


@register(f"{PX} SELECT * FROM {blurred_sql('(SELECT image_id, x, y, r * 257 AS v FROM px)', 1, 3)}")
def feather_blur(spark: SparkSession, d: str) -> DataFrame:
    """A feather of 0.3 on frames of eight: radius 1, three passes."""
    return neighbourhood.box_blur(plane(carrier_frames(spark, d), "r"), int(0.3 * SIDE / 2), 3)


@register(f"""WITH r AS (SELECT user_id, {KEY_SQL} AS key, max_by(value, event_id) / 10 AS value FROM events GROUP BY ALL), p(key, add) AS (VALUES ('exposure', 0.5::DOUBLE), ('tint', 0.1::DOUBLE)),
u AS (SELECT DISTINCT user_id FROM events), k AS (SELECT user_id, key FROM r UNION SELECT user_id, key FROM u, p WHERE user_id % 2 = 0)
SELECT k.user_id, CASE WHEN k.user_id % 2 = 0 THEN 'ok' ELSE 'needs_auto_tone' END AS status, k.key, round(CASE WHEN k.user_id % 2 = 0 AND add IS NOT NULL THEN CASE WHEN k.key = 'exposure' THEN coalesce(value, 0) + add ELSE add END ELSE value END, 6) AS value
FROM k LEFT JOIN r ON r.user_id = k.user_id AND r.key = k.key LEFT JOIN p ON p.key = k.key""")
def preset_merge(spark: SparkSession, d: str) -> DataFrame:
    latest = table(spark, d, "events").groupBy("user_id", F.expr(KEY).alias("key")).agg((F.max_by("value", "event_id") / 10).alias("value"))
    # at most one entry for each of the four keys
    recipes = latest.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("adjustments")).withColumn("auto_tone", F.col("user_id") % 2 == 0)
    return rounded(catalog.with_preset(recipes, {"exposure": 0.5, "tint": 0.1}, relative=True).select("user_id", "status", F.explode("adjustments").alias("key", "value")))


FACTS = dict(status_valid=5, artifact=3, source=7, decode=11, model=13, available=2)


@register("WITH f AS (SELECT event_id, " + ", ".join(f"event_id % {m} <> 0 AS {k}" for k, m in FACTS.items()) + """ FROM events)
SELECT event_id, CASE WHEN status_valid AND artifact AND source AND decode AND model THEN 'persisted' WHEN available THEN 'inferred' WHEN artifact THEN 'cached_unavailable' ELSE 'model_unavailable' END AS outcome FROM f""")
def mask_decision(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "events").select("event_id", *[(F.col("event_id") % m != 0).alias(k) for k, m in FACTS.items()])
    return catalog.mask_decision(facts).select("event_id", "outcome")


@register("""WITH e AS (SELECT user_id, event_type, max(event_id) AS last, max_by(event_id % 50 + 1, event_id) AS size FROM events GROUP BY ALL)
SELECT user_id, event_type, last, size, (SELECT sum(n.size) FROM e n WHERE n.user_id = e.user_id AND n.last >= e.last) <= 80 AS kept FROM e""")
def cache_lru(spark: SparkSession, d: str) -> DataFrame:
    accesses = table(spark, d, "events").select("user_id", "event_type", "event_id", (F.col("event_id") % 50 + 1).alias("size"))
    return catalog.kept_by_recency(accesses, ["user_id"], "event_type", "event_id", "size", 80)
