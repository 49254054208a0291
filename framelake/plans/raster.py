"""Geometry and detail queries over the carrier frames, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detail, geometry
from ..sources.frames import SIDE, carrier_frames, table
from .queries import ORACLE, PX, QUERIES, RGB, blurred_sql, plane, register, rounded

__all__ = ["ORACLE", "QUERIES"]


def at_least(v: str, low: str, high: str) -> str:
    return f"greatest({low}, least({high}, {v}))"


def sample_sql(source: str, name: str, size: tuple[int, int], sx: str, sy: str, channels: str = "rgb", black: bool = True, w: int = SIDE, h: int = SIDE, gain: str = "1", top: int = 255) -> str:
    """CTEs that end with ``name``: the raster of ``size`` sampled from ``source`` at (sx, sy), expressions in x and y."""
    inside = "sx >= 0 AND sy >= 0 AND sx < {w} AND sy < {h}".format(w=w, h=h) if black else "true"
    edge_x, edge_y = (w, h) if black else (w - 1, h - 1)
    values = ", ".join(f"CAST(greatest(0, least({top}, round(CASE WHEN inside THEN ((a.{c} * (1 - fx) + b.{c} * fx) * (1 - fy) + (c.{c} * (1 - fx) + d.{c} * fx) * fy) * gn ELSE 0 END))) AS INTEGER) AS {c}" for c in channels)
    return f"""{name}_o AS MATERIALIZED (SELECT *, {sx} AS sx, {sy} AS sy, {gain} AS gn FROM (SELECT CAST(i % {size[0]} AS INTEGER) AS x, CAST(i // {size[0]} AS INTEGER) AS y FROM range({size[0] * size[1]}) t(i))),
{name}_p AS (SELECT x, y, gn, {inside} AS inside, {at_least('sx', '0', str(edge_x))} AS px, {at_least('sy', '0', str(edge_y))} AS py FROM {name}_o),
{name}_c AS MATERIALIZED (SELECT *, CAST(least(floor(px), {w - 1}) AS INTEGER) AS x0, CAST(least(floor(py), {h - 1}) AS INTEGER) AS y0 FROM {name}_p),
{name} AS MATERIALIZED (SELECT a.image_id, o.x, o.y, {values} FROM (SELECT *, px - x0 AS fx, py - y0 AS fy, least(x0 + 1, {w - 1}) AS x1, least(y0 + 1, {h - 1}) AS y1 FROM {name}_c) o
 JOIN {source} a ON a.x = o.x0 AND a.y = o.y0 JOIN {source} b ON b.image_id = a.image_id AND b.x = o.x1 AND b.y = o.y0 JOIN {source} c ON c.image_id = a.image_id AND c.x = o.x0 AND c.y = o.y1 JOIN {source} d ON d.image_id = a.image_id AND d.x = o.x1 AND d.y = o.y1)"""


def d(v: float) -> str:
    return f"({v!r})::DOUBLE"


def centre_sql(c: str, n: int, m: int) -> str:
    return f"(({c} + 0.5::DOUBLE) * {n} / {m}::DOUBLE - 0.5::DOUBLE)"


@register(f"{PX}, v AS (SELECT image_id, x, y, r * 257 AS v FROM px), {sample_sql('v', 'o', (4, 4), centre_sql('x', 8, 4), centre_sql('y', 8, 4), 'v', black=False, top=65535)} SELECT * FROM o")
def resample_plane(spark: SparkSession, sf: str) -> DataFrame:
    """Half the size: most output values are means of four, many of them at an exact half."""
    return geometry.resample(plane(carrier_frames(spark, sf), "r"), SIDE, SIDE, 4, 4)


@register(f"{PX}, v AS (SELECT image_id, x, y, g * 257 AS v FROM px), {sample_sql('v', 'o', (11, 13), centre_sql('x', 8, 11), centre_sql('y', 8, 13), 'v', black=False, top=65535)} SELECT * FROM o")
def resample_plane_up(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.resample(plane(carrier_frames(spark, sf), "g"), SIDE, SIDE, 11, 13)


@register(f"{PX}, {sample_sql('px', 'o', (5, 5), centre_sql('x', 8, 5), centre_sql('y', 8, 5), black=False)} SELECT * FROM o")
def downscale_preview(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.downscale(carrier_frames(spark, sf), SIDE, SIDE, 5).select(*RGB)


ANGLE = 30.0
TURNED = geometry.rotated_size(SIDE, SIDE, ANGLE)
COS, SIN = d(math.cos(math.radians(ANGLE))), d(math.sin(math.radians(ANGLE)))
DX, DY = f"(x - {d((TURNED[0] - 1) / 2)})", f"(y - {d((TURNED[1] - 1) / 2)})"


@register(f"{PX}, {sample_sql('px', 'o', TURNED, f'{COS} * {DX} + {SIN} * {DY} + 3.5::DOUBLE', f'-{SIN} * {DX} + {COS} * {DY} + 3.5::DOUBLE')} SELECT * FROM o")
def rotate_any(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.rotated(carrier_frames(spark, sf), SIDE, SIDE, ANGLE).select(*RGB)


def newton_sql(k1: float, k2: float, k3: float, c0: float, c1: float, c2: float) -> str:
    """CTE ``lens_map``: where each place of the frame comes from, and its gain."""
    diagonal = d(math.hypot(SIDE, SIDE) / 2)
    steps = ["n0 AS MATERIALIZED (SELECT *, sqrt(nx * nx + ny * ny) AS t, sqrt(nx * nx + ny * ny) AS r FROM (SELECT CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, (i % 8 - 3.5::DOUBLE) / " + diagonal + " AS nx, (i // 8 - 3.5::DOUBLE) / " + diagonal + " AS ny FROM range(64) g(i)))"]
    for k in range(8):
        f = f"(r * (1 + {d(k1)} * r * r + {d(k2)} * r * r * r * r + {d(k3)} * r * r * r * r * r * r) - t) / (1 + 3 * {d(k1)} * r * r + 5 * {d(k2)} * r * r * r * r + 7 * {d(k3)} * r * r * r * r * r * r)"
        steps.append(f"n{k + 1} AS MATERIALIZED (SELECT x, y, nx, ny, t, greatest(r - {f}, 0) AS r FROM n{k})")
    q = "CASE WHEN t > 1e-6 THEN r / t ELSE 1 END"
    return ", ".join(steps) + f", lens_map AS MATERIALIZED (SELECT x, y, 3.5::DOUBLE + nx * ({q}) * {diagonal} AS mx, 3.5::DOUBLE + ny * ({q}) * {diagonal} AS my, greatest({d(c0)} + {d(c1)} * t * t + {d(c2)} * t * t * t * t, 0.01) AS gain FROM n8)"


MAPPED = "(SELECT {} FROM lens_map m WHERE m.x = t.x AND m.y = t.y)"


def lens_sql(source: str, name: str, lens: geometry.Lens) -> str:
    body = sample_sql(source, name, (SIDE, SIDE), "mx", "my", gain="gain")
    grid = f"(SELECT CAST(i % {SIDE} AS INTEGER) AS x, CAST(i // {SIDE} AS INTEGER) AS y FROM range({SIDE * SIDE}) t(i))"
    return newton_sql(*lens.coefficients()[:6]) + ", " + body.replace(grid, "lens_map")


LENS = geometry.Lens("wide-light", c1=-0.3, c2=0.05)


@register(f"{PX}, {lens_sql('px', 'o', LENS)} SELECT * FROM o")
def lens_correction(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.undistorted(carrier_frames(spark, sf), SIDE, SIDE, LENS).select(*RGB)


def ca_sql(source: str, name: str, red: float, blue: float, w: int, h: int) -> str:
    at = lambda c, n, k: f"{d((n - 1) / 2)} + ({c} - {d((n - 1) / 2)}) * (1 + {d(k)})"
    parts = [sample_sql(source, f"{name}_{c}", (w, h), at("x", w, k), at("y", h, k), c, w=w, h=h) for c, k in (("r", red), ("b", blue))]
    return ", ".join(parts) + f", {name} AS MATERIALIZED (SELECT s.image_id, s.x, s.y, p.r, s.g, q.b FROM {source} s JOIN {name}_r p USING (image_id, x, y) JOIN {name}_b q USING (image_id, x, y))"


CA = geometry.Lens(ca_red=0.04, ca_blue=-0.03)


@register(f"{PX}, {ca_sql('px', 'o', 0.04, -0.03, 8, 8)} SELECT * FROM o")
def chromatic_aberration(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.aligned(carrier_frames(spark, sf), SIDE, SIDE, CA).select(*RGB)


def warp_sql(source: str, name: str, p: geometry.Perspective) -> str:
    (w, h), (ex, ey) = p.size(SIDE, SIDE), p.box()
    nx, ny = f"({d(-ex / 2)} + x / {d(float(max(w - 1, 1)))} * {d(ex)})", f"({d(-ey / 2)} + y / {d(float(max(h - 1, 1)))} * {d(ey)})"
    u, v, z = (f"({d(a)} * {nx} + {d(b)} * {ny} + {d(c)})" for a, b, c in p.inverse())
    return sample_sql(source, name, (w, h), f"({u} / {z} / 2 + 0.5::DOUBLE) * 7", f"({v} / {z} / 2 + 0.5::DOUBLE) * 7")


TILT = geometry.Perspective(vertical=0.2, horizontal=-0.1, rotation=0.15, scale=1.1, aspect_ratio=0.9, shift_x=0.05, shift_y=-0.1)


@register(f"{PX}, {warp_sql('px', 'o', TILT)} SELECT * FROM o")
def perspective(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.warped(carrier_frames(spark, sf), SIDE, SIDE, TILT).select(*RGB)


SHAPE = geometry.Geometry((0.125, 0.25, 0.75, 0.5), 90.0, True, False)
MILD = geometry.Perspective(vertical=0.1, scale=1.2)
WIDE = geometry.Lens("tele-light")
MW, MH = MILD.size(SIDE, SIDE)
CX, CY, CW, CH = SHAPE.pixels(MW, MH)


@register(f"""{PX}, {lens_sql('px', 'a', WIDE)}, {warp_sql('a', 'b', MILD)}, {ca_sql('b', 'c', *WIDE.coefficients()[6:], MW, MH)}
SELECT image_id, {CH - 1} - ({CH - 1} - (y - {CY})) AS x, x - {CX} AS y, r, g, b FROM c WHERE x BETWEEN {CX} AND {CX + CW - 1} AND y BETWEEN {CY} AND {CY + CH - 1}""")
def full_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Lens, perspective, aberration, crop, quarter turn and mirror in one pass over the plan."""
    return geometry.transformed(carrier_frames(spark, sf), SIDE, SIDE, SHAPE, WIDE, MILD).select(*RGB)


TURNS = {1: ("x", "y"), 2: ("7 - x", "y"), 3: ("7 - x", "7 - y"), 4: ("x", "7 - y"), 5: ("y", "x"), 6: ("7 - y", "x"), 7: ("7 - y", "7 - x"), 8: ("y", "7 - x")}


@register(f"{PX} " + " UNION ALL ".join(f"SELECT {o} AS orientation, image_id, {x} AS x, {y} AS y, r, g, b FROM px" for o, (x, y) in TURNS.items()))
def exif_orientation(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame in all eight orientations."""
    px = carrier_frames(spark, sf)
    out = [geometry.oriented(px, SIDE, SIDE, o).select(F.lit(o).alias("orientation"), *RGB) for o in range(1, 9)]
    every = out[0]
    for o in out[1:]:
        every = every.union(o)
    return every


SIZES = "doc_id, 40 + n_chars % 5000 AS w, 40 + doc_id * 37 % 3000 AS h"
PRESETS = list(geometry.ASPECTS)
RATIO = "CASE preset WHEN 'original' THEN w / h::DOUBLE " + " ".join(f"WHEN '{k}' THEN {d(v)}" for k, v in geometry.ASPECTS.items() if v) + " END"


def rectangle_sql(source: str) -> str:
    good = "isfinite(x) AND isfinite(y) AND isfinite(a) AND isfinite(b) AND a > 0 AND b > 0 AND x >= 0 AND y >= 0 AND x + a <= 1 + 1e-6 AND y + b <= 1 + 1e-6"
    return f"""SELECT doc_id, CASE WHEN {good} THEN CAST(round(x * w) AS INTEGER) END AS left_px, CASE WHEN {good} THEN CAST(round(y * h) AS INTEGER) END AS top_px,
 CASE WHEN {good} THEN CAST(least(greatest(round(a * w), 1), w - round(x * w)) AS INTEGER) END AS across, CASE WHEN {good} THEN CAST(least(greatest(round(b * h), 1), h - round(y * h)) AS INTEGER) END AS down FROM {source}"""


def named(rect: str = "c") -> list:
    return [F.col(f"{rect}.x").alias("left_px"), F.col(f"{rect}.y").alias("top_px"), F.col(f"{rect}.w").alias("across"), F.col(f"{rect}.h").alias("down")]


@register(f"""WITH s AS (SELECT {SIZES}, ({PRESETS!r})[doc_id % 10 + 1] AS preset FROM documents), q AS (SELECT *, w / h::DOUBLE AS own, {RATIO} AS ratio FROM s),
t AS (SELECT *, CASE WHEN own > ratio THEN ratio / own ELSE 1::DOUBLE END AS a, CASE WHEN own > ratio THEN 1::DOUBLE ELSE own / ratio END AS b FROM q), u AS (SELECT *, (1 - a) / 2 AS x, (1 - b) / 2 AS y FROM t) {rectangle_sql('u')}""")
def crop_presets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").selectExpr(*SIZES.split(", "), f"element_at(array({', '.join(map(repr, PRESETS))}), CAST(doc_id % 10 AS INT) + 1) AS preset")
    return rows.withColumn("c", geometry.crop_rectangle(F.col("w"), F.col("h"), F.col("preset"))).select("doc_id", *named())


FREE = "(doc_id % 7) / 10.0::DOUBLE AS x, (doc_id % 5) / 10.0::DOUBLE AS y, (doc_id % 11) / 10.0::DOUBLE AS a, (n_chars % 9 + 1) / 10.0::DOUBLE AS b"


@register(f"WITH u AS (SELECT {SIZES}, {FREE} FROM documents) {rectangle_sql('u')}")
def crop_free(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").selectExpr(*SIZES.split(", "), *[p.replace("10.0::DOUBLE", "10.0D") for p in FREE.split(", ")])
    return rows.withColumn("c", geometry.pixel_rectangle(*(F.col(c) for c in ("w", "h", "x", "y", "a", "b")))).select("doc_id", *named())


@register("SELECT * FROM (VALUES " + ", ".join(f"({i}, {o.width}, {o.height}, round({d(o.x)}, 6), round({d(o.y)}, 6), round({d(o.across)}, 6), round({d(o.down)}, 6))" for i, o in enumerate([geometry.Domain(11, 11), geometry.Domain(4, 6, 0.125, 0.25, 0.75, 0.5)])) + ") t(id, width, height, x, y, across, down)")
def measurement_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Output sizes without rendering: a frame of eight turned by 30 degrees, and cropped and turned by 90."""
    cases = [geometry.measurement_domain(SIDE, SIDE, geometry.Geometry(degrees=30.0)), geometry.measurement_domain(SIDE, SIDE, SHAPE)]
    rows = ", ".join(f"({i}, {o.width}, {o.height}, {o.x}D, {o.y}D, {o.across}D, {o.down}D)" for i, o in enumerate(cases))
    return rounded(spark.sql(f"SELECT * FROM VALUES {rows} AS t(id, width, height, x, y, across, down)"))


NEAR = "a.image_id = b.image_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2"
#: Every place with the 25 around it, the edge's repeated.
AROUND = f"""{PX}, y255 AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM px), o AS (SELECT unnest(range(-2, 3)) AS d),
n AS (SELECT c.image_id, c.x, c.y, c.r, c.g, c.b, c.l, n.r AS nr, n.b AS nb, n.l AS nl, p.d * p.d + q.d * q.d AS d2 FROM y255 c, o p, o q JOIN y255 n ON n.image_id = c.image_id AND n.x = greatest(0, least(7, c.x + p.d)) AND n.y = greatest(0, least(7, c.y + q.d)))"""


@register(f"""{AROUND}, w AS (SELECT *, exp(-d2 / 4.5::DOUBLE) * exp(-((l - nl) * (l - nl)) / (2 * 0.12::DOUBLE * 255 * 0.12::DOUBLE * 255)) AS lw, exp(-d2 / 8.0::DOUBLE) AS cw FROM n),
s AS (SELECT image_id, x, y, r, g, b, l, l * 0.4::DOUBLE + sum(lw * nl) / sum(lw) * 0.6::DOUBLE AS v, sum(cw * (nr - nl)) / sum(cw) AS cr, sum(cw * (nb - nl)) / sum(cw) AS cb FROM w GROUP BY image_id, x, y, r, g, b, l)
SELECT image_id, x, y, CAST({at_least('round(v + ((r - l) * 0.5::DOUBLE + cr * 0.5::DOUBLE))', '0', '255')} AS INTEGER) AS r, CAST({at_least('round(v + (g - l))', '0', '255')} AS INTEGER) AS g, CAST({at_least('round(v + ((b - l) * 0.5::DOUBLE + cb * 0.5::DOUBLE))', '0', '255')} AS INTEGER) AS b FROM s""")
def noise_reduction(spark: SparkSession, sf: str) -> DataFrame:
    return detail.denoised(carrier_frames(spark, sf), 0.6, 0.5)


def gauss_sql(source: str, name: str, sigma: float) -> str:
    kernel = ", ".join(f"({k - len(detail.gaussian(sigma)) // 2}, {d(v)})" for k, v in enumerate(detail.gaussian(sigma)))
    part = lambda src, axis, other, out: f"{out} AS (SELECT c.image_id, c.x, c.y, sum(k.w * n.l) AS l FROM {src} c, (VALUES {kernel}) k(d, w) JOIN {src} n ON n.image_id = c.image_id AND n.{other} = c.{other} AND n.{axis} = greatest(0, least(7, c.{axis} + k.d)) GROUP BY ALL)"
    return f"{part(source, 'x', 'y', name + '_h')}, {part(name + '_h', 'y', 'x', name)}"


@register(f"""{PX}, y255 AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM px), {gauss_sql('y255', 'fine', 0.6)}, {gauss_sql('y255', 'coarse', 1.7999999999999998)},
e AS (SELECT *, abs(coalesce(lead(l) OVER h, l) - coalesce(lag(l) OVER h, l)) + abs(coalesce(lead(l) OVER v, l) - coalesce(lag(l) OVER v, l)) AS e FROM y255 WINDOW h AS (PARTITION BY image_id, y ORDER BY x), v AS (PARTITION BY image_id, x ORDER BY y)),
m AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY image_id) > 0 THEN e / max(e) OVER (PARTITION BY image_id) ELSE 0 END AS edge FROM e),
n AS (SELECT m.*, greatest(0, least(255, m.l + 0.8::DOUBLE * ((1 - 0.5::DOUBLE) + 0.5::DOUBLE * edge) * (0.4::DOUBLE * (m.l - f.l) + (1 - 0.4::DOUBLE) * (m.l - c.l)))) AS ny FROM m JOIN fine f USING (image_id, x, y) JOIN coarse c USING (image_id, x, y))
SELECT image_id, x, y, """ + ", ".join(f"CAST({at_least(f'round({c} * (CASE WHEN l > 1e-6 THEN ny / l ELSE 0 END))', '0', '255')} AS INTEGER) AS {c}" for c in "rgb") + " FROM n")
def sharpening(spark: SparkSession, sf: str) -> DataFrame:
    return detail.sharpened(carrier_frames(spark, sf), 0.8, 1.2, 0.4, 0.5)


def dog_sql(source: str, name: str, radius: int, amount: float) -> str:
    values = ", ".join(f"CAST(round(greatest(0, least(255, a.{c} + {d(amount)} * (a.{c} - sum(b.{c})::DOUBLE / count(*))))) AS INTEGER) AS {c}" for c in "rgb")
    return f"{name} AS (SELECT a.image_id, a.x, a.y, {values} FROM {source} a JOIN {source} b ON a.image_id = b.image_id AND abs(a.x - b.x) <= {radius} AND abs(a.y - b.y) <= {radius} GROUP BY a.image_id, a.x, a.y, a.r, a.g, a.b)"


@register(f"{PX}, {dog_sql('px', 't', 2, 0.5)}, {dog_sql('t', 'o', 18, -0.4)} SELECT * FROM o")
def texture_clarity(spark: SparkSession, sf: str) -> DataFrame:
    return detail.presence(carrier_frames(spark, sf), 0.5, -0.4)


@register(f"{PX} SELECT image_id, x, y, CAST(floor(v * 0.7::DOUBLE) AS INTEGER) AS v FROM " + blurred_sql(blurred_sql("(SELECT image_id, x, y, 65535 - r * 257 AS v FROM px)", 1, 3), 1, 1))
def layer_modulation(spark: SparkSession, sf: str) -> DataFrame:
    """Inverted, feathered by 0.3, blurred by 0.5 and thinned to 0.7."""
    return detail.modulated(plane(carrier_frames(spark, sf), "r"), SIDE, SIDE, True, 0.3, 0.5, 0.7)


@register(f"{PX} SELECT image_id, x, y, r // 4 * 4 AS r, g // 4 * 4 AS g, b // 4 * 4 AS b FROM px")
def webp_quantise(spark: SparkSession, sf: str) -> DataFrame:
    return detail.quantised(carrier_frames(spark, sf), 60).select(*RGB)


@register(f"{PX} SELECT image_id, x, y, r, g, b FROM px")
def alpha_drop(spark: SparkSession, sf: str) -> DataFrame:
    return carrier_frames(spark, sf).drop("a", "folder")


@register(f"{PX} SELECT image_id, x, y, round(r / 255.0::DOUBLE, 6) AS r, round(g / 255.0::DOUBLE, 6) AS g, round(b / 255.0::DOUBLE, 6) AS b FROM px")
def tensor_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(detail.as_tensor(carrier_frames(spark, sf)))


@register(f"{PX} SELECT image_id, x, y, CAST(round(greatest(0, least(1, r / 200.0::DOUBLE - 0.1::DOUBLE)) * 65535) AS INTEGER) AS v FROM px")
def tensor_plane(spark: SparkSession, sf: str) -> DataFrame:
    return carrier_frames(spark, sf).select("image_id", "x", "y", detail.as_plane(F.col("r") / 200.0 - 0.1).alias("v"))


def xorshift_sql(name: str, seed: int, n: int) -> str:
    """CTE (i, s): the sequence's first numbers, step by step."""
    nest = "s"
    for shift in (f"({{v}} << 13) & {detail.WORD}::HUGEINT", "{v} >> 7", f"({{v}} << 17) & {detail.WORD}::HUGEINT"):
        nest = f"xor({nest}, {shift.replace('{v}', f'({nest})')})"
    return f"{name}(i, s) AS (SELECT 0, {seed}::HUGEINT UNION ALL SELECT i + 1, {nest} FROM {name} WHERE i < {n})"


@register(f"""WITH RECURSIVE {xorshift_sql('state', 7 ^ detail.SEED, 3 * SIDE * SIDE)}, {PX[5:]}, sign AS (SELECT CAST((i - 1) % 3 AS INTEGER) AS c, CAST((i - 1) // 3 % 8 AS INTEGER) AS x, CAST((i - 1) // 24 AS INTEGER) AS y, CASE WHEN s & 1 = 0 THEN -1 ELSE 1 END AS d FROM state WHERE i > 0)
SELECT image_id, x, y, greatest(0, least(255, r + p.d)) AS r, greatest(0, least(255, g + q.d)) AS g, greatest(0, least(255, b + s.d)) AS b FROM px JOIN (SELECT * FROM sign WHERE c = 0) p USING (x, y) JOIN (SELECT * FROM sign WHERE c = 1) q USING (x, y) JOIN (SELECT * FROM sign WHERE c = 2) s USING (x, y)""")
def dither(spark: SparkSession, sf: str) -> DataFrame:
    return detail.dithered(carrier_frames(spark, sf), SIDE, SIDE, 7)
