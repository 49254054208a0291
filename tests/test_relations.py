"""Prompts and mask graphs from tables against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import mask_levels, prompts


def shape_rows(spark, rows):
    """(image_id, width, height, kind, dict of a shape)."""
    kinds = list(prompts.SHAPES)
    schema = "image_id int, width int, height int, kind string, " + ", ".join(f"{c} {t}" for c, t in prompts.SHAPES.items()) + ", x string"
    return spark.createDataFrame([(i, w, h, k, *[shape.get(c) for c in kinds], "clash") for i, w, h, k, shape in rows], schema)


def even_odd(nx, ny, points):
    odd = False
    for k in range(len(points)):
        (xi, yi), (xj, yj) = points[k], points[k - 1]
        if (yi > ny) != (yj > ny) and nx < (xj - xi) * (ny - yi) / (yj - yi) + xi:
            odd = not odd
    return odd


def brute(w, h, kind, shape, x, y):
    nx, ny = (x + 0.5) / w, (y + 0.5) / h
    if kind == "polygon":
        return 65535 if len(shape["points"]) >= 3 and even_odd(nx, ny, shape["points"]) else 0
    if kind == "ellipse":
        cx, cy, rx, ry = shape["ellipse"]
        return 65535 if ((nx - cx) / rx) ** 2 + ((ny - cy) / ry) ** 2 <= 1 else 0
    if kind == "box":
        bx, by, bw, bh = shape["box"]
        return 65535 if math.floor(bx * w) <= x < math.ceil((bx + bw) * w) and math.floor(by * h) <= y < math.ceil((by + bh) * h) else 0
    v = 0
    for mx, my, r, adds in shape["marks"]:
        if ((nx - mx) / r) ** 2 + ((ny - my) / r) ** 2 <= 1:
            v = 65535 if adds else 0
    return v


def test_prompts_against_every_pixel(spark):
    """Corners on pixel centres and edges, shapes beyond the frame, horizontal edges, repeated corners, crossing lines, an hour-glass."""
    r = random.Random(5)
    near = lambda: r.choice([r.uniform(-0.3, 1.3), r.randrange(0, 11) / 10, (r.randrange(0, 10) + 0.5) / 10, 0.0, 1.0])
    rows = []
    for i in range(80):
        w, h = r.choice([(10, 10), (1, 1), (7, 3), (20, 5)])
        kind = ["polygon", "ellipse", "box", "brush"][i % 4]
        if kind == "polygon":
            shape = {"points": [(near(), near()) for _ in range(r.randrange(1, 9))]}
        elif kind == "ellipse":
            shape = {"ellipse": (near(), near(), r.choice([0.05, 0.2, 0.5, 2.0]), r.choice([0.05, 0.25, 0.4]))}
        elif kind == "box":
            shape = {"box": (near(), near(), r.choice([0.0, 0.3, 0.1, 1.5]), r.choice([0.2, 0.7]))}
        else:
            shape = {"marks": [(near(), near(), r.choice([0.05, 0.3, 0.6]), r.random() < 0.7) for _ in range(r.randrange(0, 5))]}
        rows.append((i, w, h, kind, shape))
    rows.append((90, 10, 10, "polygon", {"points": [(0.1, 0.1), (0.9, 0.9), (0.9, 0.1), (0.1, 0.9)]}))
    got = {(v.image_id, v.x, v.y): v.v for v in prompts.planes(shape_rows(spark, rows)).collect()}
    assert got == {(i, x, y): brute(w, h, kind, shape, x, y) for i, w, h, kind, shape in rows for x in range(w) for y in range(h)}


def test_prompts_without_shapes(spark):
    rows = [(1, 2, 2, "polygon", {}), (2, 2, 1, "box", {}), (3, 0, 5, "ellipse", {"ellipse": (0.5, 0.5, 0.5, 0.5)}), (4, 1, 1, "unknown", {}), (5, 2, 1, None, {}), (6, 2, 2, "gradient", {})]
    got = prompts.planes(shape_rows(spark, rows)).collect()
    assert sorted((v.image_id, v.v) for v in got) == [(1, 0)] * 4 + [(2, 0)] * 2 + [(4, 0)] + [(5, 0)] * 2
    assert prompts.planes(shape_rows(spark, [])).count() == 0


def test_gradient_ends(spark):
    got = {(v.x, v.y): v.v for v in prompts.planes(shape_rows(spark, [(1, 8, 2, "gradient", {"gradient": (0.0, 0.0, 1.0)})])).collect()}
    assert all(got[x, y] == math.floor(x / 7 * 65535 + 0.5) for x in range(8) for y in range(2))


def tables(spark, nodes, sizes):
    definitions = spark.createDataFrame(nodes, "node string, op string, refs array<string>, level string")
    payloads = spark.createDataFrame([(n, w, 1) for n, w in sizes.items()], "node string, width int, height int")
    return definitions, payloads


def first_failure(nodes, sizes, name):
    """What an evaluation in order meets first: (error, node), or the plane's width."""
    graph = {n: (op, list(refs or [])) for n, op, refs, _ in nodes}
    least = {"source": (0, 0), "union": (2, 99), "intersect": (2, 99), "subtract": (2, 2), "invert": (1, 1)}

    def walk(n, stack):
        if n not in graph:
            raise LookupError("missing_mask", n)
        if n in stack:
            raise LookupError("cycle", n)
        op, refs = graph[n]
        if op not in least:
            raise LookupError("unknown_operation", n)
        if not least[op][0] <= len(refs) <= least[op][1]:
            raise LookupError("arity", n)
        if op == "source":
            if n not in sizes:
                raise LookupError("missing_payload", n)
            return sizes[n]
        width = walk(refs[0], [*stack, n])
        for r in refs[1:]:
            if walk(r, [*stack, n]) != width:
                raise LookupError("dimension_mismatch", n)
        return width

    try:
        return walk(name, [])
    except LookupError as e:
        return e.args


@pytest.mark.parametrize("seed", range(3))
def test_failures_are_those_of_an_evaluation_in_order(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(60)]
    nodes = []
    for i, n in enumerate(names):
        op = r.choice(["source", "source", "union", "intersect", "subtract", "invert", "union"]) if r.random() < 0.97 else "blend"
        count = {"source": 0, "invert": 1, "subtract": 2}.get(op, r.choice([2, 3]))
        count += r.random() < 0.05
        refs = [(r.choice(names[:i] or names) if r.random() < 0.93 else r.choice([*names, "nowhere", n])) for _ in range(count)]
        nodes.append((n, op, refs, "clash"))
    sizes = {n: r.choice([2, 2, 2, 2, 3]) for n, op, *_ in nodes if op == "source" and r.random() < 0.95}
    fine, failed = mask_levels.levels(*tables(spark, nodes, sizes))
    got = {x.node: x.width for x in fine.collect()} | {x.node: (x.error, x["at"]) for x in failed.collect() if x.node != "nowhere"}
    assert got == {n: first_failure(nodes, sizes, n) for n in names}


def test_stacked_diamonds(spark):
    """Twenty-four diamonds on each other have 2 ** 24 paths, but 24 levels of three nodes."""
    nodes = [("s", "source", [], "c"), ("a0", "invert", ["s"], "c")]
    for k in range(24):
        nodes += [(f"l{k}", "invert", [f"a{k}"], "c"), (f"r{k}", "union", [f"a{k}", f"a{k}"], "c"), (f"a{k + 1}", "union", [f"l{k}", f"r{k}"], "c")]
    definitions, payloads = tables(spark, nodes, {"s": 1})
    fine, failed = mask_levels.levels(definitions, payloads)
    assert failed.count() == 0 and fine.agg(F.max("level")).first()[0] == 49
    planes = spark.createDataFrame([("s", 0, 0, 1000)], "node string, x int, y int, v int")
    got = {x.node: x.v for x in mask_levels.evaluated(definitions, fine, planes).where("node LIKE 'a%'").collect()}
    want, v = {}, 65535 - 1000
    for k in range(25):
        want[f"a{k}"] = v
        v = max(65535 - v, v)
    assert got == want


def test_empty_graph(spark):
    fine, failed = mask_levels.levels(*tables(spark, [], {}))
    assert fine.count() == failed.count() == 0
