"""Coverage of outlines and drawing of layers, against plain versions of both."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.operators import compositing, coverage, raster
from glyphlake.plans.all_queries import QUERIES
from glyphlake.plans.raster_queries import QUERIES_WITHOUT_PYTHON

EDGE = "id bigint, x0 double, y0 double, x1 double, y1 double"


def clip(poly, axis, at, keep_less):
    """A polygon cut at a line across an axis."""
    inside = lambda p: p[axis] <= at if keep_less else p[axis] >= at
    out = []
    for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
        if inside(p):
            out.append(p)
        if inside(p) != inside(q):
            t = (at - p[axis]) / (q[axis] - p[axis])
            out.append(tuple(a + t * (b - a) for a, b in zip(p, q, strict=True)))
    return out


def signed_area(poly):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(poly, poly[1:] + poly[:1], strict=True)) / 2


def brute_canvas(contours, width, height, rule):
    """Every pixel's signed area by cutting each polygon at its four sides."""
    canvas = np.zeros((height, width), int)
    for y in range(height):
        for x in range(width):
            area = 0.0
            for poly in contours:
                part = poly
                for axis, at, less in ((0, x, False), (0, x + 1, True), (1, y, False), (1, y + 1, True)):
                    part = clip(part, axis, at, less) if part else part
                area += signed_area(part) if len(part) > 2 else 0
            area = abs(area)
            if rule == "evenodd":
                area = area % 2
                area = 2 - area if area > 1 else area
            canvas[y, x] = min(255, int(area * 256 + 1e-6))
    return canvas


def edges_of(contours, key):
    return [(key, float(p[0]), float(p[1]), float(q[0]), float(q[1])) for c in contours for p, q in zip(c, c[1:] + c[:1], strict=True)]


@pytest.mark.parametrize("rule", ["nonzero", "evenodd"])
def test_coverage_against_cut_polygons(spark, rule):
    r = random.Random(11)
    width, height = 9, 7
    pictures = {0: [[(1, 1), (5, 1), (5, 4), (1, 4)]], 1: [[(0.5, 0.25), (3.5, 0.25), (3.5, 2.5), (0.5, 2.5)]], 2: [[(-4, -4), (20, -4), (20, 20), (-4, 20)]], 3: [[(2, 2), (2, 2), (2, 2)]], 4: [[(20, 1), (25, 1), (25, 5)]]}
    for k in range(5, 25):
        pictures[k] = [[(r.uniform(-3, 12), r.uniform(-3, 10)) for _ in range(r.randrange(3, 8))] for _ in range(r.randrange(1, 4))]
    pictures[25] = [[(i % 9, i // 2) for i in r.sample(range(14), 6)]]  # on the grid
    d = spark.createDataFrame([e for k, c in pictures.items() for e in edges_of(c, k)], EDGE)
    got = {k: np.zeros((height, width), int) for k in pictures}
    runs = coverage.runs(d, ["id"], width, height, rule)
    for x in runs.collect():
        assert x.length > 0 and 0 < x.value < 256 and 0 <= x.x and x.x + x.length <= width and 0 <= x.row < height
        assert not got[x.id][x.row, x.x : x.x + x.length].any()
        got[x.id][x.row, x.x : x.x + x.length] = x.value
    for k, contours in pictures.items():
        want = brute_canvas(contours, width, height, rule)
        assert np.abs(got[k] - want).max() <= 1, k  # a level where the area ends on one
        assert (got[k] != want).sum() <= 2
    keys = spark.createDataFrame([(k,) for k in pictures], "id bigint")
    lines = coverage.scan_lines(runs, ["id"], width, keys, height).collect()
    assert len(lines) == len(pictures) * height
    assert all(list(x.line) == got[x.id][x.row].tolist() for x in lines)


def test_full_pixels_are_full_and_empty_tables_empty(spark):
    d = spark.createDataFrame(edges_of([[(0, 0), (4000, 0), (4000, 3), (0, 3)]], 1), EDGE)
    assert [(x.row, x.x, x.length, x.value) for x in coverage.runs(d, ["id"], 4000, 3).orderBy("row", "x").collect()] == [(y, a, n, 255) for y in range(3) for a, n in ((0, 1), (1, 3999))]
    assert coverage.runs(d.limit(0), ["id"], 10, 10).count() == 0
    with pytest.raises(ValueError):
        coverage.runs(d, ["id"], 4, 4, "winding")


def test_curves_follow_their_points(spark):
    """A circle of quadratic curves whose points are all off the outline has the area of one."""
    n, r = 8, 20.0
    far = r / np.cos(np.pi / n)
    points = [(float(24 + far * np.cos(2 * np.pi * k / n)), float(24 + far * np.sin(2 * np.pi * k / n)), False) for k in range(n)]
    d = spark.createDataFrame([(1, points)], "id bigint, c array<struct<x:double,y:double,on:boolean>>")
    e = d.select("id", F.explode(coverage.closed_edges(coverage.flattened(F.col("c"), 16))).alias("e")).select("id", "e.*")
    area = coverage.runs(e, ["id"], 48, 48).agg(F.sum(F.col("length") * F.col("value") / 255.0)).first()[0]
    assert abs(area - np.pi * r * r) < 0.01 * np.pi * r * r
    mixed = spark.createDataFrame([(1, [(0.0, 0.0, True), (4.0, 0.0, False), (4.0, 4.0, True)])], d.schema)
    flat = [tuple(p) for p in mixed.select(coverage.flattened(F.col("c"), 2)).first()[0]]
    assert flat == [(0.0, 0.0), (3.0, 1.0), (4.0, 4.0)]


@pytest.mark.parametrize("how", ["blend", "replace"])
def test_layers_against_a_canvas(spark, how):
    """Many overlapping layers give the canvas, counter, box and empty layers of drawing one after the other."""
    r = np.random.default_rng(4)
    rows, layers = [], {}
    for k in range(6):
        layers[k] = [(int(r.integers(-3, 8)), int(r.integers(-3, 6)), (r.integers(0, 256, (4, 5)) * (r.random((4, 5)) < 0.7)).astype(np.uint8)) for _ in range(9)]
        layers[k].append((50, 0, np.full((2, 2), 9, np.uint8)))
        rows += [(k, z, x + j, y + i, int(g[i, j])) for z, (x, y, g) in enumerate(layers[k]) for i in range(g.shape[0]) for j in range(g.shape[1])]
    d = spark.createDataFrame(rows, "id int, z int, x int, y int, value int").repartition(5)
    on = compositing.clipped(d, 9, 7)
    canvas = compositing.composited(on, ["id"], how=how).cache()
    none = compositing.empty_layers(d.select("id", "z").distinct(), on, ["id"]).collect()
    got = {k: np.zeros((7, 9), int) for k in layers}
    for p in canvas.collect():
        got[p.id][p.y, p.x] = p.value
    about = {s.id: s for s in compositing.summary(canvas, ["id"]).collect()}
    most = canvas.agg(F.max("overwrites")).first()[0]
    assert most >= 3
    for k, parts in layers.items():
        want, over, box, empty = raster.paint(parts, 7, 9, how == "blend")
        assert (got[k] == want).all() and about[k].overwrites == over
        assert (about[k].l, about[k].t, about[k].r, about[k].b) == box
        assert sorted(x.z for x in none if x.id == k) == [z for z, e in enumerate(empty) if e]
    with pytest.raises(ValueError):
        compositing.composited(d, ["id"], how="add")


def test_outlines_and_crops(spark):
    boxes = spark.createDataFrame([(1, 0, 2, 1, 6, 4), (1, 1, 3, 3, 3, 3), (2, 0, 5, 5, 4, 9)], "id int, z int, l int, t int, r int, b int")
    p = compositing.outline_pixels(boxes, ["id"])
    want = np.zeros((7, 9), np.uint8)
    raster.outline(want, 2, 1, 6, 4)
    raster.outline(want, 3, 3, 3, 3)
    canvas = compositing.composited(p, ["id"])
    got = np.zeros((7, 9), int)
    for x in canvas.collect():
        assert x.id == 1 and x.overwrites == 0
        got[x.y, x.x] = x.value
    assert (got == want).all()
    crop = compositing.cropped(canvas, ["id"], 2).collect()
    whole = raster.recognition_crop(want, (2, 1, 6, 4), 2)
    out = np.full((crop[0].height, crop[0].width), 255)
    for x in crop:
        out[x.y, x.x] = x.value
    assert (out == whole).all()


@pytest.mark.parametrize("name", QUERIES_WITHOUT_PYTHON)
def test_no_python_workers(spark, small, name):
    assert not re.search("Python|Pandas|Arrow", QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString())


def test_lines_of_pictures_are_never_broadcast(spark):
    # by its guess of their size, Spark collected the lines of all pictures in the driver
    square = [(3, x0, y0, x1, y1) for x0, y0, x1, y1 in ((1.0, 1.0, 1.0, 3.0), (1.0, 3.0, 3.0, 3.0), (3.0, 3.0, 3.0, 1.0), (3.0, 1.0, 1.0, 1.0))]
    pictures = spark.createDataFrame([(3, 4, 4), (5, 2, 1)], "id bigint, w int, h int")
    edges = spark.createDataFrame(square, EDGE).join(F.broadcast(pictures), "id")
    keys = ["id", "w", "h"]
    found = coverage.bitmaps(coverage.runs(edges, keys, "w", "h"), keys, "w", pictures, "h")
    got = {r.id: bytes(r.bitmap) for r in found.collect()}
    assert got == {3: bytes(5) + b"\xff\xff\0\0\xff\xff" + bytes(5), 5: bytes(2)}
    outlines = spark.createDataFrame(
        [("f", 0, 0, 0, "A", 64, 10, [[(0.0, 0.0, True), (0.0, 64.0, True), (64.0, 64.0, True)]], False, False, None)],
        "font_id string, face int, row int, idx int, ch string, units int, advance int, contours array<array<struct<x: double, y: double, on: boolean>>>, load_failed boolean, font_not_loaded boolean, error string",
    )
    for df in (found.drop("w", "h"), coverage.glyphs(outlines, [(16, 72)])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if " Join " in f" {line} " and "strategy=broadcast" not in line]
        assert joins and all("strategy=merge" in line for line in joins), plan
