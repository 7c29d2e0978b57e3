"""Outlines to grey pixels as relations: how much of each pixel an outline covers, exactly, for any number of outlines.

Each edge is cut at the rows and columns of the pixel grid. A piece inside a cell adds its signed height, which also covers
all pixels to its right, and its signed area within the cell. Sums by cell and a running sum along the row give each
pixel's coverage. Only cells that an edge crosses are rows; what lies between them has one coverage and is one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.session import checkpointed

#: Parts of a pixel in which pieces are counted, so that sums are whole numbers and do not depend on their order.
UNIT = 1 << 24


def closed_edges(contour: Column) -> Column:
    """The edges (x0, y0, x1, y1) of a closed contour, an array of (x, y); the last point is joined to the first."""
    def edge(p: Column, i: Column) -> Column:
        q = F.get(contour, (i + 1) % F.size(contour))
        return F.struct(*(c.cast("double").alias(n) for c, n in ((p["x"], "x0"), (p["y"], "y0"), (q["x"], "x1"), (q["y"], "y1"))))

    return F.transform(contour, edge)


def flattened(contour: Column, steps: int = 8) -> Column:
    """A contour of (x, y, on) as one of (x, y): curves become `steps` straight pieces.

    A point that is not on the outline controls a quadratic curve between its neighbours; between two such points lies
    one on the outline, half way. Points on the outline stay.
    """
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def piece(q: Column, i: Column) -> Column:
        n = F.size(contour)
        beside = [F.get(contour, (i + d + n) % n) for d in (-1, 1)]
        # a curve begins and ends at neighbours on the outline, or half way to those that are not
        ends = [[F.when(b["on"], b[c]).otherwise((q[c] + b[c]) / 2).cast("double") for c in ("x", "y")] for b in beside]

        def at(k: Column) -> Column:
            t = k / float(steps)
            return point(*((1 - t) * (1 - t) * a + 2 * (1 - t) * t * q[c] + t * t * b for c, a, b in zip(("x", "y"), *ends, strict=True)))

        curve = F.transform(F.sequence(F.lit(1), F.lit(steps - 1)), at) if steps > 1 else F.array().cast("array<struct<x:double,y:double>>")
        # the end half way to the next point that is not on the outline is a point of its own
        end = F.when(beside[1]["on"], F.array().cast("array<struct<x:double,y:double>>")).otherwise(F.array(point(*ends[1])))
        return F.when(q["on"], F.array(point(q["x"], q["y"]))).otherwise(F.concat(curve, end))

    return F.flatten(F.transform(contour, piece))


def _of(size: int | str) -> Column:
    """A size that is the same for all pictures, or one of their keys."""
    return F.col(size) if isinstance(size, str) else F.lit(size)


def cells(edges: DataFrame, keys: list[str], width: int | str, height: int | str) -> DataFrame:
    """(keys, row, cell, cover, area) of edges (keys, x0, y0, x1, y1): sums of the pieces in each cell, in UNITs.

    cover is the signed height, positive downward; area is what the pieces cover of the cell itself, to their right.
    Cell -1 holds all that lies left of the canvas; what lies above, below or right of it covers nothing there.
    """
    c = F.col
    top, bottom = F.least("y0", "y1"), F.greatest("y0", "y1")
    e = edges.select(*keys, "x0", "y0", "x1", "y1", F.floor(F.greatest(top, F.lit(0.0))).alias("_a"), (F.ceil(F.least(bottom, _of(height).cast("double"))) - 1).alias("_b"))
    e = e.where("y0 <> y1 AND _a <= _b").withColumn("row", F.explode(F.sequence("_a", "_b")))
    e = e.withColumn("ya", F.greatest(top, c("row").cast("double"))).withColumn("yb", F.least(bottom, (c("row") + 1).cast("double")))
    slope = (c("x1") - c("x0")) / (c("y1") - c("y0"))
    e = e.withColumn("xa", c("x0") + (c("ya") - c("y0")) * slope).withColumn("xb", c("x0") + (c("yb") - c("y0")) * slope)
    e = e.select(
        *keys, "row", F.least("xa", "xb").alias("xl"), F.greatest("xa", "xb").alias("xr"),
        F.when(c("y1") > c("y0"), c("yb") - c("ya")).otherwise(c("ya") - c("yb")).alias("dy"),
    )
    first = F.greatest(F.floor("xl"), F.lit(-1))
    last = F.least(F.greatest(F.floor("xl"), F.ceil("xr") - 1, F.lit(-1)), _of(width) - 1)
    e = e.withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("cell", F.explode(F.sequence("_a", "_b")))
    lo = F.when(c("cell") < 0, c("xl")).otherwise(F.greatest(c("xl"), c("cell").cast("double")))
    hi = F.least(c("xr"), (c("cell") + 1).cast("double"))
    e = e.withColumn("lo", lo).withColumn("hi", hi)
    part = F.when(c("xr") > c("xl"), c("dy") * ((c("hi") - c("lo")) / (c("xr") - c("xl")))).otherwise(c("dy"))
    whole = lambda v: F.floor(v * float(UNIT) + 0.5)
    e = e.withColumn("part", part)
    inside = F.when(c("cell") < 0, F.lit(0.0)).otherwise(c("part") * ((c("cell") + 1).cast("double") - (c("lo") + c("hi")) / 2))
    return e.groupBy(*keys, "row", "cell").agg(F.sum(whole(c("part"))).alias("cover"), F.sum(whole(inside)).alias("area"))


def grey(coverage: Column, rule: str = "nonzero") -> Column:
    """The 8-bit value of a signed coverage in UNITs: 256 levels, the highest for full ones.

    nonzero counts overlaps in one direction once; evenodd leaves out what is covered an even number of times.
    """
    v = F.abs(coverage)
    if rule == "evenodd":
        v = v % (2 * UNIT)
        v = F.when(v > UNIT, 2 * UNIT - v).otherwise(v)
    elif rule != "nonzero":
        raise ValueError(f"unknown fill rule {rule}")
    return F.least(F.lit(255), F.shiftright(v, 16)).cast("int")


def runs(edges: DataFrame, keys: list[str], width: int | str, height: int | str, rule: str = "nonzero") -> DataFrame:
    """(keys, row, x, length, value): the pixels of outlines that are not 0, as runs of equal value along the rows.

    edges: (keys, x0, y0, x1, y1) in pixels, y downward, of closed contours in any order; those of one key make one
    picture. Horizontal edges add nothing; parts outside the canvas are cut off. A key without any pixel has no run. Sizes
    are the same for all, or the names of keys.
    """
    c = F.col
    line = W.partitionBy(*keys, "row").orderBy("cell")
    before = F.coalesce(F.sum("cover").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.coalesce(F.lead("cell").over(line), _of(width))
    r = cells(edges, keys, width, height).withColumn("before", before).withColumn("after", after)
    run = lambda x, n, v: F.struct(x.cast("int").alias("x"), n.cast("int").alias("length"), grey(v, rule).alias("value"))
    two = F.array(run(c("cell"), F.lit(1), c("before") + c("area")), run(c("cell") + 1, c("after") - c("cell") - 1, c("before") + c("cover")))
    r = r.select(*keys, c("row").cast("int").alias("row"), F.explode(F.filter(two, lambda s: (s["x"] >= 0) & (s["length"] > 0) & (s["value"] > 0))).alias("r"))
    return r.select(*keys, "row", "r.*")


def pixels(found: DataFrame) -> DataFrame:
    """Runs (..., row, x, length, value) as pixels (..., x, y, value)."""
    names = [n for n in found.columns if n not in ("row", "x", "length", "value")]
    p = found.where("length > 0").withColumn("_x", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("length") - 1)))
    return p.select(*names, F.col("_x").alias("x"), F.col("row").alias("y"), "value")


def scan_lines(found: DataFrame, keys: list[str], width: int | str, pictures: DataFrame, height: int | str) -> DataFrame:
    """(keys, row, line) for every row of every picture (keys): the grey bytes of runs that do not overlap.

    A task assembles one line at a time, never a picture. Lines are far larger than Spark takes them for, so they meet by
    a shuffle; a broadcast would hold all of them in the driver.
    """
    hexed = lambda v: F.lpad(F.hex(v), 2, "0")
    m = F.array_sort(F.collect_list(F.struct("x", "length", "value")))
    lines = found.groupBy(*keys, "row").agg(m.alias("_m"))

    def piece(r: Column, i: Column) -> Column:
        last = F.get("_m", i - 1)
        return F.concat(F.repeat(F.lit("00"), r["x"] - F.coalesce(last["x"] + last["length"], F.lit(0))), F.repeat(hexed(r["value"]), r["length"]))

    lines = lines.select(*keys, "row", F.array_join(F.transform("_m", piece), "").alias("_hex"))
    every = pictures.select(*keys).distinct().where(_of(height) > 0).withColumn("row", F.explode(F.sequence(F.lit(0), _of(height) - 1)))
    text = F.rpad(F.coalesce("_hex", F.lit("")), 2 * _of(width), F.lit("0"))
    return every.join(lines.hint("merge"), [*keys, "row"], "left").select(*keys, "row", F.unhex(text).alias("line"))


def bitmaps(found: DataFrame, keys: list[str], width: str, pictures: DataFrame, height: str) -> DataFrame:
    """(keys, bitmap) for every picture: its lines one after the other; for pictures as small as glyphs are."""
    lines = scan_lines(found, keys, width, pictures, height).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", F.hex("line").alias("h")))).alias("_l"))
    whole = lines.select(*keys, F.unhex(F.array_join(F.transform("_l", lambda l: l["h"]), "")).alias("bitmap"))
    return pictures.select(*keys).distinct().join(whole.hint("merge"), keys, "left").withColumn("bitmap", F.coalesce("bitmap", F.unhex(F.lit(""))))


def glyphs(outlines: DataFrame, sizes: list[tuple[int, int]], steps: int = 8) -> DataFrame:
    """Outlines (see sources.outlines) at each size (point, dpi) as the rows of bitmaps that raster.rendered_sizes() gives.

    Points lie on a grid of 1/64 pixel. A bitmap is as large as the box of the points, in whole pixels; a glyph without
    contours has none. Advances are rounded to whole pixels; glyphs are not fitted to the grid in any other way. A symbol
    that occurs more often in the lines is rasterised once. Fonts and symbols that failed stay as rows that say so.
    """
    c = F.col
    size = F.explode(F.array(*(F.struct(F.lit(p).alias("point"), F.lit(d).alias("dpi")) for p, d in sizes)))
    o = outlines.withColumn("_s", size).select(*outlines.columns, "_s.point", "_s.dpi").withColumn("_scale", c("point") * c("dpi") / (72.0 * c("units")))
    grid = lambda v: F.floor(v * 64 + 0.5) / 64.0
    place = lambda p: F.struct(grid(p["x"] * c("_scale")).alias("x"), grid(-p["y"] * c("_scale")).alias("y"), p["on"].alias("on"))
    which = ["font_id", "face", "ch", "point", "dpi"]
    shapes = o.where("NOT load_failed AND NOT font_not_loaded").dropDuplicates(which)
    shapes = shapes.select(*which, F.transform("contours", lambda line: F.transform(line, place)).alias("_c")).withColumn("_p", F.flatten("_c"))
    end = lambda of, axis: of(F.transform("_p", lambda p: p[axis]))
    shapes = shapes.withColumn("_left", F.coalesce(F.floor(end(F.array_min, "x")), F.lit(0))).withColumn("_top", F.coalesce(F.floor(end(F.array_min, "y")), F.lit(0)))
    shapes = shapes.withColumn("width", F.coalesce(F.ceil(end(F.array_max, "x")) - c("_left"), F.lit(0)).cast("int"))
    shapes = shapes.withColumn("rows", F.coalesce(F.ceil(end(F.array_max, "y")) - c("_top"), F.lit(0)).cast("int"))
    shapes = checkpointed(shapes.drop("_p"))  # read for the edges, the sizes and the places
    keys = [*which, "width", "rows"]
    flat = shapes.select(*keys, "_left", "_top", F.transform("_c", lambda line: flattened(line, steps)).alias("_f"))
    edges = flat.select(*keys, "_left", "_top", F.explode(F.flatten(F.transform("_f", closed_edges))).alias("e"))
    edges = edges.select(*keys, *((c(f"e.{n}") - c("_left" if n[0] == "x" else "_top")).alias(n) for n in ("x0", "y0", "x1", "y1")))
    drawn = bitmaps(runs(edges, keys, "width", "rows"), keys, "width", shapes, "rows")
    places = shapes.select(*which, c("_left").cast("int").alias("bitmap_left"), (-c("_top")).cast("int").alias("bitmap_top"))
    drawn = drawn.join(places.hint("merge"), which)
    advance = (F.floor(c("advance") * c("_scale") + 0.5) * 64).cast("int")
    rows = o.select("font_id", "face", "row", "idx", "ch", advance.alias("adv_x"), F.when(c("advance").isNotNull(), 0).alias("adv_y"), "load_failed", "font_not_loaded", "point", "dpi")
    return rows.join(drawn.hint("merge"), which, "left").select(
        "font_id", "face", "row", "idx", "ch", "rows", "width", "bitmap_left", "bitmap_top", "adv_x", "adv_y", "bitmap", "load_failed", "font_not_loaded", "point", "dpi",
    )
