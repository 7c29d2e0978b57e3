"""Whole curation runs over a folder of fonts: what the operators do together.

Each takes a folder and settings and returns a DataFrame; nothing is moved. verdicts.route() writes what comes out.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.functions import text
from glyphlake.operators import geometry, glyphs, raster, reports, verdicts
from glyphlake.sources import files

PRINTABLE = "".join(map(chr, range(text.FIRST_PRINTABLE, text.LAST_PRINTABLE + 1)))


def fonts(spark: SparkSession, font_dir: str, count: int = 0) -> DataFrame:
    """The files below a folder but rename manifests, in tasks that hold few fonts each."""
    found = files.scan(spark, font_dir, count=count)
    return found.where(~text.base_name(F.col("path")).isin("filenames.json"))


#: Draws fonts (path, content) at sizes (point, dpi): raster.rendered_sizes by the system's library, which fits glyphs to the
#: grid and knows all kinds of fonts, or outlines.rendered_sizes without any library, for TrueType outlines.
Renderer = Callable[[DataFrame, list[str], list[tuple[int, int]]], DataFrame]


def drawn(spark: SparkSession, font_dir: str, lines: list[str], point: int = 72, dpi: int = 110, count: int = 0, renderer: Renderer = raster.rendered_sizes) -> DataFrame:
    """Glyph rows of every font."""
    return renderer(fonts(spark, font_dir, count), lines, [(point, dpi)])


def font_stats(g: DataFrame) -> DataFrame:
    """(font_id, font_not_loaded, char_loads_failed, empty): symbols that failed, and those but spaces that draw nothing."""
    blank = ~F.coalesce(F.hex("bitmap").rlike("[1-9A-F]"), F.lit(False))
    failed = F.col("load_failed") & ~F.col("font_not_loaded")
    return g.groupBy("font_id").agg(
        F.bool_or("font_not_loaded").alias("font_not_loaded"),
        F.sort_array(F.collect_list(F.when(failed, F.col("ch")))).alias("char_loads_failed"),
        F.sort_array(F.collect_list(F.when(~F.col("load_failed") & (F.col("ch") != " ") & blank, F.col("ch")))).alias("empty"),
    )


def bad_fonts(spark: SparkSession, font_dir: str, count: int = 0, symbols: str = PRINTABLE, renderer: Renderer = raster.rendered_sizes) -> DataFrame:
    """Statistics and verdict of every font: failed_font_loads, failed_char_loads, empty_chars or keep."""
    return verdicts.bad_font_verdict(font_stats(drawn(spark, font_dir, list(symbols), count=count, renderer=renderer)))


def placed(g: DataFrame) -> DataFrame:
    """Loaded glyphs of each font and size with their column and their offsets in the cell."""
    g = geometry.successful_columns(g.where(~F.col("font_not_loaded")), ["font_id", "point", "dpi", "row"], "idx")
    half = F.expr("point * dpi DIV 72 DIV 2").cast("int")
    g = g.withColumn("p", geometry.placement(F.col("adv_x"), F.col("bitmap_left"), F.col("bitmap_top"), half))
    return g.select("*", "p.off_x", "p.off_y").drop("p")


def font_match_sets(spark: SparkSession, font_dir: str, count: int = 0, symbols: str = PRINTABLE, point: int = 72, dpi: int = 110, renderer: Renderer = raster.rendered_sizes) -> DataFrame:
    """(font_id, match_set): symbols of a font that are drawn alike."""
    p = placed(drawn(spark, font_dir, [symbols], point, dpi, count, renderer))
    names = ["area", "off_x", "off_y", "pixels"]
    keys = [k.alias(n) for k, n in zip(raster.identity_key(), names, strict=True)]
    return glyphs.match_sets(p.select("font_id", "ch", *keys), ["font_id"], names)


def identify_duplicates(spark: SparkSession, font_dir: str, count: int = 0, show_for: str | None = None) -> DataFrame:
    """How many fonts have each match set, most first, with a cell for spreadsheets; or the fonts of one set."""
    sets = font_match_sets(spark, font_dir, count)
    if show_for is not None:
        return sets.where(F.col("match_set") == show_for)
    return glyphs.count_match_sets(sets).withColumn("cell", glyphs.spreadsheet_escape(F.col("match_set"))).orderBy(F.col("occurrences").desc(), "match_set")


def duplicate_fonts(spark: SparkSession, font_dir: str, whitelist: str | None = None, count: int = 0) -> DataFrame:
    """Verdict of every font by its match sets and the whitelist file: keep, allowed_duplicates or failed_duplicates."""
    owners = fonts(spark, font_dir, count).select(F.col("path").alias("font_id"))
    return glyphs.duplicate_verdict(owners, font_match_sets(spark, font_dir, count), files.line_set(spark, whitelist), "font_id")


IMAGE = "image_id string, height int, width int, data binary, overwrites long, out_of_cell long, out_of_image long, empty array<string>"


def atlas_images(spark: SparkSession, font_dir: str, lines: list[str], dpi: int = 300, point: int = 12, border: int = -1, padding: int = -1, offset: int = -1, cells: bool = True, count: int = 0, highlight: str = "", blend: bool = True) -> DataFrame:
    """One image for each font that loads, with its counters: glyphs in cells, or along a continuous pen.

    Cells of the symbols in `highlight` get a grey rectangle, which counts as drawn where the glyph meets it. Glyphs that
    overlap are blended, or the later one overwrites, as in plain sentences.
    """
    one = {"dpi": dpi, "point": point, "border": border, "padding": padding, "offset": offset}
    return atlases(spark, font_dir, lines, [one], cells, count, highlight, blend).drop("setting")


def spacings(spark: SparkSession, settings: list[dict], lines: list[str]) -> DataFrame:
    """A row for each setting (dpi, point, border, padding, offset): its place in the list, spacing and size of image."""
    names = ["dpi", "point", "border", "padding", "offset"]
    given = spark.createDataFrame([(i, *(s.get(n, -1) for n in names)) for i, s in enumerate(settings)], "setting int, " + ", ".join(f"{n} int" for n in names))
    s = given.select("setting", geometry.spacing(*map(F.col, names)).alias("s")).select("setting", "s.*")
    extent = [geometry.atlas_extent(F.lit(n), F.col("em"), F.col("atlas_border"), F.col("atlas_padding")).cast("int") for n in (max(map(len, lines)), len(lines))]
    return s.withColumn("image_width", extent[0]).withColumn("image_height", extent[1])


def atlases(spark: SparkSession, font_dir: str, lines: list[str], settings: list[dict], cells: bool = True, count: int = 0, highlight: str = "", blend: bool = True, renderer: Renderer = raster.rendered_sizes) -> DataFrame:
    """The images of every font at every setting, with `setting`, its place in the list.

    A font is read once and rasterised once for each size; its glyphs go to one task, once, and meet the settings there.
    The settings are the caller's list, and so few that they are broadcast.
    """
    s = spacings(spark, settings, lines)
    sizes = sorted((r.point, r.dpi) for r in s.select("point", "dpi").distinct().collect())
    g = renderer(fonts(spark, font_dir, count), lines, sizes).repartition("font_id")
    g = placed(g)
    pen = W.partitionBy("font_id", "point", "dpi", "row").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    for axis in ("x", "y"):
        g = g.withColumn(f"pen_{axis}", F.coalesce(F.sum(F.shiftright(F.col(f"adv_{axis}"), 6)).over(pen), F.lit(0)))
    g = g.join(F.broadcast(s), ["point", "dpi"])
    half, gap, pad, low = map(F.col, ("half_em", "atlas_border", "atlas_padding", "bottom_offset"))
    pitch = F.col("em") + gap
    left, top = pad + F.col("col") * pitch, pad + F.col("row") * pitch
    if cells:
        # offsets are from the middle of the cell across and from half an em down
        x, y = left + half + F.col("off_x"), top + half + F.col("off_y") - low
    else:
        at = geometry.pen_placement(geometry.pen_start(F.col("row"), F.col("em"), gap, pad, low), *map(F.col, ("pen_x", "pen_y", "bitmap_left", "bitmap_top")))
        x, y = at["x"], at["y"]
    g = g.withColumn("x", x.cast("int")).withColumn("y", y.cast("int"))
    marked = F.lit(cells) & (F.position("ch", F.lit(highlight)) > 0) if highlight else F.lit(False)
    corners = (left, top, left + 2 * half + 1, top + 2 * half)
    g = g.withColumn("box", F.when(marked, F.array(*(c.cast("int") for c in corners))))
    cell = geometry.cell_bounds(F.col("row"), F.col("col"), F.col("em"), gap, pad)
    bounds = tuple(cell[side] for side in ("left", "top", "right", "bottom"))
    g = g.withColumn("o", geometry.overflow(F.col("x"), F.col("y"), F.col("width"), F.col("rows"), bounds, (F.col("image_width"), F.col("image_height"))))

    def paint(t: pa.Table) -> pa.Table:
        t = t.sort_by([("row", "ascending"), ("idx", "ascending")])
        height, width = t["image_height"][0].as_py(), t["image_width"][0].as_py()
        rows = t.select(["x", "y", "rows", "width", "bitmap", "ch", "box"]).to_pylist()
        parts = [(r["x"], r["y"], np.frombuffer(r["bitmap"], np.uint8).reshape(r["rows"], r["width"])) for r in rows]
        canvas, over, _, empty = raster.paint(parts, height, width, blend, [r["box"] for r in rows])
        out_cell = sum(t["out_of_cell"].to_pylist()) if cells else 0
        none = [r["ch"] for r, e in zip(rows, empty, strict=True) if e and r["ch"] != " "]
        return pa.table({
            "image_id": [t["font_id"][0].as_py()], "height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32()), "data": pa.array([canvas.tobytes()], pa.binary()),
            "overwrites": [over], "out_of_cell": [out_cell], "out_of_image": [sum(t["out_of_image"].to_pylist())], "empty": pa.array([none], pa.list_(pa.string())),
            "setting": t["setting"][:1],
        })

    needed = ["font_id", "setting", "row", "idx", "ch", "x", "y", "rows", "width", "bitmap", "box", "o.*", "image_height", "image_width"]
    return g.select(*needed).groupBy("font_id", "setting").applyInArrow(paint, f"{IMAGE}, setting int")


def render_atlas(spark: SparkSession, font_dir: str, lines: list[str], skip_cell_out: bool = True, **settings) -> tuple[DataFrame, DataFrame]:
    """The images to keep, and the counts of images with pixels out of the image, out of their cell or empty cells."""
    images = atlas_images(spark, font_dir, lines, **settings)
    return (images.where("out_of_cell = 0") if skip_cell_out else images), verdicts.flag_sums(images)


def ocr_distances(spark: SparkSession, font_dir: str, lines: list[str], ocr: Callable[[np.ndarray], str], dpi: int = 300, point: int = 12, padding: int = 0, count: int = 0) -> DataFrame:
    """(font_id, ocr_text, distance, lower_distance) of what a recogniser reads in each font's line; null if nothing is drawn."""
    images = atlas_images(spark, font_dir, lines, dpi, point, -1, -1, -1, False, count)
    return _distances(images, lines, ocr, padding, "image_id").withColumnRenamed("image_id", "font_id")


def _distances(images: DataFrame, lines: list[str], ocr: Callable[[np.ndarray], str], padding: int, *keys: str) -> DataFrame:
    """The keys of images with what a recogniser reads and its distance from the lines, with and without regard to case."""

    def read(canvas: np.ndarray) -> str | None:
        ys, xs = np.nonzero(canvas)
        box = (int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max())) if len(xs) else None
        crop = raster.recognition_crop(canvas, box, padding)
        return None if crop is None else ocr(crop)

    atlas = F.lit("".join(x + "\n" for x in lines))
    return raster.recognised(images, read, keys).select(
        *keys, "ocr_text", text.edit_distance(F.col("ocr_text"), atlas).alias("distance"),
        text.edit_distance(text.ascii_lower(F.col("ocr_text")), text.ascii_lower(atlas)).alias("lower_distance"),
    )


def ocr_fonts(spark: SparkSession, font_dir: str, lines: list[str], ocr: Callable[[np.ndarray], str], lowercase: bool = True, **settings) -> DataFrame:
    """ocr_distances with the verdict: keep, or the distance with three digits."""
    d = ocr_distances(spark, font_dir, lines, ocr, **settings)
    return d.withColumn("verdict", verdicts.distance_verdict(F.col("lower_distance" if lowercase else "distance")))


def ocr_stats(distances: DataFrame, lowercase: bool = True) -> DataFrame:
    return reports.histogram(distances, F.col("lower_distance" if lowercase else "distance"))


def sweep(spark: SparkSession, font_dir: str, lines: list[str], settings: list[dict], count: int = 0) -> DataFrame:
    """Counters for each setting (padding, point, dpi, offset): what a search for the best sizes reads.

    One run over the fonts for all settings; one of which no image comes has counts of 0.
    """
    names = ["padding", "point", "dpi", "offset"]
    given = [{**s, "border": s.get("border", 2 * s["padding"])} for s in settings]
    sums = verdicts.flag_sums(atlases(spark, font_dir, lines, given, count=count), "setting").withColumnRenamed("total", "image_count")
    rows = spark.createDataFrame([(i, *(s[n] for n in names)) for i, s in enumerate(settings)], "setting int, " + ", ".join(f"{n} int" for n in names))
    counters = [F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in ("image_count", "out_of_image", "out_of_cell", "empty_cell")]
    return rows.join(sums, "setting", "left").select(*names, *counters)


def size_settings(n: int = 110, seed: int = 1, dpi: tuple[int, int] = (100, 1000), point: tuple[int, int] = (10, 100)) -> list[dict]:
    """Settings with sizes drawn evenly between bounds, for search_sizes; the same for the same seed."""
    draw = random.Random(seed)
    return [{"dpi": draw.randint(*dpi), "point": draw.randint(*point)} for _ in range(n)]


def search_sizes(spark: SparkSession, font_dir: str, lines: list[str], ocr: Callable[[np.ndarray], str], settings: list[dict], lowercase: bool = True, padding: int = 0, count: int = 0) -> DataFrame:
    """(point, dpi, n) of each setting: how many fonts a recogniser reads without a fault; the most first, then the smallest.

    All settings are tried in one run over the fonts. One of which no image comes, or that is never read rightly, has 0.
    """
    d = _distances(atlases(spark, font_dir, lines, settings, False, count), lines, ocr, padding, "image_id", "setting")
    right = d.where(F.col("lower_distance" if lowercase else "distance") == 0).groupBy("setting").agg(F.count(F.lit(1)).alias("n"))
    tried = spacings(spark, settings, lines).select("setting", "point", "dpi").join(right, "setting", "left")
    return tried.select("point", "dpi", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.col("n").desc(), F.col("point") * F.col("dpi"), "point")
