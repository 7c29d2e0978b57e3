"""Layout of atlases and placement of glyphs, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _div(a: Column, b: int | Column) -> Column:
    """Integer division that truncates toward zero."""
    q = a / b
    return F.when(q >= 0, F.floor(q)).otherwise(F.ceil(q)).cast("int")


def spacing(dpi: Column, point: Column, border: Column, padding: Column, offset: Column) -> Column:
    """The seven spacing numbers of a renderer as a struct; defaults stand in for what is not positive or negative.

    Fixed values: 110 dots an inch and 72 points where they are not positive; a point is 1/72 inch; a negative border is
    an eighth of the em, a negative padding half an em or the border if larger, a negative offset a fifth.
    """
    d = F.when(dpi > 0, dpi).otherwise(110)
    p = F.when(point > 0, point).otherwise(72)
    em = _div(p * d, 72)
    half = _div(em, 2)
    b = F.when(border < 0, _div(em, 8)).otherwise(border)
    pad = F.when(padding < 0, F.greatest(half, b)).otherwise(padding)
    off = F.when(offset < 0, _div(em, 5)).otherwise(offset)
    return F.struct(d.alias("dpi"), p.alias("point"), em.alias("em"), half.alias("half_em"), b.alias("atlas_border"), pad.alias("atlas_padding"), off.alias("bottom_offset"))


def atlas_extent(n: Column, em: Column, border: Column, padding: Column) -> Column:
    """Pixels of n cells in a row with borders between and padding around them."""
    return 2 * padding + F.greatest(n - 1, F.lit(0)) * border + n * em


def cell_origin(index: Column, em: Column, border: Column, padding: Column) -> Column:
    return padding + index * (em + border)


def placement(adv_x: Column, left: Column, top: Column, half_em: Column) -> Column:
    """Offsets of a glyph in its cell: centred by its advance in 26.6 fixed point, its top hung from the middle."""
    return F.struct((-_div(F.shiftright(adv_x, 6) - left, 2)).alias("off_x"), (half_em - top).alias("off_y"))


def pen_positions(glyphs: DataFrame, line: list[str], order: str | list[str], advance: str = "adv_x", name: str = "pen_x") -> DataFrame:
    """glyphs with the pen's position before each: the advances so far on the line, in whole pixels."""
    w = W.partitionBy(*line).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(W.unboundedPreceding, -1)
    return glyphs.withColumn(name, F.coalesce(F.sum(F.shiftright(F.col(advance), 6)).over(w), F.lit(0)).cast("bigint"))


def pen_start(row: Column, em: Column, border: Column, padding: Column, bottom: Column) -> Column:
    """Where the pen of a row starts: at the padding across, and down a border above the lower bound of the row's cells, less the offset."""
    bounds = cell_bounds(row, F.lit(0), em, border, padding)
    return F.struct(padding.cast("int").alias("x"), (bounds["bottom"] - border - bottom).cast("int").alias("y"))


def pen_placement(start: Column, pen_x: Column, pen_y: Column, left: Column, top: Column) -> Column:
    """Where a glyph is drawn that follows the pen: by what it is to the right of it and above it."""
    return F.struct((start["x"] + pen_x + left).cast("int").alias("x"), (start["y"] + pen_y - top).cast("int").alias("y"))


def cell_bounds(row: Column, col: Column, em: Column, border: Column, padding: Column) -> Column:
    """The bounds (left, top, right, bottom) of a cell with half a border around it; right and bottom lie outside."""
    margin, wide = _div(border, 2), 2 * _div(em, 2)
    left, top = cell_origin(col, em, border, padding), cell_origin(row, em, border, padding)
    return F.struct((left - margin).cast("int").alias("left"), (top - margin).cast("int").alias("top"), (left + wide + margin).cast("int").alias("right"), (top + wide + margin).cast("int").alias("bottom"))


def successful_columns(glyphs: DataFrame, line: list[str], order: str) -> DataFrame:
    """Glyphs that loaded, with the column that they get: a failed one leaves no gap."""
    w = W.partitionBy(*line).orderBy(order)
    return glyphs.where(~F.col("load_failed")).withColumn("col", (F.row_number().over(w) - 1).cast("bigint"))


def _outside(start: Column, n: Column, low: Column, high: Column) -> Column:
    """How many of the n whole numbers from start on are not in [low, high)."""
    return n - F.greatest(F.lit(0), F.least(start + n, high) - F.greatest(start, low))


def overflow(x: Column, y: Column, width: Column, rows: Column, cell: tuple[Column, Column, Column, Column], image: tuple[Column, Column]) -> Column:
    """Counters of pixels out of the cell (left, top, right, bottom) and out of the image (width, height).

    Each row that lies outside counts once; each row in the image counts its pixels outside. A closed form: no pixel is
    visited.
    """
    left, top, right, bottom = cell
    rows_in = rows - _outside(y, rows, F.lit(0), image[1])
    out_cell = _outside(y, rows, top, bottom) + rows_in * _outside(x, width, left, right)
    out_image = _outside(y, rows, F.lit(0), image[1]) + rows_in * _outside(x, width, F.lit(0), image[0])
    return F.struct(out_cell.cast("bigint").alias("out_of_cell"), out_image.cast("bigint").alias("out_of_image"))


def blend(source: Column, dest: Column) -> Column:
    """Alpha blend of two 8-bit values in single precision, truncated; a zero source leaves the destination."""
    a, d = (c.cast("float") / F.lit(255.0).cast("float") for c in (source, dest))
    one, top = F.lit(1.0).cast("float"), F.lit(255.0).cast("float")
    mixed = (top * (a.cast("float") + (d.cast("float") * (one - a.cast("float"))).cast("float")).cast("float")).cast("float")
    return F.when(source == 0, dest.cast("int")).otherwise(F.floor(mixed).cast("int"))


def bounding_box(pixels: DataFrame, *keys: str) -> DataFrame:
    """The tight box of drawn pixels (value > 0) as (l, t, r, b), null where nothing is drawn."""
    drawn = lambda c: F.when(F.col("value") > 0, F.col(c))
    return pixels.groupBy(*keys).agg(F.min(drawn("x")).alias("l"), F.min(drawn("y")).alias("t"), F.max(drawn("x")).alias("r"), F.max(drawn("y")).alias("b"))


def best_point_dpi(shapes: DataFrame, target: int = 300) -> DataFrame:
    """shapes (dim, padding) with the whole point and dpi whose em fills the cell and whose dpi is nearest to target.

    Point and dpi are the pairs of whole numbers whose product is the em's 72nd parts, so the divisors up to its root
    give all of them; the smallest point wins ties. A cell without room has no row.
    """
    inside = shapes.withColumn("inside", (72 * (F.col("dim") - 2 * F.col("padding"))).cast("bigint")).where("inside > 0")
    tried = inside.withColumn("d", F.explode(F.sequence(F.lit(1).cast("bigint"), F.floor(F.sqrt("inside"))))).where("inside % d = 0")
    pair = lambda p, q: F.struct(p.cast("int").alias("point"), q.cast("int").alias("dpi"))
    other = F.expr("inside div d")
    tried = tried.withColumn("p", F.explode(F.array(pair(F.col("d"), other), pair(other, F.col("d")))))
    best = F.min_by("p", F.struct(F.abs(F.col("p.dpi") - target), F.col("p.point")))
    return tried.groupBy("dim", "padding").agg(best.alias("b")).select("dim", "padding", "b.point", "b.dpi")


def best_offset(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group the row with the fewest images out of their cell, the smallest offset on ties, with the usable share."""
    best = F.min_by(F.struct("offset", "image_count", "out_of_cell"), F.struct("out_of_cell", "offset"))
    out = sweep.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
    return out.withColumn("usable", 1 - F.col("out_of_cell") / F.col("image_count"))


def sweep_until(sweep: DataFrame, keys: list[str], order: str = "offset") -> DataFrame:
    """Rows of a parameter sweep up to where it may stop: the counter has changed and is full, or all cells are empty.

    sweep: (keys, order, image_count, out_of_cell, empty_cell), without the runs that failed. The stopping row is kept.
    """
    w = W.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((F.col("out_of_cell") != F.lag("out_of_cell").over(w)).cast("int"), F.lit(0))
    s = sweep.withColumn("_changed", changed)
    s = s.withColumn("_ever", F.max("_changed").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    stop = ((F.col("_ever") == 1) & (F.col("out_of_cell") == F.col("image_count"))) | (F.col("empty_cell") == F.col("image_count"))
    s = s.withColumn("_stop", F.min(F.when(stop, F.col(order))).over(W.partitionBy(*keys)))
    return s.where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_changed", "_ever", "_stop")
