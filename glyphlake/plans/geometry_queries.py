"""Layout and placement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.operators import geometry as g
from glyphlake.plans.registry import query
from glyphlake.session import table

# spacing of a grid of settings: p_size stands for the point size
GRID = "p_partkey, p_size AS point, CASE p_partkey % 3 WHEN 0 THEN 300 WHEN 1 THEN 110 ELSE -1 END AS dpi, CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE 3 END AS border, CASE WHEN p_partkey % 5 = 0 THEN 7 ELSE -1 END AS padding, -1 AS bottom"
SPACING_SQL = f"""
SELECT p_partkey, d AS dpi, p AS point, em, em // 2 AS half_em, b AS atlas_border, CASE WHEN padding < 0 THEN greatest(em // 2, b) ELSE padding END AS atlas_padding, em // 5 AS bottom_offset
FROM (SELECT *, CASE WHEN border < 0 THEN em // 8 ELSE border END AS b FROM (SELECT *, p * d // 72 AS em FROM (SELECT *, CASE WHEN dpi > 0 THEN dpi ELSE 110 END AS d, CASE WHEN point > 0 THEN point ELSE 72 END AS p
FROM (SELECT {GRID} FROM part) q)))"""


def _spacing(spark, sf_dir):
    s = table(spark, sf_dir, "part").selectExpr(*_exprs(GRID))
    c = F.col
    return s.select("p_partkey", g.spacing(c("dpi"), c("point"), c("border"), c("padding"), c("bottom")).alias("s")).select("p_partkey", "s.*")


def _exprs(s: str) -> list[str]:
    return [x.strip() for x in s.split(", ")]


@query("spacing_grid", f"""
SELECT p_partkey, dpi::INT AS dpi, point::INT AS point, em::INT AS em, half_em::INT AS half_em, atlas_border::INT AS atlas_border, atlas_padding::INT AS atlas_padding, bottom_offset::INT AS bottom_offset,
       (2 * atlas_padding + 11 * atlas_border + 12 * em)::INT AS width, (2 * atlas_padding + 7 * atlas_border + 8 * em)::INT AS height FROM ({SPACING_SQL})""")
def spacing_grid(spark, sf_dir):
    s = _spacing(spark, sf_dir)
    extent = lambda n: g.atlas_extent(F.lit(n), F.col("em"), F.col("atlas_border"), F.col("atlas_padding")).cast("int")
    return s.withColumn("width", extent(12)).withColumn("height", extent(8))


@query("cell_origins", f"""
SELECT p_partkey, c::INT AS col, (atlas_padding + c * (em + atlas_border))::INT AS x FROM ({SPACING_SQL}), (SELECT unnest(range(0, 12)) AS c)""")
def cell_origins(spark, sf_dir):
    s = _spacing(spark, sf_dir).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return s.select("p_partkey", "col", g.cell_origin(F.col("col"), F.col("em"), F.col("atlas_border"), F.col("atlas_padding")).cast("int").alias("x"))


SHAPES = "p_size * 40 AS dim, CAST(p_partkey % 9 AS INT) AS padding"


@query("best_point_dpi", f"""
WITH s AS (SELECT DISTINCT {SHAPES} FROM part),
t AS (SELECT dim, padding, p AS point, 72 * (dim - 2 * padding) // p AS dpi FROM (SELECT *, unnest(range(1, 72 * (dim - 2 * padding) + 1)) AS p FROM s) WHERE 72 * (dim - 2 * padding) % p = 0)
SELECT dim, padding, arg_min(point, (abs(dpi - 300), point))::INT AS point, arg_min(dpi, (abs(dpi - 300), point))::INT AS dpi FROM t GROUP BY dim, padding""")
def best_point_dpi(spark, sf_dir):
    """The best point and dpi for cells of 40 to 2,000 pixels."""
    return g.best_point_dpi(table(spark, sf_dir, "part").selectExpr(*_exprs(SHAPES)).distinct())


# each order is a sweep over line numbers: 50 images, those out of their cell, and empty ones
SWEEP_SQL = """SELECT l_orderkey AS font, l_linenumber AS "offset", 50::BIGINT AS image_count, (CASE WHEN l_quantity >= 30 THEN 50 ELSE l_quantity END)::BIGINT AS out_of_cell, (CASE WHEN l_quantity <= 2 THEN 50 ELSE 0 END)::BIGINT AS empty_cell
FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)"""


def _sweep(spark, sf_dir):
    q = F.col("l_quantity")
    runs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return runs.select(
        F.col("l_orderkey").alias("font"), F.col("l_linenumber").alias("offset"), F.lit(50).cast("bigint").alias("image_count"),
        F.when(q >= 30, 50).otherwise(q).cast("bigint").alias("out_of_cell"), F.when(q <= 2, 50).otherwise(0).cast("bigint").alias("empty_cell"),
    )


@query("best_offset", f"""
SELECT font, arg_min("offset", (out_of_cell, "offset")) AS "offset", 50::BIGINT AS image_count, min(out_of_cell) AS out_of_cell, round(1 - min(out_of_cell) / 50, 6) AS usable FROM ({SWEEP_SQL}) GROUP BY font""")
def best_offset(spark, sf_dir):
    return g.best_offset(_sweep(spark, sf_dir), ["font"]).withColumn("usable", F.round("usable", 6))


@query("sweep_stop", f"""
WITH s AS (SELECT *, coalesce(out_of_cell <> lag(out_of_cell) OVER w, false) AS changed FROM ({SWEEP_SQL}) WINDOW w AS (PARTITION BY font ORDER BY "offset")),
e AS (SELECT *, bool_or(changed) OVER (PARTITION BY font ORDER BY "offset" ROWS UNBOUNDED PRECEDING) AS ever FROM s),
t AS (SELECT *, min("offset") FILTER ((ever AND out_of_cell = image_count) OR empty_cell = image_count) OVER (PARTITION BY font) AS stop FROM e)
SELECT font, "offset", image_count, out_of_cell, empty_cell FROM t WHERE stop IS NULL OR "offset" <= stop""")
def sweep_stop(spark, sf_dir):
    return g.sweep_until(_sweep(spark, sf_dir), ["font"])


@query("pen_advance", """
SELECT l_orderkey, l_linenumber, coalesce(sum((l_quantity * 64 + l_linenumber)::BIGINT >> 6) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pen_x FROM lineitem""")
def pen_advance(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 64 + F.col("l_linenumber")).cast("bigint").alias("adv_x"))
    return g.pen_positions(l, ["l_orderkey"], ["l_linenumber", "adv_x"]).drop("adv_x")


@query("column_shift", """
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS col FROM lineitem WHERE l_returnflag <> 'R'""")
def column_shift(spark, sf_dir):
    """Glyphs that fail to load leave no gap in their line."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("load_failed"))
    return g.successful_columns(l, ["l_orderkey"], "l_linenumber").drop("load_failed")


# boxes of x, y, width, rows, from numbers of a line
BOX = "l_orderkey, l_linenumber, CAST(l_quantity AS INT) - 10 AS x, CAST(l_linenumber AS INT) * 9 - 12 AS y, CAST(l_partkey % 23 AS INT) AS w, CAST(l_suppkey % 19 AS INT) AS h"


def _box(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*_exprs(BOX))


@query("glyph_placement", f"""
SELECT l_orderkey, l_linenumber, (-(((x * 64 + 13) >> 6) - w) // 2)::INT AS naive_off_x, (CASE WHEN ((x * 64 + 13) >> 6) - w >= 0 THEN -((((x * 64 + 13) >> 6) - w) // 2) ELSE (w - ((x * 64 + 13) >> 6)) // 2 END)::INT AS off_x, (12 - h)::INT AS off_y
FROM (SELECT {BOX} FROM lineitem)""")
def glyph_placement(spark, sf_dir):
    b = _box(spark, sf_dir)
    adv = (F.col("x") * 64 + 13).cast("int")
    p = g.placement(adv, F.col("w"), F.col("h"), F.lit(12))
    naive = F.expr("CAST((-(shiftright(x * 64 + 13, 6) - w)) DIV 2 AS INT)")
    return b.select("l_orderkey", "l_linenumber", naive.alias("naive_off_x"), p["off_x"].cast("int").alias("off_x"), p["off_y"].cast("int").alias("off_y"))


@query("cell_overflow", f"""
WITH b AS (SELECT {BOX} FROM lineitem),
r AS (SELECT *, h - greatest(0, least(y + h, 20) - greatest(y, 2)) AS rows_out_cell, h - greatest(0, least(y + h, 40) - greatest(y, 0)) AS rows_out, w - greatest(0, least(x + w, 24) - greatest(x, 4)) AS cols_out_cell,
        w - greatest(0, least(x + w, 32) - greatest(x, 0)) AS cols_out FROM b)
SELECT l_orderkey, l_linenumber, (rows_out_cell + (h - rows_out) * cols_out_cell)::BIGINT AS out_of_cell, (rows_out + (h - rows_out) * cols_out)::BIGINT AS out_of_image FROM r""")
def cell_overflow(spark, sf_dir):
    c = F.col
    o = g.overflow(c("x"), c("y"), c("w"), c("h"), (F.lit(4), F.lit(2), F.lit(24), F.lit(20)), (F.lit(32), F.lit(40)))
    return _box(spark, sf_dir).select("l_orderkey", "l_linenumber", o.alias("o")).select("l_orderkey", "l_linenumber", "o.*")


@query("bbox", """
SELECT l_orderkey, min(l_linenumber) FILTER (l_quantity > 10) AS l, min(l_suppkey) FILTER (l_quantity > 10) AS t, max(l_linenumber) FILTER (l_quantity > 10) AS r, max(l_suppkey) FILTER (l_quantity > 10) AS b FROM lineitem GROUP BY l_orderkey""")
def bbox(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("x"), F.col("l_suppkey").alias("y"), (F.col("l_quantity") - 10).alias("value"))
    return g.bounding_box(p, "l_orderkey")


BLENDED = "p_partkey, CAST(p_partkey * 7 % 256 AS INT) AS source, CAST(p_size * 37 % 256 AS INT) AS dest"


@query("alpha_blend", f"""
SELECT p_partkey, s AS source, d AS dest, (CASE WHEN s = 0 THEN d ELSE floor((255::FLOAT * ((s::FLOAT / 255::FLOAT)::FLOAT + ((d::FLOAT / 255::FLOAT)::FLOAT * (1::FLOAT - (s::FLOAT / 255::FLOAT)::FLOAT)::FLOAT)::FLOAT)::FLOAT)::FLOAT) END)::INT AS blended
FROM (SELECT p_partkey, source AS s, dest AS d FROM (SELECT {BLENDED} FROM part))""")
def alpha_blend(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(*_exprs(BLENDED)).withColumn("blended", g.blend(F.col("source"), F.col("dest")))


PEN = "l_orderkey, l_linenumber, l_quantity, CAST(l_quantity * 64 + l_linenumber AS INT) AS adv_x, CAST((l_suppkey % 5) * 64 - 96 AS INT) AS adv_y, CAST(l_linenumber AS INT) - 3 AS bitmap_left, CAST(l_partkey % 19 AS INT) AS bitmap_top, CAST(l_orderkey % 8 AS INT) AS row"


@query("pen_placement", f"""
SELECT l_orderkey, l_linenumber, (7 + coalesce(sum(adv_x >> 6) OVER w, 0) + bitmap_left)::INT AS x, (7 + row * 26 + 2 * 10 + 2 - 5 - 3 + coalesce(sum(adv_y >> 6) OVER w, 0) - bitmap_top)::INT AS y
FROM (SELECT {PEN} FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, adv_x, adv_y, bitmap_top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def pen_placement(spark, sf_dir):
    """Glyphs of a line behind each other: em 21, border 5, padding 7, offset 3."""
    l = table(spark, sf_dir, "lineitem").selectExpr(*_exprs(PEN))
    for axis in "xy":
        l = g.pen_positions(l, ["l_orderkey"], ["l_linenumber", "l_quantity", "adv_x", "adv_y", "bitmap_top"], f"adv_{axis}", f"pen_{axis}")
    start = g.pen_start(F.col("row"), F.lit(21), F.lit(5), F.lit(7), F.lit(3))
    return l.select("l_orderkey", "l_linenumber", g.pen_placement(start, *map(F.col, ("pen_x", "pen_y", "bitmap_left", "bitmap_top"))).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query("cell_bounds", """
SELECT l_orderkey, l_linenumber, (7 + l_linenumber * 26 - 2)::INT AS "left", (7 + (l_orderkey % 8) * 26 - 2)::INT AS top, (7 + l_linenumber * 26 + 20 + 2)::INT AS "right", (7 + (l_orderkey % 8) * 26 + 20 + 2)::INT AS bottom FROM lineitem""")
def cell_bounds(spark, sf_dir):
    """Bounds of cells of an odd em, 21, with a border of 5 and a padding of 7."""
    bounds = g.cell_bounds(F.col("l_orderkey") % 8, F.col("l_linenumber"), F.lit(21), F.lit(5), F.lit(7))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bounds.alias("b")).select("l_orderkey", "l_linenumber", "b.*")
