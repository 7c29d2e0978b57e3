"""Rasterising, drawing and cropping as relations; vectors stand for outlines and bitmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.operators import compositing, coverage
from glyphlake.plans.registry import query
from glyphlake.plans.tensor_queries import UNIT_SQL, _unit
from glyphlake.session import table

WIDTH, HEIGHT = 24, 16

# two closed polygons of 16 points in a vector, partly outside of a canvas of 24 by 16 pixels
POLYGONS_SQL = """
SELECT vec_id, k, i, 12 + 40 * embedding[32 * k + 2 * i + 1]::DOUBLE AS x0, 8 + 30 * embedding[32 * k + 2 * i + 2]::DOUBLE AS y0,
       12 + 40 * embedding[32 * k + 2 * ((i + 1) % 16) + 1]::DOUBLE AS x1, 8 + 30 * embedding[32 * k + 2 * ((i + 1) % 16) + 2]::DOUBLE AS y1
FROM embeddings, (SELECT unnest(range(0, 2)) AS k), (SELECT unnest(range(0, 16)) AS i)"""

# the runs of grey pixels of edges; signed areas in 2 ** 24 parts of a pixel
RUNS_SQL = """
e AS ({edges}),
r AS (SELECT *, least(y0, y1) AS top, greatest(y0, y1) AS bottom, (x1 - x0) / (y1 - y0) AS slope,
             unnest(range(floor(greatest(least(y0, y1), 0))::BIGINT, ceil(least(greatest(y0, y1), 16))::BIGINT)) AS row FROM e WHERE y0 <> y1),
s AS (SELECT vec_id, row, x0 + (greatest(top, row::DOUBLE) - y0) * slope AS xa, x0 + (least(bottom, (row + 1)::DOUBLE) - y0) * slope AS xb,
             CASE WHEN y1 > y0 THEN least(bottom, (row + 1)::DOUBLE) - greatest(top, row::DOUBLE) ELSE greatest(top, row::DOUBLE) - least(bottom, (row + 1)::DOUBLE) END AS dy FROM r),
t AS (SELECT vec_id, row, least(xa, xb) AS xl, greatest(xa, xb) AS xr, dy FROM s),
u AS (SELECT *, unnest(range(greatest(floor(xl), -1)::BIGINT, least(greatest(floor(xl), ceil(xr) - 1, -1), 23)::BIGINT + 1)) AS cell FROM t),
v AS (SELECT *, CASE WHEN cell < 0 THEN xl ELSE greatest(xl, cell::DOUBLE) END AS lo, least(xr, (cell + 1)::DOUBLE) AS hi FROM u),
w AS (SELECT *, CASE WHEN xr > xl THEN dy * ((hi - lo) / (xr - xl)) ELSE dy END AS part FROM v),
c AS (SELECT vec_id, row, cell, sum(floor(part * 16777216 + 0.5)::BIGINT)::BIGINT AS cover,
             sum(CASE WHEN cell < 0 THEN 0 ELSE floor(part * ((cell + 1)::DOUBLE - (lo + hi) / 2) * 16777216 + 0.5)::BIGINT END)::BIGINT AS area FROM w GROUP BY ALL),
b AS (SELECT *, (sum(cover) OVER o - cover)::BIGINT AS before, coalesce(lead(cell) OVER o, 24) AS after FROM c WINDOW o AS (PARTITION BY vec_id, row ORDER BY cell)),
runs AS (SELECT vec_id, row, x, length, least(255, {value})::INT AS value FROM (
           SELECT vec_id, row, cell AS x, 1 AS length, before + area AS a FROM b WHERE cell >= 0
           UNION ALL SELECT vec_id, row, cell + 1, after - cell - 1, before + cover FROM b WHERE after > cell + 1))"""
NONZERO_SQL, EVENODD_SQL = "abs(a) >> 16", "(CASE WHEN abs(a) % 33554432 > 16777216 THEN 33554432 - abs(a) % 33554432 ELSE abs(a) % 33554432 END) >> 16"
LINES_SQL = """
px AS (SELECT vec_id, row, unnest(range(x, x + length)) AS x, value FROM runs),
grid AS (SELECT DISTINCT vec_id, row, x FROM embeddings, (SELECT unnest(range(0, 16)) AS row), (SELECT unnest(range(0, 24)) AS x))
SELECT vec_id, row::INT AS row, string_agg(format('{:02X}', coalesce(value, 0)), '' ORDER BY x) AS line FROM grid LEFT JOIN px USING (vec_id, row, x) GROUP BY vec_id, row"""


def _polygons(spark, sf_dir):
    """(vec_id, contour): two contours of each vector, arrays of points."""
    value = lambda i: F.get("embedding", i).cast("double")
    point = lambda k, i: F.struct((12 + 40 * value(32 * k + 2 * i)).alias("x"), (8 + 30 * value(32 * k + 2 * i + 1)).alias("y"), (i % 2 == 0).alias("on"))
    contours = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: point(k, i)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.explode(contours).alias("contour"))


def _lines(found, polygons):
    lines = coverage.scan_lines(found, ["vec_id"], WIDTH, polygons, HEIGHT)
    return lines.select("vec_id", "row", F.hex("line").alias("line"))


@query("coverage_rows", f"WITH {RUNS_SQL.format(edges=POLYGONS_SQL, value=NONZERO_SQL)}, {LINES_SQL}")
def coverage_rows(spark, sf_dir):
    """Two overlapping polygons of each vector as rows of grey pixels."""
    p = _polygons(spark, sf_dir)
    edges = p.select("vec_id", F.explode(coverage.closed_edges(F.col("contour"))).alias("e")).select("vec_id", "e.*")
    return _lines(coverage.runs(edges, ["vec_id"], WIDTH, HEIGHT), p)


# every other point controls a curve between its neighbours, which four straight pieces follow
CURVES_SQL = """
SELECT vec_id, k, m, x AS x0, y AS y0, lead(x, 1, fx) OVER o AS x1, lead(y, 1, fy) OVER o AS y1 FROM (
  SELECT *, first_value(x) OVER o AS fx, first_value(y) OVER o AS fy FROM (
    SELECT vec_id, k, 4 * i + j AS m, CASE WHEN j = 0 THEN ax ELSE (1 - t) * (1 - t) * ax + 2 * (1 - t) * t * cx + t * t * nx END AS x,
           CASE WHEN j = 0 THEN ay ELSE (1 - t) * (1 - t) * ay + 2 * (1 - t) * t * cy + t * t * ny END AS y FROM (
      SELECT vec_id, k, i, j, j / 4::DOUBLE AS t,
        12 + 40 * embedding[32 * k + 4 * i + 1]::DOUBLE AS ax, 8 + 30 * embedding[32 * k + 4 * i + 2]::DOUBLE AS ay,
        12 + 40 * embedding[32 * k + 4 * i + 3]::DOUBLE AS cx, 8 + 30 * embedding[32 * k + 4 * i + 4]::DOUBLE AS cy,
        12 + 40 * embedding[32 * k + 4 * ((i + 1) % 8) + 1]::DOUBLE AS nx, 8 + 30 * embedding[32 * k + 4 * ((i + 1) % 8) + 2]::DOUBLE AS ny
      FROM embeddings, (SELECT unnest(range(0, 2)) AS k), (SELECT unnest(range(0, 8)) AS i), (SELECT unnest(range(0, 4)) AS j)))
  WINDOW o AS (PARTITION BY vec_id, k ORDER BY m)) WINDOW o AS (PARTITION BY vec_id, k ORDER BY m)"""


@query("curved_rows", f"WITH {RUNS_SQL.format(edges=CURVES_SQL, value=EVENODD_SQL)}, {LINES_SQL}")
def curved_rows(spark, sf_dir):
    """The same points as curves, where they overlap left out."""
    p = _polygons(spark, sf_dir)
    edges = p.select("vec_id", coverage.flattened(F.col("contour"), 4).alias("c"))
    edges = edges.select("vec_id", F.explode(coverage.closed_edges(F.col("c"))).alias("e")).select("vec_id", "e.*")
    return _lines(coverage.runs(edges, ["vec_id"], WIDTH, HEIGHT, "evenodd"), p)


# a vector as four layers of 4 by 4 pixels, at places that overlap, on a canvas of 6 by 6
LAYERS_SQL = f"""
SELECT vec_id, z, x, y, value FROM (
  SELECT vec_id, z, c + (vec_id + 2 * z) % 4 - 1 AS x, r + (vec_id // 4 + z) % 4 - 1 AS y, greatest(round(u[16 * z + 4 * r + c + 1] * 255)::INT - 100, 0) AS value
  FROM ({UNIT_SQL}), (SELECT unnest(range(0, 4)) AS z), (SELECT unnest(range(0, 4)) AS r), (SELECT unnest(range(0, 4)) AS c))"""
F32 = "CAST({} AS FLOAT)".format
MIXED_SQL = "CASE WHEN s.opaque THEN s.value ELSE floor(" + F32("255::FLOAT * " + F32("s.value::FLOAT / 255::FLOAT + " + F32("acc.value::FLOAT / 255::FLOAT * " + F32("1::FLOAT - s.value::FLOAT / 255::FLOAT")))) + ")::INT END"
FOLD_SQL = f"""
stack AS (SELECT vec_id, x, y, list({{'z': z, 'value': value::INT, 'opaque': opaque}} ORDER BY z, value) AS p FROM layers
          WHERE value > 0 AND x BETWEEN 0 AND 5 AND y BETWEEN 0 AND 5 GROUP BY ALL),
canvas AS (SELECT vec_id, x, y, list_reduce(p, lambda acc, s: {{'value': {MIXED_SQL}, 'overwrites': acc.overwrites + (NOT s.opaque AND acc.value > 0)::BIGINT}}, {{'value': 0::INT, 'overwrites': 0::BIGINT}}) AS f FROM stack)"""


def _layers(spark, sf_dir):
    i, c = F.col("i"), F.col
    p = _unit(spark, sf_dir).select("vec_id", F.posexplode(F.transform("u", lambda v: F.greatest(F.round(v * 255).cast("int") - 100, F.lit(0)))).alias("i", "value"))
    z, r, q = F.floor(i / 16), F.floor((i % 16) / 4), i % 4
    x, y = q + (c("vec_id") + 2 * z) % 4 - 1, r + (F.floor(c("vec_id") / 4) + z) % 4 - 1
    return p.select("vec_id", z.alias("z"), x.cast("int").alias("x"), y.cast("int").alias("y"), "value")


@query("composited", f"""
WITH layers AS (SELECT *, false AS opaque FROM ({LAYERS_SQL})), {FOLD_SQL}
SELECT vec_id, x::INT AS x, y::INT AS y, f.value AS value, f.overwrites AS overwrites FROM canvas""")
def composited(spark, sf_dir):
    """Four bitmaps of each vector drawn over each other."""
    return compositing.composited(compositing.clipped(_layers(spark, sf_dir), 6, 6), ["vec_id"])


@query("drawn_summary", f"""
WITH layers AS (SELECT *, false AS opaque FROM ({LAYERS_SQL})), {FOLD_SQL},
used AS (SELECT DISTINCT vec_id, z FROM layers WHERE value > 0 AND x BETWEEN 0 AND 5 AND y BETWEEN 0 AND 5),
none AS (SELECT vec_id, string_agg(z, ',' ORDER BY z) AS empty FROM (SELECT DISTINCT vec_id, z FROM layers) ANTI JOIN used USING (vec_id, z) GROUP BY vec_id)
SELECT s.*, coalesce(empty, '') AS empty FROM (
  SELECT vec_id, sum(f.overwrites)::BIGINT AS overwrites, min(x)::INT AS l, min(y)::INT AS t, max(x)::INT AS r, max(y)::INT AS b FROM canvas GROUP BY vec_id) s LEFT JOIN none USING (vec_id)""")
def drawn_summary(spark, sf_dir):
    """Overwrites, box and empty layers of each canvas."""
    layers = _layers(spark, sf_dir)
    on = compositing.clipped(layers, 6, 6)
    none = compositing.empty_layers(layers.select("vec_id", "z").distinct(), on, ["vec_id"])
    none = none.groupBy("vec_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("z").cast("string"))), ",").alias("empty"))
    s = compositing.summary(compositing.composited(on, ["vec_id"]), ["vec_id"])
    return s.join(none, "vec_id", "left").withColumn("empty", F.coalesce("empty", F.lit("")))


@query("highlighted_canvas", f"""
WITH drawn AS ({LAYERS_SQL}),
boxes AS (SELECT vec_id, (vec_id + 4) % 4 - 1 AS l, (vec_id // 4 + 2) % 4 - 1 AS t FROM embeddings WHERE vec_id % 2 = 0),
ring AS (SELECT DISTINCT vec_id, 2 AS z, x, y, 128 AS value FROM boxes, (SELECT unnest(range(-1, 8)) AS x), (SELECT unnest(range(-1, 8)) AS y)
         WHERE x BETWEEN l AND l + 4 AND y BETWEEN t AND t + 3 AND (x IN (l, l + 4) OR y IN (t, t + 3))),
layers AS (SELECT vec_id, 2 * z + 1 AS z, x, y, value, false AS opaque FROM drawn UNION ALL SELECT vec_id, 2 * z, x, y, value, true FROM ring), {FOLD_SQL}
SELECT vec_id, x::INT AS x, y::INT AS y, f.value AS value, f.overwrites AS overwrites FROM canvas""")
def highlighted_canvas(spark, sf_dir):
    """In every other canvas a rectangle stands around the third bitmap, drawn before it."""
    c = F.col
    drawn = _layers(spark, sf_dir).withColumn("z", 2 * c("z") + 1).withColumn("opaque", F.lit(False))
    l, t = ((c("vec_id") + 4) % 4 - 1).cast("int"), ((F.floor(c("vec_id") / 4) + 2) % 4 - 1).cast("int")
    boxes = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select("vec_id", F.lit(4).cast("bigint").alias("z"), l.alias("l"), t.alias("t"))
    ring = compositing.outline_pixels(boxes.withColumn("r", c("l") + 4).withColumn("b", c("t") + 3), ["vec_id"])
    return compositing.composited(compositing.clipped(drawn.unionByName(ring), 6, 6), ["vec_id"])


@query("recognition_rows", f"""
WITH layers AS (SELECT *, false AS opaque FROM ({LAYERS_SQL})), {FOLD_SQL},
box AS (SELECT vec_id, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b FROM canvas GROUP BY vec_id)
SELECT vec_id, (x - l + 2)::INT AS x, (y - t + 2)::INT AS y, 255 - f.value AS value, (r - l + 5)::INT AS width, (b - t + 5)::INT AS height FROM canvas JOIN box USING (vec_id) WHERE f.value > 0""")
def recognition_rows(spark, sf_dir):
    """Each canvas cropped to what was drawn, with a margin of 2, dark on light."""
    canvas = compositing.composited(compositing.clipped(_layers(spark, sf_dir), 6, 6), ["vec_id"])
    return compositing.cropped(canvas, ["vec_id"], 2)


#: Queries that draw with built-in functions alone.
QUERIES_WITHOUT_PYTHON = ("coverage_rows", "curved_rows", "composited", "drawn_summary", "highlighted_canvas", "recognition_rows", "painted")
