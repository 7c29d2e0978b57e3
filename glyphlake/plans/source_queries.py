"""Sources, sinks and painting: what is written is read back, so that the rows show both."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from glyphlake.functions import text
from glyphlake.operators import compositing, dedupe, glyphs, manifest, raster, reports, tensors, verdicts
from glyphlake.plans.corpus_queries import FILE, SUFFIX_SQL, VERDICT_SQL, bad_doc_verdict, files
from glyphlake.plans.registry import query
from glyphlake.plans.tensor_queries import LONG_SQL, UNIT_SQL, _long, _unit
from glyphlake.session import new_folder, table
from glyphlake.sources import archives, images, pages
from glyphlake.sources import files as file_source

GREY_SQL = f"SELECT vec_id, list_transform(u, lambda x: round(x * 255)::INT) AS g FROM ({UNIT_SQL})"


@query("image_round_trip", f"""
SELECT vec_id, style, 4::INT AS height, 16::INT AS width, array_to_string(g, ',') AS pixels
FROM ({GREY_SQL}), (SELECT unnest(['pgm', 'png']) AS style)""")
def image_round_trip(spark, sf_dir):
    """A vector as an image of 4 by 16 pixels, written as grey map and as PNG and read again."""
    hexes = F.array_join(F.transform("u", lambda v: F.lpad(F.hex(F.round(v * 255).cast("int")), 2, "0")), "")
    i = _unit(spark, sf_dir).select(F.col("vec_id").cast("string").alias("image_id"), F.lit(4).alias("height"), F.lit(16).alias("width"), F.unhex(hexes).alias("data"))
    both = images.encoded(i, "fastest").unionByName(images.encoded(i, "smaller")).withColumnRenamed("name", "path")
    name = F.col("image_id")
    return images.pixels(images.read_images(both)).select(
        F.split_part(name, F.lit("."), F.lit(1)).cast("bigint").alias("vec_id"), F.split_part(name, F.lit("."), F.lit(2)).alias("style"),
        "height", "width", F.array_join(F.transform("pixels", lambda v: v.cast("string")), ",").alias("pixels"),
    )


def _zip(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def _supplier_zips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An archive for each supplier: its name, for even keys an archive with its nation; every tenth file is damaged."""
    for batch in batches:
        paths, contents = [], []
        for key, name, nation in zip(*(batch.column(c).to_pylist() for c in ("s_suppkey", "s_name", "s_nationkey")), strict=True):
            entries = {"name.txt": name.encode()}
            if key % 2 == 0:
                entries["more.zip"] = _zip({"nation.txt": str(nation).encode()})
            paths.append(f"/a/s{key}.zip")
            contents.append(b"no archive" if key % 10 == 9 else _zip(entries))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


@query("unzipped", """
SELECT '/a/s' || s_suppkey || '.zip' AS archive, '/a/s' || s_suppkey || '/name.txt' AS path, s_name AS text, false AS failed FROM supplier WHERE s_suppkey % 10 <> 9
UNION ALL SELECT '/a/s' || s_suppkey || '.zip', '/a/s' || s_suppkey || '/more.zip', NULL, false FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT '/a/s' || s_suppkey || '/more.zip', '/a/s' || s_suppkey || '/more/nation.txt', s_nationkey::VARCHAR, false FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT '/a/s' || s_suppkey || '.zip', NULL, NULL, true FROM supplier WHERE s_suppkey % 10 = 9""")
def unzipped(spark, sf_dir):
    """Archives to the bottom; a damaged one is a row that says so."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    found = archives.unzip_all(s.mapInArrow(_supplier_zips, "path string, content binary"))
    content = F.when(~F.col("path").endswith(".zip"), F.col("content").cast("string"))
    return found.select("archive", "path", content.alias("text"), F.col("error").isNotNull().alias("failed"))


@query("page_addresses", """
SELECT '/list/' || s_suppkey AS url, unnest(range(1, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE s_nationkey + 3 END))::INT AS page FROM supplier""")
def page_addresses(spark, sf_dir):
    """Every page of each listing by its pager; one without a pager has one page."""
    pager = F.format_string('<div class="noindex"><a>1</a> <a>%d</a></div>', F.col("s_nationkey") + 2)
    html = F.when(F.col("s_suppkey") % 3 == 0, "<p>none</p>").otherwise(pager)
    return pages.page_urls(table(spark, sf_dir, "supplier").select(F.format_string("/list/%d", "s_suppkey").alias("url"), html.alias("html")))


@query("routed", VERDICT_SQL)
def routed(spark, sf_dir):
    """Documents written in a folder for each verdict, as the folders say when they are read."""
    at = new_folder(spark, "routed")
    verdicts.route(bad_doc_verdict(spark, sf_dir), at)
    return spark.read.schema("doc_id bigint, verdict string").parquet(at)


MANIFEST_SQL = f"""
SELECT substr(suffix, 2) AS ext, row_number() OVER (PARTITION BY suffix ORDER BY md5('42:' || path), path) - 1 AS seq, path AS orig_path
FROM (SELECT path, {SUFFIX_SQL} AS suffix FROM (SELECT {FILE} AS path FROM documents))"""


def _written_manifest(spark, sf_dir) -> str:
    at = new_folder(spark, "manifest")
    file_source.write_manifest_json(manifest.bucketed(files(spark, sf_dir).select("path")), at)
    return at


@query("manifest_read_back", MANIFEST_SQL)
def manifest_read_back(spark, sf_dir):
    """The rename manifest written as JSON, a folder for each bucket, and read."""
    return spark.read.schema("seq bigint, orig_path string, ext string").json(_written_manifest(spark, sf_dir)).select("ext", "seq", "orig_path")


@query("scanned_buckets", f"SELECT DISTINCT 'ext=' || ext AS folder, true AS filled FROM ({MANIFEST_SQL})")
def scanned_buckets(spark, sf_dir):
    """The folders below a written manifest by a scan of names and lengths that opens no file."""
    found = file_source.scan(spark, _written_manifest(spark, sf_dir), glob="*.json", content=False)
    return found.groupBy(text.base_name(text.parent(F.col("path"))).alias("folder")).agg((F.sum("length") > 0).alias("filled"))


@query("line_sets", "SELECT p_name AS line FROM part UNION SELECT p_type FROM part")
def line_sets(spark, sf_dir):
    """Two text files as sets of lines, and what either has; a file that is not there adds none."""
    p = table(spark, sf_dir, "part")
    ats = []
    for c in ("p_name", "p_type"):
        ats.append(new_folder(spark, "lines"))
        p.select(c).write.text(ats[-1])
    return dedupe.discovered(*(file_source.line_set(spark, at, "line") for at in [*ats, ats[0] + "-missing"]))


@query("sweep_read_back", """
SELECT (p_partkey % 5)::INT AS padding, p_size AS point, (p_partkey % 300)::INT AS dpi, p_partkey::INT AS "offset", 100::INT AS image_count,
       (p_partkey % 7)::INT AS out_of_image, (p_partkey % 11)::INT AS out_of_cell, (p_partkey % 13)::INT AS empty_cell FROM part""")
def sweep_read_back(spark, sf_dir):
    """A sweep reported as CSV and read again."""
    k = F.col("p_partkey")
    given = {"padding": k % 5, "point": F.col("p_size"), "dpi": k % 300, "offset": k, "image_count": F.lit(100), "out_of_image": k % 7, "out_of_cell": k % 11, "empty_cell": k % 13}
    at = new_folder(spark, "sweep")
    reports.to_csv(table(spark, sf_dir, "part").select(*(c.alias(n) for n, c in given.items())), at)
    return file_source.sweep(spark, at)


@query("moments_reloaded", f"SELECT channel, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM ({LONG_SQL}) GROUP BY channel")
def moments_reloaded(spark, sf_dir):
    """Moments that were saved, as another run loads them."""
    at = new_folder(spark, "moments")
    tensors.save_moments(tensors.moments(_long(spark, sf_dir)), at)
    return tensors.load_moments(spark, at).select("channel", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("drawn_alike", """
SELECT vec_id, string_agg(ch, '' ORDER BY ch) AS match_set FROM (
  SELECT vec_id, chr((32 + s)::INT) AS ch, array_to_string(list_transform(embedding[4 * s + 1:4 * s + 4], lambda v: (v > 0)::INT), '') AS bits
  FROM embeddings, (SELECT unnest(range(0, 16)) AS s)) WHERE ch <> ' ' GROUP BY vec_id, bits HAVING count(*) >= 2""")
def drawn_alike(spark, sf_dir):
    """A vector as 16 symbols of four pixels, the first one a space: symbols with equal bitmaps and places."""
    bits = F.array_join(F.transform(F.slice("embedding", F.col("s") * 4 + 1, F.lit(4)), lambda v: F.when(v > 0, "FF").otherwise("00")), "")
    g = table(spark, sf_dir, "embeddings").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(15))))
    two, zero = F.lit(2), F.lit(0)
    g = g.select("vec_id", F.chr(F.col("s") + 32).alias("ch"), two.alias("rows"), two.alias("width"), zero.alias("off_x"), zero.alias("off_y"), F.unhex(bits).alias("bitmap"))
    names = ["area", "off_x", "off_y", "pixels"]
    return glyphs.match_sets(g.select("vec_id", "ch", *(k.alias(n) for k, n in zip(raster.identity_key(), names, strict=True))), ["vec_id"], names)


@query("painted", f"""
WITH v AS (SELECT vec_id, g, vec_id % 4 AS x, vec_id % 3 AS y FROM ({GREY_SQL})),
p AS (SELECT vec_id, r, c, CASE WHEN r < 4 AND c < 4 THEN greatest(g[4 * r + c + 1] - 128, 0) ELSE 0 END AS a,
             CASE WHEN r BETWEEN y AND y + 3 AND c BETWEEN x AND x + 3 THEN greatest(g[16 + 4 * (r - y) + c - x + 1] - 128, 0) ELSE 0 END AS b
      FROM v, (SELECT unnest(range(0, 5)) AS r), (SELECT unnest(range(0, 6)) AS c))
SELECT vec_id, string_agg(CASE WHEN b > 0 THEN b ELSE a END, ',' ORDER BY r, c) AS canvas, count(*) FILTER (a > 0 AND b > 0) AS overwrites,
       count(*) FILTER (a > 0) = 0 AS first_empty, count(*) FILTER (b > 0) = 0 AS second_empty,
       min(c) FILTER (a > 0 OR b > 0)::INT AS l, min(r) FILTER (a > 0 OR b > 0)::INT AS t, max(c) FILTER (a > 0 OR b > 0)::INT AS r, max(r) FILTER (a > 0 OR b > 0)::INT AS b
FROM p GROUP BY vec_id""")
def painted(spark, sf_dir):
    """Two glyphs of 4 by 4 pixels of a vector on a canvas of 5 by 6, the second over the first without blending."""
    c = F.col
    g = _unit(spark, sf_dir).select("vec_id", F.posexplode(F.slice(F.transform("u", lambda v: F.greatest(F.round(v * 255).cast("int") - 128, F.lit(0))), 1, 32)).alias("i", "value"))
    second, r, q = c("i") >= 16, F.floor((c("i") % 16) / 4).cast("int"), (c("i") % 4).cast("int")
    x, y = F.when(second, q + (c("vec_id") % 4).cast("int")).otherwise(q), F.when(second, r + (c("vec_id") % 3).cast("int")).otherwise(r)
    layers = g.select("vec_id", F.floor(c("i") / 16).cast("int").alias("z"), x.alias("x"), y.alias("y"), "value")
    on = compositing.clipped(layers, 6, 5)
    places = compositing.composited(on, ["vec_id"], how="replace")
    used = on.where("value > 0").groupBy("vec_id").agg(*(F.max((c("z") == z).cast("int")).alias(f"used{z}") for z in (0, 1)))
    pixels = places.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct(c("y") * 6 + c("x"), c("value").cast("string")))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.coalesce(F.element_at("m", k), F.lit("0"))), ",")
    rows = table(spark, sf_dir, "embeddings").select("vec_id").join(pixels, "vec_id", "left").join(compositing.summary(places, ["vec_id"]), "vec_id", "left").join(used, "vec_id", "left")
    return rows.select(
        "vec_id", line.alias("canvas"), F.coalesce("overwrites", F.lit(0)).alias("overwrites"),
        *((F.coalesce(f"used{z}", F.lit(0)) == 0).alias(n) for z, n in ((0, "first_empty"), (1, "second_empty"))), "l", "t", "r", "b",
    )


@query("symbol_counts", """
SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(p_name, '')) AS ch FROM part) WHERE ch <> '' GROUP BY ch""")
def symbol_counts(spark, sf_dir):
    """One line for each character of each name, counted."""
    lines = table(spark, sf_dir, "part").select(F.explode(text.single_symbols(F.col("p_name"))).alias("ch"))
    return reports.entry_count(lines, "ch")
