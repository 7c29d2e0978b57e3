"""Formats that are read in parts: archives by ranges of members, fonts by table."""

from __future__ import annotations

import io
import itertools
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphlake.functions import fonttables
from glyphlake.operators import tensors
from glyphlake.plans.raster_queries import NONZERO_SQL, RUNS_SQL
from glyphlake.plans.registry import query
from glyphlake.plans.tensor_queries import UNIT_SQL, _unit
from glyphlake.session import new_folder, table
from glyphlake.sources import images, outlines, zipsource


#: Members of an archive; a task's further rows go to its next one.
MEMBERS = 20_000


def _archive(folder: str, most: int = MEMBERS):
    """A task's rows as archives of at most `most` members in the folder; of keys that end in 9 the member is damaged.

    A task holds one archive and its directory at a time, so its memory does not grow with its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = zipsource.place(folder)
        system.create_dir(at)
        rows = (row for batch in batches for row in zip(batch.column("p_partkey").to_pylist(), batch.column("p_name").to_pylist(), strict=True))
        for number in itertools.count():
            out, damaged = io.BytesIO(), []
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for key, name in itertools.islice(rows, most):
                    z.writestr(f"parts/p{key}.txt", name)
                    damaged += [z.infolist()[-1]] * (key % 10 == 9)
                n = len(z.infolist())
            if number and not n:
                return
            with out.getbuffer() as data:
                for info in damaged:  # the first byte behind the header and the name
                    data[info.header_offset + 30 + len(info.filename)] ^= 0xFF
                with system.open_output_stream(f"{at}/a{TaskContext.get().partitionId()}-{number}.zip") as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


@query("zip_ranges", """
SELECT 'parts/p' || p_partkey || '.txt' AS member, CASE WHEN p_partkey % 10 <> 9 THEN p_name END AS text, strlen(p_name)::BIGINT AS size, p_partkey % 10 = 9 AS failed FROM part""")
def zip_ranges(spark, sf_dir):
    """Parts in three archives or, if these would be large, in more, whose members several tasks each inflate by ranges."""
    at = new_folder(spark, "zips")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(3, "p_partkey")
    parts.mapInArrow(_archive(at), "n bigint").agg(F.sum("n")).collect()
    spark.dataSource.register(zipsource.ZipMembers)
    found = spark.read.format("zip_members").option("split_bytes", 1 << 16).load(at)
    return found.select("member", F.col("content").cast("string").alias("text"), "size", F.col("error").isNotNull().alias("failed"))


def _u32(c: Column) -> Column:
    return F.lpad(F.hex(c.cast("bigint")), 8, "0")


def _font(key: Column, size: Column) -> Column:
    """A file of 1 to 3 faces, a collection if more, each with two tables; keys that end in 9 are cut off, of every seventh a table is too long."""
    n = size % 3 + 1
    front = F.when(n > 1, 12 + 4 * n).otherwise(0)
    data = front + 44 * n
    offsets = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: _u32(front + 44 * k)), "")
    head = F.when(n > 1, F.concat(F.lit("74746366" + "00010000"), _u32(n), offsets)).otherwise("")
    glyf = F.when(key % 7 == 0, F.lit(100_000)).otherwise(size)
    face = lambda k: F.concat(F.lit("00010000" + "0002" + "0020" + "0001" + "0000"), F.lit("676C7966"), _u32(key), _u32(data), _u32(glyf), F.lit("6E616D65"), _u32(k), _u32(data + size), _u32(4 * (k + 1)))
    whole = F.concat(head, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), face), ""), F.repeat(F.lit("00"), size + 12))
    return F.unhex(F.when(key % 10 == 9, F.substring(whole, 1, 20)).otherwise(whole))


@query("font_tables", """
WITH p AS (SELECT p_partkey, p_size, p_size % 3 + 1 AS n, CASE WHEN p_size % 3 > 0 THEN 12 + 4 * (p_size % 3 + 1) ELSE 0 END AS front FROM part),
t AS (SELECT p_partkey, p_size, k, front + 44 * n AS data FROM p, (SELECT unnest(range(0, 3)) AS k) WHERE k < n AND p_partkey % 10 <> 9)
SELECT p_partkey, k::INT AS face, 'glyf' AS tag, p_partkey::BIGINT AS checksum, data::BIGINT AS offset, (CASE WHEN p_partkey % 7 = 0 THEN 100000 ELSE p_size END)::BIGINT AS length, p_partkey % 7 = 0 AS failed FROM t
UNION ALL SELECT p_partkey, k::INT, 'name', k::BIGINT, (data + p_size)::BIGINT, 4 * (k + 1)::BIGINT, false FROM t
UNION ALL SELECT p_partkey, CASE WHEN n > 1 THEN NULL ELSE 0 END, NULL, NULL, NULL, NULL, true FROM p WHERE p_partkey % 10 = 9""")
def font_tables(spark, sf_dir):
    """Faces and tables of font files by a table function in SQL."""
    fonttables.register(spark)
    fonts = table(spark, sf_dir, "part").select("p_partkey", _font(F.col("p_partkey"), F.col("p_size")).alias("content"))
    return spark.sql("SELECT p_partkey, t.face, t.tag, t.checksum, t.offset, t.length, t.error IS NOT NULL AS failed FROM {fonts}, LATERAL font_tables(content) t", fonts=fonts)


@query("codec_round_trip", """
SELECT vec_id, style, CASE WHEN vec_id % 10 = 9 THEN 64 ELSE 0 END::BIGINT AS changed, vec_id % 10 = 9 AS failed FROM embeddings, (SELECT unnest(['pgm', 'png', 'tiff']) AS style)""")
def codec_round_trip(spark, sf_dir):
    """Changed pixels of each vector as an image of 4 by 16 pixels through every kind of file; of every tenth the end is cut off."""
    hexes = F.array_join(F.transform("u", lambda v: F.lpad(F.hex(F.round(v * 255).cast("int")), 2, "0")), "")
    before = _unit(spark, sf_dir).select(F.col("vec_id").cast("string").alias("image_id"), F.lit(4).alias("height"), F.lit(16).alias("width"), F.unhex(hexes).alias("data"))
    styles = {style: images.encoded(before, style).withColumnRenamed("name", "path") for style in images.STYLES}
    damaged = F.split_part("path", F.lit("."), F.lit(1)).cast("bigint") % 10 == 9
    named = before.withColumn("style", F.explode(F.array(*(F.lit(e) for e in images.STYLES.values()))))
    named = named.withColumn("image_id", F.concat("image_id", "style")).drop("style")
    files = None
    for f in styles.values():
        files = f if files is None else files.unionByName(f)
    files = files.withColumn("content", F.when(damaged, F.expr("substring(content, 1, length(content) - 20)")).otherwise(F.col("content")))
    after = images.read_images(files)
    failed = after.where("error IS NOT NULL").select("image_id", F.lit(True).alias("failed"))
    changed = images.changed_pixels(named, after.where("error IS NULL")).join(failed, "image_id", "left")
    part = lambda i: F.split_part("image_id", F.lit("."), F.lit(i))
    return changed.select(part(1).cast("bigint").alias("vec_id"), part(2).alias("style"), "changed", F.coalesce("failed", F.lit(False)).alias("failed"))


@query("mosaic", f"""
WITH t AS (SELECT vec_id, w, vec_id // w AS r, vec_id % w AS c, u FROM (SELECT *, ceil(sqrt(count(*) OVER ()))::BIGINT AS w, count(*) OVER () AS n FROM ({UNIT_SQL}))),
size AS (SELECT max(w) AS w, max(r) AS last FROM t),
grid AS (SELECT r, l, c, x FROM size, (SELECT unnest(range(0, 8)) AS l), (SELECT unnest(range(0, 8)) AS x), LATERAL (SELECT unnest(range(0, last + 1)) AS r), LATERAL (SELECT unnest(range(0, w)) AS c))
SELECT (8 * g.r + l)::BIGINT AS line, string_agg(coalesce(round(510 * u[8 * l + x + 1])::INT, 255), ',' ORDER BY g.c, x) AS pixels
FROM grid g LEFT JOIN t ON t.r = g.r AND t.c = g.c GROUP BY g.r, l""")
def mosaic(spark, sf_dir):
    """All vectors as tiles of 8 by 8 pixels in one grid, line by line; half grey where there is no tile."""
    u = _unit(spark, sf_dir)
    tiles = u.select(F.col("vec_id").alias("i"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda l: F.slice("u", 8 * l + 1, F.lit(8)))).alias("line", "pixels"))
    lines = tensors.mosaic_lines(tiles, u.count())
    return lines.select("line", F.array_join(F.transform("pixels", lambda v: F.round(510 * v).cast("int").cast("string")), ",").alias("pixels"))


def _quad_fonts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A font for each part with one symbol, A, of four points; those of keys that end in 9 are cut off."""
    for batch in batches:
        paths, contents = [], []
        for key, size in zip(batch.column("p_partkey").to_pylist(), batch.column("p_size").to_pylist(), strict=True):
            x, y = (3, size + 30, size + 20 - key % 11, key % 7), (-2, 5, size + 4, 20 + key % 13)
            steps = lambda v: [b - a for a, b in zip((0, *v), v, strict=False)]
            outline = struct.pack(">5hHH", 1, 0, 0, 0, 0, 3, 0) + bytes([1] * 4) + struct.pack(">8h", *steps(x), *steps(y))
            tables = {
                b"cmap": struct.pack(">2H2HI5HH", 0, 1, 3, 1, 12, 6, 12, 0, 65, 1, 1), b"glyf": outline,
                b"head": bytes(18) + struct.pack(">H", 64) + bytes(30) + struct.pack(">2h", 1, 0), b"hhea": bytes(34) + struct.pack(">H", 2),
                b"hmtx": struct.pack(">HhHh", 10, 0, 40 + key % 9, 0), b"loca": struct.pack(">3I", 0, 0, len(outline)), b"maxp": bytes(4) + struct.pack(">H", 2),
            }
            data, at = b"", 12 + 16 * len(tables)
            head = struct.pack(">4s4H", b"\0\1\0\0", len(tables), 0, 0, 0)
            for tag, body in tables.items():
                head += struct.pack(">4s3I", tag, 0, at + len(data), len(body))
                data += body
            paths.append(str(key))
            contents.append((head + data)[: 60 if key % 10 == 9 else None])
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


# four points of a symbol in quarters of a pixel, y upward; the bitmap is the box around them
QUADS_SQL = """
SELECT p_partkey AS vec_id, unnest([3, p_size + 30, p_size + 20 - p_partkey % 11, p_partkey % 7]) / 4::DOUBLE AS x, -unnest([-2, 5, p_size + 4, 20 + p_partkey % 13]) / 4::DOUBLE AS y, unnest(range(0, 4)) AS i FROM part WHERE p_partkey % 10 <> 9"""


@query("font_bitmaps", f"""
WITH q AS ({QUADS_SQL}), box AS (SELECT vec_id, floor(min(x))::INT AS l, floor(min(y))::INT AS t, ceil(max(x))::INT AS r, ceil(max(y))::INT AS b FROM q GROUP BY vec_id),
{RUNS_SQL.format(edges="SELECT p.vec_id, p.x - l AS x0, p.y - t AS y0, n.x - l AS x1, n.y - t AS y1 FROM q p JOIN q n ON n.vec_id = p.vec_id AND n.i = (p.i + 1) % 4 JOIN box ON box.vec_id = p.vec_id", value=NONZERO_SQL)},
px AS (SELECT vec_id, row, unnest(range(x, x + length)) AS x, value FROM runs),
grid AS (SELECT vec_id, row, x FROM box, (SELECT unnest(range(0, 16)) AS row), (SELECT unnest(range(0, 24)) AS x) WHERE row < b - t AND x < r - l),
bits AS (SELECT vec_id, string_agg(format('{{:02X}}', coalesce(value, 0)), '' ORDER BY row, x) AS bitmap FROM grid LEFT JOIN px USING (vec_id, row, x) GROUP BY vec_id)
SELECT vec_id::VARCHAR AS font_id, b - t AS rows, r - l AS width, l AS bitmap_left, -t AS bitmap_top, (floor((40 + vec_id % 9) * 0.25::DOUBLE + 0.5) * 64)::INT AS adv_x, bitmap, false AS failed FROM box JOIN bits USING (vec_id)
UNION ALL SELECT p_partkey::VARCHAR, NULL, NULL, NULL, NULL, NULL, NULL, true FROM part WHERE p_partkey % 10 = 9""")
def font_bitmaps(spark, sf_dir):
    """Fonts read from their bytes and rasterised without a library, at a quarter of a pixel for each unit."""
    fonts = table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInArrow(_quad_fonts, "path string, content binary")
    g = outlines.rendered_sizes(fonts, ["A"], [(16, 72)])
    return g.select("font_id", "rows", "width", "bitmap_left", "bitmap_top", "adv_x", F.hex("bitmap").alias("bitmap"), F.col("font_not_loaded").alias("failed"))
