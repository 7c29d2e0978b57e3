"""Files, archives, images, fonts and streams."""

import io
import zipfile
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.operators import geometry, glyphs, raster
from glyphlake.sources import archives, files, images, pages
from glyphlake.streaming import ingest


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_scan_prunes_content(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("b.ttf", "d/a.pgm", "c.TTF"):
        (tmp_path / n).write_bytes(b"x")
    s = files.scan(spark, str(tmp_path), content=False)
    assert s.count() == 3 and "content" not in s._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert files.scan(spark, str(tmp_path), glob="*.pgm").count() == 1
    assert [r.path.rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path), count=2).orderBy("path").collect()] == ["b.ttf", "c.TTF"]
    assert files.scan(spark, str(tmp_path), recursive=False).count() == 2


def test_line_set(spark, tmp_path):
    (tmp_path / "w").write_text("Il\n\nIl\n0O\n")
    assert sorted(r.match_set for r in files.line_set(spark, str(tmp_path / "w")).collect()) == ["", "0O", "Il"]
    assert files.line_set(spark, str(tmp_path / "absent")).count() == 0 and files.line_set(spark, None).count() == 0


def test_sweep_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("padding,point,dpi,offset,image_count,out_of_image,out_of_cell,empty_cell\n1,3,336,0,10,0,4,0\n1,3,336,1,10,0,2,0\n")
    b = geometry.best_offset(files.sweep(spark, str(tmp_path / "s.csv")), ["padding", "point", "dpi"]).first()
    assert (b.offset, b.out_of_cell, b.usable) == (1, 2, 0.8)


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("ttf", 1, "a"), ("ttf", 0, "b"), ("otf", 0, "c")], "ext string, seq int, orig_path string")
    files.write_manifest_json(d, str(tmp_path / "m"))
    assert [eval(x)["seq"] for p in (tmp_path / "m/ext=ttf").glob("part*") for x in p.read_text().split("\n") if x] == [0, 1]
    files.write_routed(d, str(tmp_path / "r"), "ext")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3


def test_archives_to_the_bottom(spark):
    inner = zipped({"deep.txt": b"1", "bad.zip": b"no archive"})
    d = spark.createDataFrame([("/x/a.zip", bytearray(zipped({"in.zip": inner, "f.ttf": b"2"}))), ("/x/b.ttf", bytearray(b"3"))], "path string, content binary")
    got = {r.path: (bytes(r.content) if r.content is not None else None, r.error is None) for r in archives.unzip_all(d).collect() if r.path}
    assert got["/x/a/in/deep.txt"] == (b"1", True) and got["/x/a/f.ttf"] == (b"2", True)
    errors = archives.members(spark.createDataFrame([("e.zip", bytearray(b"no")), ("n.zip", None)], "path string, content binary")).collect()
    assert len(errors) == 2 and all(r.error for r in errors)


def test_closure_with_cycle(spark):
    inside = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (9, 8)], "child bigint, parent bigint")
    assert sorted((r.id, r.depth) for r in archives.closure(spark.range(1, 2), inside).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_pgm_round_trip(spark):
    px = bytes(range(12))
    d = spark.createDataFrame([("a", bytearray(images.encode_pgm(3, 4, px))), ("b", bytearray(b"P6 no")), ("c", None)], "path string, content binary")
    got = {r.image_id: r for r in images.read_pgm(d).collect()}
    assert (got["a"].height, got["a"].width, bytes(got["a"].data)) == (3, 4, px) and got["b"].error and got["c"].error
    assert images.parse_pgm(b"P5 # remark\n2 1\n255\n\x01\x02") == (1, 2, b"\x01\x02")
    assert images.pixels(images.read_pgm(d).where("error IS NULL")).first().pixels == list(px)


@pytest.mark.parametrize("style", list(images.STYLES))
def test_encoders(spark, style):
    px = bytes([0, 255, 7, 7, 7, 9])
    d = spark.createDataFrame([("f.ttf", 2, 3, bytearray(px)), ("e", 0, 0, bytearray())], "image_id string, height int, width int, data binary")
    got = images.encoded(d, style).collect()
    assert [r.name for r in got] == ["f.ttf" + images.STYLES[style]]
    data = bytes(got[0].content)
    if style == "fastest":
        assert images.parse_pgm(data) == (2, 3, px)
    elif style == "smaller":
        at = data.index(b"IDAT")
        raw = zlib.decompress(data[at + 4 : at + 4 + int.from_bytes(data[at - 4 : at], "big")])
        assert raw == b"\0" + px[:3] + b"\0" + px[3:]
    else:
        assert unpacked_lzw(data[8:]) == px
    with pytest.raises(ValueError):
        images.encoded(d, "webp")


def test_pages(spark):
    p = spark.createDataFrame([(1, "u", '<a class="dl" href="//x/?f=arial"></a><div class="noindex"><a>1</a> <a>12</a></div>'), (2, "v", "")], "page_id bigint, url string, html string")
    assert [tuple(r) for r in pages.links(p).collect()] == [(1, "//x/?f=arial", "arial")]
    assert pages.page_urls(p).where("url = 'u'").count() == 12 and pages.page_urls(p).where("url = 'v'").count() == 1
    assert pages.not_fetched(pages.links(p), spark.createDataFrame([("//x/?f=arial",)], "href string")).count() == 0


def test_stream_takes_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"1")
    run = lambda: ingest.append_available(ingest.new_files(spark, str(tmp_path / "in"), "*.bin"), str(tmp_path / "t"), str(tmp_path / "c"))
    run()
    (tmp_path / "in/b.bin").write_bytes(b"2")
    run()
    run()
    assert sorted(bytes(r.content) for r in spark.read.schema(ingest.FILE).parquet(str(tmp_path / "t")).collect()) == [b"1", b"2"]


def fonts():
    return sorted(Path("/usr/share/fonts").rglob("*.ttf")) if Path("/usr/share/fonts").is_dir() else []


@pytest.mark.skipif(not raster.available() or not fonts(), reason="no FreeType or no font here")
def test_render(spark):
    f = fonts()[0]
    d = spark.createDataFrame([(str(f), bytearray(f.read_bytes())), ("bad", bytearray(b"no font"))], "path string, content binary")
    g = raster.rendered(d, ["AI", "l "], 12, 300).cache()
    ok = {r.ch: r for r in g.where("NOT font_not_loaded").collect()}
    assert set(ok) == {"A", "I", "l", " "} and len(ok["A"].bitmap) == ok["A"].rows * ok["A"].width > 0 and ok[" "].rows == 0
    assert [r.font_id for r in g.where("font_not_loaded").collect()] == ["bad"]
    counts = {r.path: r.faces for r in raster.face_counts(d).collect()}
    assert counts["bad"] == 0 and counts[str(f)] >= 1
    placed = g.where("NOT load_failed").select("*", geometry.placement(F.col("adv_x"), F.col("bitmap_left"), F.col("bitmap_top"), F.lit(25)).alias("p"))
    placed = placed.select("*", "p.*")
    again = placed.union(placed.withColumn("ch", F.concat("ch", F.lit("'"))))
    keys = [k.alias(n) for k, n in zip(raster.identity_key(), ("area", "off_x", "off_y", "pixels"), strict=True)]
    sets = glyphs.match_sets(again.select("font_id", "ch", *keys), ["font_id"], ["area", "off_x", "off_y", "pixels"])
    assert "AA'" in {r.match_set for r in sets.collect()}


def test_paint():
    g = np.array([[255, 128]], np.uint8)
    canvas, over, box, empty = raster.paint([(0, 0, g), (1, 0, g), (9, 9, g), (0, 2, np.zeros((1, 1), np.uint8))], 3, 4)
    assert canvas[0].tolist() == [255, 255, 128, 0] and over == 1 and box == (0, 0, 2, 0) and empty == [False, False, True, True]
    assert raster.paint([(0, 0, g), (1, 0, g)], 1, 3, blend=False)[0][0].tolist() == [255, 255, 128]
    assert raster.recognition_crop(canvas, box, 1).shape == (3, 5) and raster.recognition_crop(canvas, None, 1) is None


def test_recognised(spark):
    d = spark.createDataFrame([("a", 1, 2, bytearray(b"\1\2")), ("b", 0, 0, None)], "image_id string, height int, width int, data binary")
    assert {r.image_id: r.ocr_text for r in raster.recognised(d, lambda x: str(x.shape)).collect()} == {"a": "(1, 2)", "b": None}


def unpacked_lzw(data):
    bits, n, at, width, out, table, last = int.from_bytes(data, "big"), 8 * len(data), 0, 9, b"", {}, None
    while True:
        code = (bits >> (n - at - width)) & ((1 << width) - 1)
        at += width
        if code == 257:
            return out
        if code == 256:
            table, after, width, last = {i: bytes([i]) for i in range(256)}, 258, 9, None
            continue
        new = table[code] if code in table else last + last[:1]
        if last is not None:
            table[after] = last + new[:1]
            after += 1
            if after + 1 >= 1 << width and width < 12:
                width += 1
        out, last = out + new, new


def test_lzw_round_trip():
    import random

    from glyphlake.sources import images

    rng = random.Random(5)
    for n in (0, 1, 300, 20_000):
        for levels in (1, 2, 256):
            data = bytes(rng.randrange(levels) for _ in range(n))
            assert unpacked_lzw(images.lzw(data)) == data
    tiff = images.encode_tiff(2, 3, bytes(range(6)))
    assert tiff[:4] == b"II*\0" and unpacked_lzw(tiff[8 : 8 + tiff[8:].index(b"\x09\0\0\x01")].rstrip(b"\0")) == bytes(range(6))


def test_moments_are_saved(spark, tmp_path):
    from glyphlake.operators import tensors

    m = spark.createDataFrame([(0, 0.5, 0.1), (1, 0.25, 2.0)], "channel int, mean double, std double")
    tensors.save_moments(m, str(tmp_path / "m"))
    assert sorted(map(tuple, tensors.load_moments(spark, str(tmp_path / "m")).collect())) == [(0, 0.5, 0.1), (1, 0.25, 2.0)]


def png(rows, colour, width, extra=b"", depth=8):
    """A PNG of filtered rows."""
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, 0)
    return images.PNG + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(b"".join(map(bytes, rows)))) + chunk(b"IEND", b"")


def filtered(pixels, kinds, k):
    """Rows of bytes under PNG filters, written from the definition of each filter."""
    out = []
    for y, (row, kind) in enumerate(zip(pixels, kinds, strict=True)):
        line = [kind]
        for i, v in enumerate(row):
            a = row[i - k] if i >= k else 0
            b = pixels[y - 1][i] if y else 0
            c = pixels[y - 1][i - k] if y and i >= k else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(line)
    return out


def test_png_filters_and_colours(spark):
    import random

    draw = random.Random(3)
    for colour, k in images.CHANNELS.items():
        pixels = [[draw.randrange(4 if colour == 3 else 256) for _ in range(7 * k)] for _ in range(10)]
        palette = [(10, 20, 30), (0, 0, 0), (255, 255, 255), (1, 200, 3)]
        body = bytes(v for c in palette for v in c)
        import struct
        import zlib

        extra = struct.pack(">I", len(body)) + b"PLTE" + body + struct.pack(">I", zlib.crc32(b"PLTE" + body)) if colour == 3 else b""
        made = png(filtered(pixels, [0, 1, 2, 3, 4] * 2, k), colour, 7, extra)
        grey = []
        for row in pixels:
            for x in range(0, 7 * k, k):
                v = palette[row[x]] if colour == 3 else row[x : x + k]
                grey.append(v[0] if colour in (0, 4) else (299 * v[0] + 587 * v[1] + 114 * v[2]) // 1000)
        assert images.parse_png(made) == (10, 7, bytes(grey)), colour
    good = images.encode_png(2, 3, bytes(range(6)))
    bad = {"cut": good[:-20], "crc": good[:45] + b"x" + good[46:], "deep": png([[0, 1, 2]], 0, 1, depth=16), "filter": png([[9, 1]], 0, 1), "short": png([[0, 1]], 0, 2)}
    files = [("good", good), ("map", images.encode_pgm(1, 2, b"ab")), ("none", None), ("empty", b""), ("text", b"hello"), *bad.items()]
    rows = {r.image_id: r for r in images.read_images(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert bytes(rows["good"].data) == bytes(range(6)) and (rows["map"].height, rows["map"].width) == (1, 2)
    assert len(rows) == len(files) and all(rows[n].error and rows[n].data is None for n in ("none", "empty", "text", *bad))
