"""Archives by ranges of members, font tables in SQL, TIFF and mosaics."""

import io
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.functions import fonttables
from glyphlake.operators import tensors
from glyphlake.sources import images, zipsource


@pytest.fixture(scope="module")
def zips(spark):
    spark.dataSource.register(zipsource.ZipMembers)
    return lambda path, **options: spark.read.format("zip_members").options(**options).load(str(path))


def test_one_archive_is_read_by_many_tasks(zips, tmp_path):
    r = random.Random(1)
    want = {f"d{i % 7}/f{i}.bin": r.randbytes(r.randrange(0, 3000)) for i in range(400)}
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        z.mkdir("empty")
        for k, (name, data) in enumerate(want.items()):
            z.writestr(name, data, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        z.comment = b"a comment PK\x05\x06 that looks like an end"[:12]
    df = zips(tmp_path / "many.zip", split_bytes=40_000)
    got = df.withColumn("task", F.spark_partition_id()).collect()
    assert {x.member: bytes(x.content) for x in got} == want and len(got) == len(want)
    tasks = [x.task for x in got]
    assert len(set(tasks)) > 10 and tasks == sorted(tasks)
    for t in set(tasks):  # a task's members are together about a split
        assert sum(len(x.content) for x in got if x.task == t) < 80_000
    assert len({x.task for x in zips(tmp_path / "many.zip").withColumn("task", F.spark_partition_id()).collect()}) == 1


def test_damage_is_a_row(zips, tmp_path):
    (tmp_path / "sub").mkdir()
    with zipfile.ZipFile(tmp_path / "sub/a.zip", "w") as z:
        for name, how in (("plain", zipfile.ZIP_STORED), ("bad", zipfile.ZIP_DEFLATED), ("wrong", zipfile.ZIP_STORED), ("other", zipfile.ZIP_BZIP2), ("secret", zipfile.ZIP_STORED), ("é.txt", zipfile.ZIP_DEFLATED)):
            z.writestr(name, name * 50, how)
        places = {i.filename: i.header_offset for i in z.infolist()}
    data = bytearray((tmp_path / "sub/a.zip").read_bytes())
    for name in ("bad", "wrong"):
        data[places[name] + 30 + len(name)] ^= 0xFF
    at = data.index(b"secret", data.rindex(b"PK\x01\x02", 0, data.rindex(b"secret")))
    data[at - 46 + 8] |= 1  # the directory says that it is encrypted
    (tmp_path / "sub/a.zip").write_bytes(bytes(data))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    (tmp_path / "c.zip").write_bytes(bytes(data[:-40]))
    (tmp_path / "empty.zip").write_bytes(b"PK\x05\x06" + bytes(18))
    (tmp_path / "x.ZIP").write_bytes(b"not looked at")
    rows = zips(tmp_path).collect()
    by = {(x.archive.rsplit("/", 1)[1], x.member): x for x in rows}
    assert len(by) == len(rows) == 8
    assert bytes(by["a.zip", "plain"].content) == b"plain" * 50 and bytes(by["a.zip", "é.txt"].content) == "é.txt".encode() * 50
    for name, why in (("bad", "Damaged"), ("wrong", "checksum"), ("other", "method 12"), ("secret", "encrypted")):
        x = by["a.zip", name]
        assert x.content is None and why in x.error and x.size == 50 * len(name)
    assert by["b.zip", None].error and by["c.zip", None].error
    assert zips(tmp_path / "empty.zip").count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        zips(tmp_path / "missing").count()


def test_large_archives_have_large_numbers(tmp_path):
    """Sizes and places beyond 32 bits stand in fields of their own."""
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z, z.open("m", "w", force_zip64=True) as f:
        f.write(b"abc" * 100)
    with open(tmp_path / "l.zip", "rb") as f:
        begin, length, origin = zipsource.directory_of(f, (tmp_path / "l.zip").stat().st_size)
        f.seek(begin)
        (e,) = zipsource.entries(f.read(length))
        assert zipsource.inflated(f, e, origin) == b"abc" * 100
    extra = struct.pack("<2H3Q", 1, 24, 5 << 32, 6 << 32, 7 << 32)
    top = 0xFFFFFFFF
    assert zipsource._large(struct.pack("<2HI", 9, 4, 0) + extra, top, top, top) == (6 << 32, 5 << 32, 7 << 32)
    assert zipsource._large(extra, top, 12, 13) == (5 << 32, 12, 13)
    # an archive behind other bytes
    (tmp_path / "front.zip").write_bytes(b"#!/bin/sh\n" + (tmp_path / "l.zip").read_bytes())
    (s,) = zipsource.planned(str(tmp_path / "front.zip"), 1 << 20)
    assert s.origin == 10 and s.error is None
    end = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, length, begin) + struct.pack("<4sIQI", b"PK\x06\x07", 0, begin + length, 1) + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, top, top, 0)
    whole = (tmp_path / "l.zip").read_bytes()[: begin + length] + end
    assert zipsource.directory_of(io.BytesIO(whole), len(whole)) == (begin, length, 0)


def face(tables, sign=b"\x00\x01\x00\x00"):
    return sign + struct.pack(">4H", len(tables), 0, 0, 0) + b"".join(struct.pack(">4s3I", *t) for t in tables)


def test_font_tables_in_sql(spark):
    one = face([(b"glyf", 7, 12, 10), (b"name", 8, 40, 4)]) + bytes(20)
    two = struct.pack(">4sI3I", b"ttcf", 0x10000, 2, 20, 200) + face([(b"cmap", 1, 0, 5)], b"OTTO")
    rows = [(1, one), (2, two), (3, b"ttcf"), (4, b""), (5, None), (6, b"wOFF" + bytes(20)), (7, face([(b"glyf", 7, 12, 1000)])), (8, face([])), (9, one), (10, one[:30])]
    spark.createDataFrame([(k, None if d is None else bytearray(d)) for k, d in rows], "k int, content binary").createOrReplaceTempView("font_files")
    fonttables.register(spark)
    got = {}
    for r in spark.sql("SELECT k, t.* FROM font_files, LATERAL font_tables(content) t").collect():
        got.setdefault(r.k, []).append((r.face, r.tag, r.checksum, r.offset, r["length"], r.error is not None))
    assert got[1] == got[9] == [(0, "glyf", 7, 12, 10, False), (0, "name", 8, 40, 4, False)]
    assert got[2] == [(0, "cmap", 1, 0, 5, False), (1, None, None, None, None, True)]
    assert got[7] == [(0, "glyf", 7, 12, 1000, True)]
    for k, f in ((3, None), (4, 0), (6, 0), (10, 0)):
        assert got[k] == [(f, None, None, None, None, True)]
    assert 5 not in got and 8 not in got


def picture(seed, h, w):
    r = np.random.default_rng(seed)
    kinds = [lambda: r.integers(0, 256, (h, w)), lambda: np.zeros((h, w)), lambda: np.add.outer(np.arange(h), np.arange(w)) % 256, lambda: r.integers(0, 2, (h, w)) * 255]
    return kinds[seed % 4]().astype(np.uint8)


def test_lzw_there_and_back():
    r = random.Random(8)
    for data in (b"", b"a", b"aaaa" * 5000, bytes(range(256)) * 200, r.randbytes(60_000), bytes(r.choices(b"ab", k=40_000))):
        assert images.unlzw(images.lzw(data), len(data)) == data
    packed = images.lzw(b"hello hello hello")
    for bad in (b"", packed[:3], b"\x80\x7f\xff\xff"):
        with pytest.raises(ValueError):
            images.unlzw(bad, 100)


def tiff(rows, order="<", packing=1, kind=1, per_strip=None, predictor=1):
    """A TIFF of strips behind its directory, of an array of (height, width, samples)."""
    h, w, k = rows.shape
    per_strip = per_strip or h
    data = rows.copy()
    if predictor == 2:
        data[:, 1:] = rows[:, 1:] - rows[:, :-1]
    import zlib

    pack = {1: bytes, 5: images.lzw, 8: zlib.compress}[packing]
    strips = [pack(data[y : y + per_strip].tobytes()) for y in range(0, h, per_strip)]
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [8] * k), (259, 3, [packing]), (262, 3, [kind]), (273, 4, [0] * len(strips)), (277, 3, [k]), (278, 3, [per_strip]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor]), (305, 2, [0])]
    size = {3: ("H", 2), 4: ("I", 4), 2: ("B", 1)}
    for _ in range(2):
        at, entries, more = 8 + 2 + 12 * len(tags) + 4, b"", b""
        for tag, t, values in tags:
            letter, n = size[t]
            body = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(body) > 4:
                entries += struct.pack(order + "HHII", tag, t, len(values), at + len(more))
                more += body
            else:
                entries += struct.pack(order + "HHI", tag, t, len(values)) + body.ljust(4, b"\0")
        first = at + len(more)
        places = [first + sum(map(len, strips[:i])) for i in range(len(strips))]
        tags = [(tag, t, places if tag == 273 else v) for tag, t, v in tags]
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HIH", 42, 8, len(tags)) + entries + bytes(4) + more + b"".join(strips)


def test_tiff_of_all_kinds():
    for seed in range(8):
        p = picture(seed, 13, 21)
        assert images.parse(images.encode_tiff(13, 21, p.tobytes())) == (13, 21, p.tobytes())
        for order in "<>":
            for packing in (1, 5, 8):
                for per_strip in (None, 4):
                    for predictor in (1, 2):
                        got = images.parse(tiff(p[:, :, None], order, packing, 1, per_strip, predictor))
                        assert got == (13, 21, p.tobytes())
    colour = np.stack([picture(s, 5, 6) for s in (0, 4, 8)], axis=2)
    grey = (colour.astype(int) @ np.array([299, 587, 114]) // 1000).astype(np.uint8)
    assert images.parse(tiff(colour, ">", 5, 2, 2, 2)) == (5, 6, grey.tobytes())
    assert images.parse(tiff(p[:, :, None], kind=0))[2] == (255 - p).tobytes()
    whole = tiff(p[:, :, None], packing=5)
    for bad in (b"II", b"II*\0\xff\xff\0\0", whole[:-30], whole[:40], tiff(p[:, :, None]).replace(struct.pack("<HHIH", 259, 3, 1, 1), struct.pack("<HHIH", 259, 3, 1, 7))):
        with pytest.raises(ValueError):
            images.parse(bad)


def test_changed_pixels(spark):
    rows = [(str(i), 13, 21, bytearray(picture(i, 13, 21).tobytes()), None) for i in range(6)]
    before = spark.createDataFrame(rows, images.IMAGE)
    for style, suffix in images.STYLES.items():
        files = images.encoded(before, style).withColumnRenamed("name", "path")
        after = images.read_images(files).withColumn("image_id", F.replace("image_id", F.lit(suffix), F.lit("")))
        assert [r.changed for r in images.changed_pixels(before, after).collect()] == [0] * 6
    rows[1][3][5] ^= 1
    rows[1][3][90] ^= 9
    other = spark.createDataFrame([rows[0], rows[1], (*rows[2][:1], 21, 13, *rows[2][3:])], images.IMAGE)
    assert {r.image_id: r.changed for r in images.changed_pixels(before, other).collect()} == {"0": 0, "1": 2, **{k: 273 for k in "2345"}}


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 10, 16])
def test_mosaics_against_a_grid(spark, n):
    r = np.random.default_rng(n)
    tiles = r.integers(0, 9, (n, 3, 2)) / 4
    d = spark.createDataFrame([(i, y, tiles[i, y].tolist()) for i in range(n) for y in range(3)], "i bigint, line int, pixels array<double>").repartition(3)
    got = {x.line: x.pixels for x in tensors.mosaic_lines(d, n).collect()}
    w = int(np.ceil(n**0.5))
    want = np.full((-(-n // w) * 3 if n else 0, w * 2), 0.5)
    for i in range(n):
        want[i // w * 3 : i // w * 3 + 3, i % w * 2 : i % w * 2 + 2] = tiles[i]
    assert sorted(got) == list(range(len(want))) and all(got[y] == want[y].tolist() for y in got)


def test_a_task_holds_one_archive_of_a_bounded_number_of_members(spark, tmp_path):
    from glyphlake.plans import format_queries

    parts = spark.range(95).selectExpr("id AS p_partkey", "'part ' || id AS p_name").coalesce(1)
    counts = [r.n for r in parts.mapInArrow(format_queries._archive(str(tmp_path), most=20), "n bigint").collect()]
    assert sorted(counts) == [15, 20, 20, 20, 20]
    spark.dataSource.register(zipsource.ZipMembers)
    found = spark.read.format("zip_members").load(str(tmp_path)).collect()
    assert {r.member: r.content and bytes(r.content).decode() for r in found} == {f"parts/p{k}.txt": None if k % 10 == 9 else f"part {k}" for k in range(95)}
    assert len(found) == 95 and len({r.archive for r in found}) == 5
