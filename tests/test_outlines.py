"""Outlines of fonts, against the system's library where there is one."""

import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.operators import coverage, raster
from glyphlake.plans import programs
from glyphlake.sources import outlines

FONTS = sorted(Path("/usr/share/fonts").rglob("DejaVu*.ttf"))
#: What FT_Load_Char does without fitting to the grid.
PLAIN = raster.LOAD_RENDER | 2

pytestmark = pytest.mark.filterwarnings("ignore")
needs_fonts = pytest.mark.skipif(not FONTS or not raster.available(), reason="no fonts or no library here")


def font_rows(spark, names):
    return spark.createDataFrame([(n, bytearray(d)) for n, d in names.items()], "path string, content binary")


@needs_fonts
def test_bitmaps_are_those_of_the_library(spark, monkeypatch):
    monkeypatch.setattr(raster, "LOAD_RENDER", PLAIN)
    lines = ["AgQ&éÅ", "% iW@Б"]
    data = {p.name: p.read_bytes() for p in FONTS[:3]}
    sizes = [(12, 110), (72, 96)]
    got = {(r.font_id, r.row, r.idx, r.point): r for r in outlines.rendered_sizes(font_rows(spark, data), lines, sizes).collect()}
    ft = raster.FreeType()
    names = [x.split()[0] for x in raster.GLYPH.split(", ")]
    n = 0
    for name, content in data.items():
        for point, dpi in sizes:
            for row in ft.glyphs(name, content, lines, point, dpi):
                want = dict(zip(names, row, strict=True))
                r = got[name, want["row"], want["idx"], point]
                assert r.load_failed == want["load_failed"] is False
                assert (r.rows, r.width, r.bitmap_left, r.bitmap_top) == tuple(want[c] for c in ("rows", "width", "bitmap_left", "bitmap_top")), (name, r.ch)
                a, b = (np.frombuffer(bytes(x), np.uint8).astype(int) for x in (r.bitmap, want["bitmap"]))
                assert len(a) == len(b)
                if len(a):  # the library flattens curves less finely
                    assert np.abs(a - b).max() <= 32 and np.abs(a - b).mean() <= 3.2, (name, r.ch, point)
                assert abs(r.adv_x - want["adv_x"]) <= 32
                n += 1
    assert n == len(got) == 3 * 2 * 12


@needs_fonts
def test_programs_without_a_library(spark, tmp_path):
    for k, p in enumerate(FONTS[:2]):
        (tmp_path / f"{k}.ttf").write_bytes(p.read_bytes())
    (tmp_path / "bad.ttf").write_bytes(b"no font")
    symbols = "AIl|O0 "
    verdicts = {r.font_id.rsplit("/", 1)[1]: r.verdict for r in programs.bad_fonts(spark, str(tmp_path), symbols=symbols, renderer=outlines.rendered_sizes).collect()}
    assert verdicts == {"0.ttf": "keep", "1.ttf": "keep", "bad.ttf": "failed_font_loads"}
    both = [programs.atlases(spark, str(tmp_path), ["AQ", "g"], [{"dpi": 96, "point": 40}], renderer=r).orderBy("image_id").collect() for r in (raster.rendered_sizes, outlines.rendered_sizes)]
    assert len(both[0]) == len(both[1]) == 2
    for a, b in zip(*both, strict=True):
        assert (a.height, a.width, a.empty) == (b.height, b.width, b.empty)
        x, y = (np.frombuffer(bytes(r.data), np.uint8).astype(int) for r in (a, b))
        assert abs(x.sum() - y.sum()) < 0.05 * x.sum()


def table_font(tables, sign=b"\0\1\0\0"):
    head, data, at = struct.pack(">4s4H", sign, len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for tag, body in tables.items():
        head += struct.pack(">4s3I", tag, 0, at + len(data), len(body))
        data += body
    return head + data


def simple(*contours, short=False):
    points = [p for c in contours for p in c]
    ends, n = [], 0
    for c in contours:
        n += len(c)
        ends.append(n - 1)
    body = struct.pack(">5h", len(contours), 0, 0, 0, 0) + struct.pack(f">{len(ends)}HH", *ends, 0)
    xs, ys = ([b - a for a, b in zip([0] + v, v, strict=False)] for v in ([p[0] for p in points], [p[1] for p in points]))
    flags, parts = b"", [b"", b""]
    for dx, dy, p in zip(xs, ys, points, strict=True):
        flag = int(p[2])
        for axis, (d, s, same) in enumerate(((dx, 2, 16), (dy, 4, 32))):
            if d == 0:
                flag |= same
            elif short and abs(d) < 256:
                flag |= s | (same if d > 0 else 0)
                parts[axis] += bytes([abs(d)])
            else:
                parts[axis] += struct.pack(">h", d)
        flags += bytes([flag])
    if short and len(set(flags)) == 1:
        flags = bytes([flags[0] | 8, len(flags) - 1])
    return body + flags + b"".join(parts)


def made_font(glyphs, cmap, long=True, advances=None):
    places = [0]
    for g in glyphs:
        places.append(places[-1] + len(g) + len(g) % 2)
    loca = struct.pack(f">{len(places)}I", *places) if long else struct.pack(f">{len(places)}H", *(p // 2 for p in places))
    advances = advances or [100] * len(glyphs)
    return table_font({
        b"cmap": cmap, b"glyf": b"".join(g + bytes(len(g) % 2) for g in glyphs), b"head": bytes(18) + struct.pack(">H", 1000) + bytes(30) + struct.pack(">2h", int(long), 0),
        b"hhea": bytes(34) + struct.pack(">H", len(advances)), b"hmtx": b"".join(struct.pack(">Hh", a, 0) for a in advances), b"loca": loca, b"maxp": bytes(4) + struct.pack(">H", len(glyphs)),
    })


def cmap(form, body, kind=(3, 1)):
    return struct.pack(">4HI", 0, 1, *kind, 12) + struct.pack(">H", form) + body


SQUARE = [(0, 0, True), (500, 0, True), (500, 300, True), (0, 300, True)]


def test_contours_parts_and_characters():
    a, b = simple(SQUARE, short=True), simple(SQUARE, [(100, 100, True), (400, -700, False), (400, 200, False)])
    moved = struct.pack(">5h", -1, 0, 0, 0, 0) + struct.pack(">2H2h", 0x1 | 0x2 | 0x20, 1, 10, -20) + struct.pack(">2H2bh", 0x2 | 0x8, 2, 5, 6, 8192)
    tied = struct.pack(">5h", -1, 0, 0, 0, 0) + struct.pack(">2H2b", 0x2 | 0x20, 1, 0, 0) + struct.pack(">2H2B4h", 0x80, 1, 2, 0, 0, 16384, -16384, 0)
    loop = struct.pack(">5h", -1, 0, 0, 0, 0) + struct.pack(">2H2b", 0x2, 5, 0, 0)
    glyphs = [b"", a, b, moved, tied, loop]
    six = cmap(6, struct.pack(">4H", 20, 0, 65, 5) + struct.pack(">5H", 1, 2, 3, 4, 5))
    for long in (True, False):
        f = outlines.Face(made_font(glyphs, six, long, [50, 60, 70]), 0)
        assert (f.units, f.glyphs, [f.advance(g) for g in range(5)]) == (1000, 6, [50, 60, 70, 70, 70])
        square = [(float(x), float(y), on) for x, y, on in SQUARE]
        assert f.contours(0) == [] and f.contours(1) == [square]
        assert f.contours(2) == [square, [(100.0, 100.0, True), (400.0, -700.0, False), (400.0, 200.0, False)]]
        assert f.contours(3)[0] == [(x + 10, y - 20, on) for x, y, on in square] and f.contours(3)[1] == [(x / 2 + 5, y / 2 + 6, on) for x, y, on in square]
        turned = [(-y, x, on) for x, y, on in square]  # its first point on the third of the square
        assert f.contours(4)[1] == [(x + 500, y + 300, on) for x, y, on in turned]
        with pytest.raises(ValueError, match="in itself"):
            f.contours(5)
        assert [f.lookup(c) for c in (64, 65, 69, 70, 70_000)] == [0, 1, 5, 0, 0]
    # two runs of characters, one by a difference, one by a list
    four = struct.pack(">6H", 0, 0, 6, 0, 0, 0) + struct.pack(">3H", 66, 100, 0xFFFF) + bytes(2) + struct.pack(">3H", 65, 99, 0xFFFF) + struct.pack(">3H", (1 - 65) & 0xFFFF, 1, 1) + struct.pack(">3H", 0, 4, 0) + struct.pack(">2H", 3, 0)
    f = outlines.Face(made_font(glyphs, cmap(4, four)), 0)
    assert [f.lookup(c) for c in (64, 65, 66, 67, 98, 99, 100, 101, 0xFFFF, 0x1F600)] == [0, 1, 2, 0, 0, 4, 0, 0, 0, 0]
    twelve = struct.pack(">HIII", 0, 0, 0, 2) + struct.pack(">6I", 65, 70, 1, 0x1F600, 0x1F601, 3)
    f = outlines.Face(made_font(glyphs, cmap(12, twelve, (3, 10))), 0)
    assert [f.lookup(c) for c in (64, 65, 70, 71, 0x1F600, 0x1F601, 0x1F602)] == [0, 1, 6, 0, 3, 4, 0]
    f = outlines.Face(made_font(glyphs, cmap(6, struct.pack(">4H", 20, 0, 0xF041, 1) + struct.pack(">H", 2), (3, 0))), 0)
    assert f.lookup(0x41) == 2
    f = outlines.Face(made_font(glyphs, cmap(0, struct.pack(">2H", 262, 0) + bytes([k % 5 for k in range(256)]), (1, 0))), 0)
    assert f.lookup(66) == 1 and f.lookup(300) == 0


def test_damaged_fonts_are_rows(spark):
    six = cmap(6, struct.pack(">4H", 20, 0, 65, 2) + struct.pack(">2H", 1, 9))
    good = made_font([b"", simple(SQUARE)], six)
    two = struct.pack(">4sI3I", b"ttcf", 0x10000, 2, 20, 4) + bytes(10)
    d = font_rows(spark, {"good": good, "cut": good[:100], "none": b"", "cff": table_font({b"CFF ": b"x"}, b"OTTO"), "two": two, "glyf": good.replace(simple(SQUARE), simple(SQUARE)[:12] + b"\xff" * (len(simple(SQUARE)) - 12))})
    d = d.unionByName(spark.createDataFrame([("null", None)], d.schema))
    rows = outlines.outlines(d, ["AB"], every_face=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.font_id, []).append(r)
    assert [(r.ch, r.load_failed, r.font_not_loaded) for r in by["good"]] == [("A", False, False), ("B", True, False)]
    for name, n in (("cut", 1), ("none", 1), ("cff", 1), ("two", 2), ("null", 1)):
        assert len(by[name]) == n and all(r.font_not_loaded and r.error for r in by[name])
    assert [r.load_failed for r in by["glyf"]] == [True, True]
    g = coverage.glyphs(outlines.outlines(d, ["AA A"]), [(10, 72), (100, 72)]).where("font_id = 'good'").orderBy("point", "idx").collect()
    assert [(r.idx, r.ch, r.rows, r.width, r.adv_x) for r in g if r.point == 100] == [(0, "A", 30, 50, 640), (1, "A", 30, 50, 640), (2, " ", 0, 0, 640), (3, "A", 30, 50, 640)]
    assert all(bytes(r.bitmap) == b"\xff" * (r.rows * r.width) for r in g)
    assert outlines.outlines(d.limit(0), ["A"]).count() == 0
    assert coverage.glyphs(outlines.outlines(d, ["A"]), [(10, 72)]).where(F.col("font_id") == "null").first().font_not_loaded
