"""Rasterising fonts with the system's FreeType library, if there is one, and painting glyphs on a canvas.

Only loading and rasterising need Python: a partition opens the library once and each font once. Placement, identity and
counters are column expressions over the rows that come out (geometry, glyphs, verdicts).
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GLYPH = (
    "font_id string, face int, row int, idx int, ch string, rows int, width int, bitmap_left int, bitmap_top int, adv_x int, adv_y int, bitmap binary, "
    "load_failed boolean, font_not_loaded boolean"
)
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.int32()] * 6, pa.binary(), pa.bool_(), pa.bool_()]
_NAMES = [x.split()[0] for x in GLYPH.split(", ")]
#: FT_LOAD_RENDER, and the pixel mode of 8-bit grey.
LOAD_RENDER, GREY = 4, 2


class _Bitmap(ctypes.Structure):
    _fields_ = [
        ("rows", ctypes.c_uint), ("width", ctypes.c_uint), ("pitch", ctypes.c_int), ("buffer", ctypes.POINTER(ctypes.c_ubyte)),
        ("num_grays", ctypes.c_ushort), ("pixel_mode", ctypes.c_ubyte), ("palette_mode", ctypes.c_ubyte), ("palette", ctypes.c_void_p),
    ]


class _Generic(ctypes.Structure):
    _fields_ = [("data", ctypes.c_void_p), ("finalizer", ctypes.c_void_p)]


class _Vector(ctypes.Structure):
    _fields_ = [("x", ctypes.c_long), ("y", ctypes.c_long)]


class _Metrics(ctypes.Structure):
    _fields_ = [(n, ctypes.c_long) for n in "width height hx hy ha vx vy va".split()]


class _Slot(ctypes.Structure):
    _fields_ = [
        ("library", ctypes.c_void_p), ("face", ctypes.c_void_p), ("next", ctypes.c_void_p), ("index", ctypes.c_uint), ("generic", _Generic),
        ("metrics", _Metrics), ("lx", ctypes.c_long), ("ly", ctypes.c_long), ("advance", _Vector), ("format", ctypes.c_int),
        ("bitmap", _Bitmap), ("left", ctypes.c_int), ("top", ctypes.c_int),
    ]


class _Face(ctypes.Structure):
    _fields_ = [
        ("num_faces", ctypes.c_long), ("face_index", ctypes.c_long), ("face_flags", ctypes.c_long), ("style_flags", ctypes.c_long), ("num_glyphs", ctypes.c_long),
        ("family", ctypes.c_char_p), ("style", ctypes.c_char_p), ("num_fixed", ctypes.c_int), ("sizes", ctypes.c_void_p), ("num_maps", ctypes.c_int),
        ("maps", ctypes.c_void_p), ("generic", _Generic), ("bbox", ctypes.c_long * 4), ("units", ctypes.c_ushort), ("ascender", ctypes.c_short),
        ("descender", ctypes.c_short), ("height", ctypes.c_short), ("maw", ctypes.c_short), ("mah", ctypes.c_short), ("up", ctypes.c_short),
        ("ut", ctypes.c_short), ("glyph", ctypes.POINTER(_Slot)),
    ]


def available() -> bool:
    return ctypes.util.find_library("freetype") is not None


class FreeType:
    def __init__(self) -> None:
        name = ctypes.util.find_library("freetype")
        if name is None:
            raise RuntimeError("the FreeType library is not installed")
        self.ft = ctypes.CDLL(name)
        self.ft.FT_New_Memory_Face.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_long, ctypes.c_long, ctypes.POINTER(ctypes.POINTER(_Face))]
        self.ft.FT_Set_Char_Size.argtypes = [ctypes.POINTER(_Face), ctypes.c_long, ctypes.c_long, ctypes.c_uint, ctypes.c_uint]
        self.ft.FT_Load_Char.argtypes = [ctypes.POINTER(_Face), ctypes.c_ulong, ctypes.c_int32]
        self.ft.FT_Done_Face.argtypes = [ctypes.POINTER(_Face)]
        self.lib = ctypes.c_void_p()
        if self.ft.FT_Init_FreeType(ctypes.byref(self.lib)):
            raise RuntimeError("FreeType does not start")

    def faces(self, data: bytes) -> int:
        """How many faces a font file has; 0 for what is no font."""
        face = ctypes.POINTER(_Face)()
        if self.ft.FT_New_Memory_Face(self.lib, data, len(data), -1, ctypes.byref(face)):
            return 0
        n = face.contents.num_faces
        self.ft.FT_Done_Face(face)
        return n

    def glyphs(self, font_id: str, data: bytes, lines: list[str], point: int, dpi: int, index: int = 0) -> Iterator[tuple]:
        """Rows of GLYPH for every symbol of the lines; one row that says so if the font does not load."""
        face = ctypes.POINTER(_Face)()
        failed = self.ft.FT_New_Memory_Face(self.lib, data, len(data), index, ctypes.byref(face))
        if failed or self.ft.FT_Set_Char_Size(face, 0, point * 64, dpi, dpi):
            if not failed:
                self.ft.FT_Done_Face(face)
            yield (font_id, index, *[None] * 10, True, True)
            return
        for r, line in enumerate(lines):
            for k, ch in enumerate(line):
                slot = None if self.ft.FT_Load_Char(face, ord(ch), LOAD_RENDER) else face.contents.glyph.contents
                b = slot.bitmap if slot else None
                if slot is None or b.rows and b.pixel_mode != GREY:
                    yield (font_id, index, r, k, ch, *[None] * 7, True, False)
                    continue
                size = b.rows * abs(b.pitch)
                raw = np.ctypeslib.as_array(b.buffer, (size,)).reshape(b.rows, abs(b.pitch)) if size else np.zeros((0, 0), np.uint8)
                raw = raw if b.pitch >= 0 else raw[::-1]
                yield (font_id, index, r, k, ch, b.rows, b.width, slot.left, slot.top, slot.advance.x, slot.advance.y, raw[:, : b.width].tobytes(), False, False)
        self.ft.FT_Done_Face(face)


def rendered(files: DataFrame, lines: list[str], point: int = 72, dpi: int = 110) -> DataFrame:
    """files (path, content) as glyph rows; a font that does not load is one row, a failing symbol a row without bitmap."""
    return rendered_sizes(files, lines, [(point, dpi)]).drop("point", "dpi")


def rendered_sizes(files: DataFrame, lines: list[str], sizes: list[tuple[int, int]]) -> DataFrame:
    """Glyph rows at each of the sizes (point, dpi), with these as columns; each file is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ft = FreeType()
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = data.as_py() or b""
                for point, dpi in sizes:
                    rows = [(*r, point, dpi) for r in ft.glyphs(path, data, lines, point, dpi)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*_NAMES, "point", "dpi"])

    kinds = [*_KINDS, pa.int32(), pa.int32()]
    return files.select("path", "content").mapInArrow(run, f"{GLYPH}, point int, dpi int")


def face_counts(files: DataFrame) -> DataFrame:
    """(path, faces): the faces in each font file, 0 for what does not load."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ft = FreeType()
        for batch in batches:
            n = [ft.faces(d.as_py() or b"") for d in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(n, pa.int32())], names=["path", "faces"])

    return files.select("path", "content").mapInArrow(run, "path string, faces int")


def identity_key() -> list[Column]:
    """What glyphs of a font must share to be drawn alike: area, offsets from the pen, and bytes."""
    return [
        (F.col("rows") * F.col("width")).alias("area"), F.col("off_x"), F.col("off_y"),
        F.sha2("bitmap", 256).alias("pixels"),
    ]


def paint(glyphs: list[tuple[int, int, np.ndarray]], height: int, width: int, blend: bool = True, boxes: list | None = None) -> tuple[np.ndarray, int, tuple[int, int, int, int] | None, list[bool]]:
    """Glyphs (x, y, pixels) on a canvas: (canvas, overwrites, box of drawn pixels or None, whether each drew nothing).

    Pixels outside the canvas are left out, so a glyph wholly outside counts as having drawn nothing. boxes: for each
    glyph the corners (left, top, right, bottom) of a rectangle to draw first, or None.
    """
    canvas = np.zeros((height, width), np.uint8)
    overwrites, box, empty = 0, None, []
    for k, (x, y, g) in enumerate(glyphs):
        if boxes and boxes[k]:
            outline(canvas, *boxes[k])
        top, left = max(0, -y), max(0, -x)
        part = g[top : max(top, min(g.shape[0], height - y)), left : max(left, min(g.shape[1], width - x))]
        drawn = part > 0
        empty.append(not drawn.any())
        if empty[-1]:
            continue
        there = canvas[y + top : y + top + part.shape[0], x + left : x + left + part.shape[1]]
        overwrites += int((drawn & (there > 0)).sum())
        alpha = part.astype(np.float32) / np.float32(255)
        mixed = (np.float32(255) * (alpha + there.astype(np.float32) / np.float32(255) * (np.float32(1) - alpha))).astype(np.uint8) if blend else part
        there[drawn] = mixed[drawn]
        rows, cols = np.flatnonzero(drawn.any(1)) + y + top, np.flatnonzero(drawn.any(0)) + x + left
        new = (int(cols[0]), int(rows[0]), int(cols[-1]), int(rows[-1]))
        box = new if box is None else (min(box[0], new[0]), min(box[1], new[1]), max(box[2], new[2]), max(box[3], new[3]))
    return canvas, overwrites, box, empty


def outline(canvas: np.ndarray, left: int, top: int, right: int, bottom: int, grey: int = 128) -> None:
    """A rectangle one pixel wide, corners included, as far as it lies on the canvas."""
    rows, cols = slice(max(0, top), max(0, bottom + 1)), slice(max(0, left), max(0, right + 1))
    for y in (top, bottom):
        if 0 <= y < canvas.shape[0]:
            canvas[y, cols] = grey
    for x in (left, right):
        if 0 <= x < canvas.shape[1]:
            canvas[rows, x] = grey


def recognition_crop(canvas: np.ndarray, box: tuple[int, int, int, int] | None, pad: int) -> np.ndarray | None:
    """The drawn part with a margin, dark on light; None if nothing is drawn."""
    if box is None:
        return None
    left, top, right, bottom = box
    return 255 - np.pad(canvas[top : bottom + 1, left : right + 1], pad)


def recognised(images: DataFrame, ocr, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The keys of images (*keys, height, width, data) with text by ocr(array) -> str, any recogniser that workers can import."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("height", "width", "data"))
            texts = [None if not d else ocr(np.frombuffer(d, np.uint8).reshape(h, w)) for h, w, d in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), pa.array(texts, pa.string())], names=[*keys, "ocr_text"])

    kinds = images.select(*keys).schema.add("ocr_text", "string")
    return images.select(*keys, "height", "width", "data").mapInArrow(run, kinds)
