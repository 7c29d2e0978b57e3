"""Glyphs of TrueType fonts as outlines in rows, read from the bytes of the files.

The tables of a face give its characters, advances and contours; only the symbols that are asked for are read. Outlines
are rows that built-in functions can scale, flatten and rasterise.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glyphlake.functions.fonttables import HEAD, RECORD, face_places
from glyphlake.operators import coverage
from glyphlake.session import checkpointed

POINT = "struct<x:double,y:double,on:boolean>"
OUTLINE = f"font_id string, face int, row int, idx int, ch string, units int, advance int, contours array<array<{POINT}>>, load_failed boolean, font_not_loaded boolean, error string"
#: Fixed values of the format: the flags of points and of parts, how deep parts may lie in parts, and the preferred tables of characters.
ON, X_SHORT, Y_SHORT, REPEAT, X_SAME, Y_SAME = 1, 2, 4, 8, 16, 32
WORDS, OFFSETS, SCALE, MORE, TWO_SCALES, MATRIX = 0x1, 0x2, 0x8, 0x20, 0x40, 0x80
DEEPEST = 8
CHARACTERS = ((3, 10), (0, 6), (0, 4), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0), (3, 0), (1, 0))
#: Where fonts of symbols have the characters below 256.
SYMBOLS = 0xF000


class Face:
    """One face of a font file. What cannot be read raises ValueError."""

    def __init__(self, data: bytes, at: int):
        self.data = data
        try:
            _, n, *_ = HEAD.unpack_from(data, at)
            records = (RECORD.unpack_from(data, at + HEAD.size + RECORD.size * i) for i in range(n))
            self.tables = {tag: (offset, length) for tag, _, offset, length in records}
            head, maxp, hhea = (self.tables[t][0] for t in (b"head", b"maxp", b"hhea"))
            (self.units,) = struct.unpack_from(">H", data, head + 18)
            (self.long,) = struct.unpack_from(">h", data, head + 50)
            (self.glyphs,) = struct.unpack_from(">H", data, maxp + 4)
            (self.advances,) = struct.unpack_from(">H", data, hhea + 34)
            self.glyf, self.loca, self.hmtx = (self.tables[t][0] for t in (b"glyf", b"loca", b"hmtx"))
            self.lookup = self._characters()
        except KeyError as e:
            raise ValueError(f"the font has no table {e.args[0].decode('latin-1')}") from e
        except struct.error as e:
            raise ValueError("the font is cut off") from e
        if not self.units or not self.advances:
            raise ValueError("the font has no size or no advances")

    def _characters(self):
        at = self.tables[b"cmap"][0]
        (n,) = struct.unpack_from(">H", self.data, at + 2)
        places = {}
        for i in range(n):
            platform, encoding, offset = struct.unpack_from(">HHI", self.data, at + 4 + 8 * i)
            places.setdefault((platform, encoding), at + offset)
        for kind in CHARACTERS:
            if kind in places:
                (form,) = struct.unpack_from(">H", self.data, places[kind])
                if form in (0, 4, 6, 12):
                    find = getattr(self, f"_form{form}")
                    where = places[kind]
                    if kind == (3, 0):
                        return lambda c: find(where, c) or find(where, SYMBOLS + c)
                    return lambda c: find(where, c)
        raise ValueError("the font has no table of characters that is read")

    def _form0(self, at: int, c: int) -> int:
        return self.data[at + 6 + c] if c < 256 else 0

    def _form4(self, at: int, c: int) -> int:
        if c > 0xFFFF:
            return 0
        (twice,) = struct.unpack_from(">H", self.data, at + 6)
        n = twice // 2
        ends = struct.unpack_from(f">{n}H", self.data, at + 14)
        k = next((i for i, end in enumerate(ends) if end >= c), n)
        if k == n:
            return 0
        start, delta, place = (struct.unpack_from(">H", self.data, at + 16 + part * twice + 2 * k)[0] for part in (1, 2, 3))
        if c < start:
            return 0
        if not place:
            return (c + delta) & 0xFFFF
        (g,) = struct.unpack_from(">H", self.data, at + 16 + 3 * twice + 2 * k + place + 2 * (c - start))
        return (g + delta) & 0xFFFF if g else 0

    def _form6(self, at: int, c: int) -> int:
        first, n = struct.unpack_from(">HH", self.data, at + 6)
        return struct.unpack_from(">H", self.data, at + 10 + 2 * (c - first))[0] if first <= c < first + n else 0

    def _form12(self, at: int, c: int) -> int:
        (n,) = struct.unpack_from(">I", self.data, at + 12)
        low, high = 0, n
        while low < high:  # the last group that begins at c or before
            mid = (low + high) // 2
            if struct.unpack_from(">I", self.data, at + 16 + 12 * mid)[0] <= c:
                low = mid + 1
            else:
                high = mid
        if not low:
            return 0
        start, end, first = struct.unpack_from(">3I", self.data, at + 16 + 12 * (low - 1))
        return first + c - start if c <= end else 0

    def advance(self, glyph: int) -> int:
        return struct.unpack_from(">H", self.data, self.hmtx + 4 * min(glyph, self.advances - 1))[0]

    def contours(self, glyph: int, depth: int = 0) -> list[list[tuple[float, float, bool]]]:
        """The contours of a glyph, y upward, in the font's units; parts are put together."""
        if not 0 <= glyph < self.glyphs or depth > DEEPEST:
            raise ValueError("a glyph is not there, or lies in itself")
        kind, size, by = (">2I", 4, 1) if self.long else (">2H", 2, 2)
        begin, end = (by * x for x in struct.unpack_from(kind, self.data, self.loca + size * glyph))
        if begin >= end:
            return []
        at = self.glyf + begin
        (n,) = struct.unpack_from(">h", self.data, at)
        return self._parts(at + 10, depth) if n < 0 else self._simple(at + 10, n)

    def _simple(self, at: int, n: int) -> list[list[tuple[float, float, bool]]]:
        if not n:
            return []
        ends = struct.unpack_from(f">{n}H", self.data, at)
        at += 2 * n
        (code,) = struct.unpack_from(">H", self.data, at)
        at += 2 + code
        flags: list[int] = []
        while len(flags) <= ends[-1]:
            flag = self._byte(at)
            at += 1
            times = 1
            if flag & REPEAT:
                times += self._byte(at)
                at += 1
            flags += [flag] * times
        del flags[ends[-1] + 1 :]
        places = []
        for short, same in ((X_SHORT, X_SAME), (Y_SHORT, Y_SAME)):
            here, line = 0, []
            for flag in flags:
                if flag & short:
                    here += self._byte(at) if flag & same else -self._byte(at)
                    at += 1
                elif not flag & same:
                    here += struct.unpack_from(">h", self.data, at)[0]
                    at += 2
                line.append(float(here))
            places.append(line)
        points = [(x, y, bool(flag & ON)) for x, y, flag in zip(*places, flags, strict=True)]
        out, first = [], 0
        for end in ends:
            out.append(points[first : end + 1])
            first = end + 1
        return [c for c in out if c]

    def _byte(self, at: int) -> int:
        if at >= len(self.data):
            raise ValueError("an outline is cut off")
        return self.data[at]

    def _parts(self, at: int, depth: int) -> list[list[tuple[float, float, bool]]]:
        out: list[list[tuple[float, float, bool]]] = []
        flags = MORE
        while flags & MORE:
            flags, glyph = struct.unpack_from(">HH", self.data, at)
            kind = ("hh" if flags & OFFSETS else "HH") if flags & WORDS else ("bb" if flags & OFFSETS else "BB")
            one, two = struct.unpack_from(">" + kind, self.data, at + 4)
            at += 8 if flags & WORDS else 6
            a, b, c, d = 1.0, 0.0, 0.0, 1.0
            fixed = lambda n: [v / 16384 for v in struct.unpack_from(f">{n}h", self.data, at)]  # noqa: E731, B023
            if flags & SCALE:
                (a,) = fixed(1)
                d, at = a, at + 2
            elif flags & TWO_SCALES:
                a, d = fixed(2)
                at += 4
            elif flags & MATRIX:
                a, b, c, d = fixed(4)
                at += 8
            part = [[(a * x + c * y, b * x + d * y, on) for x, y, on in line] for line in self.contours(glyph, depth + 1)]
            if flags & OFFSETS:
                dx, dy = one, two
            else:  # a point of the part lies on one of what there is
                there, here = [p for line in out for p in line], [p for line in part for p in line]
                if one >= len(there) or two >= len(here):
                    raise ValueError("a part is tied to a point that is not there")
                dx, dy = there[one][0] - here[two][0], there[one][1] - here[two][1]
            out += [[(x + dx, y + dy, on) for x, y, on in line] for line in part]
        return out


def _rows(font_id: str, data: bytes, lines: list[str], every_face: bool) -> Iterator[tuple]:
    try:
        places = face_places(data)
    except struct.error:
        places = [0]
    for number, at in enumerate(places if every_face else places[:1]):
        try:
            face = Face(data, at)
        except ValueError as e:
            yield font_id, number, None, None, None, None, None, None, False, True, str(e)
            continue
        for r, line in enumerate(lines):
            for k, ch in enumerate(line):
                try:
                    glyph = face.lookup(ord(ch))  # the first glyph stands for characters that are not there
                    yield font_id, number, r, k, ch, face.units, face.advance(glyph), face.contours(glyph), False, False, None
                except (ValueError, struct.error, IndexError) as e:
                    why = str(e) if isinstance(e, ValueError) else "an outline is cut off"
                    yield font_id, number, r, k, ch, face.units, None, None, True, False, why


def rendered_sizes(files: DataFrame, lines: list[str], sizes: list[tuple[int, int]]) -> DataFrame:
    """What raster.rendered_sizes() gives, without a library: outlines of the first face, rasterised by built-in functions."""
    return coverage.glyphs(checkpointed(outlines(files, lines)), sizes)  # fonts are parsed once


def outlines(files: DataFrame, lines: list[str], every_face: bool = False) -> DataFrame:
    """files (path, content) as the outlines of the symbols of lines, for the first face of every file or for every face.

    A font that does not load is one row without symbol, a failing symbol a row without contours; both say why. Fonts
    whose outlines are not TrueType do not load. Null content counts as empty.
    """
    kinds = [
        pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(),
        pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("on", pa.bool_())]))), pa.bool_(), pa.bool_(), pa.string(),
    ]
    names = [c.split(" ")[0] for c in OUTLINE.replace(POINT, "p").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = list(_rows(path, data.as_py() or b"", lines, every_face))
                if not rows:
                    continue
                cols = [list(c) for c in zip(*rows, strict=True)]
                cols[7] = [None if c is None else [[{"x": x, "y": y, "on": on} for x, y, on in line] for line in c] for c in cols[7]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, OUTLINE)
