"""8-bit grey images: portable grey maps in and out, and other encodings that need no library but zlib."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "image_id string, height int, width int, data binary, error string"
_HEAD = re.compile(rb"P5(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")
#: Write styles: the extension and how pixels are stored.
STYLES = {"fastest": ".pgm", "efficient": ".tiff", "smaller": ".png"}

#: How a PNG begins, and the bytes of a pixel by colour type (grey, colour, palette, grey and colour with alpha).
PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Fixed values of TIFF: its kinds of whole numbers (bytes, 16 and 32 bits), its packings, and two codes of its LZW.
NUMBERS = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
PACKED = {1: "plain", 5: "lzw", 8: "deflate", 32946: "deflate"}
CLEAR_CODE, END_CODE = 256, 257


def parse_pgm(data: bytes) -> tuple[int, int, bytes]:
    """(height, width, pixels) of a binary grey map with at most 255 levels."""
    head = _HEAD.match(data)
    if not head:
        raise ValueError("no binary grey map")
    width, height, most = map(int, head.groups())
    pixels = data[head.end() : head.end() + width * height]
    if most > 255 or len(pixels) != width * height:
        raise ValueError("more than 8 bits, or too few pixels")
    return height, width, pixels


def parse_png(data: bytes) -> tuple[int, int, bytes]:
    """(height, width, grey pixels) of a PNG with samples of 8 bits that is not interlaced.

    Colours become (299 red + 587 green + 114 blue) / 1000, rounded down; alpha is left out.
    """
    if data[:8] != PNG:
        raise ValueError("no PNG")
    chunks: dict[bytes, list[bytes]] = {}
    at = 8
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a chunk is damaged")
        chunks.setdefault(kind, []).append(body)
        at += 12 + n
    if len(chunks.get(b"IHDR", [b""])[0]) != 13:
        raise ValueError("no header")
    width, height, depth, colour, *_, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"][0])
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise ValueError("not 8 bits a sample, interlaced, or of an unknown colour type")
    k = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(chunks.get(b"IDAT", [])))
    except zlib.error as e:
        raise ValueError(f"pixels are damaged: {e}") from e
    if len(raw) != height * (1 + width * k):
        raise ValueError("too few or too many pixels")
    rows = unfiltered(np.frombuffer(raw, np.uint8).reshape(height, 1 + width * k), k).reshape(height, width, k)
    if colour == 3:
        palette = np.frombuffer(chunks.get(b"PLTE", [b""])[0], np.uint8).reshape(-1, 3)
        if rows.size and int(rows.max()) >= len(palette):
            raise ValueError("a colour is not in the palette")
        rows = palette[rows[:, :, 0]]
    if rows.shape[2] >= 3:
        rows = rows[:, :, :3].astype(np.int64) @ np.array([299, 587, 114]) // 1000
    else:
        rows = rows[:, :, 0]
    return height, width, rows.astype(np.uint8).tobytes()


def unfiltered(rows: np.ndarray, k: int) -> np.ndarray:
    """Bytes of PNG rows, each with its filter before it; k bytes are a pixel."""
    out = np.zeros((rows.shape[0], rows.shape[1] - 1), np.uint8)
    above = np.zeros(rows.shape[1] - 1, np.uint8)
    for y, row in enumerate(rows):
        kind, line = int(row[0]), row[1:]
        if kind == 1:
            line = np.cumsum(line.reshape(-1, k), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            up, now = above.tolist(), line.tolist()
            for i in range(len(now)):
                a, b, c = (now[i - k], up[i], up[i - k]) if i >= k else (0, up[i], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))  # ties in this order
                now[i] = (now[i] + guess) & 255
            line = np.array(now, np.uint8)
        elif kind:
            raise ValueError("an unknown filter")
        out[y] = above = line
    return out


def parse(data: bytes) -> tuple[int, int, bytes]:
    """A grey map, a PNG or a TIFF, told by how it begins."""
    if data[:2] in (b"II", b"MM"):
        return parse_tiff(data)
    return parse_png(data) if data[:8] == PNG else parse_pgm(data)


def encode_pgm(height: int, width: int, pixels: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (width, height) + pixels


def encode_png(height: int, width: int, pixels: bytes, level: int = 3) -> bytes:
    """Grey PNG with run-length deflate, no filters."""
    rows = b"".join(b"\0" + pixels[y * width : (y + 1) * width] for y in range(height))
    deflate = zlib.compressobj(level, strategy=zlib.Z_RLE)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", deflate.compress(rows) + deflate.flush()) + chunk(b"IEND", b"")


def lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, high bit first, widened one code early."""
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, after, prefix = 9, 258, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    code_of = lambda s: s[0] if len(s) == 1 else table[s]
    put(256)
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            prefix = longer
            continue
        put(code_of(prefix))
        table[longer] = after
        after += 1
        prefix = data[i : i + 1]
        if after == 4094:  # the last code before the table is full
            put(256)
            table.clear()
            width, after = 9, 258
        elif after + 1 > 1 << width and width < 12:
            width += 1
    if prefix:
        put(code_of(prefix))
        after += 1
        if after + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def encode_tiff(height: int, width: int, pixels: bytes) -> bytes:
    """Grey little-endian TIFF, one strip, LZW (compression 5)."""
    body = lzw(pixels)
    tags = [(256, 4, width), (257, 4, height), (258, 3, 8), (259, 3, 5), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, height), (279, 4, len(body))]
    at = 8 + len(body) + len(body) % 2
    entries = b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
    return struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"


def unlzw(data: bytes, most: int) -> bytes:
    """What lzw() packed, up to `most` bytes; a code that was not made yet, or a stream without end, raises ValueError."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, last = list(single), 9, b""
    out, made, held, bits = [], 0, 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == END_CODE or made >= most:
            break
        if code == CLEAR_CODE:
            table, width, last = list(single), 9, b""
            continue
        if code < len(table):
            piece = table[code]
        elif code == len(table) and last:
            piece = last + last[:1]
        else:
            raise ValueError("a code that was not made yet")
        if last:
            table.append(last + piece[:1])
        out.append(piece)
        made += len(piece)
        last = piece
        # a code is widened one before the table needs it
        width = min(12, max(9, (len(table) + 1).bit_length()))
    else:
        raise ValueError("the packed pixels have no end")
    return b"".join(out)[:most]


def _tags(data: bytes) -> dict[int, list[int]]:
    """The numbers of the first directory of a TIFF by tag, in the file's byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF")
    (at,) = struct.unpack_from(order + "I", data, 4)
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        found = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in NUMBERS:
                continue
            letter, size = NUMBERS[kind]
            place = at + 10 + 12 * i
            if count * size > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            found[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
    except struct.error as e:
        raise ValueError("the directory is cut off") from e
    return found


def parse_tiff(data: bytes) -> tuple[int, int, bytes]:
    """(height, width, grey pixels) of the first picture of a TIFF in strips: grey or colour, 8 bits a sample.

    Strips may be plain, LZW or deflate, with or without differences along the rows. Colours become grey as those of PNG;
    pictures in which 0 is white are turned.
    """
    tags = _tags(data)
    one = lambda tag, other: tags.get(tag, [other])[0]
    width, height, k = one(256, 0), one(257, 0), one(277, 1)
    packing, kind, per_strip = one(259, 1), one(262, 1), one(278, height)
    if set(tags.get(258, [1])) != {8} or k not in (1, 3, 4) or kind not in (0, 1, 2) or (kind == 2) != (k >= 3) or one(284, 1) != 1:
        raise ValueError("not grey or colour with 8 bits a sample, sample by sample")
    if packing not in PACKED:
        raise ValueError(f"packing {packing} is not read")
    places, lengths = tags.get(273, []), tags.get(279, [])
    if not width or not height or not per_strip or len(places) != len(lengths) or len(places) != -(-height // per_strip):
        raise ValueError("strips are missing")
    strips = []
    for i, (at, n) in enumerate(zip(places, lengths, strict=True)):
        want = min(per_strip, height - i * per_strip) * width * k
        part = data[at : at + n]
        if len(part) < n:
            raise ValueError("a strip is cut off")
        if PACKED[packing] == "lzw":
            part = unlzw(part, want)
        elif PACKED[packing] == "deflate":
            try:
                part = zlib.decompressobj().decompress(part, want)
            except zlib.error as e:
                raise ValueError(f"pixels are damaged: {e}") from e
        if len(part) < want:
            raise ValueError("too few pixels")
        strips.append(part[:want])
    rows = np.frombuffer(b"".join(strips), np.uint8).reshape(height, width, k)
    if one(317, 1) == 2:
        rows = np.cumsum(rows, axis=1, dtype=np.uint8)
    if k >= 3:
        rows = rows[:, :, :3].astype(np.int64) @ np.array([299, 587, 114]) // 1000
    else:
        rows = rows[:, :, 0]
    rows = rows.astype(np.uint8)
    return height, width, (255 - rows if kind == 0 else rows).tobytes()


ENCODERS = {"fastest": encode_pgm, "efficient": encode_tiff, "smaller": encode_png}


def read_pgm(files: DataFrame) -> DataFrame:
    """files (path, content) as images; what is no grey map is a row with its error."""
    return _read(files, parse_pgm)


def read_images(files: DataFrame) -> DataFrame:
    """Grey maps, PNGs and TIFFs as images; what is none of these, or damaged, is a row with its error."""
    return _read(files, parse)


def _read(files: DataFrame, parse: Callable[[bytes], tuple[int, int, bytes]]) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows.append((path, *parse(data.as_py() or b""), None))
                except ValueError as e:
                    rows.append((path, None, None, None, str(e)))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["image_id", "height", "width", "data", "error"])

    return files.select("path", "content").mapInArrow(run, IMAGE)


def encoded(images: DataFrame, style: str = "fastest") -> DataFrame:
    """(name, content): images in a style, named by their id and the style's extension; empty images give no row."""
    if style not in STYLES:
        raise ValueError(f"unknown write style {style}; known: {', '.join(STYLES)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (f"{i}{STYLES[style]}", ENCODERS[style](h, w, d))
                for i, h, w, d in zip(*(batch.column(c).to_pylist() for c in ("image_id", "height", "width", "data")), strict=True) if d
            ]
            cols = list(zip(*rows, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary())], names=["name", "content"])

    return images.select("image_id", "height", "width", "data").mapInArrow(run, "name string, content binary")


def changed_pixels(before: DataFrame, after: DataFrame) -> DataFrame:
    """(image_id, changed) of two sets of images: pixels that differ, all of the first where the second has another shape or none.

    0 for every image says that a way through files is lossless.
    """
    a, b = (pixels(x).withColumnsRenamed({c: f"{c}{k}" for c in ("height", "width", "pixels")}) for k, x in enumerate((before, after)))
    both = a.join(b, "image_id", "left")
    same = (F.col("height0") == F.col("height1")) & (F.col("width0") == F.col("width1"))
    differ = F.aggregate(F.zip_with("pixels0", "pixels1", lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, d: n + d)
    return both.select("image_id", F.when(same, differ).otherwise(F.size("pixels0")).cast("bigint").alias("changed"))


def pixels(images: DataFrame) -> DataFrame:
    """images with `pixels`, an array of numbers from 0 to 255."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [d.as_py() for d in batch.column("data")]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int32))
            values = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(data), np.uint8).astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("image_id", "height", "width")] + [values], names=["image_id", "height", "width", "pixels"])

    return images.where(F.col("data").isNotNull()).select("image_id", "height", "width", "data").mapInArrow(run, "image_id string, height int, width int, pixels array<smallint>")
