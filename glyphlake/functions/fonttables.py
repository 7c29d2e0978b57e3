"""Faces and tables of a font file, as a table function for SQL.

    register(spark)
    spark.sql("SELECT path, t.* FROM fonts, LATERAL font_tables(content) t")
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

RETURNS = "face int, tag string, checksum bigint, offset bigint, length bigint, error string"
#: Fixed values of the format: how a collection begins, and a single face.
COLLECTION = b"ttcf"
FACES = (b"\x00\x01\x00\x00", b"OTTO", b"true", b"typ1")
HEAD, RECORD = struct.Struct(">4s4H"), struct.Struct(">4s3I")


def face_places(data: bytes) -> list[int]:
    """Where the faces of a file begin; a file that is no collection has one."""
    if data[:4] != COLLECTION:
        return [0]
    (n,) = struct.unpack_from(">I", data, 8)
    return list(struct.unpack_from(f">{n}I", data, 12))


def tables(data: bytes) -> Iterator[tuple]:
    """(face, tag, checksum, offset, length, error) of every table of every face.

    A file or face that cannot be read is a row without tag; a table beyond the end of the file has an error beside its
    numbers. A face without tables gives no row.
    """
    try:
        places = face_places(data)
    except struct.error:
        yield None, None, None, None, None, "the collection is cut off"
        return
    for face, at in enumerate(places):
        try:
            sign, n, *_ = HEAD.unpack_from(data, at)
            if sign not in FACES:
                raise ValueError("no face")
            records = [RECORD.unpack_from(data, at + HEAD.size + RECORD.size * i) for i in range(n)]
        except (struct.error, ValueError) as e:
            yield face, None, None, None, None, "the directory is cut off" if isinstance(e, struct.error) else str(e)
            continue
        for tag, checksum, offset, length in records:
            error = "the table is cut off" if offset + length > len(data) else None
            yield face, tag.decode("latin-1"), checksum, offset, length, error


class FontTables:
    """The table function; null content gives no row."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is not None:
            yield from tables(bytes(content))


def register(spark: SparkSession, name: str = "font_tables") -> None:
    spark.udtf.register(name, udtf(FontTables, returnType=RETURNS))
