"""Zip archives as a data source whose partitions are ranges of members.

    spark.dataSource.register(ZipMembers)
    spark.read.format("zip_members").option("split_bytes", 1 << 26).load("/archives")

The planner reads each archive's directory, which lies at its end, and cuts it into ranges of members with about equal
compressed bytes. A task opens the archive, reads its slice of the directory and inflates only its members, so one archive
of any size is read by many tasks, and none holds more than a member at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, member string, size bigint, content binary, error string"
#: Compressed bytes of a partition, about.
SPLIT_BYTES = 1 << 25
#: Fixed values of the format: the records' layouts and how each begins.
ENTRY, ENTRY_SIGN = struct.Struct("<4s6H3I5H2I"), b"PK\x01\x02"
LOCAL, LOCAL_SIGN = struct.Struct("<4s5H3I2H"), b"PK\x03\x04"
END, END_SIGN = struct.Struct("<4s4H2IH"), b"PK\x05\x06"
LOCATOR, LOCATOR_SIGN = struct.Struct("<4sIQI"), b"PK\x06\x07"
END64, END64_SIGN = struct.Struct("<4sQ2H2I4Q"), b"PK\x06\x06"
STORED, DEFLATED = 0, 8
ENCRYPTED, UTF8 = 0x1, 0x800
LONGEST_COMMENT = 0xFFFF


class Damaged(ValueError):
    """What an archive or a member cannot be read for."""


@dataclass
class Slice(InputPartition):
    """Some entries of an archive's directory: their place in the file, and what offsets in them are counted from."""

    archive: str
    at: int = 0
    length: int = 0
    origin: int = 0
    error: str | None = None


@dataclass
class Entry:
    name: str
    flags: int
    method: int
    crc: int
    packed: int
    size: int
    offset: int
    length: int


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(path).path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def archives_at(path: str) -> list[str]:
    """The archive, or those with the suffix .zip in a folder and below, in order of their paths."""
    system, at = place(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type != fs.FileType.Directory:
        return [path]
    front = path[: len(path) - len(at)] if path.endswith(at) else path.split(at.rstrip("/"))[0]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(front + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))


def directory_of(f: BinaryIO, size: int) -> tuple[int, int, int]:
    """(place, bytes, origin) of an archive's directory; origin is where its offsets are counted from."""
    tail_at = max(0, size - END.size - LONGEST_COMMENT)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = tail.rfind(END_SIGN)
    if at < 0 or len(tail) - at < END.size:
        raise Damaged("no directory")
    *_, length, offset, _ = END.unpack_from(tail, at)
    end = tail_at + at
    if at >= LOCATOR.size and tail[at - LOCATOR.size :][:4] == LOCATOR_SIGN:
        end -= LOCATOR.size + END64.size
        f.seek(max(0, end))
        record = f.read(END64.size)
        if len(record) < END64.size or record[:4] != END64_SIGN:
            raise Damaged("no directory for large files")
        *_, length, offset = END64.unpack(record)
    begin = end - length
    if begin < offset or begin < 0:
        raise Damaged("the directory is cut off")
    return begin, length, begin - offset


def entries(directory: bytes) -> Iterator[Entry]:
    at = 0
    while at < len(directory):
        if len(directory) - at < ENTRY.size or directory[at : at + 4] != ENTRY_SIGN:
            raise Damaged("an entry of the directory is damaged")
        _, _, _, flags, method, _, _, crc, packed, size, n_name, n_extra, n_comment, _, _, _, offset = ENTRY.unpack_from(directory, at)
        head = at + ENTRY.size
        name = directory[head : head + n_name]
        packed, size, offset = _large(directory[head + n_name : head + n_name + n_extra], packed, size, offset)
        length = ENTRY.size + n_name + n_extra + n_comment
        yield Entry(name.decode("utf-8" if flags & UTF8 else "cp437", "replace"), flags, method, crc, packed, size, offset, length)
        at += length


def _large(extra: bytes, packed: int, size: int, offset: int) -> tuple[int, int, int]:
    """The numbers that do not fit in 32 bits, which stand in a field of their own."""
    top = 0xFFFFFFFF
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            numbers = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            size, packed, offset = (next(numbers, v) if v == top else v for v in (size, packed, offset))
        at += 4 + n
    return packed, size, offset


def inflated(f: BinaryIO, e: Entry, origin: int) -> bytes:
    """A member's content; what is damaged, encrypted or packed in another way raises Damaged."""
    if e.flags & ENCRYPTED:
        raise Damaged("the member is encrypted")
    if e.method not in (STORED, DEFLATED):
        raise Damaged(f"packing method {e.method} is not read")
    f.seek(origin + e.offset)
    head = f.read(LOCAL.size)
    if len(head) < LOCAL.size or head[:4] != LOCAL_SIGN:
        raise Damaged("the member is not where the directory says")
    *_, n_name, n_extra = LOCAL.unpack(head)
    f.seek(origin + e.offset + LOCAL.size + n_name + n_extra)
    data = f.read(e.packed)
    if len(data) < e.packed:
        raise Damaged("the member is cut off")
    if e.method == DEFLATED:
        try:
            data = zlib.decompressobj(-15).decompress(data, e.size + 1)
        except zlib.error as error:
            raise Damaged(str(error)) from error
    if len(data) != e.size or zlib.crc32(data) != e.crc:
        raise Damaged("the content does not have the size and checksum of the directory")
    return data


def planned(archive: str, split_bytes: int) -> list[Slice]:
    """The slices of an archive's directory; one that cannot be read is a slice that says why."""
    system, at = place(archive)
    try:
        with system.open_input_file(at) as f:
            begin, length, origin = directory_of(f, f.size())
            f.seek(begin)
            directory = f.read(length)
        out, first, here, packed = [], 0, 0, 0
        for e in entries(directory):
            if packed and packed + e.packed > split_bytes:
                out.append(Slice(archive, begin + first, here - first, origin))
                first, packed = here, 0
            here += e.length
            packed += e.packed + e.length
        return [*out, Slice(archive, begin + first, here - first, origin)]
    except (Damaged, OSError, struct.error) as error:
        return [Slice(archive, error=f"{type(error).__name__}: {error}")]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [s for a in archives_at(self.path) for s in planned(a, self.split_bytes)] or [Slice("")]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if partition.error is not None:
            yield partition.archive, None, None, None, partition.error
        if not partition.length:
            return
        system, at = place(partition.archive)
        with system.open_input_file(at) as f:
            f.seek(partition.at)
            for e in entries(f.read(partition.length)):
                if e.name.endswith("/"):
                    continue
                try:
                    yield partition.archive, e.name, e.size, inflated(f, e, partition.origin), None
                except Damaged as error:
                    yield partition.archive, e.name, e.size, None, f"Damaged: {error}"


class ZipMembers(DataSource):
    """Regular members of the archives at a path, as (archive, member, size, content, error).

    A damaged archive is a row without member, a damaged member one without content; both say why. Archives inside
    archives are contents. Options: split_bytes, the compressed bytes of a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
