"""Zip archives: members as rows, and archives inside archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.session import checkpointed, new_folder

MEMBER = "archive string, member string, content binary, error string"


def members(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(archive, member, content, error): a row for each regular member; a damaged archive or member is a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "member", "content", "error"]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for at, data in zip(batch.column("p").to_pylist(), batch.column("c"), strict=True):
                for row in _members(at, data.as_py() or b""):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    return files.select(F.col(path).alias("p"), F.col(content).alias("c")).mapInArrow(run, MEMBER)


def _members(at: str, data: bytes) -> Iterator[tuple]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = [i for i in archive.infolist() if not i.is_dir()]
    except Exception as e:
        yield at, None, None, f"{type(e).__name__}: {e}"
        return
    for info in names:
        try:
            yield at, info.filename, archive.read(info), None
        except Exception as e:
            yield at, info.filename, None, f"{type(e).__name__}: {e}"


def unzip_all(files: DataFrame, path: str = "path", content: str = "content", most_rounds: int = 64) -> DataFrame:
    """Members of the .zip files among files, and of the archives in them, until no archive is new.

    A member's path is its archive's without the suffix, a slash and its name. Each round reads only the archives that
    the last one brought; damaged ones end there.
    """
    here = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    out = None
    for _ in range(most_rounds):
        zips = here.where(F.col("path").endswith(".zip"))
        name = F.concat(F.regexp_replace("archive", r"\.zip$", ""), F.lit("/"), F.col("member"))
        found = checkpointed(members(zips).select(name.alias("path"), "content", "error", "archive"))
        out = found if out is None else out.unionByName(found)
        here = found.where("error IS NULL AND content IS NOT NULL").select("path", "content")
        if here.where(F.col("path").endswith(".zip")).limit(1).count() == 0:
            return out
    raise RuntimeError(f"archives are nested deeper than {most_rounds}")


def closure(roots: DataFrame, inside: DataFrame) -> DataFrame:
    """(id, depth): what is reachable from roots (id) over inside (child, parent); each id once, at its least depth.

    Only the ids that the last round brought are joined in the next; what is known already is left out, so cycles end.
    Each depth is a folder of one table, so a round reads what is known as one table, however many rounds there were.
    """
    spark = roots.sparkSession
    at = new_folder(spark, "closure")
    kind = roots.schema["id"].dataType.simpleString()
    level = lambda depth: spark.read.schema(f"id {kind}").parquet(f"{at}/depth={depth}")
    known = lambda: spark.read.schema(f"id {kind}, depth int").parquet(at)
    roots.select("id").distinct().write.parquet(f"{at}/depth=0")
    depth = 0
    while level(depth).limit(1).count():
        new = level(depth).join(inside, F.col("id") == F.col("parent")).select(F.col("child").alias("id")).distinct()
        depth += 1
        new.join(known(), "id", "left_anti").write.parquet(f"{at}/depth={depth}")
    return known()
