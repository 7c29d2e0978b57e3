"""Files as rows, line sets, parameter sweeps and report sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.sources.zipsource import place

#: The columns of a parameter sweep, all whole numbers.
SWEEP = "padding INT, point INT, dpi INT, offset INT, image_count INT, out_of_image INT, out_of_cell INT, empty_cell INT"


def scan(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True, content: bool = True, count: int = 0) -> DataFrame:
    """Regular files below path as (path, modificationTime, length[, content]); `count` takes the first by path, 0 all.

    Without content the reader never opens the files. With a count only the files of the first paths are opened; their
    names come to the driver.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    columns = ["path", "modificationTime", "length"] + ["content"] * content
    if count:
        first = [r.path for r in reader.load(path).select("path").orderBy("path").limit(count).collect()]
        return spark.read.format("binaryFile").load(first).select(*columns) if first else reader.load(path).select(*columns)
    return reader.load(path).select(*columns)


def line_set(spark: SparkSession, path: str | None, name: str = "match_set") -> DataFrame:
    """The distinct lines of a text file, blank ones too; no rows for a file that is not there."""
    empty = spark.createDataFrame([], f"{name} string")
    if not path:
        return empty
    try:
        return spark.read.text(path).select(F.col("value").alias(name)).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise


def sweep(spark: SparkSession, path: str) -> DataFrame:
    """A parameter sweep from CSV with a header."""
    return spark.read.schema(SWEEP).option("header", True).csv(path)


def write_routed(df: DataFrame, path: str, by: str) -> None:
    """A manifest in a folder for each value of a column: verdicts, splits or extensions. Inputs stay where they are."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_manifest_json(df: DataFrame, path: str, by: str = "ext") -> None:
    """The rename manifest as JSON lines, a folder for each bucket, in the order of the sequence numbers.

    A bucket may hold most rows: ranges of its numbers are tasks and files of their own.
    """
    df.repartitionByRange(by, "seq").sortWithinPartitions(by, "seq").write.mode("overwrite").partitionBy(by).json(path)


def write_files(named: DataFrame, folder: str) -> DataFrame:
    """Writes (name, content) as files below a folder and returns (name, bytes), a row for each file that was written.

    Each task writes its rows; one that is repeated writes the same files again. Null content writes no file. The folder may be
    of any store that workers reach by its address.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = place(folder)
        for batch in batches:
            names, sizes = [], []
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if not data.is_valid:
                    continue
                if "/" in name:
                    system.create_dir(f"{at}/{name.rsplit('/', 1)[0]}")
                with system.open_output_stream(f"{at}/{name}") as f:
                    f.write(data.as_py())
                names.append(name)
                sizes.append(len(data.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    system, at = place(folder)
    system.create_dir(at)
    return named.select("name", "content").mapInArrow(run, "name string, bytes bigint")
