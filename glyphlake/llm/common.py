"""What the operators of this package share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of a word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that go to a Python worker at a time; a longer row goes alone.
BATCH_BYTES = 1 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the tables written inside the innermost temporary().
_inside: contextvars.ContextVar[dict[str, None] | None] = contextvars.ContextVar("glyphlake-tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new temporary one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = getattr(spark, "_glyphlake_dir", None)
        if not at:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = spark._glyphlake_dir = "file://" + tempfile.mkdtemp(prefix="glyphlake-")
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/glyphlake/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut there and lost executors do not lose it.

    The job's shuffle files go when the table is there; otherwise they stay until the driver happens to collect garbage,
    and a job of many small tables holds those of hundreds of shuffles.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    if (tables := _inside.get()) is not None:
        tables[path] = None
    with _setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that written() makes inside are deleted at the end, but for those made by the function that this gives.

    What is still to be read then has to be written by it: it takes the arguments of written(), and its table belongs to
    the block around this one, if there is one. Shuffle files of the jobs inside, counts among them, go as each ends.
    """
    outer, tables = _inside.get(), {}
    token = _inside.set(tables)

    def kept(df: DataFrame, tag: str) -> DataFrame:
        before = _inside.set(outer)
        try:
            return written(df, tag)
        finally:
            _inside.reset(before)

    try:
        with _setting(spark, _CLEANUP, "true"):
            yield kept
    finally:
        _inside.reset(token)
        for path in tables:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def merged(df: DataFrame, tag: str | None = None) -> DataFrame:
    """df as a side of a join that is merged after a shuffle, at any size; with a tag it is written first.

    Spark guesses a table's size from its files, which repeated ids and exploded arrays make far too small, and collects
    in the driver what it takes for a small side. A side that is written, not aggregated in the same job, leaves Spark free
    to split the other one where a key has many rows.
    """
    return (df if tag is None else written(df, tag)).hint("merge")


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs started inside send rows to Python in batches of about `most` bytes; all rows are sent, and the setting is put back.

    By rows alone a batch of texts takes tens of megabytes, in the executor's JVM and in each of its workers, and neither
    gives them back.
    """
    with _setting(spark, _BATCHES, str(most)):
        yield


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def text_of(c: str | Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def own_names(df: DataFrame, *columns: str) -> tuple:
    """df with its columns named by their place, the new names of the given columns, and all new names.

    So no column of df, whatever its name, clashes with those that an operator adds; the operator names them back.
    """
    names = [f"_column_{i}" for i in range(len(df.columns))]
    return df.toDF(*names), *(names[df.columns.index(c)] for c in columns), names
