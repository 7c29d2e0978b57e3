"""Image tables with access by index, as a data set of files has it: a length, and rows by their number.

Rows are numbered from 0 in the order of a key. The table lies in shards of consecutive numbers; inside its files rows are
sorted and row groups are small. So numbers name the folders to open, and the statistics of files, row groups and pages
leave out all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.session import new_folder

#: Rows of a shard, and bytes of a row group.
SHARD_ROWS, GROUP_BYTES = 1 << 16, 1 << 20


def write_indexed(df: DataFrame, path: str, order: list[str], shard_rows: int = SHARD_ROWS, group_bytes: int = GROUP_BYTES) -> None:
    """df as an indexed table at path, numbered by the columns of order, ascending, nulls first.

    One shuffle by ranges of the order; equal keys are numbered in any order. Each task writes rows of consecutive
    numbers, so no task sorts more than its range, and a shard may be written by several tasks. An empty df gives a table
    of length 0.
    """
    spark = df.sparkSession
    at = new_folder(spark, "indexed")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the high bits of this number are the range, the low ones the place within it
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(at)
    kept = spark.read.parquet(at).withColumn("_range", F.shiftright("_at", 33))
    counts = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = kept.join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    numbered = numbered.withColumn("index", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    numbered = numbered.select(*df.columns, "index", F.floor(F.col("index") / shard_rows).alias("shard")).sortWithinPartitions("shard", "index")
    numbered.write.mode("overwrite").option("parquet.block.size", group_bytes).partitionBy("shard").parquet(f"{path}/rows")
    total = spark.read.parquet(at).agg(F.count(F.lit(1)).alias("length"), F.lit(shard_rows).cast("bigint").alias("shard_rows"))
    total.write.mode("overwrite").parquet(f"{path}/length")
    df.limit(0).withColumn("index", F.lit(0).cast("bigint")).write.mode("overwrite").parquet(f"{path}/schema")


def _about(spark: SparkSession, path: str) -> tuple[int, int]:
    r = spark.read.parquet(f"{path}/length").first()
    return r["length"], r["shard_rows"]


def length(spark: SparkSession, path: str) -> int:
    """The number of rows, read from a table of one row."""
    return _about(spark, path)[0]


def rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows, with index and shard."""
    schema = spark.read.parquet(f"{path}/schema").schema
    if not length(spark, path):
        return spark.createDataFrame([], schema).withColumn("shard", F.lit(0).cast("bigint"))
    return spark.read.schema(schema.add("shard", "long")).parquet(f"{path}/rows")


def at(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """(position, index, ...): the rows of a list of numbers, in its positions; a number may occur more than once.

    Negative numbers count from the end; one beyond either end raises IndexError. The list is the caller's and small: its
    shards are a filter on folders, its numbers one on row groups and pages.
    """
    n, shard_rows = _about(spark, path)
    if any(not -n <= i < n for i in wanted):
        raise IndexError(f"an index is outside of {n} rows")
    numbers = [i % n for i in wanted]
    found = rows(spark, path)
    found = found.where(F.col("shard").isin(sorted({i // shard_rows for i in numbers})) & F.col("index").isin(sorted(set(numbers)))).drop("shard")
    places = spark.createDataFrame(list(enumerate(numbers)), "position bigint, index bigint")
    return found.join(F.broadcast(places), "index").select("position", "index", *(c for c in found.columns if c != "index"))


def lookup(wanted: DataFrame, path: str, index: str = "index") -> DataFrame:
    """wanted with the columns of its rows' numbers; numbers that the table does not have give no row.

    wanted may be of any size. It is joined by shard and number, so that where it is small Spark prunes the folders by
    the shards that occur in it.
    """
    spark = wanted.sparkSession
    _, shard_rows = _about(spark, path)
    w = wanted.withColumn("shard", F.floor(F.col(index) / shard_rows))
    found = rows(spark, path)
    return w.withColumnRenamed(index, "_index").join(found, (F.col("_index") == found["index"]) & (w["shard"] == found["shard"])).drop("shard", "_index")


def every_kth(spark: SparkSession, path: str, step: int) -> DataFrame:
    """The rows whose number is divisible by step."""
    return rows(spark, path).where(F.col("index") % step == 0).drop("shard")
