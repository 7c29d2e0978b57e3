"""Exact ranks, sequence numbers, splits and batches that do not need all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hex digits of the order key that make a cell: 4096 cells for each group.
CELL_DIGITS = 3


def shuffled_key(key: Column, seed: int | str = 42) -> Column:
    """A key whose order is a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def numbered(df: DataFrame, order: Column, ties: list[str], groups: list[str] | None = None, name: str = "no") -> DataFrame:
    """df with the rank from 0, by order (a hex digest) and then ties, within groups.

    The first digits of the digest cut a group into cells: counts of cells give each cell's first number, and only a
    cell is sorted in one task. A group may hold any part of the rows.
    """
    groups = groups or []
    d = df.withColumn("_order", order).withColumn("_cell", F.substring("_order", 1, CELL_DIGITS))
    counts = d.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*groups).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("_cell").alias("_c"), F.coalesce(before, F.lit(0)).alias("_before"))
    on = F.col("_cell") == F.col("_c")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    if not groups:
        counts = F.broadcast(counts)  # at most 16 ** CELL_DIGITS rows
    rank = F.row_number().over(W.partitionBy(*groups, "_cell").orderBy("_order", *ties)) - 1
    d = d.join(counts, on).withColumn(name, (F.col("_before") + rank).cast("bigint"))
    return d.drop("_order", "_cell", "_c", "_before", *(f"_{g}" for g in groups))


def split(df: DataFrame, key: str, test: float, validation: float, seed: int = 42) -> DataFrame:
    """df with `split`: int(n * ratio) rows of a seeded shuffle are test, the next ones validation, the rest train."""
    n = df.count()
    n_test, n_val = int(n * test), int(n * validation)
    d = numbered(df, shuffled_key(F.col(key), seed), [key], name="_no")
    part = F.when(F.col("_no") < n_test, "test").when(F.col("_no") < n_test + n_val, "validation").otherwise("train")
    return d.withColumn("split", part).drop("_no")


def batches(df: DataFrame, key: str, size: int, seed: int | None = None, drop_last: bool = False) -> DataFrame:
    """df with batch_id: rows in groups of `size`, in a seeded shuffle or, without a seed, in the order of a hash of key."""
    d = numbered(df, shuffled_key(F.col(key), "" if seed is None else seed), [key], name="_no")
    if drop_last:
        d = d.where(F.col("_no") < df.count() // size * size)
    return d.withColumn("batch_id", F.floor(F.col("_no") / size).cast("bigint")).drop("_no")


def capped(df: DataFrame, count: int, order: str) -> DataFrame:
    """The first `count` rows by order; all of them for 0."""
    return df.orderBy(order).limit(count) if count else df


def every(df: DataFrame, step: str, k: int) -> DataFrame:
    """Rows whose step is divisible by k."""
    return df.where(F.col(step) % k == 0)
