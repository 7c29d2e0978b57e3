"""Counts and histograms that the tools report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entry_count(df: DataFrame, group: str, name: str = "n") -> DataFrame:
    """Entries in each group, most first."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), group)


def histogram(df: DataFrame, value: Column, name: str = "distance") -> DataFrame:
    """(name, n) of a column in ascending order; nulls are left out, see skipped()."""
    return df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(name)


def skipped(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.count_if(value.isNull()).alias("skipped"))


def at_zero(hist: DataFrame, name: str = "distance") -> DataFrame:
    """The count at 0, or 0 if there is none: what a parameter search maximises."""
    return hist.agg(F.coalesce(F.max(F.when(F.col(name) == 0, F.col("n"))), F.lit(0)).alias("n"))


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_json_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One JSON object of all rows, keys sorted; for reports whose size is known to be small."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("json"))
