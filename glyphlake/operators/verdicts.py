"""Verdicts on records: ordered rules, counters and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: list[tuple[str, Column]], otherwise: str = "keep") -> Column:
    """The name of the first rule that holds; null conditions do not hold."""
    out = None
    for name, condition in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(otherwise)


def bad_font_verdict(stats: DataFrame) -> DataFrame:
    """stats (font_not_loaded, char_loads_failed, empty, ...) with verdict, in this order of precedence."""
    return stats.withColumn("verdict", first_match([
        ("failed_font_loads", F.col("font_not_loaded")), ("failed_char_loads", F.size("char_loads_failed") > 0), ("empty_chars", F.size("empty") > 0),
    ]))


def has_issue(stats: str = "") -> Column:
    """Whether a record of rendering statistics tells of any trouble; the bounding box is none."""
    c = lambda n: F.col(f"{stats}.{n}" if stats else n)
    return (
        c("font_not_loaded") | (F.size(c("char_loads_failed")) > 0) | (c("out_of_image") > 0) | (c("out_of_cell") > 0)
        | (c("overwrites") > 0) | (F.size(c("matched")) > 0) | (F.size(c("empty")) > 0)
    )


def counts(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    return df.groupBy(verdict).agg(F.count(F.lit(1)).alias("n"))


def distance_verdict(distance: Column) -> Column:
    """keep at distance 0, else the folder of that distance, three digits at least."""
    return F.when(distance == 0, "keep").otherwise(F.format_string("%03d", distance))


def merged_stats(df: DataFrame, *keys: str, lists: bool = False) -> DataFrame:
    """Statistics of several records as one: flags or-ed, lengths of lists and counters summed, boxes united.

    With lists, the lists themselves are joined too: for groups that are known to be small, as the lines of one font are.
    """
    names = {"char_loads_failed": "n_failed", "matched": "n_matched", "empty": "n_empty"}
    return df.groupBy(*keys).agg(
        F.bool_or("font_not_loaded").alias("font_not_loaded"),
        *(F.sum(F.size(c).cast("bigint")).alias(n) for c, n in names.items()),
        *(F.flatten(F.collect_list(c)).alias(c) for c in names if lists),
        *(F.sum(c).alias(c) for c in ("out_of_image", "out_of_cell", "overwrites")),
        F.struct(F.min("bbox.l").alias("l"), F.min("bbox.t").alias("t"), F.max("bbox.r").alias("r"), F.max("bbox.b").alias("b")).alias("bbox"),
    )


def flag_sums(df: DataFrame, *keys: str) -> DataFrame:
    """How many records have pixels out of the image, out of their cell or no pixels at all, and how many there are."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col("out_of_image") > 0).alias("out_of_image"), F.count_if(F.col("out_of_cell") > 0).alias("out_of_cell"),
        F.count_if(F.size("empty") > 0).alias("empty_cell"), F.count(F.lit(1)).alias("total"),
    )


def route(df: DataFrame, path: str, verdict: str = "verdict", dry_run: bool = False) -> DataFrame:
    """Writes df in a folder for each verdict and returns the counts; inputs are never moved, a dry run writes nothing."""
    if not dry_run:
        df.write.mode("append").partitionBy(verdict).parquet(path)
    return counts(df, verdict)


def review_page(items: DataFrame, decided: DataFrame, key: str, page: int = 0, size: int = 500) -> DataFrame:
    """Items without a verdict, a page of them in key order; decided: (key, keep), null meaning undecided."""
    left = items.join(decided.where(F.col("keep").isNotNull()).select(key), key, "left_anti")
    return left.orderBy(key).offset(page * size).limit(size)
