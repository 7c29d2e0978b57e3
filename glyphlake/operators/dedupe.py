"""Exact deduplication by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_key(content: Column) -> tuple[Column, Column]:
    """Length in bytes and SHA-256 of the bytes, of a text those of its UTF-8."""
    return F.octet_length(content).cast("bigint").alias("length"), F.sha2(content.cast("binary"), 256).alias("digest")


def keepers(df: DataFrame, path: str, content: str, priority: Column | None = None) -> DataFrame:
    """(length, digest, keeper, copies): of equal contents the row of the lowest priority, then the smallest path, stays.

    One aggregate with partial sums: a content that many rows share never meets in one task before it is reduced.
    """
    length, digest = content_key(F.col(content))
    order = F.struct((priority if priority is not None else F.lit(0)).alias("p"), F.col(path).alias("path"))
    return df.groupBy(length, digest).agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("copies")).select("length", "digest", F.col("o.path").alias("keeper"), "copies")


def log(df: DataFrame, path: str, content: str, priority: Column | None = None) -> DataFrame:
    """(path, keeper) of the rows that go."""
    length, digest = content_key(F.col(content))
    kept = keepers(df, path, content, priority).where("copies > 1").select(F.col("length").alias("l"), F.col("digest").alias("d"), "keeper")
    rows = df.select(F.col(path), length, digest)
    return rows.join(kept, (F.col("length") == F.col("l")) & (F.col("digest") == F.col("d"))).where(F.col(path) != F.col("keeper")).select(path, "keeper")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key b does not have."""
    return a.join(b.select(key).distinct(), key, "left_anti")


def discovered(*tables: DataFrame) -> DataFrame:
    """The union of one-column tables, each value once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.distinct()
