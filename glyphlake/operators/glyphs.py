"""Glyph identity: which symbols of a record are drawn alike, and what that means for the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_sets(glyphs: DataFrame, owner: list[str], key: list[str], symbol: str = "ch") -> DataFrame:
    """Groups of different symbols of one owner that share a content key, as a sorted string.

    One hash aggregate on (owner, key) instead of comparing glyph pairs. Spaces and null symbols take no part; a symbol
    that occurs twice counts once. Rows: the owner columns and match_set; sets of one symbol are left out.
    """
    symbols = F.collect_set(symbol)
    return (
        glyphs.where(F.col(symbol).isNotNull() & (F.col(symbol) != " "))
        .groupBy(*owner, *key)
        .agg(F.array_join(F.sort_array(symbols), "").alias("match_set"), F.size(symbols).alias("_n"))
        .where("_n >= 2")
        .select(*owner, "match_set")
    )


def count_match_sets(sets: DataFrame) -> DataFrame:
    """How often each match set occurs, with its length."""
    return sets.groupBy("match_set").agg(F.count(F.lit(1)).alias("occurrences")).withColumn("length", F.length("match_set").cast("bigint"))


def spreadsheet_escape(c: Column) -> Column:
    """Quoted for a spreadsheet cell that must stay text: a leading apostrophe, double quotes doubled."""
    return F.concat(F.lit("\"'"), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def duplicate_verdict(owners: DataFrame, sets: DataFrame, whitelist: DataFrame, owner: str, max_broadcast_rows: int = 100_000) -> DataFrame:
    """Per owner: keep without match sets, allowed_duplicates if the whitelist has all of them, else failed_duplicates.

    The whitelist is broadcast when it has at most max_broadcast_rows rows, else joined by shuffle.
    """
    allowed = whitelist.select(F.col("match_set"), F.lit(True).alias("_allowed")).distinct()
    if allowed.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        allowed = F.broadcast(allowed)
    judged = sets.join(allowed, "match_set", "left").groupBy(owner).agg(F.count(F.lit(1)).alias("n_sets"), F.count("_allowed").alias("n_allowed"))
    n, ok = F.coalesce("n_sets", F.lit(0)), F.coalesce("n_allowed", F.lit(0))
    return owners.select(owner).join(judged, owner, "left").select(
        owner, n.alias("n_sets"), ok.alias("n_allowed"),
        F.when(n == 0, "keep").when(n == ok, "allowed_duplicates").otherwise("failed_duplicates").alias("verdict"),
    )
