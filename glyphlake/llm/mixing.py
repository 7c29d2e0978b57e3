"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Documents of a source are laid on one line of words in a shuffled order and cut into blocks of equal length. Slot n of
the schedule holds the point frac(n * golden ratio); cumulative weights, the slots that each source's target needs, map
points to sources; the k-th slot of a source takes its k-th block, starting over after the last. Small sources have
shorter blocks, so that each has enough slots to meet its target whatever the total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.llm.common import WORD, text_of, written

#: Words per slot follow from the total so that there are about this many slots, whatever the input.
SLOTS = 1 << 20
#: Documents in a cell of a source's line, at least; cells of a source of n hold the square root of n if that is more, so
#: that neither a cell nor the cells of one source grow with the input as a whole does.
CELL = 500
#: A source's blocks are so short that its target needs this many slots, or a slot for each word; fewer, down to
#: FEWEST_SLOTS, where there are so many sources that these slots would be more than SLOTS.
SOURCE_SLOTS, FEWEST_SLOTS = 1 << 10, 1 << 6


def words_of(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """sizes (source, source_size, ...), one row for each source, with rank and target: share of all sizes by weight, capped.

    Sources in code point order, null last, weigh weights repeating. A target stops at cap times its source's size and
    the excess goes to the others by weight. In order of size over weight the capped sources stand first, so the level
    that the others share is found by running sums, without repeated rounds. Sizes of zero get zero. The table of sources, not
    of documents, is ordered in one task.
    """
    columns = sizes.columns
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank - 1) % len(weights) + 1)
    s = sizes.withColumn("rank", rank).withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    up = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    below = F.coalesce(F.sum("limit").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    beyond = F.sum("weight").over(up.rowsBetween(W.currentRow, W.unboundedFollowing))
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) * float(share) - below) / beyond)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(everything)
    target = F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))
    return s.select(*columns, "rank", target.alias("target"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = 42, slots: int = SLOTS, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document as (key, *keep, source, size, source_size, target, taken).

    taken: words that the mix takes of it, repeats counted; a source's come near cap times its size at most, and no
    document is taken more often than cap, rounded up. The order within a source follows a hash of seed and key; equal
    keys are ordered by size. Null text has size zero and null sources are one source; long texts count whole; rows that
    repeat are all returned. An empty table gives an empty result. Other columns are ignored.
    A source may hold any part of the rows: running sums go over hashed cells of a source and then over the cells.
    """
    spark = docs.sparkSession
    cols = [F.col(key).alias("key"), F.col("source").alias("source"), *(F.col(c).alias(f"_keep_{c}") for c in keep)]
    d = docs.select(*cols, words_of(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"))
    d = written(d, "mix-sizes")
    per_source = written(targets(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), share, cap, weights), "mix-targets")
    total = per_source.agg(F.sum("source_size"), F.sum("target"), F.count(F.lit(1))).first()
    words, wanted, n_sources = int(total[0] or 0), float(total[1] or 0), int(total[2])
    longest = max(1, -(-int(wanted) // slots))
    least = max(FEWEST_SLOTS, min(SOURCE_SLOTS, SLOTS // max(1, n_sources)))
    length = F.greatest(F.lit(1), F.least(F.lit(longest), F.floor(F.col("target") / least))).cast("bigint")
    per_source = per_source.withColumn("block_size", length).withColumn("slots", F.ceil(F.col("target") / F.col("block_size")).cast("bigint"))
    per_source = per_source.withColumn("cells", F.ceil(F.col("n") / F.greatest(F.lit(float(CELL)), F.sqrt("n"))).cast("bigint"))
    n_slots, n_cells = (int(x or 0) for x in per_source.agg(F.sum("slots"), F.sum("cells")).first())
    n_slots = n_slots if words else 0

    # each document's first word on its source's line
    sources = per_source.select(F.col("source").alias("ps"), "rank", "source_size", "target", "block_size", "cells")
    d = d.join(_small(sources, n_sources), F.col("source").eqNullSafe(F.col("ps"))).drop("ps")
    d = d.withColumn("cell", F.pmod("h", "cells")).drop("cells")
    cell_sums = d.groupBy("rank", "cell").agg(F.sum("size").alias("cell_size"))
    line = W.partitionBy("rank").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cell_sums = cell_sums.select("rank", "cell", F.coalesce(F.sum("cell_size").over(line), F.lit(0)).alias("cell_at"))
    d = d.join(_small(cell_sums, n_cells), ["rank", "cell"])
    inside = W.partitionBy("rank", "cell").orderBy("h", "key", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("at", F.col("cell_at") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    d = d.drop("h", "cell", "cell_at")

    # documents cut at block borders: as many pieces as documents and blocks together
    times = block_times(spark, per_source, n_slots, cap)
    own = F.col("block_size")
    first, last = F.expr("at div block_size"), F.expr("(at + size - 1) div block_size")
    pieces = d.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    length = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * own) - F.greatest(F.col("at"), F.col("block") * own)
    pieces = pieces.withColumn("length", length).join(times, ["rank", "block"], "left")
    row = ["key", *(f"_keep_{c}" for c in keep), "source", "size", "source_size", "target", "rank", "at"]
    taken = pieces.groupBy(*row).agg(F.sum(F.col("length") * F.coalesce("times", F.lit(0))).alias("taken"))
    empty = d.where("size = 0").select(*row, F.lit(0).cast("bigint").alias("taken"))
    return taken.unionByName(empty).select(
        F.col("key").alias(key), *(F.col(f"_keep_{c}").alias(c) for c in keep), "source", "size", "source_size", "target", "taken"
    )


def _small(df: DataFrame, rows: int, most: int = 1 << 17) -> DataFrame:
    """df for a broadcast if it is known to have few rows; otherwise the join shuffles, and AQE splits hot sources."""
    return F.broadcast(df) if rows <= most else df


def block_times(spark, per_source: DataFrame, n_slots: int, cap: float, cells: int = 4096) -> DataFrame:
    """(rank, block, times): how many slots of the schedule take each block of each source.

    The slots are a bounded number, so ranking those of one source in one task is bounded too. Points and the
    intervals of the cumulative weights meet in cells of the unit interval, so no pair outside a cell is looked at.
    """
    up = W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cum = per_source.where("target > 0").select(
        "rank", F.ceil(F.col("source_size") / F.col("block_size")).cast("bigint").alias("blocks"),
        (F.sum("slots").over(up) / F.sum("slots").over(whole)).alias("hi"),
    )
    cum = cum.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("rank")), F.lit(0.0)))
    cum = cum.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))))
    golden = (5**0.5 - 1) / 2
    slots = spark.range(n_slots).select(F.col("id").alias("n"), (F.col("id") * F.lit(golden) - F.floor(F.col("id") * F.lit(golden))).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * cells))
    chosen = slots.join(cum, "cell").where("u >= lo AND u < hi")
    k = F.row_number().over(W.partitionBy("rank").orderBy("n")) - 1
    chosen = chosen.select("rank", "blocks", k.alias("k")).where(F.col("k") < F.floor(F.col("blocks") * float(cap)))
    return chosen.groupBy("rank", (F.col("k") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))
