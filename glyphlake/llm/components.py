"""Connected components of a graph given as a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import merged, temporary, written

#: Up to this number of edges the smallest neighbours, a row for each node at most, are broadcast; beyond it that join shuffles.
FEW = 50_000


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any orderable type as (node, root): root is the smallest node reachable.

    Only nodes with an edge to another node are returned. In turns, every node hangs its larger, then its smaller
    neighbours on the smallest node around; the edges become stars in a number of rounds logarithmic in the size of the
    components. A round is an aggregation and a join on edges written to the shared folder; only a count and a checksum
    come to the driver.
    """
    spark = edges.sparkSession
    with temporary(spark) as kept:
        e = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
        seen = _state(e)
    while seen[0]:
        few = seen[0] <= FEW  # no step makes more edges
        with temporary(spark) as kept:
            both = e.union(e.select("v", "u")).toDF("u", "v")
            low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
            low = F.broadcast(low) if few else merged(low, "cc-low")
            large = both.join(low, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = written(large.where("u <> v").distinct(), "cc")
            low = written(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), "cc-low")
            small = e.join(F.broadcast(low) if few else merged(low), F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = kept(small.union(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
            was, seen = seen, _state(e)
        if was == seen:
            break
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
