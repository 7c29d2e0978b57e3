"""A guided search among settings, checked against trying them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.operators import search
from glyphlake.plans.registry import query
from glyphlake.session import table

# parts give the settings: a point and a step; a setting is worth the less the farther it is from the order lines
SETTINGS = "SELECT DISTINCT p_size AS point, CAST(p_partkey % 61 AS INT) AS step FROM part"


@query("guided_search", f"""
SELECT point, step, value FROM (
  SELECT point, step, -sum((l_quantity::BIGINT - point) ** 2 + (l_suppkey % 61 - step) ** 2)::BIGINT AS value FROM ({SETTINGS}), lineitem GROUP BY point, step)
ORDER BY value DESC, 100 * point + step LIMIT 1""")
def guided_search(spark, sf_dir):
    """The best setting, found by some twenty trials."""
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("point"), (F.col("p_partkey") % 61).cast("int").alias("step")).distinct()
    settings = p.select((100 * F.col("point") + F.col("step")).cast("bigint").alias("setting"), search.unit(F.col("point"), 1, 50).alias("u"), search.unit(F.col("step"), 0, 60).alias("v"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("bigint").alias("q"), (F.col("l_suppkey") % 61).alias("s"))

    def worth(chosen: DataFrame) -> DataFrame:
        """One pass over the lines for all of a round's settings, which are a few."""
        numbers = [r.setting for r in chosen.select("setting").collect()]
        far = lambda n: (F.col("q") - n // 100) * (F.col("q") - n // 100) + (F.col("s") - n % 100) * (F.col("s") - n % 100)
        sums = lines.agg(F.array(*(F.struct(F.lit(n).alias("setting"), (-F.sum(far(n))).alias("value")) for n in numbers)).alias("v"))
        return sums.select(F.explode("v").alias("v")).select("v.*")

    best = search.search(settings, worth, rounds=3).orderBy(F.col("value").desc(), "setting").limit(1)
    return best.select(F.floor(F.col("setting") / 100).cast("int").alias("point"), (F.col("setting") % 100).cast("int").alias("step"), F.col("value").cast("bigint").alias("value"))
