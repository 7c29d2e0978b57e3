"""op6: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.llm import toxicity
from glyphlake.llm.registry import query, table


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    scored = toxicity.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "neighbours")
