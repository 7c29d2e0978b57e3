"""op3: near-duplicate classes of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.llm import simhash
from glyphlake.llm.registry import query, table


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    c = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
