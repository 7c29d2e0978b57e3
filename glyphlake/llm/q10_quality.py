"""op10: quality of all documents."""

from __future__ import annotations

from glyphlake.llm import quality
from glyphlake.llm.registry import query, table


@query("op10_quality")
def op10_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")
