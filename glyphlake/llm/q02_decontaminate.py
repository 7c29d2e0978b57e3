"""op2: documents that hold benchmark items."""

from __future__ import annotations

from glyphlake.llm import decontaminate
from glyphlake.llm.registry import query, table


@query("op2_decontaminate")
def op2_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
