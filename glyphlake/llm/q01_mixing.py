"""op1: all documents mixed by source."""

from __future__ import annotations

from glyphlake.llm import mixing
from glyphlake.llm.registry import query, table


@query("op1_mixing")
def op1_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))
