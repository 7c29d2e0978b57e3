"""Importing this module registers the thirteen queries."""

from __future__ import annotations

from glyphlake.llm import (  # noqa: F401
    q01_mixing,
    q02_decontaminate,
    q03_simhash,
    q04_secrets,
    q05_warc,
    q06_toxicity,
    q07_chat,
    q08_html,
    q09_topk,
    q10_quality,
    q11_divergence,
    q12_fim,
    q13_packing,
)
from glyphlake.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
