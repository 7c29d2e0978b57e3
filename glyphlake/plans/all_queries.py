"""Importing this module registers every query of the library."""

from __future__ import annotations

from glyphlake.plans import corpus_queries, format_queries, geometry_queries, ingest_queries, raster_queries, review_queries, search_queries, source_queries, tensor_queries, text_queries  # noqa: F401
from glyphlake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
