"""op8: the main text of all pages."""

from __future__ import annotations

from glyphlake.llm import html
from glyphlake.llm.registry import query, table


@query("op8_html")
def op8_html(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))
