"""Listing pages that were crawled: links, names and what is still to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.text import after_last


def links(pages: DataFrame, pattern: str = 'href="([^"]*)"') -> DataFrame:
    """(page_id, href, name) for each link of a page; name is what follows the last equals sign."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("href"))
    return found.withColumn("name", after_last(F.col("href"), "="))


def page_count(html: Column, pattern: str = r'class="noindex"[^>]*>.*?(\d+)\s*</a>\s*</div>') -> Column:
    """The last page number of a pager, 1 without one."""
    found = F.regexp_extract(html, pattern, 1)
    return F.when(found == "", 1).otherwise(found.cast("int"))


def page_urls(listings: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, page): the addresses of all pages of each listing."""
    return listings.select(url, F.explode(F.sequence(F.lit(1), page_count(F.col(html)))).alias("page"))


def not_fetched(found: DataFrame, fetched: DataFrame, key: str = "href") -> DataFrame:
    """Links without a file yet."""
    return found.select(key).distinct().join(fetched.select(key).distinct(), key, "left_anti")
