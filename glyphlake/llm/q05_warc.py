"""op5: all pages written as WARC records and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.llm import warc
from glyphlake.llm.registry import query, table

SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS keeper FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM d LEFT JOIN k ON k.digest = d.digest AND n >= 1000"""


@query("op5_warc", SQL)
def op5_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )
