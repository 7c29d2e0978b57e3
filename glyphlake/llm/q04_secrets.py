"""op4: secrets in every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.llm import secrets
from glyphlake.llm.registry import query, table

_KINDS = {
    "assign": ("""(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}
_BASE = tuple(_KINDS)
_KINDS |= {r.kind: (r.pattern, r.group, r.least) for r in secrets.MORE_RULES}


def _spans_sql(rank: int, kind: str) -> str:
    pattern, group, least = _KINDS[kind]
    return f"""
    SELECT id, {rank} AS rank, '{kind}' AS kind,
           unnest(list_transform(range(1, len(m) + 1), lambda i: (list_sum(list_transform(p[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0))::BIGINT)) AS start,
           unnest(list_transform(m, lambda s: length(s))) AS n,
           unnest(list_transform(g, lambda s: length(s))) AS counted
    FROM (SELECT id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS g FROM d)"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT id, rank, kind, start, start + n AS stop FROM ({' UNION ALL '.join(_spans_sql(k, x) for k, x in enumerate(_KINDS))})
      WHERE counted >= CASE kind WHEN 'assign' THEN 8 WHEN 'access' THEN 16 WHEN 'hex' THEN 32 ELSE 1 END),
a AS (SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(_BASE)}) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (id)"""


@query("op4_secrets", SQL)
def op4_secrets(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.RULES]
    return found.select(
        F.col("path").alias("doc_id"),
        *(secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in base),
        F.sha2(secrets.listed(F.col("spans"), base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )
