"""op9: the five best partners of every fiftieth vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.llm import topk
from glyphlake.llm.registry import query, table

SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 5"""


@query("op9_topk", SQL)
def op9_topk(spark, sf_dir):
    return topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
