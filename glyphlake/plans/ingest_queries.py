"""Tables with access by index, and ingestion in several runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.plans.registry import query
from glyphlake.plans.source_queries import GREY_SQL
from glyphlake.plans.tensor_queries import _unit
from glyphlake.session import new_folder, table
from glyphlake.sources import indexed
from glyphlake.streaming import ingest

PATH = "'/docs/' || doc_id"
RUNS = 3


def _indexed_images(spark, sf_dir) -> str:
    at = new_folder(spark, "image-table")
    hexes = F.array_join(F.transform("u", lambda v: F.lpad(F.hex(F.round(v * 255).cast("int")), 2, "0")), "")
    images = _unit(spark, sf_dir).select("vec_id", F.lit(4).alias("height"), F.lit(16).alias("width"), F.unhex(hexes).alias("data"))
    indexed.write_indexed(images, at, ["vec_id"], shard_rows=128)
    return at


BY_INDEX_SQL = f"""
SELECT i AS "index", vec_id, array_to_string(list_transform(g, lambda x: format('{{:02X}}', x)), '') AS pixels
FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, g FROM ({GREY_SQL}))"""


@query("images_by_index", f"SELECT * FROM ({BY_INDEX_SQL}) WHERE \"index\" % 50 = 0")
def images_by_index(spark, sf_dir):
    """Every 50th image of an indexed table, looked up by a table of numbers."""
    at = _indexed_images(spark, sf_dir)
    wanted = spark.range(0, indexed.length(spark, at), 50).withColumnRenamed("id", "index")
    return indexed.lookup(wanted, at).select("index", "vec_id", F.hex("data").alias("pixels"))


@query("last_images", f"""
SELECT (n - 1 - "index")::BIGINT AS position, "index", vec_id, pixels FROM ({BY_INDEX_SQL}), (SELECT count(*) AS n FROM embeddings) WHERE "index" >= n - 20""")
def last_images(spark, sf_dir):
    """A batch of twenty images by numbers that count from the end."""
    at = _indexed_images(spark, sf_dir)
    return indexed.at(spark, at, list(range(-1, -21, -1))).select("position", "index", "vec_id", F.hex("data").alias("pixels"))


LEDGER_SQL = f"""
WITH d AS (SELECT {PATH} AS path, doc_id % {RUNS} AS run, coalesce(text, '') AS text FROM documents)
SELECT sha256(text) AS digest, strlen(text)::BIGINT AS length, arg_min(path, (run, path)) AS keeper, count(*) AS copies, min(run)::BIGINT AS first_batch, max(run)::BIGINT AS last_batch FROM d GROUP BY text"""


def _ingested(spark, sf_dir):
    """The ledger after as many runs as there are parts of the documents; each run knows the others by its checkpoint only."""
    folder, ledger, checkpoint = (new_folder(spark, f"ingest-{x}") for x in ("files", "ledger", "checkpoint"))
    docs = table(spark, sf_dir, "documents").select(F.expr(PATH).alias("path"), "text", F.pmod("doc_id", F.lit(RUNS)).alias("run"))
    for run in range(RUNS):
        docs.where(F.col("run") == run).drop("run").write.mode("append").parquet(folder)
        stream = spark.readStream.schema("path string, text string").parquet(folder)
        ingest.record_available(ingest.digests(stream, content="text"), ledger, checkpoint)
    return ingest.digests(docs, content="text"), ingest.known(spark, ledger)


@query("ingested_ledger", LEDGER_SQL)
def ingested_ledger(spark, sf_dir):
    """Contents of documents that arrive in three runs: keeper, copies, the first run and the last."""
    return _ingested(spark, sf_dir)[1]


@query("ingested_copies", f"SELECT {PATH} AS path, keeper FROM documents d JOIN ({LEDGER_SQL}) l ON l.digest = sha256(coalesce(d.text, '')) WHERE {PATH} <> keeper")
def ingested_copies(spark, sf_dir):
    """Documents that are copies of one from an earlier run, or of a smaller path of their own."""
    return ingest.copies_of(*_ingested(spark, sf_dir))
