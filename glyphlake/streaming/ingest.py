"""Incremental ingestion: files that are new since the last run become rows of a table, and copies are known by their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.operators.dedupe import content_key

FILE = "path string, modificationTime timestamp, length bigint, content binary"
LEDGER = "length bigint, digest string, keeper string, seen timestamp, copies bigint, batch bigint"
#: The state store that keeps digests on disk rather than in the heap, for ledgers of any size.
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_files(spark: SparkSession, path: str, glob: str | None = None, per_batch: int = 10_000) -> DataFrame:
    """A stream of the files below path."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def append_available(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Appends what is there now to the Parquet folder, once each, and ends."""
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def digests(stream: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, length, digest) of a stream of files or texts; null content counts as empty."""
    given = F.coalesce(F.col(content), F.lit("") if stream.schema[content].dataType.typeName() == "string" else F.lit(b""))
    return stream.select(F.col(path).cast("string").alias("path"), *content_key(given))


def record_available(found: DataFrame, ledger: str, checkpoint: str) -> None:
    """Records what a stream (path, length, digest) has now in the ledger, and ends.

    The state of the stream holds, for each content ever seen, its keeper and the number of its copies: the first batch
    that brought it wins, in it the smallest path. A copy that comes in a later run, in a new session, meets the state of
    the checkpoint. Each batch writes the contents that it brought or met, as of then, to a folder of its own; one that is
    repeated after a failure writes the same folder again. Rows of one content are summed before they are shuffled.
    """
    first = F.min(F.struct("seen", F.col("path").alias("keeper")))
    state = found.withColumn("seen", F.current_timestamp()).groupBy("length", "digest").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select("length", "digest", "first.keeper", "first.seen", "copies")
        rows.write.mode("overwrite").parquet(f"{ledger.rstrip('/')}/batch={number}")

    query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def known(spark: SparkSession, ledger: str) -> DataFrame:
    """(length, digest, keeper, copies, first_batch, last_batch): the latest state of each content in the ledger."""
    log = spark.read.schema(LEDGER).parquet(ledger)
    last = F.max_by(F.struct("keeper", "copies"), "batch")
    states = log.groupBy("length", "digest").agg(last.alias("s"), F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch"))
    return states.select("length", "digest", "s.keeper", "s.copies", "first_batch", "last_batch")


def copies_of(found: DataFrame, contents: DataFrame) -> DataFrame:
    """(path, keeper) of the rows (path, length, digest) that are copies of a known content kept under another path."""
    kept = contents.where("copies > 1").select("length", "digest", "keeper")
    return found.join(kept, ["length", "digest"]).where(F.col("path") != F.col("keeper")).select("path", "keeper")
