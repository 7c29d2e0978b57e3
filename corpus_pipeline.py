"""The corpus pipeline: five stages from documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import decontaminate, mixing, neardup, quality, secrets
from glyphlake.llm.common import own_names, small_batches, text_of, written

#: Ids of rejected documents are broadcast up to this number, and joined by shuffle beyond it.
MOST_IDS = 500_000


def _without(docs: DataFrame, gone: DataFrame, condition) -> DataFrame:
    gone = written(gone.distinct(), "pipeline-gone")
    gone = F.broadcast(gone) if gone.count() <= MOST_IDS else gone
    return docs.join(gone, condition, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of quality is below the threshold go; see quality.judge().

    Rows are told apart by doc_id and text: rows with a null id, and rows that repeat an id with another text, are judged
    one by one; rows that repeat in full share their fate. Null texts are judged as empty ones. An empty table stays
    empty. Columns of any name stay as they are.
    """
    d, key, text, _ = own_names(docs, "doc_id", "text")
    same = F.xxhash64(text_of(text)).eqNullSafe(F.col("th")) & F.col(key).cast("bigint").eqNullSafe(F.col("k"))
    with small_batches(spark):
        judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        gone = judged.where(~F.col("keep")).select(F.col("doc_id").alias("k"), "th")
        return _without(d, gone, same).toDF(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: five-word shingles, similarity of 0.8.

    All SimHash fingerprints are searched by the pigeonring as in op3, and the shingle sets of linked texts decide; similar
    texts more than two bits apart are found by bands besides. See neardup.near_classes().
    The smallest doc_id stays, null ids last; of rows that repeat in full one stays; null and empty texts are one class,
    and so is each text of fewer than five words. An empty table stays empty. Columns of any name stay as they are.
    """
    with small_batches(spark):
        return neardup.deduplicated(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go; see decontaminate.contaminated().

    Rows are told apart by doc_id and text, so null and repeated ids are no matter; null and empty texts stay. An empty
    table stays empty. Columns of any name stay as they are.
    """
    d, key, text, _ = own_names(docs, "doc_id", "text")
    rows = d.select(F.xxhash64(key, text_of(text)).alias("row"), F.col(text).alias("text"))
    with small_batches(spark):
        found = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row")
        return _without(d, found.select("row"), F.xxhash64(key, text_of(text)) == F.col("row")).toDF(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows. Documents without any stay as they are.

    Null texts stay null; all rows stay, those that repeat too; long texts are scanned whole. An empty table stays empty.
    Columns of any name stay as they are.
    """
    return secrets.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, by source weights: doc_id, lang, n_chars, source, size, source_size, target, taken.

    Null texts have no words, null sources are one source, every row stays. An empty table stays empty; columns other
    than these of documents are left out.
    """
    return mixing.mix(docs, keep=("lang", "n_chars"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
]

#: SQL cannot express the classifier, the similarity join and the alignment; the tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
