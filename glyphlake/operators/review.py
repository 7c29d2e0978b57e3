"""Review of items by people: a window that moves over them in key order, decisions as a log, and a cursor that is kept.

A window is a range of keys, so it is read by a filter that reaches the scan, whatever the place it has come to; nothing
is sorted but the rows of a page. Decisions are only appended. What leaves the window for good is purged: its decision
is final, and going back ends there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items that may be gone back to.
BACKLOG = 500


def write_items(items: DataFrame, path: str, key: str) -> None:
    """The items in ranges of the key, sorted, so that the statistics of files and row groups tell which hold a window."""
    items.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def ahead(items: DataFrame, key: str, after=None, size: int = BACKLOG) -> DataFrame:
    """The next `size` items behind a key, in key order; the first ones for None. Null keys are never shown."""
    given = items.where(F.col(key).isNotNull() if after is None else F.col(key) > F.lit(after))
    return given.orderBy(key).limit(size)


def back(items: DataFrame, key: str, before, floor=None, size: int = BACKLOG) -> DataFrame:
    """The `size` items in front of a key, in key order, but none up to the floor, which is what was purged last."""
    given = items.where(F.col(key) < F.lit(before))
    given = given if floor is None else given.where(F.col(key) > F.lit(floor))
    return given.orderBy(F.col(key).desc()).limit(size).orderBy(key)


def decide(decisions: DataFrame, log: str, step: int) -> None:
    """Appends decisions (key, keep) of a step to the log; null takes a decision back. A step that is repeated replaces itself."""
    decisions.write.mode("overwrite").parquet(f"{log}/step={step}")


def latest(spark: SparkSession, log: str, schema: str, key: str) -> DataFrame:
    """(key, keep): the last decision on each key; schema: that of the decisions, for logs without any."""
    try:
        rows = spark.read.schema(f"{schema}, step bigint").parquet(log)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], f"{schema}, step bigint")
    return rows.groupBy(key).agg(F.max_by(F.struct("keep"), "step").alias("d")).select(key, "d.keep")


def shown(page: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """A page with the decisions so far; undecided items have none."""
    return page.join(decided, key, "left")


def purge(items: DataFrame, decided: DataFrame, key: str, last, floor=None, backlog: int = BACKLOG) -> tuple[object, DataFrame]:
    """(floor, items with final decisions): what falls out of the backlog when `last` is the newest item of the window.

    The window keeps the newest `backlog` items up to `last`; the new floor is the last key in front of them. Undecided
    items that fall out stay undecided. Where fewer are in the window nothing falls out.
    """
    given = items.where(F.col(key) <= F.lit(last))
    given = given if floor is None else given.where(F.col(key) > F.lit(floor))
    edge = given.orderBy(F.col(key).desc()).limit(backlog + 1).agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n")).first()
    if edge["n"] <= backlog:
        return floor, given.limit(0).join(decided, key, "left")
    return edge["k"], given.where(F.col(key) <= F.lit(edge["k"])).join(decided, key, "left")


def save_cursor(spark: SparkSession, path: str, step: int, **place: str | None) -> None:
    """Keeps where a review is, as text, after a step."""
    rows = [(step, name, value) for name, value in place.items()]
    spark.createDataFrame(rows, "step bigint, name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/at={step}")


def load_cursor(spark: SparkSession, path: str) -> dict[str, str | None]:
    """Where a review was after its last step; empty before the first."""
    try:
        rows = spark.read.schema("step bigint, name string, value string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    last = rows.groupBy("name").agg(F.max_by(F.struct("value"), "step").alias("v")).select("name", "v.value")
    return {r["name"]: r["value"] for r in last.collect()}  # a row for each name that was saved
