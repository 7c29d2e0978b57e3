"""A review that goes forward and back, decides and purges, each step from what the step before left in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.operators import review
from glyphlake.plans.registry import query
from glyphlake.session import new_folder, table

PAGE, KEPT = 40, 60
DECISION = "doc_id bigint, keep boolean"
#: What a reviewer does: two pages on, one back, two pages on, one back, which the purge cuts short.
MOVES = ("ahead", "ahead", "back", "ahead", "ahead", "back")

# rows numbered by doc_id; a page shows the decisions of earlier steps: by the label, but undecided where doc_id ends in 7
REVIEW_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS no FROM (SELECT DISTINCT doc_id FROM documents)),
l AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 7 THEN max(quality) = 1 END AS keep FROM labels GROUP BY doc_id),
s AS (SELECT * FROM (VALUES (0, 1, {PAGE}, 0), (1, {PAGE + 1}, {2 * PAGE}, {PAGE}), (2, {2 * PAGE - KEPT + 1}, {PAGE}, {2 * PAGE}), (3, {PAGE + 1}, {2 * PAGE}, {2 * PAGE}), (4, {2 * PAGE + 1}, {3 * PAGE}, {2 * PAGE}), (5, {3 * PAGE - KEPT + 1}, {2 * PAGE}, {3 * PAGE})) t(step, a, b, decided))
SELECT step::INT AS step, d.doc_id, CASE WHEN no <= decided THEN keep END AS keep FROM s JOIN d ON no BETWEEN a AND b LEFT JOIN l ON l.doc_id = d.doc_id"""


def _reviewed(spark, sf_dir):
    """The pages that were shown, by step, and the tables of decisions that became final."""
    at = {name: new_folder(spark, f"review-{name}") for name in ("items", "log", "cursor", "pages", "final")}
    review.write_items(table(spark, sf_dir, "documents").select("doc_id").distinct(), at["items"], "doc_id")
    items = spark.read.parquet(at["items"])
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("keep"))
    labels = labels.withColumn("keep", F.when(F.col("doc_id") % 10 != 7, F.col("keep")))
    for step, move in enumerate(MOVES):
        cursor = {k: None if v is None else int(v) for k, v in review.load_cursor(spark, at["cursor"]).items()}
        floor = cursor.get("floor")
        if move == "ahead":
            page = review.ahead(items, "doc_id", cursor.get("last"), PAGE)
        else:
            page = review.back(items, "doc_id", cursor["first"], floor, PAGE)
        decided = review.latest(spark, at["log"], DECISION, "doc_id")
        review.shown(page, decided, "doc_id").write.parquet(f"{at['pages']}/step={step}")
        ends = page.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).first()
        review.decide(page.join(labels, "doc_id").select("doc_id", "keep"), at["log"], step)
        newest = max(x for x in (cursor.get("newest"), ends["last"]) if x is not None)
        floor, final = review.purge(items, review.latest(spark, at["log"], DECISION, "doc_id"), "doc_id", newest, floor, KEPT)
        final.write.parquet(f"{at['final']}/step={step}")
        place = {"first": ends["first"], "last": ends["last"], "newest": newest, "floor": floor}
        review.save_cursor(spark, at["cursor"], step, **{k: None if v is None else str(v) for k, v in place.items()})
    return at


@query("review_pages", REVIEW_SQL)
def review_pages(spark, sf_dir):
    """The documents of each page with the decisions so far."""
    return spark.read.schema(f"{DECISION}, step int").parquet(_reviewed(spark, sf_dir)["pages"]).select("step", "doc_id", "keep")


@query("review_purged", f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS no FROM (SELECT DISTINCT doc_id FROM documents)),
l AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 7 THEN max(quality) = 1 END AS keep FROM labels GROUP BY doc_id)
SELECT CASE WHEN no <= {2 * PAGE - KEPT} THEN 1 ELSE 4 END::INT AS step, d.doc_id, keep FROM d LEFT JOIN l ON l.doc_id = d.doc_id WHERE no <= {3 * PAGE - KEPT}""")
def review_purged(spark, sf_dir):
    """Documents that left the backlog, by the step that purged them, with their final decision."""
    return spark.read.schema(f"{DECISION}, step int").parquet(_reviewed(spark, sf_dir)["final"]).select("step", "doc_id", "keep")
