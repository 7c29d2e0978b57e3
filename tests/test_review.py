"""Review by cursor."""

from glyphlake.operators import review

SCHEMA = "k string, keep boolean"


def test_windows_are_ranges_of_keys(spark, tmp_path):
    at = str(tmp_path / "items")
    d = spark.createDataFrame([(f"k{i:04}",) for i in range(1000)] + [(None,)], "k string")
    review.write_items(d, at, "k")
    items = spark.read.parquet(at)
    page = review.ahead(items, "k", "k0499", 3)
    assert [r.k for r in page.collect()] == ["k0500", "k0501", "k0502"]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,k0499)" in plan and "TakeOrderedAndProject" in plan and "Offset" not in plan
    assert [r.k for r in review.ahead(items, "k", None, 2).collect()] == ["k0000", "k0001"]
    assert review.ahead(items, "k", "k0999", 2).count() == 0
    older = review.back(items, "k", "k0500", None, 3)
    assert [r.k for r in older.collect()] == ["k0497", "k0498", "k0499"]
    assert "LessThan(k,k0500)" in older._jdf.queryExecution().executedPlan().toString()
    assert [r.k for r in review.back(items, "k", "k0500", "k0498", 3).collect()] == ["k0499"]


def test_the_last_decision_counts(spark, tmp_path):
    log = str(tmp_path / "log")
    assert review.latest(spark, log, SCHEMA, "k").count() == 0
    put = lambda step, *rows: review.decide(spark.createDataFrame(rows, SCHEMA), log, step)
    put(0, ("a", True), ("b", False), ("c", True))
    put(1, ("b", True), ("c", None))
    put(1, ("b", True), ("c", None))  # the step again
    assert {r.k: r.keep for r in review.latest(spark, log, SCHEMA, "k").collect()} == {"a": True, "b": True, "c": None}
    page = spark.createDataFrame([("b",), ("z",)], "k string")
    assert {r.k: r.keep for r in review.shown(page, review.latest(spark, log, SCHEMA, "k"), "k").collect()} == {"b": True, "z": None}


def test_what_leaves_the_backlog_is_final(spark):
    items = spark.createDataFrame([(f"k{i}",) for i in range(10)], "k string")
    decided = spark.createDataFrame([("k0", True), ("k2", False)], SCHEMA)
    floor, gone = review.purge(items, decided, "k", "k5", None, 4)
    assert floor == "k1" and {r.k: r.keep for r in gone.collect()} == {"k0": True, "k1": None}
    floor, gone = review.purge(items, decided, "k", "k5", floor, 4)
    assert floor == "k1" and gone.count() == 0
    floor, gone = review.purge(items, decided, "k", "k9", floor, 4)
    assert floor == "k5" and {r.k: r.keep for r in gone.collect()} == {"k2": False, "k3": None, "k4": None, "k5": None}


def test_a_cursor_outlives_its_session(spark, tmp_path):
    at = str(tmp_path / "cursor")
    assert review.load_cursor(spark, at) == {}
    review.save_cursor(spark, at, 0, last="k5", floor=None)
    review.save_cursor(spark, at, 1, last="k9", floor="k1")
    review.save_cursor(spark, at, 2, last="k7", floor="k1")
    assert review.load_cursor(spark.newSession(), at) == {"last": "k7", "floor": "k1"}
