"""Golden cases, property tests and plans of the operators."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.functions import text
from glyphlake.operators import dedupe, geometry, glyphs, ranking, reports, tensors, verdicts


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize(
    "a,b,d", [("test", "test", 0), ("test", "tent", 1), ("gumbo", "gambol", 2), ("kitten", "sitting", 3), ("Saturday", "Sunday", 3), ("", "abc", 3)]
)
def test_edit_distance(spark, a, b, d):
    assert one(spark, text.edit_distance(F.lit(a), F.lit(b)), text.edit_distance(F.lit(a), F.lit(b), "byte")) == (d, d)


def test_edit_distance_units(spark):
    assert one(spark, text.edit_distance(F.lit("é"), F.lit("e")), text.edit_distance(F.lit("é"), F.lit("e"), "byte"), text.edit_distance(F.lit(""), F.lit("abc"), naive_empty=True)) == (1, 2, 0)
    with pytest.raises(ValueError):
        text.edit_distance(F.lit("a"), F.lit("b"), "word")


@pytest.mark.parametrize("s,points,size", [("f", 1, 1), ("܀", 1, 2), ("─", 1, 3), ("🂡", 1, 4), ("Hello World", 11, 11), ("Привет, товарищ", 15, 28)])
def test_lengths(spark, s, points, size):
    assert one(spark, text.code_points(F.lit(s)), text.utf8_bytes(F.lit(s))) == (points, size)


def test_ascii_lower(spark):
    assert one(spark, text.ascii_lower(F.lit("HeLlO, w0rLd!")), text.ascii_lower(F.lit("🂡helLO, товарищ")), text.ascii_lower(F.lit("É"))) == ("hello, w0rld!", "🂡hello, товарищ", "É")


@pytest.mark.parametrize("name,want", [("a.tar.GZ", ".gz"), (".bashrc", ".NONE"), ("noext", ".NONE"), ("x.TTF", ".ttf"), ("..x", ".NONE")])
def test_suffix(spark, name, want):
    assert one(spark, text.suffix(F.lit(name))) == (want,)


def test_paths_and_atlases(spark):
    assert one(spark, text.stem(F.lit("/a/b.c.zip")), text.parent(F.lit("/a/b.c.zip")), text.after_last(F.lit("x=1&f=arial"), "="), text.padded(F.lit(7), 7), text.padded(F.lit(12345678), 7)) == ("b.c", "/a", "arial", "0000007", "12345678")
    lines = spark.range(1).select(text.printable_atlas().alias("l")).first().l
    assert "".join(lines) == "".join(map(chr, range(32, 127))) and [len(x) for x in lines] == [12] * 7 + [11]
    assert len(text.OCR_LINE) == 55
    assert one(spark, text.split_atlas(F.lit("ab\ncd\n")), text.atlas_text(F.array(F.lit("ab"), F.lit("cd"))), text.single_symbols(F.lit("ab")), text.without_spaces(F.lit("a b"))) == (["ab", "cd"], "ab\ncd\n", ["a", "b"], "ab")


@pytest.mark.parametrize(
    "given_,want",
    [((0, 0, -1, -1, -1), (110, 72, 110, 55, 13, 55, 22)), ((110, 0, -1, -1, -1), (110, 72, 110, 55, 13, 55, 22)), ((-10, -10, -1, -1, -1), (110, 72, 110, 55, 13, 55, 22)),
     ((300, 12, -1, -1, -1), (300, 12, 50, 25, 6, 25, 10)), ((300, 12, 30, 20, -1), (300, 12, 50, 25, 30, 20, 10)), ((336, 3, 2, 1, 0), (336, 3, 14, 7, 2, 1, 0))],
)
def test_spacing(spark, given_, want):
    s = spark.range(1).select(geometry.spacing(*(F.lit(x) for x in given_)).alias("s")).first().s
    assert tuple(s) == want


def test_strip_geometry(spark):
    lit = F.lit
    assert one(spark, geometry.atlas_extent(lit(1), lit(14), lit(2), lit(1)), geometry.atlas_extent(lit(55), lit(14), lit(2), lit(1))) == (16, 880)


def test_best_point_dpi(spark):
    rows = geometry.best_point_dpi(spark.createDataFrame([(128, 8), (64, 4), (32, 2), (16, 1)], "dim int, padding int")).collect()
    assert {(r.dim, r.point, r.dpi) for r in rows} == {(128, 28, 288), (64, 14, 288), (32, 7, 288), (16, 3, 336)}


def test_overflow_closed_form(spark):
    rng = random.Random(5)
    boxes = [(rng.randint(-12, 30), rng.randint(-12, 30), rng.randint(0, 12), rng.randint(0, 12)) for _ in range(200)]

    def brute(x, y, w, h):
        cell = image = 0
        for j in range(y, y + h):
            cell += not 3 <= j < 21
            if not 0 <= j < 24:
                image += 1
                continue
            for i in range(x, x + w):
                cell += not 4 <= i < 22
                image += not 0 <= i < 26
        return cell, image

    c = F.col
    o = geometry.overflow(c("x"), c("y"), c("w"), c("h"), (F.lit(4), F.lit(3), F.lit(22), F.lit(21)), (F.lit(26), F.lit(24)))
    got = spark.createDataFrame(boxes, "x int, y int, w int, h int").select("x", "y", "w", "h", o.alias("o")).collect()
    assert all(tuple(r.o) == brute(r.x, r.y, r.w, r.h) for r in got)


def test_placement_truncates(spark):
    p = lambda adv, left: one(spark, geometry.placement(F.lit(adv), F.lit(left), F.lit(5), F.lit(9)))[0]
    assert tuple(p(10 * 64, 3)) == (-3, 4) and tuple(p(64, 4)) == (1, 4)


def test_failed_glyphs_shift_columns(spark):
    g = spark.createDataFrame([("f", 0, 0, False), ("f", 0, 1, True), ("f", 0, 2, False)], "font string, row int, idx int, load_failed boolean")
    assert [(r.idx, r.col) for r in geometry.successful_columns(g, ["font", "row"], "idx").orderBy("idx").collect()] == [(0, 0), (2, 1)]


def test_sweep_stops(spark):
    s = [("a", 1, 5, 2, 0), ("a", 2, 5, 5, 0), ("a", 3, 5, 1, 0), ("b", 1, 5, 5, 0), ("b", 2, 5, 5, 5), ("b", 3, 5, 5, 5), ("c", 1, 5, 0, 0)]
    got = geometry.sweep_until(spark.createDataFrame(s, "f string, offset int, image_count int, out_of_cell int, empty_cell int"), ["f"])
    assert sorted((r.f, r.offset) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)]


def greedy(atlas):
    """Pairs of alike symbols, each later one with its first earlier match, merged into sets in order."""
    pairs = []
    for j, (b, kb) in enumerate(atlas):
        for a, ka in atlas[:j]:
            if ka == kb and a != b:
                pairs.append((a, b))
                break
    sets = []
    for a, b in pairs:
        for s in sets:
            if a in s or b in s:
                s |= {a, b}
                break
        else:
            sets.append({a, b})
    return sorted("".join(sorted(s)) for s in sets)


def test_match_sets_equal_pairwise_merge(spark):
    rng = random.Random(3)
    atlases = {i: [(chr(33 + k), rng.randrange(6)) for k in rng.sample(range(60), rng.randint(0, 14))] for i in range(60)}
    rows = [(i, ch, key) for i, a in atlases.items() for ch, key in a] + [(0, " ", 1), (0, None, 1)]
    got = glyphs.match_sets(spark.createDataFrame(rows, "font int, ch string, key int"), ["font"], ["key"]).collect()
    for i, a in atlases.items():
        assert sorted(r.match_set for r in got if r.font == i) == greedy(a)


def test_duplicate_verdict(spark):
    owners = spark.createDataFrame([(1,), (2,), (3,)], "f int")
    sets = spark.createDataFrame([(1, "ab"), (2, "ab"), (2, "xy")], "f int, match_set string")
    allowed = spark.createDataFrame([("ab",), ("ab",)], "match_set string")
    v = glyphs.duplicate_verdict(owners, sets, allowed, "f")
    assert {r.f: r.verdict for r in v.collect()} == {1: "allowed_duplicates", 2: "failed_duplicates", 3: "keep"}
    assert "BroadcastHashJoin" in v._jdf.queryExecution().executedPlan().toString()


def test_verdict_order(spark):
    s = spark.createDataFrame([(1, True, ["a"], ["b"]), (2, False, ["a"], ["b"]), (3, False, [], ["b"]), (4, False, [], [])], "i int, font_not_loaded boolean, char_loads_failed array<string>, empty array<string>")
    v = verdicts.bad_font_verdict(s)
    assert [r.verdict for r in v.orderBy("i").collect()] == ["failed_font_loads", "failed_char_loads", "empty_chars", "keep"]
    assert sum(r.n for r in verdicts.counts(v).collect()) == 4


def test_route(spark, tmp_path):
    d = spark.createDataFrame([(1, "keep"), (2, "bad")], "i int, verdict string")
    verdicts.route(d, str(tmp_path / "dry"), dry_run=True).collect()
    assert not (tmp_path / "dry").exists()
    verdicts.route(d, str(tmp_path / "out")).collect()
    assert {p.name for p in (tmp_path / "out").glob("verdict=*")} == {"verdict=keep", "verdict=bad"}


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 60), st.floats(0, 0.5), st.floats(0, 0.5))
def test_splits(spark, n, test, validation):
    d = ranking.split(spark.range(n), "id", test, validation).groupBy("split").count().collect()
    c = {r.split: r["count"] for r in d}
    assert c.get("test", 0) == int(n * test) and c.get("validation", 0) == int(n * validation) and sum(c.values()) == n


def test_numbers_are_complete_in_each_group(spark):
    d = spark.range(500).withColumn("g", F.when(F.col("id") < 300, "hot").when(F.col("id") < 400, None).otherwise("b"))
    got = ranking.numbered(d, ranking.shuffled_key(F.col("id")), ["id"], ["g"]).collect()
    for g in ("hot", None, "b"):
        assert sorted(r.no for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


def test_dedupe_and_sets(spark):
    d = spark.createDataFrame([("/a", "x"), ("/b", "x"), ("/c", "y")], "path string, content string")
    assert {(r.keeper, r.copies) for r in dedupe.keepers(d, "path", "content").collect()} == {("/a", 2), ("/c", 1)}
    assert [tuple(r) for r in dedupe.log(d, "path", "content").collect()] == [("/b", "/a")]
    assert dedupe.difference(d, d.where("path = '/a'"), "path").count() == 2
    assert dedupe.discovered(d.select("content"), d.select("content")).count() == 2


def test_quantisation_round_trip(spark):
    v = spark.range(256).select((F.col("id") / 255.0).alias("x"))
    for levels in (2, 4, 14, 256):
        back = tensors.from_labels(tensors.one_hot(tensors.bucket(F.col("x"), levels), levels), levels)
        assert v.where(back != tensors.quantised(F.col("x"), levels)).count() == 0


def test_noise_is_standard_and_repeats(spark):
    z = spark.range(200).select(F.explode(tensors.noise(50, F.col("id"))).alias("z"))
    m, s = z.agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(m) < 0.05 and abs(s - 1) < 0.05
    assert z.agg(F.sum("z")).first() == z.agg(F.sum("z")).first()


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([(0,), (2,), (2,), (None,)], "d int")
    h = reports.histogram(d, F.col("d"))
    assert [tuple(r) for r in h.collect()] == [(0, 1), (2, 2)]
    assert reports.at_zero(h).first().n == 1 and reports.at_zero(h.where("distance > 0")).first().n == 0
    assert reports.skipped(d, F.col("d")).first().skipped == 1
    reports.to_csv(h, str(tmp_path / "h"))
    assert spark.read.option("header", True).csv(str(tmp_path / "h")).count() == 2
    assert reports.to_json_map(spark.createDataFrame([("b", "2"), ("a", "1")], "k string, v string"), "k", "v").first().json == '{"a":"1","b":"2"}'


def test_truncation_losses(spark):
    v = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 1.0],), (None,), ([],)], "mu array<double>")
    settings = spark.createDataFrame([(0,), (1,), (2,), (2,), (3,), (9,)], "hidden int")
    got = sorted((r.hidden, r.loss) for r in tensors.truncation_losses(v, settings).collect())
    assert got == [(0, 15 / 4), (1, 14 / 4), (2, 10 / 4), (2, 10 / 4), (3, 0.0), (9, 0.0)]


def test_best_sizes_of_large_cells(spark):
    """The best point may be larger than the dpi that is wanted."""
    d = spark.createDataFrame([(2000, 0), (128, 8), (64, 4), (32, 2), (16, 1), (4, 2)], "dim int, padding int")
    got = {(r.dim, r.padding): (r.point, r.dpi) for r in geometry.best_point_dpi(d).collect()}
    assert got == {(2000, 0): (480, 300), (128, 8): (28, 288), (64, 4): (14, 288), (32, 2): (7, 288), (16, 1): (3, 336)}
