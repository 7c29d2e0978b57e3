"""Whole runs over a folder of fonts."""

import shutil
from pathlib import Path

import numpy as np
import pytest

from glyphlake.operators import raster
from glyphlake.plans import programs
from glyphlake.sources import images

FOUND = sorted(Path("/usr/share/fonts").rglob("*.ttf")) if Path("/usr/share/fonts").is_dir() else []
pytestmark = pytest.mark.skipif(not raster.available() or not FOUND, reason="no FreeType or no font here")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("fonts")
    for f in FOUND[:2]:
        shutil.copy(f, d / f.name)
    (d / "broken.ttf").write_bytes(b"no font")
    (d / "filenames.json").write_text("{}")
    return str(d)


def test_bad_fonts(spark, folder):
    v = {r.font_id.rsplit("/", 1)[1]: r.verdict for r in programs.bad_fonts(spark, folder, symbols="Ab!").collect()}
    assert v.pop("broken.ttf") == "failed_font_loads" and set(v.values()) == {"keep"} and len(v) == len(FOUND[:2])


def test_duplicates(spark, folder, tmp_path):
    sets = programs.font_match_sets(spark, folder, symbols="AAB", point=12)
    assert sets.count() == 0
    verdict = {r.font_id.rsplit("/", 1)[1]: r.verdict for r in programs.duplicate_fonts(spark, folder).collect()}
    assert verdict["broken.ttf"] == "keep" and len(verdict) == len(FOUND[:2]) + 1
    assert programs.identify_duplicates(spark, folder).columns == ["match_set", "occurrences", "length", "cell"]


def test_atlas_and_ocr(spark, folder):
    kept, sums = programs.render_atlas(spark, folder, ["AB"], skip_cell_out=False, dpi=300, point=12)
    rows = kept.collect()
    assert len(rows) == len(FOUND[:2]) and all(r.height == 100 and r.width == 156 and any(r.data) for r in rows)
    assert sums.first().total == len(rows) and images.encoded(kept).count() == len(rows)
    d = programs.ocr_fonts(spark, folder, ["AB"], lambda crop: "ab\n" if crop.min() < 255 else "")
    assert {(r.distance, r.lower_distance, r.verdict) for r in d.collect()} == {(2, 0, "keep")}
    assert [tuple(r) for r in programs.ocr_stats(d).collect()] == [(0, len(rows))]
    s = programs.sweep(spark, folder, ["AB"], [{"padding": 1, "point": 3, "dpi": 336, "offset": o} for o in (0, 1)])
    assert s.count() == 2 and {r.image_count for r in s.collect()} == {len(rows)}


def test_settings_as_rows(spark, folder, tmp_path):
    """All settings in one run give what each gives alone; fonts are read once, glyphs shuffled once."""
    from glyphlake.operators import verdicts

    settings = [{"padding": b, "point": p, "dpi": d, "offset": o, "border": 2 * b} for b, p, d, o in ((1, 3, 336, 0), (1, 3, 336, 40), (100, 12, 300, 5), (1, 0, 0, 3))]
    alone = []
    for x in settings:
        f = verdicts.flag_sums(programs.atlas_images(spark, folder, ["Ag", "!"], **x)).first()
        alone.append((x["padding"], x["point"], x["dpi"], x["offset"], f.total, f.out_of_image, f.out_of_cell, f.empty_cell))
    found = programs.sweep(spark, folder, ["Ag", "!"], settings)
    assert sorted(map(tuple, found.collect())) == sorted(alone) and len({r[6] for r in alone}) > 1
    plan = programs.sweep(spark, folder, ["Ag", "!"], settings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning(font_id") == 1
    assert [r.image_count for r in programs.sweep(spark, str(tmp_path), ["A"], settings[:1]).collect()] == [0]


def test_search_sizes(spark, folder):
    ocr = lambda crop: "AB\n" if crop.shape[0] > 30 else "A8\n"
    tried = programs.search_sizes(spark, folder, ["AB"], ocr, [{"point": 6, "dpi": 72}, {"point": 72, "dpi": 72}, {"point": 36, "dpi": 300}])
    n = len(FOUND[:2])
    assert [tuple(r) for r in tried.collect()] == [(72, 72, n), (36, 300, n), (6, 72, 0)]
    drawn = programs.size_settings(5)
    assert drawn == programs.size_settings(5) and all(100 <= s["dpi"] <= 1000 and 10 <= s["point"] <= 100 for s in drawn)


def test_sentences_overwrite(spark, folder):
    blended, plain = (programs.atlas_images(spark, folder, ["fjfj"], cells=False, blend=b).select("image_id", "overwrites").collect() for b in (True, False))
    assert sorted(blended) == sorted(plain) and len(plain) == len(FOUND[:2])


def test_highlight_and_bounds(spark, tmp_path):
    """Rectangles of highlighted cells lie where the cell's corners are; pen and cells agree with the spacing."""
    from glyphlake.operators import raster

    canvas = np.zeros((8, 9), np.uint8)
    raster.outline(canvas, 2, 1, 12, 5)
    assert canvas[1, 2:].tolist() == [128] * 7 and canvas[5, 2:].tolist() == [128] * 7 and canvas[1:6, 2].tolist() == [128] * 5
    assert int((canvas > 0).sum()) == 7 + 7 + 3
    g = np.full((2, 2), 255, np.uint8)
    drawn, over, _, _ = raster.paint([(2, 1, g), (5, 5, g)], 8, 9, boxes=[[2, 1, 6, 4], None])
    assert over == 3 and drawn[4, 6] == 128 and drawn[1, 2] == 255 and drawn[5, 5] == 255
