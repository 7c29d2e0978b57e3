"""The programs as commands."""

import csv
import io
import zipfile
from pathlib import Path

import pytest

from glyphlake.__main__ import PROGRAMS, main, parser
from glyphlake.operators import raster
from glyphlake.sources import images

FONTS = sorted(Path("/usr/share/fonts").rglob("DejaVu*.ttf"))


def run(spark, *argv):
    out = io.StringIO()
    assert main([str(a) for a in argv], out, spark) == 0
    return list(csv.DictReader(io.StringIO(out.getvalue())))


@pytest.fixture(scope="module")
def fonts(tmp_path_factory):
    if not FONTS:
        pytest.skip("no fonts here")
    at = tmp_path_factory.mktemp("fonts")
    for k, p in enumerate(FONTS[:2]):
        (at / f"{k}.ttf").write_bytes(p.read_bytes())
    (at / "sub").mkdir()
    (at / "sub/bad.TTF").write_bytes(b"no font")
    return at


def test_flags(capsys):
    assert parser().parse_args(["bad_fonts", "--font_dir", "x", "--dry_run"]).dry_run is True
    assert parser().parse_args(["atlases", "--font_dir", "x", "--save", "false"]).save is False
    for bad in ([], ["entries"], ["atlases", "--font_dir", "x", "--save", "maybe"], ["atlases", "--font_dir", "x", "--write_style", "tga"], ["bad_fonts", "--font_dir", "x", "--renderer", "own"]):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)
    capsys.readouterr()
    assert len(PROGRAMS) == 12


def test_files(spark, tmp_path):
    for name in ("a.ttf", "b.TTF", "c.otf", "d/e", "filenames.json"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(name.encode())
    at = tmp_path / "in"
    assert [r["path"].rsplit("/", 1)[1] for r in run(spark, "fonts", "--font_dir", at, "--count", 2)] == ["a.ttf", "b.TTF"]
    assert {(r["folder"], r["n"]) for r in run(spark, "entries", "--font_dir", at)} == {("in", "4"), ("d", "1")}
    got = run(spark, "buckets", "--font_dir", at, "--output_dir", tmp_path / "named")
    assert {(r["ext"], r["n"]) for r in got} == {("ttf", "2"), ("otf", "1"), ("NONE", "1")}
    assert spark.read.json(str(tmp_path / "named")).count() == 4
    got = run(spark, "splits", "--font_dir", at, "--output_dir", tmp_path / "split", "--test_ratio", 0.4, "--validation_ratio", 0.2)
    assert {r["split"]: r["n"] for r in got} == {"test": "2", "validation": "1", "train": "2"}
    main(["entries", "--font_dir", str(at), "--table", str(tmp_path / "t")], None, spark)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_unzip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.ttf", "x")
    with zipfile.ZipFile(tmp_path / "in/a.zip", "w") as z:
        z.writestr("b.zip", inner.getvalue())
        z.writestr("dir/c.txt", "y")
    got = run(spark, "unzip", "--font_dir", tmp_path / "in", "--output_dir", tmp_path / "out")
    assert sorted(r["path"].rsplit("/in/", 1)[1] for r in got) == ["a/b.zip", "a/b/deep.ttf", "a/dir/c.txt"]
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.suffix in (".ttf", ".txt")} == {"deep.ttf": b"x", "c.txt": b"y"}


def test_best_sizes(spark, tmp_path):
    (tmp_path / "s.csv").write_text("padding,point,dpi,offset,image_count,out_of_image,out_of_cell,empty_cell\n1,3,336,0,10,0,4,0\n1,3,336,1,10,0,2,0\n")
    (r,) = run(spark, "best_sizes", "--csv", tmp_path / "s.csv")
    assert (r["offset"], r["out_of_cell"], r["usable"]) == ("1", "2", "0.8")


@pytest.mark.skipif(not raster.available(), reason="no library here")
def test_fonts(spark, fonts, tmp_path, monkeypatch):
    (tmp_path / "own_reader.py").write_text("def read(image):\n    return 'A\\n'\n")  # a recogniser that workers can import
    spark.sparkContext.addPyFile(str(tmp_path / "own_reader.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    got = run(spark, "bad_fonts", "--font_dir", fonts, "--error_dir", tmp_path / "bad")
    assert {r["verdict"]: r["n"] for r in got} == {"keep": "2", "failed_font_loads": "1"}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 3
    run(spark, "bad_fonts", "--font_dir", fonts, "--error_dir", tmp_path / "dry", "--dry_run")
    assert not (tmp_path / "dry").exists()
    got = run(spark, "duplicate_fonts", "--font_dir", fonts, "--error_dir", tmp_path / "dup")
    assert sum(int(r["n"]) for r in got) == 3
    assert all(r["match_set"] and int(r["occurrences"]) > 0 for r in run(spark, "match_sets", "--font_dir", fonts))
    for renderer in ("library", "outlines"):
        out = tmp_path / renderer
        got = run(spark, "atlases", "--font_dir", fonts, "--output_dir", out, "--atlas", "Ab\nc", "--dpi", 96, "--point", 30, "--write_style", "smaller", "--skip_cell_out", "false", "--renderer", renderer)
        assert len(got) == 2 and {p.name for p in out.iterdir()} == {"0.ttf.png", "1.ttf.png"}
        h, w, data = images.parse((out / "0.ttf.png").read_bytes())
        assert (h, w) == (int(got[0]["height"]), int(got[0]["width"])) and any(data)
    (r,) = run(spark, "atlases", "--font_dir", fonts, "--atlas", "Ab", "--stats", "--save", "false")
    assert r["total"] == "2"
    got = run(spark, "distances", "--font_dir", fonts, "--atlas", "A", "--ocr", "own_reader:read", "--padding", 4)
    assert got == [{"distance": "0", "n": "2"}]
    got = run(spark, "unread_fonts", "--font_dir", fonts, "--atlas", "B", "--ocr", "own_reader:read", "--padding", 4)
    assert got == [{"verdict": "001", "n": "2"}]
