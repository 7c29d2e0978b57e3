"""Tables with access by index, and ingestion with state."""

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import dedupe
from glyphlake.sources import indexed
from glyphlake.streaming import ingest


def scans(df):
    """Files and rows that the scans of a collected DataFrame read."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    out = []
    for i in range(leaves.size()):
        m = leaves.apply(i).metrics()
        if m.contains("numFiles"):
            out.append((m.get("numFiles").get().value(), m.get("numOutputRows").get().value()))
    return out


@pytest.fixture(scope="module")
def images(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("indexed") / "t")
    d = spark.range(5000).select(F.concat(F.lit("img"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("image_id"), F.sha2(F.col("id").cast("string"), 512).alias("data"), (F.col("id") % 7).alias("index2"))
    indexed.write_indexed(d.repartition(6, F.xxhash64("image_id")), at, ["image_id"], shard_rows=500, group_bytes=4096)
    return at


def test_indexed_rows_are_in_order(spark, images):
    assert indexed.length(spark, images) == 5000
    got = indexed.rows(spark, images).orderBy("index").collect()
    assert [(r["index"], r.image_id, r.shard) for r in got] == [(i, f"img{i:05}", i // 500) for i in range(5000)]


def test_access_by_index_reads_matching_files_and_groups_only(spark, images):
    wanted = [7, 4999, 7, -1, 2600]
    df = indexed.at(spark, images, wanted)
    got = df.orderBy("position").collect()
    assert [(r.position, r.image_id) for r in got] == [(k, f"img{i % 5000:05}") for k, i in enumerate(wanted)]
    # the scan alone, as its metrics say after it ran: three of ten shards, and of these some row groups
    scan = indexed.rows(spark, images).where(F.col("shard").isin([0, 5, 9]) & F.col("index").isin([7, 2600, 4999]))
    assert len(scan.collect()) == 3
    (files, rows), (all_files, all_rows) = scans(scan)[0], None or _all(spark, images)
    assert files < all_files / 2 and rows < 1500 and all_rows == 5000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert "In(index" in plan.replace("`", "")


def _all(spark, at):
    whole = indexed.rows(spark, at)
    whole.collect()
    return scans(whole)[0]


def test_index_errors_and_empty_tables(spark, images, tmp_path):
    for bad in (5000, -5001):
        with pytest.raises(IndexError):
            indexed.at(spark, images, [bad])
    assert indexed.at(spark, images, []).count() == 0
    wanted = spark.createDataFrame([(3, "x"), (3, "y"), (9999, "z"), (None, "n")], "index bigint, tag string")
    assert sorted((r.tag, r.image_id, r["index"]) for r in indexed.lookup(wanted, images).collect()) == [("x", "img00003", 3), ("y", "img00003", 3)]
    assert indexed.every_kth(spark, images, 1000).count() == 5
    at = str(tmp_path / "none")
    indexed.write_indexed(spark.createDataFrame([], "image_id string, data binary"), at, ["image_id"])
    assert indexed.length(spark, at) == 0 and indexed.rows(spark, at).count() == 0
    with pytest.raises(IndexError):
        indexed.at(spark, at, [0])


def test_repeated_and_null_keys_get_numbers_of_their_own(spark, tmp_path):
    at = str(tmp_path / "t")
    d = spark.createDataFrame([("b",), (None,), ("b",), ("a",)], "image_id string")
    indexed.write_indexed(d, at, ["image_id"], shard_rows=2)
    assert [r.image_id for r in indexed.rows(spark, at).orderBy("index").collect()] == [None, "a", "b", "b"]


def test_copies_of_later_runs_are_known(spark, tmp_path):
    src, ledger, checkpoint = (str(tmp_path / x) for x in ("in", "ledger", "cp"))
    (tmp_path / "in").mkdir()
    parts = [{"b.bin": b"same", "c.bin": b"\xff\xfe one", "d.bin": b"same"}, {"a.bin": b"same", "e.bin": b"\xff\xfd one"}, {}, {"f.bin": b"\xff\xfe one"}]
    seen = {}
    for k, part in enumerate(parts):
        for name, data in part.items():
            (tmp_path / "in" / name).write_bytes(data)
            seen[name] = (k, data)
        ingest.record_available(ingest.digests(ingest.new_files(spark, src)), ledger, checkpoint)
    got = {r.keeper.rsplit("/", 1)[1]: r for r in ingest.known(spark, ledger).collect()}
    assert {n: r.copies for n, r in got.items()} == {"b.bin": 3, "c.bin": 2, "e.bin": 1}
    assert got["b.bin"].first_batch == 0 and got["b.bin"].last_batch == 1 and got["b.bin"].length == 4
    everything = spark.read.format("binaryFile").load(src).select("path", *dedupe.content_key(F.col("content")))
    names = lambda df: sorted(tuple(p.rsplit("/", 1)[1] for p in r) for r in df.collect())
    assert names(ingest.copies_of(everything, ingest.known(spark, ledger))) == [("a.bin", "b.bin"), ("d.bin", "b.bin"), ("f.bin", "c.bin")]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """A run that is lost before its batch was committed writes the same folder again."""
    import shutil

    src, ledger, checkpoint = (str(tmp_path / x) for x in ("in", "ledger", "cp"))
    d = spark.createDataFrame([("p1", "t"), ("p2", "t"), ("p3", None), ("p4", "")], "path string, text string")
    d.write.parquet(src)
    run = lambda: ingest.record_available(ingest.digests(spark.readStream.schema(d.schema).parquet(src), content="text"), ledger, checkpoint)
    run()
    before = sorted(map(tuple, ingest.known(spark, ledger).collect()))
    for name in ("0", ".0.crc"):
        (tmp_path / "cp/commits" / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "ledger/batch=0")
    run()
    assert sorted(map(tuple, ingest.known(spark, ledger).collect())) == before
    assert [(r[2], r[3]) for r in before] == [("p3", 2), ("p1", 2)]
