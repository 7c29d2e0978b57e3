"""Queries over the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.functions import text
from glyphlake.operators import dedupe, glyphs, manifest, ranking, reports, verdicts
from glyphlake.plans.registry import query
from glyphlake.session import new_folder, table
from glyphlake.sources import archives
from glyphlake.sources import files as file_source


def _vector_glyphs(spark, sf_dir):
    """embeddings as glyphs: a vector is a font, a dimension a symbol, the value in steps of 1/20 its content key."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return v.select("vec_id", F.expr("chr(33 + pos)").alias("ch"), F.rint(F.col("v").cast("double") * 20).cast("bigint").alias("key"))


SETS_SQL = """
SELECT vec_id, key, string_agg(chr((32 + pos)::int), '' ORDER BY pos) AS match_set
FROM (SELECT vec_id, pos, round_even(v::double * 20, 0)::bigint AS key
      FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS v FROM embeddings))
GROUP BY vec_id, key HAVING count(*) >= 2"""


@query("match_sets", f"SELECT vec_id, match_set FROM ({SETS_SQL})")
def match_sets(spark, sf_dir):
    return glyphs.match_sets(_vector_glyphs(spark, sf_dir), ["vec_id"], ["key"])


@query("match_set_counts", f"""
SELECT match_set, count(*) AS occurrences, length(match_set)::BIGINT AS length, '"''' || replace(match_set, '"', '""') || '"' AS cell
FROM ({SETS_SQL}) GROUP BY match_set""")
def match_set_counts(spark, sf_dir):
    return glyphs.count_match_sets(match_sets(spark, sf_dir)).withColumn("cell", glyphs.spreadsheet_escape(F.col("match_set")))


#: Pairs that may be drawn alike, for the query; the library takes any table.
ALLOWED = [f"{chr(33 + i)}{chr(33 + i + 1)}" for i in range(0, 60, 2)] + ["Il", "0O"]
ALLOWED_SQL = "SELECT unnest([" + ", ".join("'" + s.replace("'", "''") + "'" for s in ALLOWED) + "]) AS match_set"


@query("duplicate_verdict", f"""
WITH s AS ({SETS_SQL}), w AS ({ALLOWED_SQL}),
j AS (SELECT vec_id, count(*) AS n_sets, count(w.match_set) AS n_allowed FROM s LEFT JOIN w USING (match_set) GROUP BY vec_id)
SELECT vec_id, coalesce(n_sets, 0)::BIGINT AS n_sets, coalesce(n_allowed, 0)::BIGINT AS n_allowed,
       CASE WHEN coalesce(n_sets, 0) = 0 THEN 'keep' WHEN n_sets = n_allowed THEN 'allowed_duplicates' ELSE 'failed_duplicates' END AS verdict
FROM embeddings LEFT JOIN j USING (vec_id)""")
def duplicate_verdict(spark, sf_dir):
    allowed = spark.createDataFrame([(s,) for s in ALLOWED], "match_set string")
    return glyphs.duplicate_verdict(table(spark, sf_dir, "embeddings"), match_sets(spark, sf_dir), allowed, "vec_id")


@query("match_set_report", f"SELECT vec_id, match_set FROM ({SETS_SQL}) WHERE match_set = '9@'")
def match_set_report(spark, sf_dir):
    """Only the records with one given match set."""
    return match_sets(spark, sf_dir).where(F.col("match_set") == "9@")


# documents as files of a corpus: the path has an extension that depends on the id
EXTENSIONS = [".TTF", ".otf", "", ".tar.GZ", ".pfb"]
FILE = "'/corpus/' || source || '/' || CASE WHEN doc_id % 7 = 6 THEN '.hidden' ELSE 'f' END || doc_id || CASE doc_id % 5 WHEN 0 THEN '.TTF' WHEN 1 THEN '.otf' WHEN 2 THEN '' WHEN 3 THEN '.tar.GZ' ELSE '.pfb' END"
SUFFIX_SQL = r"CASE WHEN regexp_extract(path, '[^./](\.[^./]+)$', 1) = '' THEN '.NONE' ELSE lower(regexp_extract(path, '[^./](\.[^./]+)$', 1)) END"


def files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(FILE).alias("path"), "source", "text")


@query("entry_count", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def entry_count(spark, sf_dir):
    return reports.entry_count(table(spark, sf_dir, "documents").select("source"), "source")


@query("bucket_rename", f"""
WITH f AS (SELECT {FILE} AS path FROM documents), e AS (SELECT path, {SUFFIX_SQL} AS suffix FROM f)
SELECT substr(suffix, 2) AS ext, row_number() OVER (PARTITION BY suffix ORDER BY md5('42:' || path), path) - 1 AS seq,
       substr(suffix, 2) || '/' || format('{{:07d}}', row_number() OVER (PARTITION BY suffix ORDER BY md5('42:' || path), path) - 1)
         || CASE suffix WHEN '.NONE' THEN '' ELSE suffix END AS new_path, path AS orig_path
FROM e""")
def bucket_rename(spark, sf_dir):
    return manifest.bucketed(files(spark, sf_dir).select("path"))


@query("rename_map", f"""
WITH f AS (SELECT {FILE} AS path FROM documents), e AS (SELECT path, {SUFFIX_SQL} AS suffix FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY md5('42:' || path), path) - 1 AS seq FROM e)
SELECT substr(suffix, 2) AS ext, (seq // 1000)::BIGINT AS part, count(*) AS n, string_agg(format('{{:07d}}', seq) || '=' || path, ',' ORDER BY seq) AS entries FROM n GROUP BY suffix, part""")
def rename_map(spark, sf_dir):
    """The manifest of each bucket in parts of a thousand entries, so that no row grows with the corpus."""
    b = manifest.bucketed(files(spark, sf_dir).select("path")).withColumn("part", F.floor(F.col("seq") / 1000))
    entries = F.array_sort(F.collect_list(F.struct("seq", F.concat(text.padded(F.col("seq"), 7), F.lit("="), F.col("orig_path")).alias("e"))))
    return b.groupBy("ext", "part").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(entries, lambda x: x["e"]), ",").alias("entries"))


@query("file_parts", f"""
WITH f AS (SELECT {FILE} AS path FROM documents)
SELECT path, string_split(path, '/')[-1] AS name, regexp_replace(path, '/[^/]*$', '') AS parent, {SUFFIX_SQL} AS suffix FROM f""")
def file_parts(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", text.base_name(p).alias("name"), text.parent(p).alias("parent"), text.suffix(text.base_name(p)).alias("suffix"))


@query("exact_dedupe", """
SELECT strlen(coalesce(text, ''))::BIGINT AS length, sha256(coalesce(text, '')) AS digest, min(doc_id) AS keeper, count(*) AS copies FROM documents GROUP BY ALL""")
def exact_dedupe(spark, sf_dir):
    """Null texts are empty contents."""
    return dedupe.keepers(table(spark, sf_dir, "documents").fillna("", ["text"]), "doc_id", "text")


@query("dedupe_log", """
SELECT doc_id, keeper FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS keeper FROM documents) WHERE doc_id <> keeper""")
def dedupe_log(spark, sf_dir):
    return dedupe.log(table(spark, sf_dir, "documents").fillna("", ["text"]), "doc_id", "text")


SPLIT_SQL = """
SELECT doc_id, text, CASE WHEN no < floor(n * 0.2) THEN 'test' WHEN no < floor(n * 0.2) + floor(n * 0.1) THEN 'validation' ELSE 'train' END AS split
FROM (SELECT doc_id, text, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS no, count(*) OVER () AS n FROM documents)"""


@query("split_assign", f"SELECT doc_id, split FROM ({SPLIT_SQL})")
def split_assign(spark, sf_dir):
    return ranking.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2, 0.1)


@query("split_counts", f"SELECT split, count(*) AS n FROM ({SPLIT_SQL}) GROUP BY split")
def split_counts(spark, sf_dir):
    return split_assign(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("cross_split_dedupe", f"""
SELECT doc_id, keeper FROM (
  SELECT doc_id, arg_min(doc_id, (CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, doc_id)) OVER (PARTITION BY sha256(coalesce(text, ''))) AS keeper
  FROM ({SPLIT_SQL})) WHERE doc_id <> keeper""")
def cross_split_dedupe(spark, sf_dir):
    """Copies across the splits: the row of test stays before validation before train, so nothing leaks into training."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    d = ranking.split(hashed, "doc_id", 0.2, 0.1)  # ranks are sorted with digests, not with texts
    return dedupe.log(d, "doc_id", "digest", F.expr("CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END"))


@query("capped_scan", f"SELECT path FROM (SELECT {FILE} AS path FROM documents) ORDER BY path LIMIT 25")
def capped_scan(spark, sf_dir):
    return ranking.capped(files(spark, sf_dir).select("path"), 25, "path")


@query("batches", """
SELECT doc_id, (no // 64)::BIGINT AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS no, count(*) OVER () AS n FROM documents)
WHERE no < n // 64 * 64""")
def batches(spark, sf_dir):
    return ranking.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64, seed=7, drop_last=True)


@query("every_200th", "SELECT event_id, value FROM events WHERE event_id % 200 = 0")
def every_200th(spark, sf_dir):
    return ranking.every(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 200)


# documents and labels as rendering statistics
STATS_SQL = """
SELECT doc_id, n_chars < 100 AS font_not_loaded, regexp_matches(coalesce(text, ''), '[|]') AS bad_chars, coalesce(toxic, 0) = 1 AS has_empty
FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)"""
VERDICT_SQL = f"""SELECT doc_id, CASE WHEN font_not_loaded THEN 'failed_font_loads' WHEN bad_chars THEN 'failed_char_loads' WHEN has_empty THEN 'empty_chars' ELSE 'keep' END AS verdict FROM ({STATS_SQL})"""


def _stats(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left")
    none, one = F.array().cast("array<string>"), F.array(F.lit("|"))
    return d.select(
        "doc_id", (F.col("n_chars") < 100).alias("font_not_loaded"),
        F.when(F.coalesce("text", F.lit("")).contains("|"), one).otherwise(none).alias("char_loads_failed"),
        F.when(F.col("toxic") == 1, one).otherwise(none).alias("empty"),
        F.lit(0).cast("bigint").alias("out_of_image"), (F.col("n_chars") % 3).cast("bigint").alias("out_of_cell"), F.lit(0).cast("bigint").alias("overwrites"),
        none.alias("matched"),
    )


@query("bad_doc_verdict", VERDICT_SQL)
def bad_doc_verdict(spark, sf_dir):
    return verdicts.bad_font_verdict(_stats(spark, sf_dir)).select("doc_id", "verdict")


@query("verdict_counts", f"SELECT verdict, count(*) AS n FROM ({VERDICT_SQL}) GROUP BY verdict")
def verdict_counts(spark, sf_dir):
    return verdicts.counts(bad_doc_verdict(spark, sf_dir))


@query("verdict_conservation", f"SELECT (SELECT count(*) FROM documents) AS n_in, count(*) FILTER (verdict = 'keep') AS n_keep, count(*) FILTER (verdict <> 'keep') AS n_failed FROM ({VERDICT_SQL})")
def verdict_conservation(spark, sf_dir):
    v = bad_doc_verdict(spark, sf_dir).agg(F.count_if(F.col("verdict") == "keep").alias("n_keep"), F.count_if(F.col("verdict") != "keep").alias("n_failed"))
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_in")).join(v)


@query("has_issue", f"""
SELECT doc_id FROM ({STATS_SQL}) JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) WHERE font_not_loaded OR bad_chars OR has_empty OR n_chars % 3 > 0""")
def has_issue(spark, sf_dir):
    return _stats(spark, sf_dir).where(verdicts.has_issue()).select("doc_id")


@query("flag_sums", f"""
SELECT 0::BIGINT AS out_of_image, count(*) FILTER (n_chars % 3 > 0) AS out_of_cell, count(*) FILTER (has_empty) AS empty_cell, count(*) AS total
FROM ({STATS_SQL}) JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)""")
def flag_sums(spark, sf_dir):
    return verdicts.flag_sums(_stats(spark, sf_dir))


@query("skip_cell_out", "SELECT doc_id FROM documents WHERE n_chars % 3 = 0")
def skip_cell_out(spark, sf_dir):
    return _stats(spark, sf_dir).where("out_of_cell = 0").select("doc_id")


@query("merged_stats", f"""
SELECT source, bool_or(font_not_loaded) AS font_not_loaded, count(*) FILTER (bad_chars) AS n_failed, count(*) FILTER (has_empty) AS n_empty, sum(n_chars % 3)::BIGINT AS out_of_cell,
       min(doc_id) AS l, max(doc_id) AS r
FROM ({STATS_SQL}) JOIN (SELECT doc_id, source, n_chars FROM documents) USING (doc_id) GROUP BY source""")
def merged_stats(spark, sf_dir):
    s = _stats(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    s = s.withColumn("bbox", F.struct(F.col("doc_id").alias("l"), F.col("doc_id").alias("t"), F.col("doc_id").alias("r"), F.col("doc_id").alias("b")))
    m = verdicts.merged_stats(s, "source")
    return m.select("source", "font_not_loaded", "n_failed", "n_empty", "out_of_cell", "bbox.l", "bbox.r")


# the records of an order's lines, with lists of symbols
LISTS = ["l_orderkey", "l_linenumber", "l_returnflag", "CASE WHEN l_quantity > 40 THEN 'f' || l_linenumber END AS failed", "CASE WHEN l_quantity < 10 THEN 'e' || l_linenumber END AS empty", "l_partkey"]


@query("merged_lists", f"""
SELECT l_orderkey, count(failed) AS n_failed, count(empty) AS n_empty, coalesce(string_agg(failed, ',' ORDER BY failed), '') AS failed, coalesce(string_agg(empty, ',' ORDER BY empty), '') AS empty,
       string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_returnflag || l_linenumber) AS matched, sum(l_partkey % 5)::BIGINT AS overwrites FROM (SELECT {', '.join(LISTS)} FROM lineitem) GROUP BY l_orderkey""")
def merged_lists(spark, sf_dir):
    """Statistics of each order's lines as one, with all symbols of their lists."""
    c = F.col
    l = table(spark, sf_dir, "lineitem").selectExpr(*LISTS)
    one = lambda name: F.when(c(name).isNull(), F.array().cast("array<string>")).otherwise(F.array(name))
    s = l.select(
        "l_orderkey", F.lit(False).alias("font_not_loaded"), one("failed").alias("char_loads_failed"), F.array(F.concat("l_returnflag", "l_linenumber")).alias("matched"), one("empty").alias("empty"),
        F.lit(0).alias("out_of_image"), F.lit(0).alias("out_of_cell"), (c("l_partkey") % 5).alias("overwrites"),
        F.struct(*(c("l_linenumber").alias(n) for n in "ltrb")).alias("bbox"),
    )
    joined = lambda name: F.array_join(F.array_sort(name), ",")
    m = verdicts.merged_stats(s, "l_orderkey", lists=True)
    return m.select("l_orderkey", "n_failed", "n_empty", joined("char_loads_failed").alias("failed"), joined("empty").alias("empty"), joined("matched").alias("matched"), "overwrites")


@query("split_sink", f"SELECT doc_id, split FROM ({SPLIT_SQL})")
def split_sink(spark, sf_dir):
    """Documents written in a folder for each split, as the folders say when they are read."""
    at = new_folder(spark, "splits")
    file_source.write_routed(split_assign(spark, sf_dir), at, "split")
    return spark.read.schema("doc_id bigint, split string").parquet(at)


@query("listed_here", "SELECT doc_id, source FROM documents")
def listed_here(spark, sf_dir):
    """Rows of the JSON files that lie in a folder itself: neither those of folders in it nor other files are opened."""
    at = new_folder(spark, "listed")
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    d.write.json(at)
    d.write.json(f"{at}/inner")
    d.write.mode("append").csv(at)
    lines = file_source.scan(spark, at, glob="*.json", recursive=False).select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    return lines.where("line <> ''").select(F.from_json("line", "doc_id bigint, source string").alias("r")).select("r.*")


@query("review_queue", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL) ORDER BY doc_id LIMIT 500""")
def review_queue(spark, sf_dir):
    decided = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("keep"))
    return verdicts.review_page(table(spark, sf_dir, "documents").select("doc_id"), decided, "doc_id")


@query("archive_closure", """
WITH RECURSIVE n AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0),
r(id, depth) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT n.child, r.depth + 1 FROM r JOIN n ON n.parent = r.id AND n.child <> r.id)
SELECT id, depth::INT AS depth FROM r""")
def archive_closure(spark, sf_dir):
    """Archives inside archives until none is new: part p lies in part p div 3."""
    inside = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey DIV 3").alias("parent"))
    return archives.closure(spark.range(1, 2), inside)
