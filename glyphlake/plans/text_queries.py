"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.functions import text
from glyphlake.operators import reports, verdicts
from glyphlake.plans.registry import query
from glyphlake.session import table
from glyphlake.sources import pages

LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DISTANCES_SQL = f"""
SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS distance, levenshtein({LOWER_SQL.format('p_name')}, {LOWER_SQL.format('p_type')})::BIGINT AS lower_distance FROM part"""


def _distances(spark, sf_dir):
    """p_type stands for the expected atlas and p_name for the recognised text of a part."""
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.edit_distance(a, b).alias("distance"), text.edit_distance(text.ascii_lower(a), text.ascii_lower(b)).alias("lower_distance"))


@query("edit_distance_hist", f"SELECT distance, count(*) AS n FROM ({DISTANCES_SQL}) WHERE distance IS NOT NULL GROUP BY distance")
def edit_distance_hist(spark, sf_dir):
    return reports.histogram(_distances(spark, sf_dir), F.col("distance"))


@query("edit_distance_hist_lower", f"SELECT lower_distance AS distance, count(*) AS n FROM ({DISTANCES_SQL}) WHERE lower_distance IS NOT NULL GROUP BY lower_distance")
def edit_distance_hist_lower(spark, sf_dir):
    return reports.histogram(_distances(spark, sf_dir), F.col("lower_distance"))


@query("edit_distance_delta_hist", f"SELECT distance - lower_distance AS distance, count(*) AS n FROM ({DISTANCES_SQL}) WHERE distance IS NOT NULL GROUP BY ALL")
def edit_distance_delta_hist(spark, sf_dir):
    return reports.histogram(_distances(spark, sf_dir), F.col("distance") - F.col("lower_distance"))


@query("ocr_skipped", "SELECT count(*) FILTER (p_name IS NULL OR p_type IS NULL) AS skipped FROM part")
def ocr_skipped(spark, sf_dir):
    return reports.skipped(_distances(spark, sf_dir), F.col("distance"))


@query("ocr_objective", f"SELECT count(*) FILTER (distance = 0)::BIGINT AS n FROM ({DISTANCES_SQL})")
def ocr_objective(spark, sf_dir):
    return reports.at_zero(edit_distance_hist(spark, sf_dir))


@query("ocr_verdict", f"SELECT p_partkey, CASE WHEN lower_distance = 0 THEN 'keep' ELSE format('{{:03d}}', lower_distance) END AS verdict FROM ({DISTANCES_SQL})")
def ocr_verdict(spark, sf_dir):
    return _distances(spark, sf_dir).select("p_partkey", verdicts.distance_verdict(F.col("lower_distance")).alias("verdict"))


@query("byte_levenshtein", """
SELECT p.p_partkey, levenshtein(p.p_name || 'é', c.c_mktsegment)::BIGINT AS distance
FROM part p JOIN customer c ON p.p_partkey = c.c_custkey""")
def byte_levenshtein(spark, sf_dir):
    """Distances over UTF-8 bytes: the accented letter counts as two."""
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    j = p.join(c, F.col("p_partkey") == F.col("c_custkey"))
    return j.select("p_partkey", text.edit_distance(F.concat("p_name", F.lit("é")), F.col("c_mktsegment"), "byte").alias("distance"))


@query("naive_levenshtein", "SELECT p_partkey, CASE WHEN p_name = '' OR p_type = '' THEN 0 ELSE levenshtein(p_name, p_type) END::BIGINT AS distance FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS p_name, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_type END AS p_type FROM part)")
def naive_levenshtein(spark, sf_dir):
    """Some sides are empty, which this variant counts as no distance."""
    side = lambda c, n: F.when(F.col("p_partkey") % n == 0, "").otherwise(F.col(c))
    return table(spark, sf_dir, "part").select("p_partkey", text.edit_distance(side("p_name", 7), side("p_type", 11), naive_empty=True).alias("distance"))


@query("ascii_lower", f"SELECT conv_id, turn, {LOWER_SQL.format('text')} AS lowered FROM conversations")
def ascii_lower(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.ascii_lower(F.col("text")).alias("lowered"))


@query("utf8_lengths", "SELECT conv_id, turn, length(text)::BIGINT AS code_points, strlen(text)::BIGINT AS bytes FROM conversations")
def utf8_lengths(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.code_points(F.col("text")).alias("code_points"), text.utf8_bytes(F.col("text")).alias("bytes"))


@query("atlas_lines", """
WITH l AS (SELECT i AS line, string_agg(chr((32 + k)::INT), '' ORDER BY k) AS symbols FROM (SELECT unnest(range(0, 95)) AS k, k // 12 AS i) GROUP BY i),
u AS (SELECT unnest(string_split(p_name, '')) AS ch FROM part)
SELECT line::INT AS line, symbols, length(symbols)::INT AS n, (SELECT count(*) FROM u WHERE ch <> '' AND contains(symbols, ch)) AS used FROM l""")
def atlas_lines(spark, sf_dir):
    """The lines of the printable atlas, with how often the names of parts use a symbol of each."""
    lines = table(spark, sf_dir, "part").limit(1).select(F.posexplode(text.printable_atlas()).alias("line", "symbols"))
    used = table(spark, sf_dir, "part").select(F.explode(text.single_symbols(F.col("p_name"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    symbols = lines.select("line", "symbols", F.explode(text.single_symbols(F.col("symbols"))).alias("ch"))
    found = symbols.join(used, "ch", "left").groupBy("line", "symbols").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("used"))
    return found.select("line", "symbols", F.length("symbols").alias("n"), "used")


@query("atlas_split", r"""
SELECT conv_id, turn, len(string_split(regexp_replace(text, '\n$', ''), chr(10)))::INT AS n_lines,
       array_to_string(list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda x: x || chr(10)), '') AS atlas
FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)""")
def atlas_split(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").fillna("", ["text"]).withColumn("lines", text.split_atlas(F.col("text")))
    return c.select("conv_id", "turn", F.size("lines").alias("n_lines"), text.atlas_text(F.col("lines")).alias("atlas"))


@query("highlighted", "SELECT item_id, pos::INT AS pos FROM (SELECT item_id, unnest(range(0, length(text))) AS pos, unnest(string_split(text, '')) AS ch FROM benchmark) WHERE ch IN ('a', 'e')")
def highlighted(spark, sf_dir):
    """Places of the symbols of a given string."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.single_symbols(F.col("text"))).alias("pos", "ch"))
    return b.where(F.expr("locate(ch, 'ae') > 0")).select("item_id", "pos")


@query("without_spaces", "SELECT item_id, replace(text, ' ', '') AS packed FROM benchmark")
def without_spaces(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.without_spaces(F.col("text")).alias("packed"))


LINKS_SQL = """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages"""


@query("links", f"SELECT page_id, href, string_split(href, '=')[-1] AS name FROM ({LINKS_SQL})")
def links(spark, sf_dir):
    return pages.links(table(spark, sf_dir, "pages"))


@query("new_links", f"SELECT DISTINCT href FROM ({LINKS_SQL}) WHERE href NOT IN (SELECT href FROM ({LINKS_SQL}) WHERE page_id % 2 = 0)")
def new_links(spark, sf_dir):
    """Links that are not fetched yet: those of the even pages are."""
    found = links(spark, sf_dir)
    return pages.not_fetched(found, found.where("page_id % 2 = 0").select("href"))
