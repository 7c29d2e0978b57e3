"""op11: divergence of the sources of all documents."""

from __future__ import annotations

from glyphlake.llm import divergence
from glyphlake.llm.registry import query, table

SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
use AS (SELECT lang, source, unnest(t) AS term FROM d),
has AS (SELECT lang, unnest(list_distinct(t)) AS term FROM d),
kept AS (SELECT lang, term FROM has GROUP BY ALL HAVING count(*) >= 30),
cnt AS (SELECT lang, source, term, count(*) AS n FROM use SEMI JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
full_ AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM grp g JOIN kept k ON k.lang = g.lang LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM full_ GROUP BY ALL),
p AS (SELECT f.lang, f.source, f.term, n, (1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v))::BIGINT AS p FROM full_ f JOIN tot USING (lang, source) JOIN size USING (lang)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v))::BIGINT AS q
      FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM cnt GROUP BY ALL) JOIN size USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
         FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""


@query("op11_divergence", SQL)
def op11_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))
