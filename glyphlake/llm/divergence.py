"""Audit of how the sources of a language diverge in their use of terms.

A baseline-correction inverted index: a pair of sources starts at what it would be worth if neither had any of the kept
terms, their number times the difference of the probabilities of a zero count. Each posting, a term that a source has,
then emits only what changes: its correction against a source without the term, and, where two sources share the term,
what sharing it takes back. Terms that neither source has are never visited. All numbers are whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.llm.common import small_batches, text_of, written

#: Probabilities are whole numbers of this part.
SCALE = 1_000_000_000
#: What each count is raised by.
SMOOTHING = 5
#: Distinct terms that a task counts before it hands them on, and bytes of a text that are split at a time.
HELD, SLICE = 200_000, 1 << 22
#: Groups up to this number are broadcast, beyond it joined by shuffle.
MOST_GROUPS = 1 << 17
#: Letters, lower-cased where they are A-Z, and all bytes of other code points stay; every other byte ends a term.
_TERM = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms in the rows of a task, by lang and source; a row without term counts the rows of its group."""
    uses: dict[tuple, Counter] = {}
    rows: dict[tuple, Counter] = {}
    seen: Counter = Counter()

    def handed_on() -> Iterator[pa.RecordBatch]:
        for group, n in uses.items():
            terms = list(n)
            yield _record(group, [t.decode() for t in terms], [n[t] for t in terms], [rows[group][t] for t in terms])
        for group, n in seen.items():
            yield _record(group, [None], [0], [n])
        uses.clear(), rows.clear(), seen.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            group = lang, source
            seen[group] += 1
            n = uses.setdefault(group, Counter())
            own: set[bytes] = set()
            for part in _slices(text.as_py().translate(_TERM)):
                terms = part.split()
                n.update(terms)
                own.update(terms)
            rows.setdefault(group, Counter()).update(own)
        if sum(map(len, uses.values())) > HELD:
            yield from handed_on()
    yield from handed_on()


def _record(group: tuple, terms: list, n: list, docs: list) -> pa.RecordBatch:
    of_group = [pa.array([g] * len(terms), pa.string()) for g in group]
    return pa.RecordBatch.from_arrays([*of_group, pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the rows that hold it; a null term counts the group's rows.

    Null text, lang and source count as empty. A task counts before anything is shuffled, so a frequent term or a
    source that holds most rows is a few rows from each task. A long text is split in slices, cut between terms.
    """
    d = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), F.encode(text_of("text"), "UTF-8").alias("text"))
    return d.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)) in whole numbers of any size; null where there are no terms."""
    above = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + SMOOTHING * terms).cast("decimal(21,0)")
    return F.when(terms > 0, 1 + F.call_function("div", above, below)).cast("bigint")


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_GROUPS else df


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """How far the sources of each language of docs (lang, source, text) lie apart: (lang, source, part, item, value, rank).

    Terms are runs of letters and of code points beyond ASCII, A-Z lower-cased; a language keeps those in at least
    `least_docs` of its rows. p of a term in a group, or in the whole language, is probability() of its count. Part
    `pair`: item is another source of the language, value the sum of abs(p - p of item) over all kept terms, all items
    ranked. Part `term`: item is a kept term that the group has and uses more than its language, value the difference;
    the first `top` by rank. Ranks go by value descending, then item in order of its UTF-8 bytes.

    Null text, lang and source count as empty ones. Rows that repeat count each time. A group without terms has zero
    counts; a language without kept terms has pairs of value 0 and no terms; one with a single source has no pairs. Other
    columns, whatever their names, are ignored, and an empty table gives none.

    The pairs are the result, so the work is their number, and the pairs of sources that share a term, summed before
    they are shuffled. What a source's postings change against sources without the term depends on p alone, so postings
    with equal p go as one row.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        counts = written(term_counts(docs), "audit-counts")
    used = counts.where("term IS NOT NULL")
    kept = used.groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("lang_n")).where(F.col("df") >= least_docs)
    kept = written(kept.select("lang", "term", "lang_n"), "audit-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    n_langs = langs.count()
    held = written(used.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "audit-postings")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(_few(langs, n_langs), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), "lang_total")
    groups = written(groups.withColumn("z", probability(F.lit(0), F.col("total"), F.col("v"))), "audit-groups")
    n_groups = groups.count()

    with_p = held.join(_few(groups, n_groups), ["lang", "source"])
    postings = written(with_p.select(
        "lang", "source", "term", "z", probability(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        probability(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"),
    ), "audit-probabilities")
    return _pairs(groups, postings, n_groups).unionByName(_terms(postings, top))


def _pairs(groups: DataFrame, postings: DataFrame, n_groups: int) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    of = lambda df: df.withColumnRenamed("source", "a").join(_few(other, n_groups), "lang")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    base = of(groups).where("a < b").select("lang", "a", "b", F.coalesce(F.col("v") * F.abs(F.col("z") - F.col("zb")), F.lit(0)).alias("value"))
    # a posting against sources that may lack the term
    alike = postings.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("terms"))
    change = F.abs(F.col("p") - F.col("zb")) - F.abs(F.col("z") - F.col("zb"))
    one = of(alike).where("a <> b").where(change != 0).select("lang", *pair, (F.col("terms") * change).alias("value"))
    # two sources that share the term: their difference stands in for both changes
    x, y = (postings.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p{s}"), F.col("z").alias(f"z{s}")) for s in "ab")
    gap = lambda c, d: F.abs(F.col(c) - F.col(d))
    back = gap("pa", "pb") - gap("pa", "zb") - gap("pb", "za") + gap("za", "zb")
    both = x.join(y, ["lang", "term"]).where("a < b").select("lang", "a", "b", back.alias("value")).where("value <> 0")
    summed = [t.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for t in (one, both)]
    value = base.unionByName(summed[0]).unionByName(summed[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return _ranked(value.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value"))


def _terms(postings: DataFrame, top: int) -> DataFrame:
    more = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(more).where(F.col("rank") <= top)


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
