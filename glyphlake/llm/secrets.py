"""Secret scans by an incremental ledger of blobs.

Every text is addressed by its SHA-256. A ledger keeps, for each (digest, rule version), the spans that the rule found.
A scan reads only the pairs that the ledger lacks, one representative text per digest, and joins the findings back to
every path (here: document) that holds the blob. Texts are scanned where they lie: only digests, paths and spans move.
DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.llm.common import new_path, own_names, text_of, written


@dataclass(frozen=True)
class Rule:
    """pattern: Java regular expression; group: of which the length counts; least: code points that it needs.

    hints: strings of which every match holds one; texts without any are not searched.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        return self.kind + "@" + hashlib.sha256(f"{self.pattern}\0{self.group}\0{self.least}".encode()).hexdigest()[:12]


#: In the order in which equal starts are listed. For access and hex a maximal run is matched whole or not at all, so
#: the least length is part of the pattern.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", hints=("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Public formats of keys and tokens, found beside the others.
MORE_RULES = (
    Rule("key", r"-----BEGIN [A-Z0-9\x20]*PRIVATE KEY-----[A-Za-z0-9+/=:,\x20\r\n-]*?-----END [A-Z0-9\x20]*PRIVATE KEY-----", hints=("PRIVATE KEY-----",)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-")),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35,}|ASIA[A-Z0-9]{16,}|[sr]k_live_[A-Za-z0-9]{16,}", hints=("AIza", "ASIA", "k_live_")),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=("eyJ",)),
)
ALL_RULES = RULES + MORE_RULES

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
STEPS = "array<struct<p:int,m:int,g:int>>"
#: Code points that are looked through for the place of a piece of text.
BLOCK = 1 << 14


def steps_of(text: Column, rule: Rule) -> Column:
    """Of each leftmost non-overlapping match of a rule the lengths of the text before it, of itself and of the group that counts.

    Running sums of the first two give the places of all matches. Texts without a match have none.
    """
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    steps = F.arrays_zip(F.transform(pieces, F.length).alias("p"), F.transform(whole, F.length).alias("m"), F.transform(counted, F.length).alias("g"))
    likely = text.rlike(rule.pattern)
    if rule.hints:
        likely = reduce(lambda a, b: a | b, (F.contains(text, F.lit(h)) for h in rule.hints)) & likely
    return F.when(likely, F.filter(steps, lambda x: x["m"].isNotNull())).otherwise(F.array().cast(STEPS))


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = ALL_RULES, ledger: str | None = None, max_broadcast_rows: int = 200_000) -> DataFrame:
    """Every row of versions as (path, digest, spans): spans of all rules, sorted by start, then by rule.

    ledger: folder of a Parquet table (digest, rule, spans) in a shared store; it is read if it has rows, and what was
    scanned is appended, so a later scan of the same texts by the same rules reads no text again. Without it a new one
    is made in the shared folder. Null text counts as empty; rows with equal texts, or with equal or null paths, are
    all returned; long texts are scanned whole; an empty table gives an empty result. Other columns are ignored.

    Digests that the ledger has for all rules, and copies other than the one with the least path, are taken out by joins
    on digests, so of rows with different paths each digest is scanned once: against broadcast tables while these have at
    most max_broadcast_rows rows of about 150 bytes, beyond that by a shuffle of texts.

    A text with many matches takes a time that grows with their number: each is a row for a while, with the lengths of
    what lies between, and running sums over the rows of one text and rule give the places.
    """
    spark = versions.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    rows = versions.select(F.col(path).alias("path"), text_of(text).alias("text"))
    hashed = rows.select("path", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), "text")
    addressed = written(hashed.select("path", "digest"), "secrets-addressed")
    versions_of = F.array(*(F.lit(r.version) for r in rules))
    done = _ledger(spark, ledger).where(F.col("rule").isin([r.version for r in rules])).groupBy("digest").agg(F.collect_set("rule").alias("done"))
    done = written(addressed.select("digest").distinct().join(done, "digest").select(F.col("digest").alias("d"), "done"), "secrets-done")
    copies = addressed.groupBy("digest").agg(F.min("path").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1 AND owner IS NOT NULL")
    copies = written(copies.select(F.col("digest").alias("c"), "owner"), "secrets-copies")
    todo = hashed
    if (n := done.count()) > 0:
        done = F.broadcast(done) if n <= max_broadcast_rows else done
        todo = todo.join(done, F.col("digest") == F.col("d"), "left").drop("d")
    else:
        todo = todo.withColumn("done", F.lit(None).cast("array<string>"))
    todo = todo.withColumn("done", F.coalesce("done", F.array().cast("array<string>"))).where(F.size(F.array_except(versions_of, "done")) > 0)
    copies = F.broadcast(copies) if copies.count() <= max_broadcast_rows else copies
    todo = todo.join(copies, F.col("digest") == F.col("c"), "left").where(F.col("c").isNull() | F.col("path").eqNullSafe(F.col("owner")))
    found = F.array(*(
        F.struct(
            F.lit(r.version).alias("rule"), F.lit(k).alias("rank"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"),
            F.when(~F.array_contains("done", r.version), steps_of(F.col("text"), r)).otherwise(F.array().cast(STEPS)).alias("steps"),
        )
        for k, r in enumerate(rules)
    ))
    looked = todo.select("digest", F.array_except(versions_of, "done").alias("rules"), F.filter(found, lambda h: F.size(h["steps"]) > 0).alias("hits"))
    looked = written(looked.withColumn("scan", F.monotonically_increasing_id()), "secrets-looked")
    none = looked.select("digest", F.explode(F.array_except("rules", F.transform("hits", lambda h: h["rule"]))).alias("rule"), F.array().cast(SPAN).alias("spans"))
    _placed(looked).unionByName(none).write.mode("append").parquet(ledger)
    hits = _ledger(spark, ledger).where(F.size("spans") > 0).where(F.col("rule").isin([r.version for r in rules]))
    # what was scanned twice has equal rows in the ledger, which count once
    hits = hits.groupBy("digest", "rule").agg(F.first("spans").alias("spans")).groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return addressed.join(hits, "digest", "left").select("path", "digest", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _placed(looked: DataFrame) -> DataFrame:
    """(digest, rule, spans) of what was looked at (scan, digest, hits): the matches of each rule that are long enough, by running sums."""
    h = looked.select("scan", "digest", F.explode("hits").alias("h")).select("scan", "digest", "h.rule", "h.rank", "h.kind", "h.least", F.posexplode("h.steps").alias("no", "s"))
    end = F.sum(F.col("s.p") + F.col("s.m")).over(W.partitionBy("scan", "digest", "rule").orderBy("no").rowsBetween(W.unboundedPreceding, W.currentRow))
    h = h.withColumn("end", end)
    span = F.struct((F.col("end") - F.col("s.m")).cast("int").alias("start"), "rank", "kind", F.col("end").cast("int").alias("end"))
    spans = F.array_sort(F.collect_list(F.when(F.col("s.g") >= F.col("least"), span))).cast(SPAN)
    return h.groupBy("scan", "digest", "rule").agg(spans.alias("spans")).drop("scan")


def _gaps(found: DataFrame) -> DataFrame:
    """(digest, gaps, last) of (digest, spans): what lies before each span or run of overlapping ones, as (a, b), and where the last ends."""
    s = found.select("digest", F.posexplode("spans").alias("no", "s"))
    before = F.max("s.end").over(W.partitionBy("digest").orderBy("no").rowsBetween(W.unboundedPreceding, -1))
    s = s.withColumn("a", F.coalesce(before, F.lit(0)))
    gap = F.when(F.col("s.start") >= F.col("a"), F.struct("a", F.col("s.start").alias("b")))
    return s.groupBy("digest").agg(F.array_sort(F.collect_list(gap)).alias("gaps"), F.max("s.end").alias("last"))


def _between(blocks: Column, a: Column, b: Column) -> Column:
    """The code points from a to before b of a text that lies in blocks."""
    i, j = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
    first = F.substring(F.get(blocks, i), a - i * BLOCK + 1, F.least(b - a, F.lit(BLOCK)))
    rest = F.concat(F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(blocks, j), F.lit(1), b - j * BLOCK))
    return F.when(b <= a, "").when(i == j, first).otherwise(F.concat(first, rest))


def _ledger(spark, at: str) -> DataFrame:
    schema = f"digest string, rule string, spans {SPAN}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        # not of a list: its rows, none, would come of Python workers
        return spark.range(0).select(*(F.lit(None).cast(t).alias(c) for c, t in (("digest", "string"), ("rule", "string"), ("spans", SPAN))))
    return spark.read.schema(schema).parquet(at)


def listed(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redacted(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = ALL_RULES, ledger: str | None = None, mark: str = "[REDACTED]", max_broadcast_rows: int = 200_000) -> DataFrame:
    """docs with every span replaced by mark; an n_chars column follows the new length. Overlapping spans are one.

    Texts without a secret are unchanged, null too. Columns and their order stay, whatever their names; rows that repeat
    all stay; an empty table gives an empty result.
    """
    d, t, names = own_names(docs, text)
    found = scan(d.select(t, F.xxhash64(text_of(t)).alias("path")), "path", t, rules, ledger, max_broadcast_rows)
    hits = found.where(F.size("spans") > 0).groupBy("digest").agg(F.first("spans").alias("spans"))
    hits = written(_gaps(hits).select(F.col("digest").alias("_digest"), F.col("gaps").alias("_spans"), F.col("last").alias("_last")), "secrets-hits")
    if hits.count() <= max_broadcast_rows:
        hits = F.broadcast(hits)
    joined = d.join(hits, F.sha2(F.encode(text_of(t), "UTF-8"), 256) == F.col("_digest"), "left")
    text, n_chars = t, dict(zip(docs.columns, names, strict=True)).get("n_chars")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int")), lambda i: F.substring(F.col(text), i * BLOCK + 1, F.lit(BLOCK)))
    joined = joined.withColumn("_blocks", F.when(F.col("_spans").isNotNull(), blocks))
    pieces = F.transform("_spans", lambda g: _between(F.col("_blocks"), g["a"], g["b"]))
    new = F.concat(F.array_join(pieces, mark), F.lit(mark), _between(F.col("_blocks"), F.col("_last"), F.length(text)))
    joined = joined.withColumn("_clean", F.when(F.col("_spans").isNull(), F.col(text)).otherwise(new))
    out = {c: F.col(c) for c in names}
    out[text] = F.col("_clean")
    if n_chars:
        length = F.when(F.col("_spans").isNull(), F.col(n_chars)).otherwise(F.length("_clean"))
        out[n_chars] = length.cast(docs.schema["n_chars"].dataType)
    return joined.select(*(c.alias(name) for c, name in zip(out.values(), docs.columns, strict=True)))
