"""Document quality by hierarchical empirical Bayes.

A logistic classifier on measures of the text gives each document's evidence. Its mean over a host, and over a path of
the host, is shrunk toward the level above by as much as the spread between sites, against that within them, calls for;
the posterior of a document adds what its path, without the document itself, says beyond the global rate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import text_of, written

#: Labelled rows that the classifier is fitted on, at most, of each label.
EXAMPLES = 10_000
THRESHOLD = 0.5
MEASURES = ("bars", "tails", "capitals", "repeats", "top_word", "symbols", "digits", "long_words", "line_copies", "length")
_TAIL = re.compile(r"([^\w\s])\1+$")


def measures(text: str) -> list[float]:
    """Shares between 0 and 1 of what low-quality text is full of, square-rooted, and a measure of length."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(MEASURES)
    kinds = Counter(words)
    chars = max(1, len(text))
    bars = tails = capitals = longs = digits = alnum = 0
    for w, k in kinds.items():
        if not w[-1].isalnum():
            if not any(c.isalnum() for c in w):
                bars += k
            elif len(w) > 1 and w[-1] == w[-2] and _TAIL.search(w):
                tails += k
        if len(w) > 1 and w.isupper():
            capitals += k
        if len(w) > 25:
            longs += k
        if w.isalpha():
            alnum += k * len(w)
        else:
            for c in w:
                if c.isdigit():
                    digits += k
                    alnum += k
                elif c.isalpha():
                    alnum += k
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = text.split("\n")
    visible = sum(len(w) * k for w, k in kinds.items())
    shares = (
        bars / n, tails / n, capitals / n, repeats / n, max(kinds.values()) / n if n > 20 else 0.0,
        (visible - alnum) / chars, digits / chars, longs / n, 1 - len(set(lines)) / len(lines),
    )
    return [float(np.sqrt(s)) for s in shares] + [1 / (1 + float(np.log1p(n)))]


def measured(docs: DataFrame, key: str, text: str, host: Column, path: Column) -> DataFrame:
    """(k, host, path, m): keys, sites and measures; the text stays behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [measures(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k", "th", "host", "path")), pa.array(m, pa.list_(pa.float64()))], names=["k", "th", "host", "path", "m"])

    t = text_of(text)
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.xxhash64(t).alias("th"), host.cast("string").alias("host"), path.cast("string").alias("path"), t.alias("t"))
    return rows.mapInArrow(run, "k bigint, th bigint, host string, path string, m array<double>")


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Coefficients, the intercept first, of a ridge logistic regression by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str | Column = "source", path: str | Column | None = None, label: str = "quality", examples: int = EXAMPLES, max_broadcast_rows: int = 200_000) -> DataFrame:
    """Every row of docs as (key, th, evidence, host_rate, path_rate, score, keep); th is xxhash64 of the text.

    evidence: the classifier's probability of quality; host_rate and path_rate: the shrunk rates of its site; score: the
    posterior; keep: score of at least 0.5. Sites are aggregated over all documents by partial sums, so a host with a
    third of all rows is one row of its table; site tables are broadcast while they have at most max_broadcast_rows rows
    and joined by shuffle beyond. path defaults to host and lang. Null hosts and paths are sites of their own; null text
    counts as empty; long texts are measured whole; of repeated labels of a key the highest counts, and of rows that
    repeat a key the one with the least text hash is learned from, while all are judged; rows with null key are judged
    too. Without labels of both kinds the evidence is 0.5 and everything is kept. Fitting uses at most `examples` rows
    of each label. An empty table gives an empty result; other columns are ignored.
    """
    host = F.col(host) if isinstance(host, str) else host
    if path is None:
        path = F.concat_ws("/", host, F.coalesce(F.col("lang"), F.lit("")))
    path = F.col(path) if isinstance(path, str) else path
    d = written(measured(docs, key, text, host, path), "quality-measures")
    known = labels.select(F.col(key).cast("bigint").alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    sizes = dict(known.groupBy("y").count().collect())
    order = F.xxhash64(F.lit(11), "k")
    sample = known.where("y = 0").orderBy(order, "k").limit(examples).union(known.where("y = 1").orderBy(order, "k").limit(examples))
    # of rows that repeat a key the one with the least text hash
    taken = d.join(F.broadcast(sample), "k").groupBy("k").agg(F.min(F.struct("th", "m"))["m"].alias("m"), F.max("y").alias("y")).orderBy("k").collect()
    y = np.array([r.y for r in taken], float)
    if len(set(y)) == 2:
        each = np.array([sizes[int(v)] / (y == v).sum() for v in (0.0, 1.0)])
        beta = fitted(np.array([r.m for r in taken]), y, each[y.astype(int)] / each.mean())
    else:
        beta = np.zeros(len(MEASURES) + 1)
    logit = F.lit(float(beta[0]))
    for i in range(len(MEASURES)):
        logit = logit + F.col("m")[i] * float(beta[i + 1])
    d = d.select("k", "th", "host", "path", _sigmoid(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))).alias("p"))

    paths = written(d.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "quality-hosts")
    whole = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = (whole[1] / whole[0]) if whole[0] else 0.5
    strength = _strength(hosts, F.lit(rate))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + strength * rate) / (F.col("n") + strength)).alias("host_rate"), (F.col("s") / F.col("n")).alias("host_mean"))
    p = paths.join(_small(hosts, max_broadcast_rows), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    strength = _strength(p, F.col("host_mean"))
    sites = written(p.select(F.col("host").alias("h"), F.col("path").alias("pa"), "n", "s", "host_rate"), "quality-sites")
    d = d.join(_small(sites, max_broadcast_rows), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("pa")))
    # a document is no evidence for itself
    path_rate = (F.col("s") - F.col("p") + strength * F.col("host_rate")) / (F.col("n") - 1 + strength)
    d = d.withColumn("path_rate", path_rate)
    score = _sigmoid(_logit(F.col("p")) + _logit(F.col("path_rate")) - _logit(F.lit(rate)))
    d = d.withColumn("score", score)
    return d.select(F.col("k").alias(key), "th", F.col("p").alias("evidence"), "host_rate", "path_rate", "score", (F.col("score") >= THRESHOLD).alias("keep"))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _strength(sites: DataFrame, center: Column) -> float:
    """Documents that the level above counts for: variance within sites over that between them, by moments."""
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    between = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - center, 2))
    w, b, n, squares, sites_n = sites.agg(within, between, F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count(F.lit(1))).first()
    if not n or n <= sites_n or sites_n < 2:
        return 10.0
    inside = max(w / (n - sites_n), 1e-9)
    spread = (b - (sites_n - 1) * inside) / max(n - squares / n, 1e-9)
    return float(min(max(inside / spread, 1.0), 1e6)) if spread > 0 else 1e6
