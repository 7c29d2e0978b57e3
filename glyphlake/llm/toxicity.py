"""Toxicity by the nearest labelled examples.

A text is the vector of all its words and their first letters that occur in the examples, weighted by TF-IDF and by how
much a term tells toxic from other examples beyond chance; no term of the examples is left out. The exact cosine of a
text with every example is searched by a block-max inverted index: examples lie in blocks, the maxima of a block bound
its cosines, and blocks are opened from the highest bound down until none can change the k nearest. Their votes,
weighted by cosine and calibrated on examples that are not in the index, give the score; the nearest are its evidence.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.llm.common import text_of, written

#: Labelled rows that are learned from, at most, of each label, and their characters, at most.
EXAMPLES, CHARS = 2_000, 8_000_000
#: One in so many of them is not indexed, and fits the calibration.
ASIDE = 5
NEIGHBOURS, BLOCK = 15, 64
PREFIXES = (4, 6)
#: A term's weight grows with its log odds between the labels beyond so many standard errors; FLOOR is the least.
ERRORS, FLOOR = 1.5, 0.4
#: Terms in a larger share of the examples have dense lists.
DENSE = 0.05
#: Texts that are searched for together.
TOGETHER = 128
#: Weight of the prior against the cosines of the neighbours.
PRIOR_WEIGHT = 0.1
THRESHOLD = 0.7
_APART = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))
#: Document frequencies are summed as arrays of so many terms.
CHUNK = 4096


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_APART).split()


def held_out(key: Column) -> Column:
    """Rows of which labels are never learned: crc32 of the key as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Vocabulary:
    """Numbers of terms: words, and their prefixes, marked by a star.

    Where no more terms are added, a word has the terms in one row of `rows`: that of its own number or, if it has none,
    of its longest prefix that has one. So each word is looked up as it is, and no words are remembered.
    """

    def __init__(self, number: dict[str, int], grow: bool = False) -> None:
        self.number, self.grow = number, grow
        if not grow:
            self.freeze()

    def __getstate__(self) -> dict:
        return {"number": self.number}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["number"])

    def freeze(self) -> None:
        """Adds no more terms from now on."""
        self.grow = False
        self.words = {t.encode(): i for t, i in self.number.items() if not t.endswith("*")}
        self.starts = {n: {t[:-1]: i for t, i in self.number.items() if len(t) == n + 1 and t.endswith("*")} for n in PREFIXES}
        at = list(self.number.values())
        self.rows = np.full((len(at), 1 + len(PREFIXES)), -1, np.int64)
        self.rows[at, 0] = at
        for j, n in enumerate(PREFIXES, 1):
            get = self.starts[n].get
            self.rows[at, j] = [get(t[:n], -1) if len(t) > n and t[n:] != "*" else -1 for t in self.number]

    def _rows(self, words: Collection[bytes]) -> np.ndarray:
        """The row of each word, -1 for a word without terms."""
        rows = list(map(self.words.get, words))
        if None in rows:
            rest = b" ".join([w for w, r in zip(words, rows, strict=True) if r is None]).decode("utf-8", "replace")  # words hold no space
            texts = rest.split(" ")
            found = [self.number.get(w, -1) for w in texts] if "\ufffd" in rest else [-1] * len(texts)
            for n in reversed(PREFIXES):
                get = self.starts[n].get
                found = [get(w[:n], -1) if r < 0 and len(w) > n else r for w, r in zip(texts, found, strict=True)]
            found = iter(found)
            rows = [next(found) if r is None else r for r in rows]
        return np.array(rows, np.int64)

    def _added(self, often: Counter) -> tuple[np.ndarray, np.ndarray]:
        number, tf = self.number, Counter()
        for word, n in often.items():
            w = word.decode("utf-8", "replace")
            for term in (w, *(w[:p] + "*" for p in PREFIXES if len(w) > p)):
                tf[number.setdefault(term, len(number))] += n
        terms = sorted(tf)
        return np.array(terms, np.int64), np.array([tf[t] for t in terms], float)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text by number, ascending, and how often it has each."""
        often = Counter(words_of(text))
        if self.grow:
            return self._added(often)
        rows = self._rows(often)
        held = self.rows[rows[rows >= 0]]
        n = np.fromiter(often.values(), np.float64, len(often))[rows >= 0]
        has = held >= 0
        terms, where = np.unique(held[has], return_inverse=True)
        return terms, np.bincount(where, weights=np.repeat(n, has.sum(axis=1)), minlength=len(terms))

    def present(self, text: str) -> np.ndarray:
        """The terms of a text by number, in no order, some of them repeated."""
        rows = self._rows(set(words_of(text)))
        held = self.rows[rows[rows >= 0]]
        return held[held >= 0]


def unit(terms: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a text's terms, of length 1 together."""
    w = (1 + np.log(tf)) * weight[terms]
    norm = math.sqrt(float(w @ w))
    return w / norm if norm > 0 else w


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start up to its stop, one range after another, and the lengths."""
    n = stops - starts
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - n), n), n


class BlockMax:
    """An inverted index over unit vectors in blocks.

    Terms in a larger share of the vectors than `dense` have dense lists, and their maxima in each block bound what they
    add to its products; lists of all other terms are short and are added up in full first.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK, dense: float = DENSE) -> None:
        self.block, self.n = block, len(vectors)
        self.blocks = max(1, -(-self.n // block))
        ids = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        terms = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weights = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        frequent = np.flatnonzero(np.bincount(terms, minlength=n_terms) > max(dense * self.n, 1))
        self.column = np.full(n_terms, -1, np.int64)
        self.column[frequent] = np.arange(len(frequent))
        at = self.column[terms]
        lists = np.zeros((self.blocks * block, len(frequent)))
        lists[ids[at >= 0], at[at >= 0]] = weights[at >= 0]
        self.lists = lists.reshape(self.blocks, block, -1)
        self.top = self.lists.max(axis=1, initial=0)
        ids, terms, weights = ids[at < 0], terms[at < 0], weights[at < 0]
        order = np.lexsort((ids, terms))
        self.ids, self.weights = ids[order], weights[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the numbers and products of the k vectors with the highest positive ones: exact.

        Ties go to the smaller number; products that differ after the twelfth digit only are ties.
        """
        m, rows = len(queries), self.blocks * self.block
        query = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms = np.concatenate([t for t, _ in queries]) if m else np.zeros(0, np.int64)
        weights = np.concatenate([w for _, w in queries]) if m else np.zeros(0)
        at = self.column[terms]
        frequent = at >= 0
        factors = np.zeros((m, self.lists.shape[2]))
        factors[query[frequent], at[frequent]] = weights[frequent]
        query, terms, weights = query[~frequent], terms[~frequent], weights[~frequent]
        postings, n = _ranges(self.starts[terms], self.starts[terms + 1])
        score = np.bincount(np.repeat(query * rows, n) + self.ids[postings], weights=self.weights[postings] * np.repeat(weights, n), minlength=m * rows)
        score = score.reshape(m, self.blocks, self.block).astype(float)
        bound = score.max(axis=2) + factors @ self.top.T
        # first the blocks of the highest bounds, then all that can still hold one of the k nearest
        likely = min(self.blocks, -(-2 * k // self.block) + 1)
        first = np.argpartition(-bound, likely - 1, axis=1)[:, :likely]
        opened = np.zeros((m, self.blocks), bool)
        opened[np.arange(m)[:, None], first] = True
        self._open(score, opened, factors)
        some = score[np.arange(m)[:, None], first].reshape(m, -1)
        least = np.partition(some, -min(k, some.shape[1]), axis=1)[:, -min(k, some.shape[1])] if some.shape[1] >= k else np.zeros(m)
        more = ~opened & (bound >= np.maximum(least, 0.0)[:, None] - 1e-9) & (bound > 0)
        self._open(score, more, factors)
        score[~(opened | more)] = 0.0
        score = np.round(score.reshape(m, rows), 12)
        out = []
        for own in score:
            near = np.flatnonzero(own > 0)
            if len(near) > k:
                near = near[own[near] >= np.partition(own[near], -k)[-k]]
            near = near[np.lexsort((near, -own[near]))[:k]]
            out.append((near, own[near]))
        return out

    def _open(self, score: np.ndarray, which: np.ndarray, factors: np.ndarray) -> None:
        """Adds the dense lists of each block to the scores of the queries that open it."""
        for b in np.flatnonzero(which.any(axis=0)):
            own = np.flatnonzero(which[:, b])
            score[own, b] += factors[own] @ self.lists[b].T


class Model:
    """Examples, their weights and the calibration: all that scoring needs."""

    def __init__(self, texts: list[tuple[int, str, int]], sizes: dict[int, int]) -> None:
        """texts: (key, text, label) in a fixed order; sizes: labelled rows of each label."""
        total = sum(sizes.values())
        self.prior = (sizes.get(1, 0) + 0.5) / (total + 1)
        self.vocabulary = Vocabulary({}, grow=True)
        self.rows = [(k, y, *self.vocabulary.counts(t)) for k, t, y in texts]
        self.vocabulary.freeze()
        self.n_terms = len(self.vocabulary.number)
        taught = Counter(y for _, y, _, _ in self.rows)
        #: an example stands for this many labelled rows, toxic ones for one
        each = {y: sizes[y] / n for y, n in taught.items()}
        self.each = {y: e / each.get(1, e) for y, e in each.items()}
        self.calibration = (0.0, 1.0)

    def fit(self, frequency: np.ndarray, n_docs: int, k: int = NEIGHBOURS) -> None:
        """Weights, index and calibration, from the terms' document frequencies over n_docs documents."""
        parts: tuple[list, list] = ([], [])
        for place, r in enumerate(self.rows):
            parts[place % ASIDE == 0].append(r)
        kept, aside = parts if len({r[1] for r in parts[1]}) == 2 and len({r[1] for r in parts[0]}) == 2 else (self.rows, [])
        had = np.zeros((2, self.n_terms))
        for _, y, terms, _ in kept:
            had[y, terms] += 1
        n = np.array([[sum(r[1] == y for r in kept)] for y in (0, 1)])
        yes, no = had + 0.5, n - had + 0.5
        odds = np.log(yes[1] / no[1]) - np.log(yes[0] / no[0])
        error = np.sqrt((1 / yes + 1 / no).sum(axis=0))
        beyond = np.maximum(0.0, np.abs(odds) - ERRORS * error) if n.min() else np.zeros(self.n_terms)
        self.weight = (np.log((1 + n_docs) / (1 + frequency)) + 1) * (FLOOR + beyond)
        # like texts share a block: by their heaviest term
        kept = [(*r[:2], r[2], unit(r[2], r[3], self.weight)) for r in kept if len(r[2])]
        kept.sort(key=lambda r: (r[2][int(r[3].argmax())], -r[3].max(), r[0]))
        self.told = [(r[0], r[1]) for r in kept]
        self.votes = np.array([self.each[r[1]] for r in kept])
        self.toxic = np.array([r[1] == 1 for r in kept], bool)
        self.index = BlockMax([(r[2], r[3]) for r in kept], self.n_terms)
        self.calibration = (0.0, 1.0)
        if aside:
            x = np.array([_logit(share) for share, _, _ in self.votes_of([r[2:] for r in aside], k)])
            y = np.array([r[1] for r in aside], float)
            self.calibration = _platt(x, y, np.array([self.each[r[1]] for r in aside]))
        self.rows = []

    def votes_of(self, counted: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each text the share of toxic votes among the nearest, the prior if there are none, and these with their cosines."""
        for i in range(0, len(counted), TOGETHER):
            for at, cosine in self.index.nearest([(t, unit(t, tf, self.weight)) for t, tf in counted[i : i + TOGETHER]], k):
                own = cosine * self.votes[at]
                share = (own[self.toxic[at]].sum() + PRIOR_WEIGHT * self.prior) / (own.sum() + PRIOR_WEIGHT)
                yield float(share), at, cosine

    def scores(self, texts: list[str], k: int) -> Iterator[tuple[float, list[dict]]]:
        """The score of each text and its evidence."""
        a, b = self.calibration
        for i in range(0, len(texts), TOGETHER):
            for share, at, cosine in self.votes_of([self.vocabulary.counts(t) for t in texts[i : i + TOGETHER]], k):
                near = [{"doc_id": self.told[j][0], "cosine": float(c), "label": self.told[j][1]} for j, c in zip(at[:3], cosine[:3], strict=True)]
                yield 1 / (1 + math.exp(-min(30.0, max(-30.0, a + b * _logit(share))))), near


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def _platt(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through votes x and labels y; drawn toward leaving the votes as they are."""
    beta = np.array([0.0, 1.0])
    z = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (each * (y - p)) - (beta - np.array([0.0, 1.0]))
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + np.eye(2), gradient)
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.05))


def score_all(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, chars: int = CHARS, k: int = NEIGHBOURS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Every row of docs as (key, held_out, score, neighbours): score from 0 to 1, higher for likelier toxic.

    Learned is from at most `examples` labelled rows of each label and at most about `chars` characters of their texts,
    the first by a hash of the key, with no held-out row among them. Of rows that repeat a key the one with the least
    text hash is the example, and of its labels the highest counts. The vocabulary is all that the examples hold;
    inverse document frequencies are of all documents. neighbours: up to three nearest examples as (key, cosine, label).
    Empty and null texts, and texts that share no term with the examples, get the calibrated rate of toxic labels.
    Without any label every score is 0.5; with labels of one kind all votes are alike. Rows with null keys are scored
    too; long texts are read whole; an empty table gives an empty result; other columns are ignored. Only examples and
    the frequencies of their terms come to the driver, both bounded by the parameters.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("k"), text_of(text).alias("t"))
    model = Model(*_examples(rows, labels, examples, chars, key, label))
    frequency, n_docs = _frequencies(spark, rows, model)
    model.fit(frequency, n_docs, k)
    sent = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            made = list(model.scores(batch.column("t").to_pylist(), k))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([s for s, _ in made], pa.float64()), pa.array([e for _, e in made], kind)], names=["k", "score", "neighbours"])

    out = rows.mapInArrow(judge, "k bigint, score double, neighbours array<struct<doc_id:bigint,cosine:double,label:int>>")
    return out.select(F.col("k").alias(key), held_out(F.col("k")).alias("held_out"), "score", "neighbours")


def _examples(rows: DataFrame, labels: DataFrame, examples: int, chars: int, key: str, label: str) -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """Texts of the sample as (key, text, label) in the order of a hash, and how many rows have each label."""
    known = labels.select(F.col(key).cast("bigint").alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    known = written(known.groupBy("k").agg(F.max("y").alias("y")), "tox-known")
    sizes = dict(known.groupBy("y").count().collect())
    order = F.xxhash64(F.lit(7), "k")
    sample = known.where("y = 0").orderBy(order, "k").limit(examples).union(known.where("y = 1").orderBy(order, "k").limit(examples))
    own = rows.join(F.broadcast(sample), "k").groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), F.col("t").alias("t"))).alias("o"))
    own = written(own.select("k", "y", "o.t"), "tox-examples")
    before = W.partitionBy("y").orderBy(order, "k").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("before", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0))).where(F.col("before") < chars)
    return [(r.k, r.t, r.y) for r in own.orderBy(order, "k").select("k", "t", "y").collect()], sizes


def _frequencies(spark, rows: DataFrame, model: Model) -> tuple[np.ndarray, int]:
    """In how many of all rows each term of the model occurs, and the number of rows.

    Tasks count into arrays, which are summed in two steps of grouped calls, so no call holds those of all tasks.
    """
    sent = spark.sparkContext.broadcast(model.vocabulary)
    n_terms = model.n_terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, n = sent.value, np.zeros(n_terms + 1, np.int64)  # the last counts rows
        for batch in batches:
            for t in batch.column("t"):
                n[vocabulary.present(t.as_py())] += 1  # repeats are added once
                n[-1] += 1
        part = TaskContext.get().partitionId() % 64
        for c in range(0, len(n), CHUNK):
            if n[c : c + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([part], pa.int64()), pa.array([n[c : c + CHUNK].tobytes()], pa.binary())], names=["c", "part", "n"])

    def summed(group: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x.as_py(), np.int64) for x in group["n"])
        return pa.table({"c": group["c"][:1], "part": group["part"][:1], "n": pa.array([n.tobytes()], pa.binary())})

    kind = "c bigint, part bigint, n binary"
    counted = rows.select("t").mapInArrow(count, kind).groupBy("c", "part").applyInArrow(summed, kind).groupBy("c").applyInArrow(summed, kind)
    whole = np.zeros(n_terms + 1, np.int64)
    for r in counted.collect():
        n = np.frombuffer(r.n, np.int64)
        whole[r.c : r.c + len(n)] = n
    return whole[:-1], int(whole[-1])
