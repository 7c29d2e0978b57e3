"""Exact top-k by inner product over a bit-sliced index.

Vectors become integers; each component of a block of rows is stored as bitmaps, one for each bit. For a query the
scores of all rows of a block are summed at once, as bit slices, by carry-save adders over bitmaps weighted by the set
bits of the query. Top rows are selected from the most significant score slice downward; the low bits of components
are left out of the sums, and rows that the left-out bits could lift into the top are resolved exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.llm.common import written

#: Low bits of each component that the slices leave to the exact step.
DROPPED = 2
#: Components and scores beyond these stop there, so that sums of differences stay within 64 bits.
MOST = (1 << 62) - (1 << 10)
MOST_SCORE = (1 << 63) - 1
#: Bytes of query vectors that are broadcast at once.
QUERY_BYTES = 32_000_000
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) for each component, at most MOST either way; null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    within = lambda x: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), x))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(within(x.cast("double") * scale))))


class BitSliced:
    """Bit slices of a block of rows."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows.astype(np.int64)
        self.n, self.dims = self.rows.shape
        # non-negative codes: the shift is the same for all rows, so it does not change their order for a query
        self.base = self.rows.min(axis=0, initial=0) if self.n else np.zeros(self.dims, np.int64)
        self.widest = max(abs(int(self.rows.max(initial=0))), abs(int(self.rows.min(initial=0))))
        codes = (self.rows - self.base) >> DROPPED
        self.bits = max(1, int(codes.max(initial=0)).bit_length())
        width = -(-self.n // 64) * 8
        packed = np.zeros((self.dims, self.bits, width), np.uint8)
        for b in range(self.bits):
            x = np.packbits(((codes >> b) & 1).astype(np.uint8), axis=0, bitorder="little")
            packed[:, b, : x.shape[0]] = x.T
        self.slices = packed.view(np.uint64)
        self.valid = np.zeros(width, np.uint8)
        v = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        self.valid[: len(v)] = v
        self.valid = self.valid.view(np.uint64)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Score slices from the least significant up, and by how much the full score can exceed what they tell.

        Negative factors take the complement of a component's slices: -q * code = q * (~code) - const.
        """
        by_weight: list[list[np.ndarray]] = []
        factor = np.abs(query)
        top = int(factor.max(initial=0)).bit_length()
        flip = query < 0
        for j in range(top):
            used = (factor >> j) & 1 == 1
            if not used.any():
                continue
            part = self.slices[used]
            part = np.where(flip[used][:, None, None], ~part, part)
            for b in range(self.bits):
                while len(by_weight) <= j + b:
                    by_weight.append([])
                by_weight[j + b].append(part[:, b, :])
        out, w = [], 0
        while w < len(by_weight):
            group = by_weight[w]
            x = np.concatenate(group) if group else np.zeros((1, self.slices.shape[2]), np.uint64)
            carries = []
            while len(x) > 2:
                third = len(x) // 3
                a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
                ab = a ^ b
                carries.append((a & b) | (c & ab))
                x = np.concatenate([ab ^ c, x[3 * third :]])
            if len(x) == 2:
                carries.append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
            out.append(x[0])
            if carries:
                if len(by_weight) == w + 1:
                    by_weight.append([])
                by_weight[w + 1].extend(carries)
            w += 1
        slack = int(factor.sum()) * ((1 << DROPPED) - 1)
        return out, slack

    def values(self, slices: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """The summed scores of single rows."""
        total = np.zeros(len(at), np.int64)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        for k, s in enumerate(slices):
            total += ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << k
        return total

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows among which the k best are, all ties of the last included."""
        if self.n <= k:
            return np.arange(self.n)
        slices, slack = self.sums(query)
        # descending from the top slice: sure are rows above the bound, open are those that equal its bits so far
        sure, still, bound = np.zeros_like(self.valid), self.valid.copy(), 0
        n_sure = 0
        for s in range(len(slices) - 1, -1, -1):
            ones = still & slices[s]
            n = n_sure + int(np.bitwise_count(ones).sum())
            if n >= k:
                still, bound = ones, bound | (1 << s)
            else:
                sure, n_sure, still = sure | ones, n, still & ~slices[s]
        # bound: the k-th highest sum; a full score is in [sum, sum + slack] in the same unit
        least = bound - (slack >> DROPPED) - 1
        if least <= 0:
            return np.arange(self.n)
        above, same = np.zeros_like(self.valid), self.valid.copy()
        for s in range(len(slices) - 1, -1, -1):
            if least >> s & 1:
                same = same & slices[s]
            else:
                above, same = above | (same & slices[s]), same & ~slices[s]
        chosen = np.unpackbits((above | same).view(np.uint8), bitorder="little")[: self.n]
        return np.flatnonzero(chosen)

    def top(self, query: np.ndarray, k: int, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows whose id is not own; ties go to the smaller id.

        Where products may leave 64 bits, all rows are scored in unbounded integers, and scores stop at MOST_SCORE.
        """
        wide = self.widest * max(abs(int(query.max(initial=0))), abs(int(query.min(initial=0)))) * self.dims > MOST_SCORE
        at = np.arange(self.n) if wide else self.candidates(query, k + int((ids == own).sum()))
        at = at[ids[at] != own]
        if wide:
            score = np.array([max(-MOST_SCORE, min(MOST_SCORE, x)) for x in self.rows[at].astype(object) @ query.astype(object)], np.int64)
        else:
            score = self.rows[at] @ query
        order = np.lexsort((ids[at], -score))[:k]
        return ids[at][order], score[order]


def _padded(values: list, dims: int) -> np.ndarray:
    if all(len(v) == dims for v in values):
        return np.array(values, np.int64).reshape(len(values), dims)
    out = np.zeros((len(values), dims), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding", block_rows: int = 8192, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """For each row that the condition `queries` marks, the k rows of other key with the highest integer inner product.

    Rows (query_id, rank from 1, vec_id, score), all if fewer than k; ties go to the smaller key; rows that repeat the key
    of a query are queries of their own. Vectors that are null
    or hold a null, NaN or infinite component take no part, nor do rows with a null key; of repeated keys every row is a
    candidate. Shorter vectors are padded with zeros. Components stop at MOST, scores at MOST_SCORE, either way; scores
    that stop there are ties. An empty table gives an empty result. Other columns are ignored.

    Queries are broadcast in blocks of about query_bytes. For each such block every task goes through its rows in index
    blocks of block_rows and keeps the k best of each query, so a task holds one index block and one query block, and only
    k rows for a query leave a task. Rows are moved once, queries are never shuffled.
    """
    spark = vectors.sparkSession
    v = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), quantised(F.col(vector), scale).alias("v"), queries.alias("q")).where("v IS NOT NULL")
    v = written(v.withColumn("n", F.xxhash64(F.monotonically_increasing_id())), "topk-vectors")
    total, size = v.agg(F.count(F.lit(1)), F.sum(F.when(F.col("q"), 8 * F.size("v") + 100))).first()
    tasks = max(1, min(-(-total // block_rows), 4 * spark.sparkContext.defaultParallelism))
    rows = written(v.select("id", "v").repartition(tasks), "topk-rows")
    out = None
    blocks = max(1, -(-(size or 0) // query_bytes))
    for b in range(blocks):
        asked = v.where("q").where(F.pmod("n", F.lit(blocks)) == b).select("id", "v").collect()
        sent = spark.sparkContext.broadcast([(r.id, np.array(r.v, np.int64)) for r in asked])
        got = rows.mapInArrow(_searcher(sent, k, block_rows), "query bigint, query_id bigint, vec_id bigint, score bigint")
        if blocks > 1:
            got = written(got, "topk-found")
        got = got.select(F.lit(b).alias("block"), "*")
        out = got if out is None else out.unionByName(got)
    # rows of a repeated query key are queries of their own with equal results
    best = W.partitionBy("block", "query").orderBy(F.col("score").desc(), "vec_id")
    top = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")


def _searcher(sent, k: int, block_rows: int):
    """The search of a task: its rows, block by block, against the queries that were sent."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        ids: list[int] = []
        values: list = []

        def close() -> None:
            dims = max(map(len, values))
            index, own = BitSliced(_padded(values, dims)), np.array(ids, np.int64)
            for q, (i, vec) in enumerate(asked):
                at, score = index.top(_padded([vec[:dims]], dims)[0], k, own, i)
                at, score = np.concatenate([best[q][0], at]), np.concatenate([best[q][1], score])
                order = np.lexsort((at, -score))[:k]
                best[q] = at[order], score[order]
            ids.clear()
            values.clear()

        for batch in batches:
            for i, vec in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids.append(i)
                values.append(vec)
                if len(ids) >= block_rows:
                    close()
        if ids:
            close()
        for q in range(0, len(asked), 10_000):
            part = range(q, min(len(asked), q + 10_000))
            n = [len(best[j][0]) for j in part]
            columns = [np.repeat(list(part), n), np.repeat([asked[j][0] for j in part], n), *(np.concatenate([best[j][c] for j in part]) for c in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query", "query_id", "vec_id", "score"])

    return search
