"""Benchmark decontamination: pairs of words as seeds, joined by hash, then Smith-Waterman alignment.

An alignment with m matches and e edits scores 2m - e and keeps at least m - 1 - e of the item's pairs of neighbouring
words, so one that scores `threshold` of an item of n words keeps (2 * threshold - 1) * n - 1 of its n - 1 pairs: the need.
All pairs but the need - r most common ones are seeds; whatever is edited, r of them are left. Hashed pairs of the texts
are joined with the seeds; a document with r seeds of an item is aligned with it, by words, and the local alignment score
over the score of the whole item tells copies, edited and paraphrased ones among them, from chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.llm.common import text_of, written

#: Items of fewer words match texts that are the same words and no others.
LEAST_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's own score from which a document counts as contaminated: a fifth of the words replaced is 0.7.
THRESHOLD = 0.7
#: Seeds of an item that a document has to hold, where so many are sure to be left.
SEEDS = 3
#: Bits of the filter for each seed, and of all of it as a power of two at most: beyond that more pairs pass it.
FILTER_BITS, MOST_FILTER_BITS = 16, 28
#: Words of which a task remembers the hash.
CACHE = 500_000
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

#: ASCII punctuation parts words as white space does.
_APART = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words in UTF-8, parted by ASCII white space and punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_APART).split()


class Hasher:
    """Hashes of words, remembered, and of what stands in a text."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        known, got = self.known, list(map(self.known.get, words))
        if None in got:
            for i, h in enumerate(got):
                if h is None:
                    got[i] = known[words[i]] = xxhash.xxh64_intdigest(words[i])
        return np.array(got, np.uint64)

    def pairs(self, words: list[bytes]) -> np.ndarray:
        """The hash of each pair of neighbours; of a text shorter than LEAST_WORDS one, of all of it."""
        if 0 < len(words) < LEAST_WORDS:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), LEAST_WORDS)], np.uint64)
        h = self.words(words)
        x = h[:-1] * _MIX[0] + h[1:] * _MIX[1]
        return (x ^ (x >> np.uint64(32))) * _MIX[2]


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (score, start, stop) of word numbers, stop exclusive in the window; linear gap costs."""
    n = len(window)
    score = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    steps = -GAP * np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diagonal = score[:-1] + np.where(window == w, MATCH, MISMATCH)
        new, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        up = score + GAP
        take = diagonal > 0
        new[1:] = np.where(take, diagonal, 0)
        start[1:] = np.where(take, begin[:-1], start[1:])
        take = up > new
        new, start = np.where(take, up, new), np.where(take, begin, start)
        # gaps along the window: the best earlier cell less the distance, by a running maximum
        shifted = new + steps
        reach = np.maximum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == reach, np.arange(n + 1), 0))
        along = reach - steps
        take = along > new
        new, start = np.where(take, along, new), np.where(take, start[source], start)
        score, begin = new, start
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(begin[top]), top)
    return best


def need_of(n: int, threshold: float) -> int:
    """Pairs of an item of n words that every alignment at the threshold keeps."""
    return max(1, math.ceil((2 * threshold - 1) * n - 1 - 1e-9))


def match(words: list[bytes], item: list[bytes], threshold: float) -> tuple[float, int, int] | None:
    """(score share, start word, stop word) of the best place of an item in a text; None if it is below the threshold."""
    n = len(item)
    if n < LEAST_WORDS or n == 0:
        return (1.0, 0, n) if n and words == item else None
    at: dict[tuple[bytes, bytes], list[int]] = {}
    for j, pair in enumerate(zip(item, item[1:], strict=False)):
        at.setdefault(pair, []).append(j)
    slack = max(4, math.ceil(2 * (1 - threshold) * n))  # no more words are inserted at this score
    starts = sorted({p - j for p, pair in enumerate(zip(words, words[1:], strict=False)) for j in at.get(pair, ())})
    spans: list[list[int]] = []
    for s in starts:  # windows that overlap are one
        lo, hi = max(0, s - slack), min(len(words), s + n + slack)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in item], np.int64)
    need, best = need_of(n, threshold), None
    for lo, hi in spans:
        part = words[lo:hi]
        # the needed pairs, and enough words in common, bound the score from above
        here = set(zip(part, part[1:], strict=False))
        if sum(len(js) for pair, js in at.items() if pair in here) < need:
            continue
        window = np.array([number.get(w, -1) for w in part], np.int64)
        if np.isin(codes, window).sum() < threshold * n - 1e-9:
            continue
        score, start, stop = align(codes, window)
        share = score / (MATCH * n)
        if share >= threshold and (best is None or share > best[0]):
            best = (share, lo + start, lo + stop)
    return best


def _seeds(items: DataFrame, threshold: float) -> DataFrame:
    """(hash, item_id, ith, least): seeds of all items, and how many of them a document has to hold.

    Rare ones come first by how often the items have their words, which only tells how many documents are aligned in vain.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for i, ith, t in zip(batch.column("item_id").to_pylist(), batch.column("ith").to_pylist(), batch.column("t").to_pylist(), strict=True):
                words = words_of(t)
                if not words:
                    continue
                h, single = hasher.pairs(words).view(np.int64), hasher.words(words).view(np.int64)
                m = len(h)
                single = single if len(words) > m else np.append(single, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * m, pa.int64()), pa.array([ith] * m, pa.int64()), pa.array([need_of(len(words), threshold)] * m, pa.int32()), pa.array([m] * m, pa.int32()),
                     pa.array(np.arange(m), pa.int32()), pa.array(single[:m]), pa.array(single[1 : m + 1]), pa.array(h)],
                    names=["item_id", "ith", "need", "m", "j", "a", "b", "hash"],
                )

    own = written(items.mapInArrow(pairs, "item_id bigint, ith bigint, need int, m int, j int, a bigint, b bigint, hash bigint"), "decontaminate-pairs")
    often = own.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    own = own.join(often.select("a", F.col("n").alias("na")), "a").join(often.select(F.col("a").alias("b"), F.col("n").alias("nb")), "b", "left")
    rare = F.col("na") * F.coalesce("nb", F.lit(1))
    own = own.withColumn("no", F.row_number().over(W.partitionBy("item_id", "ith").orderBy(rare, "j")))
    least = F.least(F.lit(SEEDS), "need")
    return own.where(F.col("no") <= F.col("m") - F.col("need") + least).select("hash", "item_id", "ith", least.alias("least"))


def _bits(hash_: Column, bits: int) -> Column:
    """The two bits of a hash in a filter of 2 ** bits."""
    return F.array(F.shiftrightunsigned(hash_, 64 - bits), hash_.bitwiseAND(F.lit((1 << bits) - 1)))


def _filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap that has the bits of all seeds, of a size that follows their number up to MOST_FILTER_BITS."""
    n = seeds.count()
    bits = min(MOST_FILTER_BITS, max(16, (FILTER_BITS * n).bit_length()))
    at = seeds.select(F.explode(_bits(F.col("hash"), bits)).alias("bit")).select((F.col("bit") + 1).alias("bit"))
    parts = at.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts:
        whole[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.map, np.uint8)
    return whole, bits


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, max_broadcast_rows: int = 200_000) -> DataFrame:
    """Pairs (key, item_id, score, start_word, end_word, n_words): documents that hold a test item, whole or edited.

    score: alignment score over the item's own, from threshold to 1. A document that holds several items has a row for
    each, with its best place. Null texts count as empty; items with null id or without a word match nothing, those of
    fewer than LEAST_WORDS words match texts of just these words; items that repeat in full count once, and those that
    repeat an id with another text are items of their own. Documents with a null key are returned with it, and rows that
    repeat are returned as often. Empty tables give no rows; other columns are ignored. No pair at the threshold is
    missed where (2 * threshold - 1) * words > 1, as it is at THRESHOLD for every longer item.

    Texts are read whole, twice, and not shuffled: first for their hashes in the seeds, through a filter of at most 32 MB
    at any number of items, then those with candidates for the alignment. Seeds, and candidates with their items' texts,
    are broadcast while they have at most max_broadcast_rows rows, and candidates at most 64 million characters; beyond
    that these joins shuffle.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("k"), text_of(text).alias("t"))
    items = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), text_of("text").alias("t"))
    items = written(items.withColumn("ith", F.xxhash64("t")).dropDuplicates(["item_id", "ith"]), "decontaminate-items")
    seeds = written(_seeds(items, threshold), "decontaminate-seeds")
    bitmap, bits = _filter(seeds)
    sent = spark.sparkContext.broadcast(bitmap)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hasher = sent.value, Hasher()
        high, low = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        has = lambda at: (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        for batch in batches:
            found, n = [], []
            for t in batch.column("t"):
                words = words_of(t.as_py())
                h = hasher.pairs(words) if words else np.zeros(0, np.uint64)
                h = h[has(h >> high) == 1]
                h = np.unique(h[has(h & low) == 1])
                found.append(h.view(np.int64))
                n.append(len(h))
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([batch.column("k").take(at), batch.column("th").take(at), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["k", "th", "hash"])

    rows = rows.withColumn("th", F.xxhash64("t"))
    hits = rows.mapInArrow(find, "k bigint, th bigint, hash bigint")
    few = F.broadcast(seeds) if seeds.count() <= max_broadcast_rows else seeds
    held = hits.join(few, "hash").groupBy("k", "th", "item_id", "ith").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"))
    asked = held.where("n >= least").join(items.withColumnRenamed("t", "item"), ["item_id", "ith"])
    asked = written(asked.select(F.col("k").alias("ck"), F.col("th").alias("cth"), "item_id", "item"), "decontaminate-candidates")
    n, chars = asked.agg(F.count(F.lit(1)), F.sum(F.length("item"))).first()
    asked = F.broadcast(asked) if n <= max_broadcast_rows and (chars or 0) <= 64_000_000 else asked
    both = rows.join(asked, (F.col("th") == F.col("cth")) & F.col("k").eqNullSafe(F.col("ck"))).select("k", "t", "item_id", "item")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "item_id", "score", "start_word", "end_word", "n_words"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
        last, words = None, []
        for batch in batches:
            out = []
            for k, t, i, item in zip(*(batch.column(c) for c in ("k", "t", "item_id", "item")), strict=True):
                t = t.as_py()
                if t != last:
                    last, words = t, words_of(t)
                if got := match(words, words_of(item.as_py()), threshold):
                    out.append((k.as_py(), i.as_py(), *got, len(words)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return both.mapInArrow(aligned, "k bigint, item_id bigint, score double, start_word int, end_word int, n_words int").withColumnRenamed("k", key)
