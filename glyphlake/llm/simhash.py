"""Near duplicates by SimHash.

Fingerprints whose bits differ in at most `distance` places are linked; classes are the connected components. Links are
found by the pigeonring principle: of the segments of a fingerprint, arranged in a ring, some chain of consecutive
segments starts such that its first l segments differ in at most l * distance / segments bits, for every l. While that
budget is below one bit the segments must agree, which makes the key of a bucket; the longer chains and then the full
Hamming distance are checked for the pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import merged, text_of, written
from glyphlake.llm.components import components

BITS = 64
SEED = 42
#: Bits set in each value of a byte, one row for each value.
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_AT = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the shingles of `width` words, repeats included; fewer words make one shingle, none make none."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        starts, stops = [0], [len(line)]
    else:
        stops = ends[width - 1 :].tolist()
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)]), ">u8").astype(np.uint64)


def majority(h: np.ndarray) -> int:
    """The fingerprint: bits set in over half of the hashes; zero for none."""
    if not len(h):
        return 0
    cells = h.view(np.uint8).reshape(-1, 8) + _AT
    counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _OF_BYTE
    return int.from_bytes(np.packbits((2 * counts > len(h)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(key, fp): the fingerprint of each row's whole text as a signed 64-bit integer. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(shingle_hashes(t.as_py(), width, seed)) for t in batch.column("t")]
            fps = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(fps)], names=["k", "fp"])

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.encode(text_of(text), "UTF-8").alias("t"))
    return rows.mapInArrow(run, "k bigint, fp bigint").withColumnRenamed("k", key)


def _segments(n: int) -> list[tuple[int, int]]:
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _ring_mask(segments: list[tuple[int, int]], first: int, length: int) -> int:
    mask = 0
    for j in range(length):
        at, width = segments[(first + j) % len(segments)]
        mask |= ((1 << width) - 1) << at
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def ring_near(d: Column, distance: int, segments: int) -> Column:
    """Whether fingerprints that differ in the bits of d pass the pigeonring filter and then the full Hamming check.

    Some start must have chains whose differences stay within their budgets for every length; of lengths with equal
    budgets the longest says it all.
    """
    seg = _segments(segments)
    free = [length * distance // segments for length in range(1, segments + 1)]
    ends = [n for n in range(1, segments) if free[n - 1] < free[n]]
    chains = F.lit(False)
    for i in range(segments):
        ok = F.lit(True)
        for n in ends:
            ok = ok & (F.bit_count(d.bitwiseAND(F.lit(_ring_mask(seg, i, n)))) <= free[n - 1])
        chains = chains | ok
    return chains & (F.bit_count(d) <= distance)


def search(fps: DataFrame, distance: int = 2, segments: int = 8, bucket: int = 48) -> tuple[DataFrame, DataFrame]:
    """links(), and the values (fp) that lie in a large bucket; all other values have every pair within the distance in links()."""
    if distance != 2:
        raise ValueError("links are made for a distance of 2")
    seg = _segments(segments)
    free = [length * distance // segments for length in range(1, segments + 1)]
    clean = sum(b == 0 for b in free)
    masks = [_ring_mask(seg, i, clean) for i in range(segments)]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks))))
    b = fps.select("fp").distinct().select("fp", keys.alias("k")).select("fp", "k.i", "k.key")
    n = b.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    b = written(b.join(merged(n, "simhash-counts"), ["i", "key"]), "simhash-buckets")
    # pairs of small buckets, in arrays: chains first, then the whole distance
    def near(x: Column, y: Column) -> Column:
        return ring_near(x.bitwiseXOR(y), distance, segments)

    few = b.where(F.col("n") <= bucket).groupBy("i", "key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("u"), y.alias("v")))))
    few = few.select(F.explode(pairs).alias("p")).select("p.u", "p.v").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit((1 << k) if k < 63 else -(1 << 63)).cast("bigint") for k in range(BITS)))
    many = b.where(F.col("n") > bucket).select("fp").distinct()
    met = many.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("at"))
    hubs = met.groupBy("at").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "hub")
    stars = met.join(merged(hubs, "simhash-hubs"), "at").where("fp <> hub").select(F.col("hub").alias("u"), F.col("fp").alias("v")).distinct()
    return few.union(stars), many


def links(fps: DataFrame, distance: int = 2, segments: int = 8, bucket: int = 48) -> DataFrame:
    """Pairs (u, v) of different values of fps.fp that connect all values at most `distance` bits apart.

    For distance 2 every pair within the distance is joined by a path of returned pairs, each within the distance.
    Buckets of at most `bucket` values are compared pair by pair in one row. Values of larger buckets are linked exactly
    without pairs: each is sent to itself and to its 64 values one bit away; values that meet are at most two bits
    apart, and any two within two bits meet, so a star on the smallest holds all that pairs would.
    """
    return search(fps, distance, segments, bucket)[0]


def classes(fps: DataFrame, key: str = "doc_id", distance: int = 2) -> DataFrame:
    """fps (key, fp, ...) with component_id: the smallest key among the rows linked to a row, itself included.

    Equal fingerprints are one node, so copies make no pairs. Null keys are returned and count only if a class has no
    other; an empty table gives an empty result.
    """
    nodes = written(fps.groupBy("fp").agg(F.min(key).alias("least")), "simhash-nodes")
    comp = components(links(nodes, distance))
    nodes = nodes.join(merged(comp), F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), "least", F.coalesce("root", "fp").alias("root"))
    nodes = written(nodes, "simhash-roots")
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    nodes = nodes.join(merged(ids, "simhash-ids"), F.col("root") == F.col("r")).select("f", "component_id")
    return fps.join(merged(nodes, "simhash-components"), F.col("fp") == F.col("f"), "left").drop("f")


def near_duplicate_classes(docs: DataFrame, width: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for every row of docs; see fingerprints() and classes()."""
    return classes(written(fingerprints(docs, width, key, text), "simhash-fps"), key, distance)
