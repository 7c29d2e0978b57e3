"""Near-duplicate documents at a word-shingle similarity, by SimHash with pigeonring search, and beyond its reach.

All fingerprints go through simhash.search(): buckets by the ring's segments, chains, the Hamming distance of two bits.
Texts so linked are compared by their shingle sets, and star contraction makes the classes. Two bits of 64 are reached by
texts of a Jaccard similarity near 1 only; at 0.8 about ten bits differ, and no segment can be expected to agree. So more
candidates come from bands of minimum hashes over the same shingle hashes, pruned by the pigeonring filter and the Hamming
distance of the same fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glyphlake.llm.common import merged, own_names, temporary, text_of, written
from glyphlake.llm.components import components
from glyphlake.llm.simhash import majority, ring_near, search, shingle_hashes

#: Bands of rows of minimum hashes: at a similarity of 0.8 a pair shares a band with probability 0.9993.
BANDS, ROWS = 24, 6
#: Bits that the fingerprints of a link of the pigeonring search differ in, at most.
LINKED = 2
#: Bits that fingerprints of similar sets may differ in: at 0.8 about 9.7 are expected, with a deviation of 2.9.
DISTANCE, SEGMENTS = 24, 8
#: Buckets up to this size are compared pair by pair.
BUCKET = 32
LEADERS, NEIGHBOURS = 4, 3
#: Counters of shingles by hash, for the order of rarity; texts that meet at one key in one group of the join.
COUNTERS, BLOCK = 1 << 20, 1024
_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: bytes, width: int) -> tuple[bytes, int, list[int]]:
    """Digest of the shingle set, SimHash of it as a signed integer, and a key for each band."""
    h = np.unique(shingle_hashes(text, width))
    digest = xxhash.xxh3_128_digest(h.tobytes())
    fp = majority(h)
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 2048):
        x = h[i : i + 2048, None] * _FACTORS
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0))
    keys = [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return digest, signed(fp), [signed(k) for k in keys]


def _sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t.as_py(), width) for t in batch.column("t")]
            digest, fp, keys = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("th"), pa.array(digest, pa.binary()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["k", "th", "node", "fp", "keys"],
            )

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.xxhash64(text_of(text)).alias("th"), F.encode(text_of(text), "UTF-8").alias("t"))
    return rows.mapInArrow(run, "k bigint, th bigint, node binary, fp bigint, keys array<bigint>")


def _linked(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of nodes whose fingerprints simhash.search() links; and nodes of which these do not hold every pair.

    A fingerprint's least node stands for it. The nodes of fingerprints that several have, or that are linked to such a
    one, or lie in a large bucket of the ring, are left to the prefix join of _across() besides.
    """
    g = written(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")), "neardup-fps")
    found, many = search(g.select("fp"), LINKED, bucket=BUCKET)
    of = lambda side: g.select(F.col("fp").alias(side), F.col("rep").alias(f"rep_{side}"), F.col("n").alias(f"n_{side}"))
    found = written(found.join(merged(of("u")), "u").join(merged(of("v")), "v"), "neardup-ring")
    copies = nodes.join(merged(g.where("n > 1")), "fp").where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    pairs = found.select(F.least("rep_u", "rep_v").alias("u"), F.greatest("rep_u", "rep_v").alias("v")).union(copies)
    shared = found.where("n_u > 1 OR n_v > 1")
    hot = many.union(shared.select("u")).union(shared.select("v")).union(g.where("n > 1").select("fp")).distinct()
    return pairs, nodes.join(merged(hot, "neardup-hot"), "fp").select("node")


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of nodes that share a band and pass the filter, linear in the nodes; and the nodes in large buckets."""
    b = nodes.select("node", "fp", F.posexplode("keys").alias("band", "key"))
    n = b.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
    b = written(b.join(merged(n, "neardup-counts"), ["band", "key"]), "neardup-buckets")
    near = lambda x, y: ring_near(x.bitwiseXOR(y), DISTANCE, SEGMENTS)
    few = b.where(F.col("n") <= BUCKET).groupBy("band", "key").agg(F.collect_list(F.struct("node", "fp")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(
        F.filter("m", lambda y: (y["node"] > x["node"]) & (F.bit_count(y["fp"].bitwiseXOR(x["fp"])) <= DISTANCE)),
        lambda y: F.struct(x["node"].alias("u"), y["node"].alias("v"), x["fp"].alias("f"), y["fp"].alias("g")),
    )))
    few = few.select(F.explode(pairs).alias("p")).select("p.*")
    # large buckets: leaders, and neighbours in the order of the fingerprints, rotated by another number of bits for each
    # band; cells by the first bits of the rotated fingerprint bound what is sorted together
    big = b.where(F.col("n") > BUCKET)
    turned = F.expr("(fp << CAST((band * 37) % 64 AS INT)) | shiftrightunsigned(fp, CAST((64 - (band * 37) % 64) % 64 AS INT))")
    big = big.withColumn("turned", turned).withColumn("cell", F.shiftrightunsigned("turned", 58))
    order = W.partitionBy("band", "key", "cell").orderBy("turned", "node")
    ahead = big.select("node", "fp", *(F.lead(F.struct("node", "fp"), j).over(order).alias(f"n{j}") for j in range(1, NEIGHBOURS + 1)))
    beside = ahead.select("node", "fp", F.explode(F.array(*(F.col(f"n{j}") for j in range(1, NEIGHBOURS + 1)))).alias("o")).where("o IS NOT NULL")
    beside = beside.select(F.col("node").alias("u"), F.col("o.node").alias("v"), F.col("fp").alias("f"), F.col("o.fp").alias("g"))
    # leaders: the first nodes of each large bucket by a hash that is the same in all bands, found by a bounded aggregate
    rank = F.struct(F.xxhash64("node").alias("x"), F.col("node").alias("node"), F.col("fp").alias("fp"))
    parts = big.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(LEADERS)))
    leads = parts.groupBy("band", "key", "part").agg(F.min(rank).alias("lead")).select("band", "key", "lead")
    led = big.join(merged(leads, "neardup-leads"), ["band", "key"]).where(F.col("node") != F.col("lead.node"))
    led = led.select(F.col("lead.node").alias("u"), F.col("node").alias("v"), F.col("lead.fp").alias("f"), F.col("fp").alias("g"))
    every = few.union(beside).union(led).where(near(F.col("f"), F.col("g")))
    return every.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), big.select("node").distinct()


def _sets(wanted: DataFrame, docs: DataFrame, owners: DataFrame, width: int, key: str, text: str, max_broadcast_rows: int) -> DataFrame:
    """(node, h): the shingle hashes of wanted's nodes, sorted; owners: (node, k, th) names a row with the text."""
    wanted = written(owners.join(merged(wanted), "node").select("node", F.col("k").alias("ok"), F.col("th").alias("oth")), "neardup-involved")
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.xxhash64(text_of(text)).alias("th"), F.encode(text_of(text), "UTF-8").alias("t"))
    wanted = F.broadcast(wanted) if wanted.count() <= max_broadcast_rows else merged(wanted)
    texts = rows.join(wanted, (F.col("th") == F.col("oth")) & F.col("k").eqNullSafe(F.col("ok"))).select("node", "t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(t.as_py(), width)).tobytes() for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "h"])

    held = written(texts.mapInArrow(sets, "node binary, h binary"), "neardup-sets")
    # rows that repeat in full gave their node twice
    return held.groupBy("node").agg(F.first("h").alias("h"))


def _across(rooted: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """All pairs (u, v) of held's nodes with different roots that can have the similarity; none that has it is left out.

    Prefix filtering: of sets with n <= m shingles in one order, a similar pair has its first common shingle in the first
    n - 2s/(1+s) n + 1 of the shorter and the first m - s m + 1 of the longer, and as many after it as the overlap needs.
    Rare shingles come first, so that what many texts have in common is in few prefixes.
    """
    spark = held.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for h in batch.column("h"):
                np.add.at(n, np.frombuffer(h.as_py(), np.uint64) % np.uint64(COUNTERS), 1)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 10_000):
            part = at[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(n[part], pa.int64())], names=["at", "n"])

    counted = held.select("h").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)
    often[counted["at"].to_numpy()] = counted["n"].to_numpy()
    often = spark.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for h in batch.column("h"):
                x = np.frombuffer(h.as_py(), np.uint64)
                order = np.lexsort((x, often.value[x % np.uint64(COUNTERS)]))
                made.append((len(x), x[order[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1]].view(np.int64)))
            n, keys = zip(*made, strict=True) if made else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["node", "root", "n", "keys"])

    keyed = held.join(merged(rooted.select("node", "root")), "node").select("node", "root", "h")
    keyed = keyed.mapInArrow(prefixes, "node binary, root binary, n int, keys array<bigint>")
    keyed = written(keyed.select("node", "root", "n", F.posexplode("keys").alias("pos", "key")), "neardup-prefixes")
    cross = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("a"), F.max("root").alias("b")).where("a != b")
    keyed = keyed.join(merged(cross.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "neardup-cross"), "key")
    keyed = written(keyed, "neardup-keyed")
    need = lambda n, share: F.ceil(n * F.lit(share) - 1e-9)
    both = similarity / (1 + similarity)
    x = keyed.where(F.col("pos") <= F.col("n") - need(F.col("n"), 2 * both)).withColumn("block", F.pmod(F.hash("node"), "blocks")).alias("x")
    y = merged(keyed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))).alias("y")
    shorter = F.struct("x.n", "x.node") < F.struct("y.n", "y.node")
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    fits = (F.col("x.n") >= need(F.col("y.n"), similarity)) & (left >= need(F.col("x.n") + F.col("y.n"), both))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.root") != F.col("y.root")) & shorter & fits)
    return met.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v")).distinct()


def _verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose shingle sets, by node in held, have the Jaccard similarity."""
    of = lambda side: merged(held.select(F.col("node").alias(side), F.col("h").alias(f"h{side}")))
    both = pairs.join(of("u"), "u").join(of("v"), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("hu"), batch.column("hv"), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                ok.append(common >= similarity * (len(x) + len(y) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], names=["u", "v"])

    return both.select("u", "v", "hu", "hv").mapInArrow(compare, "u binary, v binary")


def near_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", max_broadcast_rows: int = 500_000) -> DataFrame:
    """Every row of docs as (k, th, keep_k, keep_th): its key and xxhash64 of its text, and those of the row that its class keeps.

    Classes are the connected components of texts whose sets of `width`-word shingles (A-Z lower-cased) have a Jaccard
    similarity of at least `similarity`; shorter texts are one shingle, and empty and null texts are one class. The
    smallest key stays, null keys last. All texts whose fingerprints the pigeonring search links are compared. Links within buckets of at most BUCKET texts that share a band are found pair by pair; in larger
    ones each text is compared with leaders and with neighbours in 24 sort orders, and the keepers of the classes that
    come of it are compared again in the smaller buckets that they make, as long as that finds links. Texts of large
    buckets, and of fingerprints that many share, that are still in different classes then meet wherever the rare ends of
    their shingle sets do, which no similar pair avoids. So a similar pair is missed only if its fingerprints are
    more than LINKED bits apart and it shares no band or fails the filter in a small bucket, and no large bucket is paired
    with itself. Tables of ids are broadcast while they have at most max_broadcast_rows rows.
    """
    made = written(_sketches(docs, key, text, width), "neardup-sketches")
    least = F.min(F.struct(F.col("k").isNull().alias("nil"), "k", "th"))
    nodes = written(made.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), least.alias("least")), "neardup-nodes")
    owners = nodes.select("node", "least.k", "least.th")
    ring, hot = _linked(nodes)
    # keepers of classes in large buckets meet again, in smaller buckets, until no two of them are found to be similar
    looked, links, rooted, crowded = nodes, None, None, None
    owned = (docs, owners, width, key, text, max_broadcast_rows)
    while True:
        with temporary(docs.sparkSession) as kept:
            pairs, large = _candidates(looked)
            pairs = written(pairs if rooted is not None else pairs.union(ring).distinct(), "neardup-pairs")
            involved = pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "node")
            new = kept(_verified(pairs, _sets(involved, *owned), similarity), "neardup-links")
            if rooted is not None and new.limit(1).count() == 0:
                break
            links = new if links is None else kept(links.union(new), "neardup-links")
            comp = components(links)
            rooted = kept(nodes.join(merged(comp), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "neardup-roots")
            large = kept(large, "neardup-large")
            if crowded is None:  # large buckets of later rounds are parts of these
                crowded = kept(large.union(hot).distinct(), "neardup-crowded-nodes")
            if large.limit(1).count() == 0:
                break
            again = rooted.join(merged(large), "node").select("root").distinct()
            # heads of all classes first: summed up in the tasks, so that no class is one task's
            heads = rooted.groupBy("root").agg(F.min(F.struct("least", "node")).alias("h"))
            heads = heads.join(merged(again, "neardup-again"), "root").select("h.node")
            looked = kept(nodes.join(merged(heads), "node"), "neardup-heads")
    if crowded.limit(1).count():
        with temporary(docs.sparkSession) as kept:
            held = written(_sets(crowded, *owned), "neardup-crowded")
            new = kept(_verified(written(_across(rooted, held, similarity), "neardup-pairs"), held, similarity), "neardup-links")
            if new.limit(1).count():
                comp = components(written(links.union(new), "neardup-links"))
                rooted = kept(nodes.join(merged(comp), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "neardup-roots")
    keeper = rooted.groupBy("root").agg(F.min("least").alias("keep"))
    rooted = written(rooted.join(merged(keeper, "neardup-kept"), "root").select("node", "keep"), "neardup-keepers")
    return made.select("k", "th", "node").join(merged(rooted), "node").select("k", "th", F.col("keep.k").alias("keep_k"), F.col("keep.th").alias("keep_th"))


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", max_broadcast_rows: int = 500_000) -> DataFrame:
    """docs with one row of each class of near_classes(); all columns stay, whatever their names.

    Empty and null texts are one class. Of rows with equal key and text one stays; an empty table gives an empty result.
    """
    d, key, text, names = own_names(docs, key, text)
    with temporary(docs.sparkSession) as kept:
        c = written(near_classes(d, width, similarity, key, text, max_broadcast_rows), "neardup-classes")
        stays = F.col("k").eqNullSafe(F.col("keep_k")) & (F.col("th") == F.col("keep_th"))
        gone = kept(c.where(~stays).select("k", "th").distinct(), "neardup-gone")
        repeated = c.where(stays).groupBy("k", "th").count().where("count > 1").limit(1).count()
        gone = F.broadcast(gone) if gone.count() <= max_broadcast_rows else merged(gone)
    d = d.withColumn("text_hash", F.xxhash64(text_of(text)))
    d = d.join(gone, (F.col("text_hash") == F.col("th")) & F.col(key).cast("bigint").eqNullSafe(F.col("k")), "left_anti")
    if repeated:
        d = d.dropDuplicates([key, "text_hash"])
    return d.select(*(F.col(c).alias(name) for c, name in zip(names, docs.columns, strict=True)))
