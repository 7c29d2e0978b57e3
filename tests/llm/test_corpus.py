"""SimHash, near duplicates, decontamination, quality and the pipeline."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from glyphlake.llm import common, components, decontaminate, neardup, quality, secrets, simhash

TEXT = "doc_id bigint, text string"


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_classes(pairs, n):
    of = list(range(n))
    for a, b in pairs:
        x, y = of[a], of[b]
        if x != y:
            of = [min(x, y) if c in (x, y) else c for c in of]
    return of


def test_fingerprints(spark):
    texts = [None, "", " \t\n", "one", "One TWO", "É a b", "a b c d", "x " * 60_000, *(" ".join(random.Random(i).choices("abcdefgh", k=i)) for i in range(40))]
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), TEXT).withColumn("fp", F.lit(1))).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("bucket", [2, 48])
def test_links_join_all_within_two_bits(spark, bucket):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(60)}
    v = sorted(x - 2**64 if x >> 63 else x for x in values)
    fps = spark.createDataFrame([(x,) for x in v + v[:5]], "fp bigint")
    pairs = simhash.links(fps, bucket=bucket).collect()
    distance = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(distance(p.u, p.v) <= 2 for p in pairs)
    at = {x: i for i, x in enumerate(v)}
    want = brute_classes([(i, j) for i in range(len(v)) for j in range(i) if distance(v[i], v[j]) <= 2], len(v))
    assert brute_classes([(at[p.u], at[p.v]) for p in pairs], len(v)) == want
    with pytest.raises(ValueError):
        simhash.links(fps, 3)


def test_ring_filter_loses_nothing(spark):
    rng = random.Random(2)
    for distance, segments in ((2, 8), (24, 8), (5, 4)):
        d = [sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance + 3))) for _ in range(150)]
        rows = spark.createDataFrame([(x - 2**64 if x >> 63 else x, x.bit_count()) for x in d], "d bigint, n int")
        assert rows.where(simhash.ring_near(F.col("d"), distance, segments) != (F.col("n") <= distance)).count() == 0


def test_simhash_classes(spark):
    base = " ".join(random.Random(1).choices([f"w{i}" for i in range(500)], k=400))
    rows = [(5, base), (2, base), (9, base.upper().replace(" ", "\n")), (7, None), (8, ""), (1, "another text"), (None, base), (None, "alone here")]
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicate_classes(spark.createDataFrame(rows, TEXT)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(5, 2), (2, 2), (9, 2), (7, 7), (8, 7), (1, 1), (None, 2), (None, None)]))
    assert simhash.near_duplicate_classes(spark.createDataFrame([], TEXT)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    e = [(i, i + 1) for i in range(0, 120)] + [(200, j) for j in range(201, 260)] + [tuple(rng.sample(range(300, 500), 2)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(e, "u bigint, v bigint")).collect()}
    want = brute_classes(e, 500)
    assert got == {i: want[i] for i in {x for p in e for x in p}}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def edited(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] += rng.choice("xyz") + str(rng.randrange(10**6))
    return out


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET", 8)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for g in range(25):
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        texts += [" ".join(edited(base, k, rng)) for k in (0, 0, 1, 2, 3)[: 1 + g % 5]]
    hot = rng.choices(vocabulary, k=300)
    texts += [" ".join(edited(hot, rng.randint(0, 4), rng)) for _ in range(60)]
    texts += [" ".join(hot[:60] + rng.choices(vocabulary, k=200)) for _ in range(30)]
    texts += ["", "", "two words", "two words", "x " * 30_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, texts[0]), (501, texts[0]), (None, "nobody else says this at all here")]
    d = spark.createDataFrame([(*r, "keep") for r in rows], TEXT + ", node string")
    kept = neardup.deduplicated(d).collect()
    assert kept and set(d.columns) == set(kept[0].asDict())
    links = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] and texts[j] and jaccard(texts[i], texts[j]) >= 0.8 or not texts[i] and not texts[j]]
    want = brute_classes(links, len(texts))
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want))
    assert sum(r.doc_id is None for r in kept) == 1
    assert neardup.deduplicated(spark.createDataFrame([], TEXT)).count() == 0


def test_near_duplicates_on_one_template(spark):
    """Pairs at 0.81 among hundreds of texts that are all similar at 0.75."""
    rng = random.Random(9)
    texts = []
    for _ in range(150):
        shared, *own = [rng.sample(range(200), k) for k in (9, 6, 6)]
        new = {i: rng.randrange(10**9) for i in shared}
        for places in own:  # words at 5 i + 2 break other shingles each
            mine = {i: rng.randrange(10**9) for i in places} | new
            texts.append(" ".join(f"x{mine[j // 5]}" if j % 5 == 2 and j // 5 in mine else f"w{j}" for j in range(1000)))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 1.8 * len(sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j]))]
    want = brute_classes(links, len(texts))
    assert 100 < len(set(want)) < 300
    kept = neardup.deduplicated(spark.createDataFrame(list(enumerate(texts)), TEXT)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_near_duplicates_by_fingerprints_alone(spark, small, monkeypatch):
    """The stage finds all links of the pigeonring search where no two texts share a band, in large buckets too."""
    import corpus_pipeline as cp

    sketches = neardup._sketches
    monkeypatch.setattr(neardup, "_sketches", lambda *a: sketches(*a).withColumn("keys", F.array(F.xxhash64("node"))))
    monkeypatch.setattr(neardup, "BUCKET", 8)
    rng = random.Random(14)
    texts = []
    for n in (2, 3, 3, 4, 6, 40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        texts += [" ".join(edited(base, k % 4, rng)) for k in range(n)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(10)]
    fps = [neardup.sketch(t.encode(), 5)[1] for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    least, most = (brute_classes(links, len(texts)) for links in (set(near) & set(alike), alike))
    assert len(set(least)) < len(texts) - 10
    kept = {r.doc_id for r in cp.dedup_stage(spark, spark.createDataFrame(list(enumerate(texts)), TEXT), small).collect()}
    assert set(most) <= kept <= set(least)


def test_repeated_row_stays_once(spark):
    d = spark.createDataFrame([(1, "same row here"), (1, "same row here"), (None, "z"), (None, "z"), (2, "other")], TEXT)
    assert sorted(str(r.doc_id) for r in neardup.deduplicated(d).collect()) == ["1", "2", "None"]


def brute_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 14))] for _ in range(2))
        score, start, stop = decontaminate.align(np.array(a), np.array(b))
        assert score == brute_alignment(a, b) == brute_alignment(a, b[start:stop])


@pytest.mark.parametrize("most", [0, 10**6])
def test_contaminated(spark, most):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(800)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 50)))) for i in range(12)]
    texts, want = [], set()
    for i in range(200):
        t = rng.choices(vocabulary, k=rng.randint(0, 400))
        if i % 4 == 0:
            k, w = items[i % 12]
            w = w.split()
            w = edited(w, len(w) * (i % 3) // 20, rng)
            if i % 8 == 0:
                del w[len(w) // 2]
            p = rng.randint(0, len(t))
            t[p:p] = [w[0].upper() + ",", *w[1:]]
            want.add((i, k))
        texts.append((i, " ".join(t)))
    texts += [(300, None), (301, ""), (None, items[0][1]), (302, "w1 " * 40_000 + items[1][1]), (303, items[2][1] + " . " + items[3][1])]
    texts += [(304, "W1, w2!"), (305, "w1 w2 w3"), (306, "alone")]
    want |= {(None, 0), (302, 1), (303, 2), (303, 3), (304, 52), (306, 53)}
    d = spark.createDataFrame(texts, TEXT).withColumn("score", F.lit("clash"))
    b = spark.createDataFrame([*items, items[4], (50, None), (51, ""), (52, "w1 w2"), (53, "alone"), (54, "!"), (None, "w1 w2 w3 w4 w5")], "item_id bigint, text string")
    got = decontaminate.contaminated(d, b, max_broadcast_rows=most).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(decontaminate.THRESHOLD <= r.score <= 1 for r in got)
    assert decontaminate.contaminated(spark.createDataFrame([], TEXT), b).count() == 0
    assert decontaminate.contaminated(d, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_contaminated_by_edited_copies_beside_exact_ones(spark):
    """Copies that keep few or none of the rarest passages are found beside many exact copies."""
    rng = random.Random(8)
    items = [(n, [f"v{rng.randrange(10**6)}" for _ in range(n)]) for n in (3, 5, 15, 24, 40, 60)]
    texts, want = [], set()
    for n, w in items:
        sixth = [f"new{i}" if i % 6 == 5 else x for i, x in enumerate(w)]
        second = [y for i, x in enumerate(w) for y in ([x, f"more{i}"] if i % 2 and i < n - 1 else [x])]
        for copy in [w] * 6 + [sixth, second]:
            around = [[f"a{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))] for _ in range(2)]
            texts.append((len(texts), around[0] + copy + around[1]))
            if brute_alignment(w, copy) >= decontaminate.THRESHOLD * 2 * n:
                want.add((len(texts) - 1, n))
    assert len(want) == 8 * len(items)
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], TEXT)
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    got = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    by = dict(items)
    assert all(abs(r.score - brute_alignment(by[r.item_id], texts[r.doc_id][1]) / (2 * r.item_id)) < 1e-9 for r in got)


def test_contaminated_against_alignment_of_every_pair(spark):
    """Copies with words replaced, inserted, left out and moved, among texts of the items' words."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, rng.choices(vocabulary, k=rng.randint(3, 25))) for i in range(14)]
    texts = []
    for i in range(110):
        copy = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, max(1, len(copy) // 3))):
            p = rng.randrange(len(copy))
            kind = rng.randrange(4)
            if kind == 0:
                copy[p] = rng.choice(vocabulary)
            elif kind == 1:
                copy.insert(p, rng.choice(vocabulary))
            elif len(copy) > 2:
                w = copy.pop(p)
                if kind == 2:
                    copy.insert(rng.randrange(len(copy)), w)
        around = [rng.choices(vocabulary, k=rng.randint(0, 30)) for _ in range(2)]
        texts.append((i, around[0] + copy + around[1]))
    want = {(i, k): brute_alignment(w, t) / (2 * len(w)) for i, t in texts for k, w in items}
    want = {pair: score for pair, score in want.items() if score >= decontaminate.THRESHOLD}
    got = decontaminate.contaminated(
        spark.createDataFrame([(i, " ".join(t)) for i, t in texts], TEXT), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string")
    ).collect()
    assert 60 < len(want) and {(r.doc_id, r.item_id) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.score - want[r.doc_id, r.item_id]) < 1e-9 for r in got)


def test_quality(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        t = [f"word{rng.randrange(300)}" for _ in range(rng.randint(20, 120))]
        bad = i % 6 == 0
        if bad:
            t = [w.upper() + "!!" for w in t] if i % 12 else [x for w in t for x in (w, "|")]
        rows.append((i, " ".join(t), "en", "hot" if i % 3 else f"s{i % 40}", 0))
        if i % 2 == 0:
            labels.append((i, int(not bad)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "hot", 0), (None, "good words are here to stay", "en", "hot", 1), (2002, "w " * 100_000, "en", "hot", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("score", F.lit(1)).withColumn("path", F.lit(1))
    got = quality.judge(d, spark.createDataFrame(labels + [(1, None), (None, 0)], "doc_id bigint, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 2]
    assert all(r.keep == bool(r.doc_id % 6) for r in unseen)
    none = quality.judge(d, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert all(r.keep and abs(r.evidence - 0.5) < 1e-9 for r in none)
    assert quality.judge(spark.createDataFrame([], d.schema), spark.createDataFrame(labels, "doc_id bigint, quality int")).count() == 0


def test_small_sites_shrink(spark):
    sites = [("a", "a/1", 0.9)] * 400 + [("b", "b/1", 0.2)] * 400 + [("c", "c/1", 0.2)]
    d = spark.createDataFrame(sites, "host string, path string, p double")
    h = d.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    k = quality._strength(h, F.lit(0.55))
    assert 1.0 <= k < 50
    rate = {r.host: (r.s + k * 0.55) / (r.n + k) for r in h.collect()}
    assert abs(rate["b"] - 0.2) < 0.02 < abs(rate["c"] - 0.2)


def test_pipeline(spark, small):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, small), "test")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert docs.where(F.col("text").rlike(r"AKIA[A-Z0-9]{12,}")).count() == 0
    labels = spark.read.parquet(f"{small}/labels.parquet")
    first = cp.quality_stage(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    good = labels.where("quality = 1").select("doc_id").distinct()
    assert good.join(first, "doc_id", "left_anti").count() == 0
    assert cp.run(spark, small).count() == counts[-1]
    assert [n for n, _ in cp.STAGES][0] == "quality classifier" and len(cp.STAGES) == 5


CLASHES = (
    "_k", "_th", "_gone", "_row", "_digest", "_spans", "_clean", "_text_hash", "_text", "_path", "k", "th", "row", "h", "t", "m", "p", "s", "n", "node", "fp", "root", "keep", "digest", "spans",
    "rank", "cell", "size", "target", "taken", "block", "text_hash", "_column_0", "_column_1", "path", "host", "score", "evidence", "at", "key", "held_out",
)


def test_stages_with_odd_rows_and_clashing_columns(spark, small):
    """Every stage, on nulls in all columns, empty and repeated rows and columns of the names that operators use; and on no rows."""
    import corpus_pipeline as cp

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = " ".join(f"plain{i}" for i in range(60))
    rows = [(None,) * 5, (None,) * 5, (1, None, "en", "a", 0), (2, "", None, None, None), (3, text, "en", "a", 400), (3, text, "en", "a", 400), (4, text + " and one more", "en", None, 410)]
    rows += [(5, "password=" + "x" * 20 + " " + " ".join(f"other{i}" for i in range(30)), "en", "a", 200), (None, "w " * 30_000, "en", "b", 60_000), (3, "the same id with another text", "en", "a", 29)]
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit(c) for c in CLASHES})
    for table in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, table, small)
            got = out.collect()
            if name == "mixing sources":
                assert len(got) == table.count()
                continue
            assert out.columns == docs.columns
            assert all(r[c] == c for r in got for c in CLASHES)
            texts = sorted((str(r.doc_id), (r.text or "")[:30]) for r in got)
            if table is not docs:
                assert not got
            elif name == "simhash near-dedup":
                assert len(texts) == 5 and sum(i == "3" for i, _ in texts) == 2
            elif name == "secret scans":
                assert len(got) == len(rows) and any((r.text or "").startswith("[REDACTED] other0") for r in got)
            elif name == "benchmark decontamination":
                assert len(got) == len(rows)


def test_quality_posteriors_against_brute_force(spark):
    """Rates of hosts and paths, their strengths and the posteriors, from the evidence, by plain sums; input order does not matter."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(500):
        t = [f"word{rng.randrange(200)}" for _ in range(rng.randint(5, 60))]
        bad = rng.random() < (0.5 if i % 9 == 0 else 0.1)
        rows.append((i, " ".join(w.upper() + "!!" if bad and rng.random() < 0.7 else w for w in t), rng.choice(["en", "fr", None]), f"s{i % 9}" if i % 3 else None))
        if i % 2:
            labels.append((i, int(not bad)))
    rows += [(1, "another text of id one!! !!", "en", "s1"), (3, "THIRD!! OF!! ITS!! ID!!", "en", "s3")]
    schema = "doc_id bigint, text string, lang string, source string"
    got, again = (sorted(quality.judge(spark.createDataFrame(r, schema).repartition(n), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect(), key=str) for r, n in ((rows, 1), (rows[::-1], 5)))
    assert [(r.doc_id, r.keep, round(r.score, 6)) for r in got] == [(r.doc_id, r.keep, round(r.score, 6)) for r in again]
    p = {(r.doc_id, r.th): r.evidence for r in got}
    site = {}
    hashed = spark.createDataFrame(rows, schema).select("doc_id", F.xxhash64("text").alias("th"), "lang", "source").collect()
    for r in hashed:
        site[r.doc_id, r.th] = (r.source, "/".join(x for x in (r.source, r.lang or "") if x is not None))
    groups = lambda of: {g: [p[x] for x in p if of(site[x]) == g] for g in {of(site[x]) for x in p}}
    hosts, paths = groups(lambda s: s[0]), groups(lambda s: s)
    rate = sum(p.values()) / len(p)

    def strength(sites, center):
        n, inside = sum(map(len, sites.values())), sum(sum((x - np.mean(v)) ** 2 for x in v) for v in sites.values())
        inside = max(inside / (n - len(sites)), 1e-9)
        spread = sum(len(v) * (np.mean(v) - center(g)) ** 2 for g, v in sites.items()) - (len(sites) - 1) * inside
        spread /= max(n - sum(len(v) ** 2 for v in sites.values()) / n, 1e-9)
        return min(max(inside / spread, 1.0), 1e6) if spread > 0 else 1e6

    k = strength(hosts, lambda g: rate)
    host_rate = {g: (sum(v) + k * rate) / (len(v) + k) for g, v in hosts.items()}
    k = strength(paths, lambda g: np.mean(hosts[g[0]]))
    logit = lambda x: np.log(np.clip(x, 1e-6, 1 - 1e-6) / (1 - np.clip(x, 1e-6, 1 - 1e-6)))
    for r in got:
        v = paths[site[r.doc_id, r.th]]
        path_rate = (sum(v) - r.evidence + k * host_rate[site[r.doc_id, r.th][0]]) / (len(v) - 1 + k)
        score = 1 / (1 + np.exp(-(logit(r.evidence) + logit(path_rate) - logit(rate))))
        assert abs(r.path_rate - path_rate) < 1e-6 and abs(r.score - score) < 1e-6 and r.keep == (r.score >= 0.5)


def test_batches_of_bounded_bytes(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("t"))
    with common.small_batches(spark):
        got = long.mapInArrow(sizes, "n bigint, size bigint").agg(F.sum("n"), F.max("size")).first()
    assert got[0] == 3000 and got[1] < 2 * common.BATCH_BYTES
    assert spark.conf.get(setting, None) is None
    for given in (None, "5000000"):  # what the session had is put back, after an error too
        if given:
            spark.conf.set(setting, given)
        with pytest.raises(ZeroDivisionError), common.small_batches(spark, 1 << 10):
            assert spark.conf.get(setting) == "1024"
            _ = 1 // 0
        assert spark.conf.get(setting, None) == given
        spark.conf.unset(setting)


@pytest.mark.parametrize("stage", [0, 1, 2])
def test_all_python_jobs_of_a_stage_have_small_batches(spark, small, monkeypatch, stage):
    seen = []
    for module in (corpus_pipeline, quality, neardup, decontaminate):
        def noted(df, tag, write=common.written):
            seen.append((tag, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)))
            return write(df, tag)

        monkeypatch.setattr(module, "written", noted)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, small)
    assert seen and all(most and int(most) <= 1 << 20 for _, most in seen)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # nothing is left to run later


def test_empty_ledger_needs_no_python_workers(spark, tmp_path):
    none = secrets._ledger(spark, f"file://{tmp_path}/none")
    assert none.count() == 0 and none.dtypes == [("digest", "string"), ("rule", "string"), ("spans", secrets.SPAN)]
    assert "ExistingRDD" not in none._jdf.queryExecution().executedPlan().toString()


def test_no_side_is_broadcast_by_a_guess_of_its_size(spark, monkeypatch):
    # Spark took a side of 203 MB for less than 10 MB and collected it in the driver
    import random

    from glyphlake.llm import common, components, neardup, simhash

    plans, real = [], common.written

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, tag)

    for module in (common, components, neardup, simhash):
        monkeypatch.setattr(module, "written", seen)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(80)]
    near = [" ".join([*base, f"end{k}"]) for k in range(40)]  # a bucket of more than BUCKET texts
    rows = [(k, t) for k, t in enumerate([*near, near[0], *(" ".join(f"x{r.randrange(10**6)}" for _ in range(40)) for _ in range(8))])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = neardup.near_classes(docs, max_broadcast_rows=0)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    joins = [line for p in plans for line in p.splitlines() if " Join " in f" {line.replace('+-', ' ').replace(':-', ' ')} "]
    # a table that was counted may be broadcast: here only one without rows
    assert len(joins) > 15 and [line for line in joins if "strategy=" not in line] == []
    assert {(x.k, x.keep_k) for x in found.collect()} == {(k, 0 if k <= 40 else k) for k, _ in rows}


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if "/shuffle_" in f}


def test_disk_of_near_dedup_is_freed_as_it_goes(spark, monkeypatch):
    # on check_h, 211 partitions, shuffles and tables of all steps together took more disk than the budget
    import os
    import time

    tables, real = [], common.new_path

    def new_path(s, tag):
        tables.append(real(s, tag))
        return tables[-1]

    monkeypatch.setattr(common, "new_path", new_path)
    monkeypatch.setattr(neardup, "BUCKET", 8)
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(80)]
    near = [" ".join([*base, f"end{k}"]) for k in range(30)]
    docs = spark.createDataFrame([*enumerate([*near, near[0]]), (31, "other words"), (31, "other words"), (None, None)], TEXT)
    before, setting = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    out = neardup.deduplicated(docs)
    there = [t for t in tables if os.path.isdir(t.removeprefix("file://"))]
    assert len(tables) > 15 and len(there) == 1 and "neardup-gone" in there[0]
    for _ in range(50):  # files go in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    assert sorted(str(x.doc_id) for x in out.collect()) == ["0", "31", "None"]


def test_tables_of_an_inner_block_belong_to_the_outer_one(spark):
    with common.temporary(spark) as kept:
        with common.temporary(spark) as inner:
            one, two = inner(spark.range(3), "a"), common.written(spark.range(3), "b")
            last = kept(spark.range(4), "c")
        assert one.count() == 3
        with pytest.raises(Exception, match="PATH_NOT_FOUND|FileNotFound|does not exist|FILE_NOT_EXIST"):
            two.count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FileNotFound|does not exist|FILE_NOT_EXIST"):
        one.count()
    assert last.count() == 4


@pytest.mark.parametrize("few", [0, 1000])
def test_components_by_broadcast_and_by_merge(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    r = random.Random(few)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(300, 340)]
    of = brute_classes(pairs, 341)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert got == {a: of[a] for a in {x for p in pairs if p[0] != p[1] for x in p}}
