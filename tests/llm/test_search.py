"""Top-k, WARC, HTML and toxicity."""

import base64
import gzip
import hashlib
import math
import pickle
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import html, topk, toxicity, warc

VEC = "vec_id bigint, embedding array<float>"


# top-k


def brute_top(rows, queries, k, scale=256):
    ok = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(len(v) for _, v in ok)
    ok = [(i, np.array(v + [0] * (dims - len(v)))) for i, v in ok]
    out = set()
    for q, v in ok:
        if q in queries:
            best = sorted(((-int(v @ x), i) for i, x in ok if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("seed,dims", [(1, 64), (2, 3), (3, 1)])
def test_nearest_is_exact(spark, seed, dims):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, 0.15), 0.5, -0.5, 0.0]) for _ in range(dims)]) for i in range(400)]
    rows += [(1000, rows[7][1]), (1001, rows[7][1]), (1002, None), (1003, [None] * dims), (1004, [float("nan")] * dims), (1005, [float("inf")] * dims), (None, rows[0][1]), (1006, [3.5] * dims)]
    if dims > 2:
        rows.append((1007, [1.0, -1.0]))
    d = spark.createDataFrame(rows, VEC)
    got = {tuple(r) for r in topk.nearest(d, F.col("vec_id") % 50 == 0, 5, block_rows=100).collect()}
    assert got == brute_top(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)


def test_nearest_edges(spark):
    assert topk.nearest(spark.createDataFrame([], VEC), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], VEC).withColumn("rank", F.lit(1)).withColumn("g", F.lit(2))
    assert sorted(tuple(r) for r in topk.nearest(few, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]


def test_nearest_of_wide_and_many(spark):
    """Components beyond 64 bits stop, scores too; repeated query keys and several query blocks lose nothing."""
    rows = [(i, [float(i % 7), 1.0]) for i in range(120)] + [(50, [3.0, 3.0]), (200, [1e8, 0.0]), (201, [1e30, -1e30]), (202, [1e30, 1.0]), (203, [-1e30, 0.0])]
    got = topk.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id").isin(0, 50, 100, 201, 200), 3, block_rows=32, query_bytes=150).collect()
    codes = [(i, [max(-topk.MOST, min(topk.MOST, math.floor(256 * x))) for x in v]) for i, v in rows]
    want = []
    for q, v in codes:
        if q in (0, 50, 100, 200, 201):
            dot = [(-max(-topk.MOST_SCORE, min(topk.MOST_SCORE, sum(a * b for a, b in zip(v, x, strict=True)))), i) for i, x in codes if i != q]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(dot)[:3])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_slices_prune(spark):
    rows = np.floor(np.random.default_rng(0).normal(0, 30, (5000, 64))).astype(int)
    b = topk.BitSliced(rows)
    found = b.candidates(rows[0], 6)
    exact = rows @ rows[0]
    assert set(np.flatnonzero(exact >= np.sort(exact)[-6])) <= set(found) and len(found) < 2500


# WARC

PAGE = "page_id bigint, url string, html string"
FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\nevil\r\n\r\n"


def test_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a\r\nX: y", FAKE + "tail" + FAKE), (2, None, None), (3, "u", big), (9, "u", big), (5, "u", big), (6, "u", "short"), (7, "u", "short"), (8, "u", ""), (None, "n", big), (10, "u", "x" * 3_000_000), (11, "u", FAKE * 20_000)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGE).withColumn("digest", F.lit("clash"))).collect()
    assert sorted((str(r.page_id), r.type, str(r.refers_to), r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (str(i), "revisit" if h == big and i != 9 else "response", "9" if h == big and i != 9 else "None", len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows
    )
    assert all(r.body_ok for r in got)
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def record(i, body, version="1.1", more="", http=False):
    kind = "Content-Type: application/http; msgtype=response\r\n" if http else "Content-Type: text/plain\r\n"
    body = body if isinstance(body, bytes) else body.encode()
    return f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\n{kind}{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def archive_rows(spark, path):
    got = warc.read(spark, str(path)).withColumn("f", F.substring_index("file", "/", -1)).collect()
    return {f: sorted((r.offset, r.type, r.id, r.payload_bytes, r.payload_digest, r.body_ok) for r in got if r.f == f) for f in {r.f for r in got}}


def test_chain_ends_at_damage(spark, tmp_path):
    one, two, three = record(1, "one"), record(2, "two"), record(3, "three")
    (tmp_path / "a.warc").write_bytes(one + two + b"garbage\r\n\r\n" + three)
    (tmp_path / "b.warc").write_bytes(b"".join(record(i, "x" * 200_000) for i in range(40)))
    (tmp_path / "c.warc").write_bytes(b"nothing")
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc").write_bytes(one + three[:-10])
    (tmp_path / "f.warc").write_bytes(one + two[:-4])
    (tmp_path / "g.warc").write_bytes(one.replace(b"Length: 3", b"Length: 2") + two)
    got = archive_rows(spark, tmp_path)
    assert [x[2] or x[:2] for x in got["a.warc"]] == ["urn:page:1", "urn:page:2", (len(one + two), warc.BROKEN)]
    assert len(got["b.warc"]) == 40 and all(x[1] == "response" for x in got["b.warc"])
    assert [x[:2] for x in got["c.warc"]] == [(0, warc.BROKEN)] and "d.warc" not in got
    assert [x[:2] for x in got["e.warc"]] == [(0, "response"), (len(one), warc.BROKEN)]
    assert [x[2] for x in got["f.warc"]] == ["urn:page:1", "urn:page:2"]
    assert [x[1] for x in got["g.warc"]][-1] == warc.BROKEN and len(got["g.warc"]) <= 2


def test_versions_digests_and_folded_headers(spark, tmp_path):
    sha = hashlib.sha1(b"body").digest()
    records = [
        record(1, "body", "1.0", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}\r\n"), record(2, "body", "1.1", f"WARC-Payload-Digest:\r\n sha1:{sha.hex()}\r\n"),
        record(3, "body", "1.0", "WARC-Payload-Digest: sha1:" + "0" * 40 + "\r\n"), record(4, b"\xff\x00\r\n\r\n\xfe", "1.0", "X-Long: a\r\n\tb\r\n c\r\n"), record(5, "HTTP/1.1 200 OK\r\n\r\nhello", http=True),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = archive_rows(spark, tmp_path)
    assert got["a.warc"] == got["b.warc.gz"]
    assert [(x[2][-1], x[3], x[5]) for x in got["a.warc"]] == [("1", 4, True), ("2", 4, True), ("3", 4, False), ("4", 7, True), ("5", 5, True)]
    assert got["a.warc"][3][4] == hashlib.sha1(b"\xff\x00\r\n\r\n\xfe").hexdigest()
    members = [gzip.compress(r) for r in records]
    (tmp_path / "b.warc.gz").write_bytes(b"".join([*members[:3], members[3][:30] + b"\0\0\0\0" + members[3][34:], members[4]]))
    with pytest.raises(Exception):
        archive_rows(spark, tmp_path)


def test_archives_in_many_splits(spark, tmp_path):
    """Splits of some kB through records of all lengths, with magic inside payloads that cross the splits."""
    rng = random.Random(8)
    records, want, at = [], [], 0
    for i in range(300):
        fake = record(1000 + i, "evil")
        body = rng.choice([b"", b"x", fake, b"\r\n\r\n" + fake * rng.randint(1, 200), bytes(rng.choices(range(256), k=rng.randint(1, 9000)))])
        r = record(i, body)
        want.append((at, "response", f"urn:page:{i}", len(body), hashlib.sha1(body).hexdigest(), True))
        records.append(r)
        at += len(r)
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001b")
    try:
        assert warc._lines(spark, str(tmp_path / "a.warc")).select("split").distinct().count() > 30
        got = archive_rows(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert got["a.warc"] == want and got["b.warc.gz"] == want


# HTML


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("<article></article>", ""), ("plain text", "plain text"),
        ("<nav><a href=x>m</a></nav><article><h1>T &amp; u</h1><p>a <b>b</b>\n c<p>d</article><footer>f</footer>", "T & u\na b c\nd"),
        ("<body><article><header><h1>T</h1><span>by x</span></header><p>text<aside>no</aside><div class='ad-box'>ad</div><p>more<section class=comments><article class=comment>hi</article></section></article>", "T\ntext\nmore"),
        ("<article><p>a<script>var x='<p>no</p>'</script><style>p{}</style>b<form><input>no</form></article>", "ab"),
        ("<div class=cookie-notice>We use cookies and say so at some length here</div><main><p>short</main>", "short"),
        ("<article><p hidden>x<p style='display: none'>y<p aria-hidden=true>z<p>ok &lt;b&gt; &#233;&nbsp;!</article>", "ok <b> é !"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_region_without_article():
    body = "".join(f"<p>{'long running text of the story ' * 8}{i}</p>" for i in range(4))
    page = f"<header><h1>Site</h1></header><div class=menu><a>x</a></div><div id=story><h2>Head</h2>{body}<p>end</p></div><div class=sidebar>{body}</div><footer>{body}</footer>"
    lines = html.main_text(page).split("\n")
    assert lines[0] == "Head" and lines[-1] == "end" and len(lines) == 6


@pytest.mark.parametrize(
    "page,want",
    [
        ("<div id=page><h1>Head</h1><div class=entry>LONG</div><p>end</p></div><footer>f</footer>", "Head\nLONG\nend"),
        ("<article><h2>A</h2><p>LONG</article><article><p>x</article><div>stray</div>", "A\nLONG\nx"),
        ("<main><div class=card><article><p>teaser</article></div><section><p>LONG<p>LONG</section></main>", "teaser\nLONG\nLONG"),
        ("<article><section class='social-history'><p>LONG</section><p class=commentary>c<div id=search-results>r</div><div class='search-box'>s</div><ul class=shareLinks><li>t</ul><div class='post comment-list'>u</div></article>", "LONG\nc\nr"),
    ],
)
def test_region_by_ratio(page, want):
    long = "long running text of the story " * 12
    assert html.main_text(page.replace("LONG", long)) == want.replace("LONG", long.strip())


@pytest.mark.parametrize("piece", ["<div>text ", "<b>text ", "<p><b><i>text", "<li>text</i> ", "<article><nav>text ", "<span></b>text"])
def test_deep_pages_are_linear(piece):
    times = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        html.main_text(piece * n)
        times.append(time.perf_counter() - began)
    assert times[1] < 30 * times[0] + 0.5


LONG = "word " * 60
INDEX = "".join(f"<li><a href=x><b>Link</b> number {i}</a></li>" for i in range(80))


@pytest.mark.parametrize(("page", "want"), [
    # no article: the deepest element with the content, and the headings before it
    (f"<div><p>Home</p><p>Two</p><p>Three</p></div><div id=content><h1>Title</h1><div class=text><p>{LONG}</p><p>short</p><p>{LONG}</p></div></div>", ["Title", LONG, "short", LONG]),
    # articles that only tease, and the text beside them
    (f"<div class=list><article><h2>T1</h2><p>tease one</p></article><article><h2>T2</h2><p>tease two</p></article></div><div class=text><p>{LONG}</p><p>{LONG}</p><p>end.</p></div>", [LONG, LONG, "end."]),
    (f"<article><h2>Teaser</h2><p>a few words</p></article><div><h1>Big</h1><p>{LONG}</p><p>{LONG}</p></div>", ["Big", LONG, LONG]),
    # an index with more text than the text itself, in many tags
    (f"<div id=index><ul>{INDEX}</ul></div><div><h2>Big</h2><p>{LONG}</p><p>a line of middling length</p><p>{LONG}</p></div>", ["Big", LONG, "a line of middling length", LONG]),
    # several articles hold the content; a section without any is left out
    (f"<div><article><h2>A</h2><p>{LONG}</p></article><section><ul>{INDEX[:420]}</ul></section><article><h2>B</h2><p>{LONG}</p></article></div>", ["A", LONG, "B", LONG]),
    # all alike
    ("<p>one</p><p>two</p>", ["one", "two"]),
])
def test_ratios_choose_the_region(page, want):
    assert html.main_text(f"<html><body>{page}</body></html>").split("\n") == [w.strip() for w in want]


def test_without_the_threshold_another_region_comes_out(monkeypatch):
    page = f"<body><div id=index><ul>{INDEX}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert len(html.main_text(page).split("\n")) == 2
    monkeypatch.setattr(html, "content_of", lambda ratios: [True] * len(ratios))
    assert len(html.main_text(page).split("\n")) == 82


def test_two_clusters():
    assert html.content_of([5, 6, 7, 300, 400]) == [False, False, False, True, True]
    assert html.content_of([50, 60, 70, 80]) == [True] * 4  # not apart
    assert html.content_of([9]) == [True] and html.content_of([9, 9, 9]) == [True] * 3


def test_extraction_equals_a_cut_by_tags(spark, small):
    """On the pages of the tables, whose menus, adverts and footers are known, the text is the article, cut by patterns."""
    import html as entities

    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1|div|li|ul)\b[^>]*>", re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", body[1] if body else "", flags=re.S))
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br ?/?>", " ", x))).split()) for x in blocks]
        want[r.page_id] = "\n".join(x for x in blocks if x)
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == want


def test_extract(spark):
    d = spark.createDataFrame([(1, "u", "<article><p>a</article>", "clash"), (None, None, None, "x")], PAGE + ", text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html.extract(d).collect()) == [("1", "a", 1), ("None", "", 0)]
    assert html.extract(spark.createDataFrame([], PAGE)).count() == 0
    long = "<article>" + "<p>" + "word " * 200_000 + "</article>"
    assert len(html.main_text(long)) == 999_999


# toxicity


@pytest.mark.parametrize("dense", [0.0, 0.2, 1.0])
def test_block_max_is_exact(dense):
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, rng.integers(1, 7), replace=False))
        w = rng.random(len(t)) * rng.choice([0.01, 1.0], len(t))
        vectors.append((t, w / np.sqrt(w @ w)))
    vectors += vectors[:50]
    full = np.zeros((len(vectors), 40))
    for i, (t, w) in enumerate(vectors):
        full[i, t] = w
    index = toxicity.BlockMax(vectors, 40, 32, dense)
    asked = [*vectors[:120], (np.zeros(0, np.int64), np.zeros(0))]
    for q, (at, score) in enumerate(index.nearest(asked, 15)):
        every = np.round(full @ full[q], 12) if q < 120 else np.zeros(len(full))
        want = sorted(np.flatnonzero(every > 0), key=lambda i: (-every[i], i))[:15]
        assert np.allclose(score, every[want]) and (list(at) == want or np.allclose(every[at], every[want]))


def test_vocabulary_looks_words_up_without_remembering_them():
    rng = random.Random(4)
    letters = "abé\ud800\ufffdß"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(80)]

    def plain(text):
        out = {}
        for w in text.split():
            w = w.encode("utf-8", "surrogatepass").decode("utf-8", "replace")
            for t in (w, *(w[:n] + "*" for n in (4, 6) if len(w) > n)):
                out[t] = out.get(t, 0) + 1
        return out

    vocabulary = toxicity.Vocabulary({}, grow=True)
    for t in texts[:30]:
        terms, tf = vocabulary.counts(t)
        names = list(vocabulary.number)
        assert {names[i]: n for i, n in zip(terms, tf)} == plain(t) and list(terms) == sorted(terms)
    vocabulary = pickle.loads(pickle.dumps(vocabulary))
    names, state = list(vocabulary.number), pickle.dumps(vars(vocabulary))
    for t in texts:
        terms, tf = vocabulary.counts(t)
        want = {x: n for x, n in plain(t).items() if x in vocabulary.number}
        assert {names[i]: n for i, n in zip(terms, tf)} == want and list(terms) == sorted(terms)
        assert {names[i] for i in vocabulary.present(t)} == set(want)
    assert pickle.dumps(vars(vocabulary)) == state


def toxic_rows(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 7 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                t.insert(rng.randrange(len(t)), rng.choice(["foulone", "nastytwo", "vilethree"]) + rng.choice(["", "er", ","]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    return rows, labels


def test_scores_held_out(spark):
    rows, labels = toxic_rows(1500, 1)
    more = [(None, "foulone"), (9000, None), (9001, ""), (9002, "w1 foulone " * 20_000), (0, rows[0][1])]
    d = spark.createDataFrame(rows + more, "doc_id bigint, text string").withColumn("held_out", F.lit(3)).withColumn("terms", F.lit("x"))
    got = toxicity.score_all(d, spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id bigint, toxic int")).collect()
    assert len(got) == len(rows) + len(more)
    y = dict(labels)
    test = [(r.score >= 0.7, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    assert sum(p == bool(t) for p, t in test) / len(test) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    other = {r.doc_id: r for r in got}
    assert other[None].score > 0.7 and other[9002].score > 0.7 and other[9000].score == other[9001].score < 0.3
    assert other[9002].neighbours[0].label == 1


def test_scores_against_brute_force(spark):
    """Weights, cosines, votes and calibration by plain dictionaries over all words and prefixes."""
    rows, labels = toxic_rows(300, 2)
    rows += [(5, "another text of a repeated key foulone"), (1000, "no such words anywhere"), (1001, None)]
    got = sorted(map(tuple, toxicity.score_all(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()), key=str)
    again = sorted(map(tuple, toxicity.score_all(spark.createDataFrame(rows[::-1], "doc_id bigint, text string").repartition(5), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()), key=str)
    assert [(g[0], g[1], round(g[2], 9)) for g in got] == [(g[0], g[1], round(g[2], 9)) for g in again]

    def counted(text):
        out = {}
        for w in re.findall(r"\w+", (text or "").lower()):
            for t in {w, *(w[:n] + "*" for n in (4, 6) if len(w) > n)}:
                out[t] = out.get(t, 0) + 1
        return out

    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    texts, sizes = toxicity._examples(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), 10**6, 10**9, "doc_id", "toxic")
    train = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted((k, y) for k, _, y in texts) == sorted(train) and sizes == {y: sum(b == y for _, b in train) for y in (0, 1)}
    vectors = [(k, y, counted(t)) for k, t, y in texts]
    kept, aside = [v for n, v in enumerate(vectors) if n % 5], [v for n, v in enumerate(vectors) if n % 5 == 0]
    vocabulary = {t for v in vectors for t in v[2]}
    df = {t: 0 for t in vocabulary}
    for _, t in rows:
        for x in counted(t).keys() & vocabulary:
            df[x] += 1
    n = [sum(v[1] == y for v in kept) for y in (0, 1)]
    weight = {}
    for t in vocabulary:
        c = [sum(t in v[2] for v in kept if v[1] == y) + 0.5 for y in (0, 1)]
        r = [n[y] - c[y] + 1 for y in (0, 1)]
        odds, error = math.log(c[1] / r[1]) - math.log(c[0] / r[0]), math.sqrt(sum(1 / x for x in c + r))
        weight[t] = (math.log((1 + len(rows)) / (1 + df[t])) + 1) * (0.4 + max(0.0, abs(odds) - 1.5 * error))

    def unit(v):
        w = {t: (1 + math.log(k)) * weight[t] for t, k in v.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / norm for t, x in w.items()}

    examples = [(k, y, unit(v)) for k, y, v in kept]
    each = {0: sizes[0] / sum(y == 0 for _, _, y in texts), 1: sizes[1] / sum(y for _, _, y in texts)}
    prior = (sizes[1] + 0.5) / (sum(sizes.values()) + 1)

    def logit(v):
        u = unit(v)
        near = sorted(((sum(x * e.get(t, 0.0) for t, x in u.items()), y) for _, y, e in examples), reverse=True)
        near = [x for x in near if x[0] > 1e-12]
        tied = len(near) > 15 and near[14][0] - near[15][0] < 1e-9 and near[14][1] != near[15][1]
        w = [(c * each[y] / each[1], y) for c, y in near[:15]]
        p = (sum(c for c, y in w if y) + 0.1 * prior) / (sum(c for c, _ in w) + 0.1)
        return math.log(p / (1 - p)), tied

    a, b = toxicity._platt(np.array([logit(v)[0] for _, _, v in aside]), np.array([float(y) for _, y, _ in aside]), np.array([each[y] / each[1] for _, y, _ in aside]))
    want = sorted(((i, a + b * x, tied) for i, (x, tied) in ((i, logit(counted(t))) for i, t in rows)), key=str)
    scored = sorted(((k, math.log(s / (1 - s))) for k, _, s, _ in got), key=str)
    ok = sum(k == i and abs(x - y) < 1e-6 for (k, x), (i, y, _) in zip(scored, want, strict=True))
    assert ok >= len(rows) - sum(t for _, _, t in want) and ok > 0.95 * len(rows)


def test_scores_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    assert {r.score for r in toxicity.score_all(d, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()} == {0.5}
    assert toxicity.score_all(spark.createDataFrame([], d.schema), spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")).count() == 0
