"""Divergence of sources, fill-in-middle and packing."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glyphlake.llm import divergence, fim, packing, rope
from glyphlake.llm.queries import ORACLE, QUERIES

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["op11_divergence", "op12_fim"])
def test_sql(spark, small, duck, name):
    from conftest import same_rows

    got, want = same_rows(QUERIES[name](spark, small), duck, ORACLE[name])
    assert got and got == want


# divergence


def brute_audit(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(la or "", so or "", term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), te or ""))) for _, te, la, so, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())
        p = lambda c, k=kept: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(k)) for t in k}
        q = p(whole)
        for s, c in counts.items():
            ps = p(c)
            pair = [(o, sum(abs(ps[t] - x) for t, x in p(counts[o]).items())) for o in counts if o != s]
            more = [(t, ps[t] - q[t]) for t in kept if c[t] and ps[t] > q[t]]
            for part, items in (("pair", pair), ("term", more)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def test_audit_against_brute_force(spark):
    r = random.Random(3)
    words = ["Alpha", "beta", "βήτα", "naïve", "x", "Y", "İ", "zz top", "日本", "don't", "a1b", "\x00nul", "tie", "eit"]
    rows = [(i, " ".join(r.choices(words, range(1, 15), k=r.randrange(0, 40))), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "Z", "é", None]), 0) for i in range(300)]
    rows += [(0, "alpha alpha tie eit", "fr", "only", 0)] * 3  # repeats, ties, a single source
    rows += [(1, None, "xx", "a", 0), (2, "", "xx", "b", 0), (None, "unkept " * 3, "xx", "c", None)]  # nothing kept
    rows += [(3, "beta " * 5000, "en", "rich", 0), (4, "... 12 !", "en", "none", 0)]
    d = spark.createDataFrame(rows, DOC)
    for least, top in ((2, 3), (30, 50)):
        assert sorted(map(tuple, divergence.audit(d.repartition(5), least, top).collect())) == brute_audit(rows, least, top)


def test_audit_of_clashing_names_and_of_nothing(spark, monkeypatch):
    rows = [(i, "one two" if i % 2 else "two two", "en", "ab"[i % 2], 0) for i in range(8)]
    d = spark.createDataFrame(rows, DOC)
    want = brute_audit(rows, 2, 50)
    clash = d.selectExpr("*", "1 AS term", "2 AS n", "3 AS docs", "4 AS item", "5 AS value", "6 AS rank", "7 AS p", "8 AS z")
    assert sorted(map(tuple, divergence.audit(clash, 2).collect())) == want
    assert divergence.audit(d.limit(0)).count() == 0
    monkeypatch.setattr(divergence, "MOST_GROUPS", -1)  # groups are joined by shuffle
    assert sorted(map(tuple, divergence.audit(d, 2).collect())) == want


def test_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = b"abc de fghijklmnop q  rst " * 50
    assert [t for part in divergence._slices(text) for t in part.split()] == text.split()


# ropes and fill-in-middle


def test_rope_splits_like_a_string():
    r = random.Random(5)
    for unit in (None, r"\w+", "ab|c"):
        for _ in range(200):
            text = "".join(r.choices("ab c<é𝄞\n", k=r.randrange(0, 90)))
            whole = rope.built(text, unit, leaf=r.choice([1, 3, 16]))
            ends = list(range(1, len(text) + 1)) if unit is None else rope.ends_of(text, unit)
            assert (whole.units, whole.chars, rope.text_of(whole)) == (len(ends), len(text), text)
            k = r.randrange(-1, len(ends) + 2)
            a, b = rope.split(whole, k, unit)
            cut = 0 if k <= 0 else ends[min(k, len(ends)) - 1] if ends else 0
            assert (rope.text_of(a), rope.text_of(b)) == (text[:cut], text[cut:])
            assert (a.units + b.units, a.chars, b.chars) == (len(ends), cut, len(text) - cut)
            j = rope.joined(b, a)
            assert rope.text_of(j) == text[cut:] + text[:cut] and j.units == len(ends)
            wanted = text[3:6]
            assert rope.find(whole, wanted) == text.find(wanted)


def test_rope_of_a_long_text_is_shallow():
    whole = rope.built("x" * 1_000_000)
    depth, node = 0, whole
    while node.left is not None:
        depth, node = depth + 1, node.left
    assert depth <= 10
    a, b = rope.split(whole, 123_457)
    assert a.chars == 123_457 and sum(map(len, rope.leaves(rope.joined(b, a)))) == 1_000_000


@pytest.mark.parametrize("unit", [None, r"\w+\W*"])
def test_fill_in_middle_round_trip(spark, unit):
    r = random.Random(7)
    parts = ["<", "P", ">", "<P", "S>", "<<", "M>", "a", " word", "é", "𝄞", "\n"]
    texts = ["".join(r.choices(parts, k=r.randrange(0, 60))) for _ in range(300)] + [None, "", "<P>", "a<M>b", "long " * 50_000, "same", "same"]
    rows = [(i if i % 50 else None, t, "en", "a", 0) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS form", "2 AS n", "3 AS output", "4 AS k", "5 AS t")
    made = fim.transformed(d, unit)
    got = fim.inverted(made).collect()
    assert sorted(x.restored for x in got) == sorted(t or "" for t in texts)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    by_text = {(k, t or ""): None for k, t, *_ in rows}
    for x in got:
        t = x.restored
        assert (x.doc_id, t) in by_text
        n = len(t) if unit is None else len(rope.ends_of(t, unit))
        assert x.n == n
        if x.form == "plain":
            assert x.output == t and x.prefix_chars is None and x.middle_chars is None
            continue
        assert not any(s in t for s in ("<P>", "<S>", "<M>")) and t
        h = hashlib.sha256(f"1:{'' if x.doc_id is None else x.doc_id}".encode()).hexdigest()
        a, b = sorted(int(h[i : i + 8], 16) % (n + 1) for i in (0, 8))
        ends = [0, *(range(1, n + 1) if unit is None else rope.ends_of(t, unit))]
        p, m, s = t[: ends[a]], t[ends[a] : ends[b]], t[ends[b] :]
        assert (x.prefix_chars, x.middle_chars) == (len(p), len(m))
        assert x.output == (f"<P>{p}<S>{s}<M>{m}" if x.form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert fim.inverted(fim.transformed(d.limit(0), unit)).count() == 0


def test_what_is_no_output_is_refused():
    for output, form in (("<P>a<S>b", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c", "spm")):
        with pytest.raises(ValueError):
            fim.restored(output, form)


# packing

ODD = [
    "Hello  World", "a\x1cb\x85c\xa0d e", "é ́x", "<|endoftext|> a<|startoftext|>b", "ΟΔΟΣ ΣΑΣ", "it's we'll 123 4.5",
    "İstanbul ǅ", "日本 語テキスト", "tab\tnew\nline\r\x0b\x0c.", "가 한", "x" * 500 + " " + "y" * 3, "   ", "\x00 \x7f", "👩‍👩‍👧 𝄞", "a​b﻿c",
    "H̱ello ẖ", "<|ENDOFTEXT|> X", "DON'T l''s ''Tis it'SSS", "ŒUVRE Ŀ ǅ ÉÉ× Ø÷ŉ", "Привет ЁЖ Й́", "x=1²³½;y++...!!''--", "a\u00adb µª",
]


def test_ids_are_those_of_whole_texts(small):
    import duckdb

    texts = ODD + [r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{small}/documents.parquet'").fetchall()]
    r = random.Random(2)
    texts += ["".join(r.choices("aBİÉßǄ's't.,1²<|>Жй -_", k=300)) for _ in range(300)]
    texts += ["".join(chr(c) for c in range(k, k + 40)) for k in range(0, 0x500, 40)] + [f"{chr(c)}a {chr(c).lower()}x" for c in range(0x21, 0x530)]
    texts += ["".join(r.choices("aB é́̈가\xa0 'st. 1<|", k=200)) for _ in range(200)]
    t = Tokenizer.from_file(TOKENIZER)
    own = packing.Ids(TOKENIZER)
    for text, ids in zip(texts, own.of([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_remembered_runs_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    own = packing.Ids(TOKENIZER)
    texts = [f"w{i} w{i + 1} {'z' * 200} again" for i in range(50)]
    t = Tokenizer.from_file(TOKENIZER)
    for text, ids in zip(texts, own.of([x.encode() for x in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert len(own.known) <= 12
    assert all(len(r) <= packing.LONGEST_RUN for r in own.known)


def test_cuts():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        c = list(packing.cuts(n))
        assert c[0][0] == 0 and sum(x for _, x in c) == n and all(a + x == b for (a, x), (b, _) in pairwise(c))
        assert all(x & (x - 1) == 0 and x <= 2048 for _, x in c) and [x for _, x in c] == sorted((x for _, x in c), reverse=True)
        assert len(c) == n // 2048 + (n % 2048).bit_count()


def test_packing_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 3)
    r = random.Random(9)
    texts = ODD + [None, ""] + ["lorem ipsum dolor " * r.randrange(1, 9) for _ in range(40)] + ["very long text, " * 4000]
    rows = [(i if i % 7 else None, t, "en", "a", 0) for i, t in enumerate(texts)] + [(5, "same", "en", "a", 0)] * 4
    d = spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS start", "2 AS length", "3 AS bucket", "4 AS number", "5 AS k", "6 AS _h")
    got = packing.packed(d.repartition(4), TOKENIZER, longest=64).collect()
    t = Tokenizer.from_file(TOKENIZER)
    want = []
    for k, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for start, length in packing.cuts(len(ids), 64):
            piece = ids[start : start + length]
            want.append((k, start, length, zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids), tuple(piece)))
    assert sorted(((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens, tuple(x.ids)) for x in got), key=repr) == sorted(want, key=repr)
    assert len({x.sequence_id for x in got}) == len(got) and all(x.offset == 0 and 1 << x.bucket == x.length for x in got)
    for b in {x.bucket for x in got}:
        assert sorted(x.number for x in got if x.bucket == b) == list(range(sum(x.bucket == b for x in got)))
    again = packing.packed(d.repartition(9), TOKENIZER, longest=64, with_ids=False)
    assert sorted((x.sequence_id, x.ids_crc32, str(x.doc_id)) for x in got) == sorted((x.sequence_id, x.ids_crc32, str(x.doc_id)) for x in again.collect())
    assert packing.packed(d.limit(0), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(d, TOKENIZER, longest=1000)


def test_batches_hold_equal_lengths(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, "word " * (i * 5 % 90), "en", "a", 0) for i in range(200)], DOC)
    p = packing.packed(d, TOKENIZER, longest=32, with_ids=False)
    b = p.withColumn("batch", packing.batch_of(F.col("length"), F.col("number"), 128)).groupBy("bucket", "batch").agg(F.sum("length").alias("n"), F.countDistinct("length").alias("k"))
    rows = b.orderBy("bucket", "batch").collect()
    assert all(x.k == 1 and x.n <= 128 for x in rows)
    assert all(a.n == 128 for a, c in pairwise(rows) if a.bucket == c.bucket)
