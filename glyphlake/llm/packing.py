"""Packing without padding: documents are cut into pieces whose lengths are powers of two.

A document of n tokens gives n // longest pieces of the longest length and one for each further binary digit of n, the
long ones first. Each piece is a sequence of its own, so none holds parts of two documents, and sequences of equal length
make up a bucket, numbered in a shuffled order, from which batches are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphlake.llm.common import small_batches, text_of, written

#: Tokens of the longest sequence, a power of two.
LONGEST = 2048
#: The id that ends a document.
END = 1
#: Runs without white space whose ids a task remembers, twice so many at most, and the bytes of the longest of them.
REMEMBERED, LONGEST_RUN = 300_000, 128
#: Rows of a cell of a bucket, at least; cells of a bucket of n rows hold the square root of n if that is more.
CELL = 20_000
#: Characters that normalisation only turns to lower case, one by one, whatever stands beside them.
_PLAIN = regex.compile(r"[!-~\u00c0-\u024f\u0400-\u045f]+")
#: Fixed values of the tokenizer: the pattern of its words, and how it writes each byte of one as a character: printable ones
#: of Latin-1 as themselves, the others, in order, from U+0100 on.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_PIECE = "k bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Ids:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    The tokenizer's words never hold white space, and its normalisation composes nothing across it, so a text's ids are
    those of its runs between ASCII white space, one after the other. Runs recur, so most are looked up. A new run of
    plain characters is cut into words here, by the tokenizer's own pattern, and only its words go to the tokenizer's
    model; any other run goes through the whole tokenizer.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.model = self.tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        for text in texts:
            # where nothing composes with an ASCII letter and no special token may begin, its case does not matter
            if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
                text = text.lower()
            runs = text.split()
            if len(self.known) > REMEMBERED:
                self.known, self.before = {}, self.known
            known, before = self.known, self.before
            new = set(runs).difference(known)
            for run in new:
                ids = before.get(run)
                known[run] = self._of(run) if ids is None else ids
            yield b"".join(map(known.__getitem__, runs))
            if new and max(map(len, new)) > LONGEST_RUN:
                for run in new:
                    if len(run) > LONGEST_RUN:
                        del known[run]

    def _of(self, run: bytes) -> bytes:
        if run.isalpha():  # of ASCII letters
            return self._word(run.decode().lower())
        text = run.decode()
        if not (text.isascii() and text.isprintable() or _PLAIN.fullmatch(text)) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        text = text.lower()
        if text.isalpha():
            return self._word(text)
        words = (text[:-1], text[-1]) if text[:-1].isalpha() and text[-1] in ".,;:!?" else _WORDS.findall(text)
        if len(words) == 1:
            return self._word(text)
        out, known = [], self.known
        for word in words:
            key = word.encode()
            ids = known.get(key)
            if ids is None:
                ids = self.before.get(key) or self._word(word)
                if len(key) <= LONGEST_RUN:
                    known[key] = ids
            out.append(ids)
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(word)])


def cuts(n: int, longest: int = LONGEST) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    at = 0
    while at < n:
        length = min(longest, 1 << ((n - at).bit_length() - 1))
        yield at, length
        at += length


def pieces(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end: int = END, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens[, ids]): the pieces of every row of docs.

    A document is the ids of its whole text, without special ones, and then `end`. ids_crc32: CRC of the piece's ids as
    little-endian unsigned 32-bit numbers; doc_tokens: the document's ids with the last. A null or empty text is that id
    alone; null keys stay; rows that repeat give their pieces each; an empty table gives none; other columns, whatever
    their names, are left out.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(tokenizer)
        for batch in batches:
            rows, held = [], []
            for k, data in zip(batch.column("k").to_pylist(), ids.of(batch.column("t").to_pylist()), strict=True):
                data += last
                n = len(data) // 4
                for start, length in cuts(n, longest):
                    piece = data[4 * start : 4 * (start + length)]
                    rows.append((k, start, length, zlib.crc32(piece), n))
                    if with_ids:
                        held.append(piece)
            arrays = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 5)]
            names = ["k", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                ends = pa.array(np.concatenate([[0], np.cumsum([len(p) // 4 for p in held])]).astype(np.int32))
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(held), "<u4").astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.encode(text_of(text), "UTF-8").alias("t"))
    return rows.mapInArrow(run, _PIECE + ", ids array<int>" * with_ids).withColumnRenamed("k", key)


def packed(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end: int = END, seed: int = 42, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """pieces() with bucket, number, sequence_id and offset. tokenizer: the path of its file on every worker.

    bucket: the binary logarithm of the length; number: the place, from 0, in a shuffled order of the bucket that depends
    on seed and rows only; sequence_id: unique over all buckets; offset: always 0, as a sequence is one piece. Equal rows
    get different numbers. No sequence is padded, as each is as long as a power of two.

    A bucket may hold most rows: it is numbered in cells of a hash, whose sizes give each cell its first number.
    """
    spark = docs.sparkSession
    bucket = F.round(F.log2("length")).cast("int")
    cut = pieces(docs, tokenizer, longest, end, key, text, with_ids).withColumn("bucket", bucket)
    hashed = F.xxhash64(F.lit(seed), key, "start", "length", "ids_crc32", "doc_tokens")
    with small_batches(spark):
        cut = written(cut.withColumn("_h", hashed), "packing-pieces")
    sizes = cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = sizes.select("bucket", F.ceil(F.col("_rows") / F.greatest(F.lit(float(CELL)), F.sqrt("_rows"))).cast("bigint").alias("_cells"))
    cut = cut.join(F.broadcast(sizes), "bucket").withColumn("_cell", F.pmod("_h", "_cells")).drop("_cells")  # a row for each bucket: at most 64
    counts = cut.groupBy("bucket", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("bucket").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("bucket", "_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("bucket", "_cell").orderBy("_h", key, "start", "length", "ids_crc32", "doc_tokens")) - 1
    numbered = cut.withColumn("_inside", inside).join(counts, ["bucket", "_cell"])
    numbered = numbered.withColumn("number", F.col("_before") + F.col("_inside"))
    ids = ["ids"] * with_ids
    return numbered.select(
        key, "start", "length", "ids_crc32", "doc_tokens", *ids, "bucket", "number",
        (F.col("number") * 64 + F.col("bucket")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
    )


def batch_of(length: Column, number: Column, tokens: int) -> Column:
    """The batch of its bucket that a sequence is in: sequences of one length, `tokens` tokens together; longer ones go alone."""
    return F.floor(number / F.greatest(F.lit(1), F.floor(F.lit(tokens) / length))).cast("bigint")
