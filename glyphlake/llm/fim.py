"""Fill-in-middle: prefix, middle and suffix of a document in the order that a model is trained on, and back.

The text is a rope. It is split at two unit ranks, the three subtrees are joined in their new order with sentinels
between, and an output is taken apart by splitting its tree at the sentinels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.llm import rope
from glyphlake.llm.common import text_of

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The order of the parts by form.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Of 100 documents, how many are rearranged at most, and how many of these begin with the suffix.
RATE, SPM_RATE = 90, 20


def draws(key: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that depend on seed and key only; a null key is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def rearranged(key: int | None, text: str, unit: str | None = None, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, rope.Rope]:
    """(units, form, code points of the prefix, of the middle, output) of one text; plain texts have no prefix and middle."""
    whole = rope.built(text, unit)
    n = whole.units
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, whole
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = rope.split(whole, first, unit)
    middle, suffix = rope.split(rest, last - first, unit)
    form = "spm" if h4 % 100 < spm_rate else "psm"
    parts = {PREFIX: prefix, MIDDLE: middle, SUFFIX: suffix}
    output = rope.joined(*(x for s in ORDER[form] for x in (rope.built(s), parts[s])))
    return n, form, prefix.chars, middle.chars, output


def restored(output: str, form: str) -> rope.Rope:
    """The text that an output was made of.

    The text holds no sentinel, and a sentinel has its first and its last character nowhere else in it, so none begins or
    ends across a border: each is found where it was put.
    """
    rest = rope.built(output)
    if form == "plain":
        return rest
    parts = {}
    order = ORDER[form]
    for k, sentinel in enumerate(order):
        at = rope.find(rest, sentinel)
        if at < 0 or not k and at:
            raise ValueError(f"no output of form {form}")
        before, rest = rope.split(rest, at)
        if k:
            parts[order[k - 1]] = before
        _, rest = rope.split(rest, len(sentinel))
    parts[order[-1]] = rest
    return rope.joined(parts[PREFIX], parts[MIDDLE], parts[SUFFIX])


def transformed(docs: DataFrame, unit: str | None = None, seed: int = 1, rate: int = RATE, spm_rate: int = SPM_RATE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs as (key, n, form, prefix_chars, middle_chars, output).

    unit: a regular expression of the units at whose ends a text may be cut, by default each code point; n counts them.
    Where the cuts lie and whether a document is rearranged follows from seed and key alone, so reruns agree and rows
    that repeat give the same. Null text is an empty one; empty texts and texts that hold a sentinel stay plain. A null
    key is drawn for as an empty one. Texts of any length are cut whole; an empty table gives none; other columns,
    whatever their names, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("k")
            made = [rearranged(k, t, unit, seed, rate, spm_rate) for k, t in zip(keys.to_pylist(), batch.column("t").to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else [()] * 5
            yield pa.RecordBatch.from_arrays([
                keys, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                pa.array(map(rope.text_of, output), pa.string()),
            ], names=["k", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(key).cast("bigint").alias("k"), text_of(text).alias("t"))
    return rows.mapInArrow(run, "k bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").withColumnRenamed("k", key)


def inverted(made: DataFrame, name: str = "restored") -> DataFrame:
    """made (form, output, ...) with the texts that the outputs were made of; a row that is no output of its form fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [rope.text_of(restored(o, f)) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return made.mapInArrow(run, T.StructType([*made.schema, T.StructField(name, T.StringType())]))
