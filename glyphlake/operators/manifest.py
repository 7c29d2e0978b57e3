"""Rename manifests: files bucketed by extension under numbered names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions import text
from glyphlake.operators.ranking import numbered, shuffled_key


def bucketed(files: DataFrame, path: str = "path", exclude: tuple[str, ...] = ("filenames.json",), seed: int = 42) -> DataFrame:
    """(ext, seq, new_path, orig_path): files of an extension numbered from 0, seven digits, in a seeded order of paths.

    Manifest files are left out by name, so that a second run does not take them for records.
    """
    f = files.select(F.col(path).alias("orig_path")).where(~text.base_name(F.col("orig_path")).isin(*exclude))
    f = f.withColumn("suffix", text.suffix(text.base_name(F.col("orig_path"))))
    f = numbered(f, shuffled_key(F.col("orig_path"), seed), ["orig_path"], ["suffix"], "seq")
    ext = F.substring("suffix", 2, 1000)
    tail = F.when(F.col("suffix") == ".NONE", "").otherwise(F.col("suffix"))
    return f.select(ext.alias("ext"), "seq", F.concat(ext, F.lit("/"), text.padded(F.col("seq"), 7), tail).alias("new_path"), "orig_path")
