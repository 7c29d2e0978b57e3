"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The recognition line of 55 symbols, and the printable ASCII symbols.
OCR_LINE = UPPER + LOWER + "!?."
FIRST_PRINTABLE, LAST_PRINTABLE = 32, 126


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def code_points(c: Column) -> Column:
    return F.length(c).cast("bigint")


def utf8_bytes(c: Column) -> Column:
    return F.octet_length(c).cast("bigint")


def edit_distance(a: Column, b: Column, unit: str = "code_point", naive_empty: bool = False) -> Column:
    """Levenshtein distance over code points or over UTF-8 bytes.

    naive_empty gives 0 when either side is empty, as one historical implementation does; otherwise the standard holds.
    """
    if unit == "byte":
        x, y = (F.decode(F.encode(s, "UTF-8"), "ISO-8859-1") for s in (a, b))
    elif unit == "code_point":
        x, y = a, b
    else:
        raise ValueError(f"unknown unit {unit}")
    d = F.levenshtein(x, y).cast("bigint")
    return F.when((a == "") | (b == ""), F.lit(0).cast("bigint")).otherwise(d) if naive_empty else d


def suffix(name: Column) -> Column:
    """The last extension with its dot, lower-cased; .NONE without one. Leading dots begin no extension."""
    found = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    return F.when(found == "", F.lit(".NONE")).otherwise(found)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]+$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def after_last(c: Column, mark: str) -> Column:
    """What follows the last mark; all of it without one."""
    return F.substring_index(c, mark, -1)


def without_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def padded(c: Column, width: int) -> Column:
    """A non-negative number with leading zeros to the width; longer numbers stay whole."""
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def atlas_text(lines: Column) -> Column:
    """The lines of an atlas, each ended by a newline."""
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def split_atlas(text: Column) -> Column:
    """Lines of a text; a newline at its end opens no further line."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def printable_atlas(per_line: int = 12) -> Column:
    """The 95 printable ASCII symbols in lines of per_line, the last one shorter."""
    symbols = F.transform(F.sequence(F.lit(FIRST_PRINTABLE), F.lit(LAST_PRINTABLE)), lambda i: F.chr(i))
    n = -(-(LAST_PRINTABLE - FIRST_PRINTABLE + 1) // per_line)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_join(F.slice(symbols, i * per_line + 1, per_line), ""))


def single_symbols(text: Column) -> Column:
    """One line for each character."""
    return F.filter(F.split(text, ""), lambda x: x != "")


def round_half_even(c: Column) -> Column:
    return F.rint(c)
