"""Ropes: texts as trees whose nodes cache how many units and code points lie below them.

Splitting and joining make a few new nodes and copy no text but that of one leaf; leaves end where a unit ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import regex

#: Code points of a leaf, about.
LEAF = 2048


class Rope(NamedTuple):
    """A leaf (text) or an inner node (left, right)."""

    units: int
    chars: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0)


def ends_of(text: str, unit: str | None) -> list[int]:
    """Where the units of a text end. A unit ends with each match of the pattern, matches taken from left to right over code
    points; what follows the last match belongs to the last unit, and a text without any match is one unit. Empty matches
    end none."""
    ends = [m.end() for m in regex.finditer(unit, text) if m.end() > m.start()]
    if text and not ends:
        ends = [0]
    if ends:
        ends[-1] = len(text)
    return ends


def built(text: str, unit: str | None = None, leaf: int = LEAF) -> Rope:
    """The balanced rope of a text; without a pattern each code point is a unit."""
    leaves = []
    if unit is None:
        leaves = [Rope(len(part), len(part), part) for part in (text[at : at + leaf] for at in range(0, len(text), leaf))]
    else:
        first = units = 0
        ends = ends_of(text, unit)
        for end in ends:
            units += 1
            if end - first >= leaf or end == ends[-1]:
                leaves.append(Rope(units, end - first, text[first:end]))
                first, units = end, 0
    while len(leaves) > 1:
        leaves = [joined(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def joined(*parts: Rope) -> Rope:
    """The parts one after the other; their trees are shared, not copied."""
    whole = EMPTY
    for part in parts:
        if not whole.chars:
            whole = part
        elif part.chars:
            whole = Rope(whole.units + part.units, whole.chars + part.chars, "", whole, part)
    return whole


def split(rope: Rope, rank: int, unit: str | None = None) -> tuple[Rope, Rope]:
    """The first `rank` units and the rest, by the counts of the nodes on one path down."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= rope.units:
        return rope, EMPTY
    if rope.left is None:
        at = rank if unit is None else ends_of(rope.text, unit)[rank - 1]
        return Rope(rank, at, rope.text[:at]), Rope(rope.units - rank, rope.chars - at, rope.text[at:])
    if rank <= rope.left.units:
        a, b = split(rope.left, rank, unit)
        return a, joined(b, rope.right)
    a, b = split(rope.right, rank - rope.left.units, unit)
    return joined(rope.left, a), b


def leaves(rope: Rope) -> Iterator[str]:
    """The texts of the leaves from left to right."""
    stack = [rope]
    while stack:
        node = stack.pop()
        if node.left is None:
            yield node.text
        else:
            stack += [node.right, node.left]


def text_of(rope: Rope) -> str:
    return "".join(leaves(rope))


def find(rope: Rope, wanted: str) -> int:
    """The code point at which `wanted` first begins, or -1; it may lie across leaves."""
    before, kept = 0, ""
    for part in leaves(rope):
        here = kept + part
        at = here.find(wanted)
        if at >= 0:
            return before + at
        kept = here[max(0, len(here) - len(wanted) + 1) :] if len(wanted) > 1 else ""
        before += len(here) - len(kept)
    return -1
