"""Replacing emoji by their names."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_LIMIT = 20_000


def _rough_class(names: dict[str, str], ranges: int = 4) -> str | None:
    """A character class that finds every text with an emoji, in few ranges and so cheap to test.

    Each emoji is looked for by its first character beyond ASCII; the ranges may hold others.
    """
    points = set()
    for emoji in names:
        beyond = [ord(c) for c in emoji if ord(c) > 0x7F]
        if not beyond:
            return None
        points.add(beyond[0])
    ordered = sorted(points)
    gaps = sorted(range(1, len(ordered)), key=lambda i: ordered[i - 1] - ordered[i])[: ranges - 1]
    starts = [0, *sorted(gaps), len(ordered)]
    spans = [(ordered[i], ordered[j - 1]) for i, j in zip(starts, starts[1:])]
    return "[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in spans) + "]"


def _covering_class(points: list[int], ranges: int = 16) -> str:
    """A class of at most ``ranges`` ranges that holds every code point of ``points`` (and maybe others)."""
    gaps = sorted(range(1, len(points)), key=lambda i: points[i - 1] - points[i])[: ranges - 1]
    cuts = [0, *sorted(gaps), len(points)]
    spans = [(points[i], points[j - 1]) for i, j in zip(cuts, cuts[1:])]
    return "[" + "".join(f"{re.escape(chr(low))}-{re.escape(chr(high))}" for low, high in spans) + "]"


def trie_of(names: dict[str, str]) -> dict:
    """Nested dictionaries by code point; the key ``None`` holds the name of the sequence ending there."""
    root: dict = {}
    for emoji, name in names.items():
        node = root
        for char in emoji:
            node = node.setdefault(char, {})
        node[None] = name
    return root


def substituter(names: dict[str, str]) -> Callable[[str], str]:
    """Left to right, the longest entry beginning at each place is replaced, and its name is not read again.

    Places are found by one character class of all first characters; from each, the trie is walked as far
    as the text follows it. The cost per text follows its length and the emoji in it, not the table's size.
    """
    trie = trie_of(names)
    # Few ranges: a class of many single characters beyond U+FFFF is a list that every place would scan.
    starts = re.compile(_covering_class(sorted(map(ord, trie))))

    def run(text: str) -> str:
        out, done, size = [], 0, len(text)
        found = starts.search(text)
        while found is not None:
            at = found.start()
            node, end, name, k = trie, at, None, at
            while k < size and (node := node.get(text[k])) is not None:
                k += 1
                if None in node:
                    end, name = k, node[None]
            if name is None:
                found = starts.search(text, at + 1)
                continue
            out += (text[done:at], name)
            done = end
            found = starts.search(text, end)
        return "".join(out) + text[done:] if out else text

    return run


def name_emoji(text: Column, names: dict[str, str]) -> Column:
    """Replace every emoji of ``names`` in one pass from left to right (see ``substituter``).

    Where several begin at one place the longest wins, and names are not looked at again. Runs in
    Arrow batches; texts without any emoji are passed to Python as null, so that only the others
    are copied.
    """
    if not names:
        return text
    if len(names) > TABLE_LIMIT:
        raise ValueError(f"emoji table of {len(names)} entries, at most {TABLE_LIMIT} expected")

    @F.pandas_udf("string")
    def substitute(texts: pd.Series) -> pd.Series:
        return texts.map(substituter(names), na_action="ignore")

    rough = _rough_class(names)
    if rough is None:
        return substitute(text)
    return F.coalesce(substitute(F.when(F.rlike(text, F.lit(rough)), text)), text)
