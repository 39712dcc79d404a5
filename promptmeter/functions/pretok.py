"""Pre-tokenizers: how a text falls into the pieces that byte-pair merging works on.

`cl100k` and `o200k` are regexes over the classes of unicode_classes (or over full Unicode categories);
`spaces` splits at single blanks. The Python form runs in an Arrow UDF, which is the faster one for classes of
this size; the SQL form is kept as a second implementation.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode_classes as u
from .slices import column

KINDS = ("cl100k", "o200k", "spaces")


@lru_cache(16)
def pattern(kind: str, java: bool = False) -> str:
    c = lambda *sets: "".join(u.in_class(s, java) for s in sets)
    letter, digit, blank = c(u.LETTER), c(u.NUMBER), c(u.SPACE)
    tail = f"[{blank}]*[\\r\\n]+|[{blank}]+(?![^{blank}])|[{blank}]+"
    if kind == "spaces":
        return "[^ ]+| "
    if kind == "cl100k":
        return f"'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])|[^\\r\\n{letter}{digit}]?[{letter}]+|[{digit}]{{1,3}}| ?[^{blank}{letter}{digit}]+[\\r\\n]*|{tail}"
    if kind == "o200k":
        high, low = c(u.UPPER, u.TITLE, u.MODIFIER, u.OTHER, u.MARK), c(u.LOWER, u.MODIFIER, u.OTHER, u.MARK)
        prefix, short = f"[^\\r\\n{letter}{digit}]?+", "(?:'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL]))?"
        return f"{prefix}[{high}]*[{low}]+{short}|{prefix}[{high}]+{short}|[{digit}]{{1,3}}| ?[^{blank}{letter}{digit}]+[\\r\\n/]*|{tail}"
    raise ValueError(f"no pre-tokenizer {kind}")


@lru_cache(8)
def _compiled(kind: str) -> re.Pattern:
    return re.compile(pattern(kind))


def split(text: str | None, kind: str) -> list[str]:
    return _compiled(kind).findall(text or "")


def pieces_sql(text, kind: str) -> Column:
    """Pieces by the JVM's regex engine."""
    return F.regexp_extract_all(text, F.lit(pattern(kind, java=True)), F.lit(0))


def pieces(text, kind: str) -> Column:
    """Pieces by an Arrow UDF; null has none."""
    return column(text, lambda: lambda t: split(t, kind), "array<string>")


def piece_count(text, kind: str, like: str | None = None) -> Column:
    """How many pieces there are, or how many of them the regex `like` matches as a whole; they stay in the worker."""

    def make():
        if like is None:
            return lambda t: len(split(t, kind))
        whole = re.compile(like).fullmatch
        return lambda t: sum(whole(p) is not None for p in split(t, kind))

    return column(text, make, "long")
