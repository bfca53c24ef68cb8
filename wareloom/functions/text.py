"""Text expressions that stay inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width and other ignorable characters (fixed values).
IGNORABLES = (
    "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f"
    "\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff"
)
#: Blanks other than the plain space (fixed values).
ODD_BLANKS = (
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
)
#: Every kind of blank, as the inside of a regular-expression class.
BLANK_CLASS = r"\s\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff"


@lru_cache(maxsize=1)
def width_map() -> tuple[str, str]:
    """One-to-one compatibility foldings, derived from the Unicode database by block."""
    source, target = [], []
    blocks = [(0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFF01, 0xFFEE)]
    for low, high in blocks:
        for code in range(low, high + 1):
            ch = chr(code)
            folded = unicodedata.normalize("NFKC", ch)
            if folded != ch and len(folded) == 1:
                source.append(ch)
                target.append(folded)
    for ch in ODD_BLANKS:
        source.append(ch)
        target.append(" ")
    return "".join(source), "".join(target)


def fold_width(col: Column) -> Column:
    """Full-width, half-width and compatibility forms to their plain form; odd blanks to spaces."""
    source, target = width_map()
    return F.translate(col, source, target)


def drop_ignorables(col: Column) -> Column:
    return F.translate(col, IGNORABLES, "")


def trim_blanks(col: Column) -> Column:
    """Trim every kind of blank, line breaks included."""
    return F.regexp_replace(col, rf"^[{BLANK_CLASS}]+|[{BLANK_CLASS}]+$", "")


def is_blank(col: Column) -> Column:
    return col.isNull() | (trim_blanks(drop_ignorables(col)) == "")


def letters_only(col: Column) -> Column:
    """Width-folded, case-folded letters and digits: the form texts are compared in."""
    return F.regexp_replace(F.lower(fold_width(col)), r"[^\p{L}\p{N}]+", "")


def ngrams(col: Column, n: int) -> Column:
    """All character n-grams of a string with their order kept; an empty array if it is shorter or null.

    One pass of a look-ahead, so the work is linear in the length of the text. A look-ahead may
    not begin inside a character of two code units.
    """
    grams = F.regexp_extract_all(col, F.lit(rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{n - 1}}}))"), F.lit(1))
    return F.coalesce(grams, F.array().cast("array<string>"))
