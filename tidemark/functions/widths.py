"""Widths of texts in the columns of a terminal: wide characters take two, marks that join the one before them none.

Both kinds are intervals of code points that follow from Unicode's own properties, and a character class of a regex; every
other character takes one column. Characters count one by one: joined emoji are as wide as their parts.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SOFT_HYPHEN = 0xAD
#: Vowels and final consonants of Hangul syllables that are written part by part.
JAMO = range(0x1160, 0x1200)


def _columns(code: int) -> int:
    c = chr(code)
    if unicodedata.category(c) in ("Mn", "Me", "Cf") and code != SOFT_HYPHEN or code in JAMO:
        return 0
    return 2 if unicodedata.east_asian_width(c) in ("W", "F") else 1


@functools.cache
def intervals(columns: int) -> tuple[tuple[int, int], ...]:
    """First and last code points of the runs of characters that take so many columns (0 or 2), in order."""
    out: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or _columns(code) != columns:
            continue
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return tuple(map(tuple, out))


@functools.cache
def _class(columns: int) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in intervals(columns)) + "]"


def width(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit(_class(2))) - F.regexp_count(text, F.lit(_class(0)))


def cut(text: Column, columns: int, mark: str = "…") -> Column:
    """The text if it fits; else as much of its beginning as fits before the mark, which takes a column. Nothing fits into no
    column. A wide character that would reach over the border goes, marks on the last character stay."""
    if columns <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(state: Column, c: Column) -> Column:
        used = state["used"] + width(c)
        full = state["full"] | (used > columns - 1)
        return F.struct(F.when(full, state["kept"]).otherwise(F.concat(state["kept"], c)).alias("kept"), F.when(full, state["used"]).otherwise(used).alias("used"), full.alias("full"))

    # no more characters than columns and marks are looked at; a text of thousands costs no more than its first ones
    short = F.regexp_extract(text, f"^(?s:(?:{_class(0)}*[^{_class(0)[1:]}){{0,{columns}}}{_class(0)}*)", 0)
    kept = F.aggregate(F.split(short, "(?<=.)(?=.)|(?<=\\n)|(?=\\n)"), start, step)["kept"]
    return F.when(width(text) <= columns, text).otherwise(F.concat(kept, F.lit(mark)))
