"""Unicode folds as plan-time tables, for Spark columns and for the SQL that checks them."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that a fold may meet: Latin with its extensions, Greek, Cyrillic, full-width and compatibility forms.
RANGES = ((0xA0, 0x530), (0x1E00, 0x2000), (0x2100, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))
#: How German and Nordic letters are written without them.
TRANSLITERATIONS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "å": "aa", "æ": "ae", "ø": "oe"}


def folded(char: str) -> str:
    """NFKD without combining marks, casefolded."""
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).casefold()


@cache
def tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that fold to one other, those others, and pairs for characters that fold to several or none."""
    one, to, several = [], [], []
    for low, high in RANGES:
        for code in range(low, min(high, sys.maxunicode)):
            char = chr(code)
            if not char.isalnum() and not unicodedata.combining(char):
                continue
            fold = folded(char)
            if fold == char:
                continue
            if len(fold) == 1:
                one.append(char)
                to.append(fold)
            else:
                several.append((char, fold))
    return "".join(one), "".join(to), tuple(several)


def _marks() -> str:
    return "".join(c for c, fold in tables()[2] if not fold)


def _replaced(char: str, written: str) -> bool:
    """Whether a fold to several letters is worth an expression of its own: Latin letters and ligatures."""
    latin = ord(char) < 0x250 or 0x1E00 <= ord(char) < 0x1F00 or 0xFB00 <= ord(char) < 0xFB07
    return written != "" and latin and unicodedata.category(char)[0] == "L"


def fold(text: Column | str) -> Column:
    """NFKD, marks dropped, casefold, over the letters of RANGES."""
    one, to, several = tables()
    x = F.translate(F.lower(text), one + _marks(), to)
    for char, written in several:
        if _replaced(char, written):
            x = F.replace(x, F.lit(char), F.lit(written))
    return x


def fold_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    one, to, several = tables()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"translate(lower({text}), {quote(one + _marks())}, {quote(to)})"
    for char, written in several:
        if _replaced(char, written):
            x = f"replace({x}, {quote(char)}, {quote(written)})"
    return x


def squeeze(text: Column) -> Column:
    """White space runs, NBSP included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s  -     　]+", " "))


def transliterated(text: Column) -> Column:
    """German and Nordic letters written out, other marks dropped."""
    x = F.lower(text)
    for char, written in TRANSLITERATIONS.items():
        x = F.replace(x, F.lit(char), F.lit(written))
    return fold(x)
