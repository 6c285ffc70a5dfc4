"""String functions. NULL in gives NULL out unless said."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slice_text(col: Column, start: int, stop: int | None = None) -> Column:
    """``col[start:stop]`` counted in characters; no negatives, no step."""
    if start < 0 or (stop is not None and stop < start):
        raise ValueError("slices are non-negative and ordered")
    if stop is None:
        return F.substring(col, F.lit(start + 1), F.char_length(col))
    return F.substring(col, start + 1, stop - start)


def concat_text(*cols: Column) -> Column:
    """Concatenation with NULL as '' and values cast to text."""
    if len(cols) < 2:
        raise ValueError("concat takes at least two expressions")
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def char_of(code: Column) -> Column:
    """Character of a code point, beyond Latin-1 too."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def code_of(col: Column) -> Column:
    return F.ascii(col)


def str_index(col: Column, part: Column) -> Column:
    """1-based position of the first occurrence, 0 if absent."""
    return F.locate_in(col, part) if hasattr(F, "locate_in") else F.call_function("instr", col, part)


def left(col: Column, n: int) -> Column:
    if n < 1:
        raise ValueError("length must be positive")
    return F.left(col, F.lit(n))


def right(col: Column, n: int) -> Column:
    if n < 1:
        raise ValueError("length must be positive")
    return F.right(col, F.lit(n))


def pad(col: Column, n: int, fill: str = " ", side: str = "left") -> Column:
    if n < 0:
        raise ValueError("length must not be negative")
    return F.lpad(col, n, fill) if side == "left" else F.rpad(col, n, fill)


@F.pandas_udf(T.StringType())
def decompose(s: pd.Series) -> pd.Series:
    """NFKD with combining marks dropped; only called on non-ASCII text."""
    def strip(x):
        if x is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return s.map(strip)


@F.pandas_udf(T.StringType())
def compose(s: pd.Series) -> pd.Series:
    """NFC form."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


# Latin letters that are no letter with a mark, and how they are written without.
PLAIN = {
    "ß": "ss", "ẞ": "SS", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th", "Ø": "O", "ø": "o", "Ł": "L", "ł": "l",
    "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ŧ": "T", "ŧ": "t",
}


def _marked() -> dict[str, str]:
    """Latin letters with a mark, and the letter it sits on."""
    letters = map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
    found = {c: unicodedata.normalize("NFD", c)[0] for c in letters}
    return {c: PLAIN.get(x, x) for c, x in found.items() if c != x and len(PLAIN.get(x, x)) == 1 and c not in PLAIN}


def unaccent(col: Column) -> Column:
    """Latin letters without diacritics, JVM-side; see decompose for all scripts."""
    single = _marked() | {c: x for c, x in PLAIN.items() if len(x) == 1}
    for letter, plain in PLAIN.items():
        if len(plain) > 1:
            col = F.replace(col, F.lit(letter), F.lit(plain))
    # marks that stand by themselves go as well
    return F.regexp_replace(F.translate(col, "".join(single), "".join(single.values())), r"[\x{300}-\x{36f}]", "")


def fold_case(col: Column) -> Column:
    """Column that compares, sorts and groups without regard to case."""
    return F.collate(col, "UTF8_LCASE")
