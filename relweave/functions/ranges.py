"""Range values as struct<lower, upper, lower_inc, upper_inc>.

A NULL bound is infinite. Discrete ranges are kept as [lower, upper).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lower: Column, upper: Column, bounds: str = "[)", step: Column | None = None) -> Column:
    """Range from two columns; ``step`` canonicalises a discrete one to [)."""
    if bounds not in ("[]", "[)", "(]", "()"):
        raise ValueError("bounds are one of [] [) (] ()")
    li, ui = bounds[0] == "[", bounds[1] == "]"
    if step is not None:
        lower = lower if li else lower + step
        upper = upper + step if ui else upper
        li, ui = True, False
    return F.struct(
        lower.alias("lower"), upper.alias("upper"),
        (F.lit(li) & lower.isNotNull()).alias("lower_inc"), (F.lit(ui) & upper.isNotNull()).alias("upper_inc"))


def is_empty(r: Column) -> Column:
    lo, hi = r["lower"], r["upper"]
    point = (lo == hi) & ~(r["lower_inc"] & r["upper_inc"])
    return F.coalesce((lo > hi) | point, F.lit(False))


def lower(r: Column) -> Column:
    return F.when(~is_empty(r), r["lower"])


def upper(r: Column) -> Column:
    return F.when(~is_empty(r), r["upper"])


def lower_inf(r: Column) -> Column:
    return r["lower"].isNull() & ~is_empty(r)


def upper_inf(r: Column) -> Column:
    return r["upper"].isNull() & ~is_empty(r)


def _starts_by(a: Column, b: Column) -> Column:
    """a starts no later than b."""
    lo, lb = a["lower"], b["lower"]
    return lo.isNull() | F.coalesce((lo < lb) | ((lo == lb) & (a["lower_inc"] | ~b["lower_inc"])), F.lit(False))


def _ends_by(a: Column, b: Column) -> Column:
    """a ends no later than b."""
    hi, hb = a["upper"], b["upper"]
    return hb.isNull() | F.coalesce((hi < hb) | ((hi == hb) & (b["upper_inc"] | ~a["upper_inc"])), F.lit(False))


def _before(a: Column, b: Column) -> Column:
    """a lies wholly before b."""
    hi, lo = a["upper"], b["lower"]
    return F.coalesce((hi < lo) | ((hi == lo) & ~(a["upper_inc"] & b["lower_inc"])), F.lit(False))


def _both(a: Column, b: Column) -> Column:
    return ~is_empty(a) & ~is_empty(b)


def contains_value(r: Column, v: Column) -> Column:
    lo, hi = r["lower"], r["upper"]
    above = lo.isNull() | (v > lo) | ((v == lo) & r["lower_inc"])
    below = hi.isNull() | (v < hi) | ((v == hi) & r["upper_inc"])
    return above & below & ~is_empty(r)


def contains(a: Column, b: Column) -> Column:
    """a holds b; the empty range is held by all."""
    return is_empty(b) | (_both(a, b) & _starts_by(a, b) & _ends_by(b, a))


def contained_by(a: Column, b: Column) -> Column:
    return contains(b, a)


def overlap(a: Column, b: Column) -> Column:
    return _both(a, b) & ~_before(a, b) & ~_before(b, a)


def fully_lt(a: Column, b: Column) -> Column:
    return _both(a, b) & _before(a, b)


def fully_gt(a: Column, b: Column) -> Column:
    return fully_lt(b, a)


def not_lt(a: Column, b: Column) -> Column:
    """a does not reach before b."""
    return _both(a, b) & _starts_by(b, a)


def not_gt(a: Column, b: Column) -> Column:
    """a does not reach beyond b."""
    return _both(a, b) & _ends_by(a, b)


def adjacent(a: Column, b: Column) -> Column:
    def meets(x, y):
        touch = (x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"])
        return F.coalesce(touch, F.lit(False))

    return _both(a, b) & (meets(a, b) | meets(b, a))
