"""Lookups and transforms addressed by name, and condition trees over them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from relweave.functions import temporal as tm

Transform = Callable[[Column], Column]
Lookup = Callable[[Column, object], Column]


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _in(col: Column, values) -> Column:
    """Membership; None in the list is ignored, an empty list matches nothing."""
    kept = [v for v in values if v is not None]
    return col.isin(kept) if kept else F.lit(False)


def _isnull(col: Column, flag) -> Column:
    if flag not in (True, False):
        raise ValueError("isnull takes True or False")
    return col.isNull() if flag else col.isNotNull()


def _folded(test: Callable[[Column, Column], Column]) -> Lookup:
    return lambda col, v: test(F.lower(col), F.lower(as_column(v)))


LOOKUPS: dict[str, Lookup] = {
    "exact": lambda c, v: c == as_column(v),
    "iexact": _folded(lambda a, b: a == b),
    "gt": lambda c, v: c > as_column(v),
    "gte": lambda c, v: c >= as_column(v),
    "lt": lambda c, v: c < as_column(v),
    "lte": lambda c, v: c <= as_column(v),
    "in": _in,
    "range": lambda c, v: c.between(as_column(v[0]), as_column(v[1])),
    "isnull": _isnull,
    "contains": lambda c, v: c.contains(as_column(v)),
    "icontains": _folded(lambda a, b: a.contains(b)),
    "startswith": lambda c, v: c.startswith(as_column(v)),
    "istartswith": _folded(lambda a, b: a.startswith(b)),
    "endswith": lambda c, v: c.endswith(as_column(v)),
    "iendswith": _folded(lambda a, b: a.endswith(b)),
    "regex": lambda c, v: c.rlike(v),
    "iregex": lambda c, v: c.rlike(f"(?iuU){v}"),
}

TRANSFORMS: dict[str, Transform] = {
    "year": F.year,
    "iso_year": tm.iso_year,
    "month": F.month,
    "day": F.dayofmonth,
    "quarter": F.quarter,
    "week": F.weekofyear,
    "week_day": F.dayofweek,
    "iso_week_day": tm.iso_week_day,
    "hour": F.hour,
    "minute": F.minute,
    "second": tm.whole_second,
    "date": F.to_date,
    "lower": F.lower,
    "upper": F.upper,
    "length": F.char_length,
    "trim": F.trim,
    "abs": F.abs,
}

# Transforms applied to both sides of a comparison.
BILATERAL: set[str] = set()

_YEAR_TESTS = ("exact", "gt", "gte", "lt", "lte")


def register_transform(name: str, fn: Transform, bilateral: bool = False) -> None:
    TRANSFORMS[name] = fn
    (BILATERAL.add if bilateral else BILATERAL.discard)(name)


def register_lookup(name: str, fn: Lookup) -> None:
    LOOKUPS[name] = fn


def predicate(col: Column, steps: Iterable[str], value) -> Column:
    """Boolean for ``col__step__..__lookup = value``.

    The last step may be a lookup; otherwise every step is a transform and the
    test is ``exact``. ``exact=None`` is a NULL test; others refuse None.
    """
    steps = list(steps)
    if steps and steps[-1] in LOOKUPS:
        name = steps.pop()
    else:
        name = "exact"
    if value is None:
        if name not in ("exact", "iexact"):
            raise ValueError(f"{name} cannot take None")
        name, value = "isnull", True
    if steps == ["year"] and name in _YEAR_TESTS and isinstance(value, int):
        return year_range(col, name, value)
    both = all(s in BILATERAL for s in steps) and steps
    for step in steps:
        if step not in TRANSFORMS:
            raise ValueError(f"unknown transform or lookup {step!r}")
        col = TRANSFORMS[step](col)
        if both:
            value = TRANSFORMS[step](as_column(value))
    return LOOKUPS[name](col, value)


def year_range(col: Column, name: str, year: int) -> Column:
    """Year test as a range on the raw column, so Parquet statistics apply."""
    lo = F.expr(f"timestamp_ntz'{year:04d}-01-01 00:00:00'")
    hi = F.expr(f"timestamp_ntz'{year + 1:04d}-01-01 00:00:00'")
    return {
        "exact": (col >= lo) & (col < hi),
        "gt": col >= hi,
        "gte": col >= lo,
        "lt": col < lo,
        "lte": col < hi,
    }[name]


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def xor_of(*conds: Column) -> Column:
    """True when an odd number of conditions hold."""
    ones = [F.coalesce(c, F.lit(False)).cast("int") for c in conds]
    return reduce(lambda a, b: a + b, ones) % 2 == 1


def negate(cond: Column) -> Column:
    """NOT that keeps rows on which the condition is unknown."""
    return ~F.coalesce(cond, F.lit(False))


def tuple_compare(cols: list[Column], op: str, values: list) -> Column:
    """Lexicographic test on a composite key; unknown if a needed part is NULL."""
    vals = [as_column(v) for v in values]
    if op == "exact":
        return all_of(*[c == v for c, v in zip(cols, vals)])
    strict = op[:2]
    result = None
    for i in reversed(range(len(cols))):
        c, v = cols[i], vals[i]
        ahead = c > v if strict == "gt" else c < v
        if result is None:
            last = {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
            result = last
        else:
            result = ahead | ((c == v) & result)
    return result


def tuple_in(cols: list[Column], rows: list[tuple]) -> Column:
    """Composite membership; tuples holding None never match."""
    kept = [r for r in rows if None not in r]
    return any_of(*[tuple_compare(cols, "exact", list(r)) for r in kept])


def tuple_isnull(cols: list[Column], flag: bool) -> Column:
    """True asks for any part NULL, False for every part present."""
    some = any_of(*[c.isNull() for c in cols])
    return some if flag else ~some
