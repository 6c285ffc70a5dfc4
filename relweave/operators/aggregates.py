"""Aggregates with filter and default, facets, date drill-down and archives."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.functions import temporal as tm
from relweave.runtime import ntz


def only(agg, col: Column, cond: Column) -> Column:
    """Filtered aggregate: rows that fail the condition count as NULL."""
    return agg(F.when(cond, col))


def with_default(agg: Column, default) -> Column:
    return F.coalesce(agg, default if isinstance(default, Column) else F.lit(default))


def per_parent(parent: DataFrame, key: str, children: DataFrame, child_key: str, **aggs: Column) -> DataFrame:
    """Aggregates of a to-many relation on every parent row.

    Children are aggregated by key first; the wide parent rows are never
    grouped.
    """
    per = children.groupBy(F.col(child_key).alias("__k")).agg(*[a.alias(n) for n, a in aggs.items()])
    return parent.join(per, parent[key] == per["__k"], "left").drop("__k")


def interval_avg(seconds: Column) -> Column:
    return F.avg(seconds)


def dates(df: DataFrame, col: str, unit: str, descending: bool = False) -> DataFrame:
    """Distinct truncated non-null values, ordered."""
    out = df.where(F.col(col).isNotNull()).select(tm.trunc(F.col(col), unit).alias(unit)).distinct()
    return out.orderBy(F.col(unit).desc() if descending else F.col(unit).asc())


def facet_counts(df: DataFrame, facets: dict[str, dict[str, Column]], active: dict[str, Column]) -> DataFrame:
    """Rows per choice of each list filter, with the other active filters on.

    One pass: every choice is a conditional count; the single result row is
    then turned into (facet, choice, n).
    """
    counts, pairs = [], []
    for facet, choices in facets.items():
        others = F.lit(True)
        for name, cond in active.items():
            if name != facet:
                others = others & cond
        for choice, cond in choices.items():
            name = f"c{len(counts)}"
            counts.append(F.count_if(others & cond).alias(name))
            pairs.append(F.struct(F.lit(facet).alias("facet"), F.lit(choice).alias("choice"), F.col(name).alias("n")))
    return df.agg(*counts).select(F.inline(F.array(*pairs)))


def null_safe_choices(col: str, values: list) -> dict[str, Column]:
    """Choices of a column: each value, and empty."""
    out = {str(v): F.col(col) == v for v in values}
    out["-"] = F.col(col).isNull()
    return out


def past_ranges(col: str, today: dt.date) -> dict[str, Column]:
    """Any date, today, past 7 days, this month, this year, no date, has date."""
    t = lambda x: ntz(f"{x.isoformat()} 00:00:00")
    tomorrow = today + dt.timedelta(days=1)
    month = today.replace(day=1)
    next_month = (month + dt.timedelta(days=32)).replace(day=1)
    year = today.replace(month=1, day=1)
    span = lambda a, b: (F.col(col) >= t(a)) & (F.col(col) < t(b))
    return {
        "any": F.lit(True),
        "today": span(today, tomorrow),
        "past 7 days": span(today - dt.timedelta(days=7), tomorrow),
        "this month": span(month, next_month),
        "this year": span(year, year.replace(year=year.year + 1)),
        "no date": F.col(col).isNull(),
        "has date": F.col(col).isNotNull(),
    }


def date_hierarchy(df: DataFrame, col: str) -> DataFrame:
    """Choices of the first useful drill-down level.

    The level is year, or month if all rows fall in one year, or day if they
    fall in one month.
    """
    per_day = df.where(F.col(col).isNotNull()).groupBy(F.to_date(col).alias("day")).agg(F.count("*").alias("n"))
    lo, hi = per_day.agg(F.min("day"), F.max("day")).first()
    if lo is None or lo.year != hi.year:
        level = "year"
    else:
        level = "month" if lo.month != hi.month else "day"
    start = tm.trunc_date_unit(F.col("day"), level)
    return per_day.groupBy(F.lit(level).alias("level"), start.alias("start")).agg(F.sum("n").alias("n"))


def date_archive(df: DataFrame, col: str, period: str, at: dt.date, now: str | None = None) -> DataFrame:
    """Rows of the period that holds ``at``: half-open [since, until).

    ``now`` hides later rows (no future rows allowed). Newest first.
    """
    if period == "year":
        lo = at.replace(month=1, day=1)
        hi = lo.replace(year=lo.year + 1)
    elif period == "month":
        lo = at.replace(day=1)
        hi = (lo + dt.timedelta(days=32)).replace(day=1)
    elif period == "week":
        lo = at - dt.timedelta(days=at.weekday())
        hi = lo + dt.timedelta(days=7)
    else:
        lo, hi = at, at + dt.timedelta(days=1)
    rows = df.where((F.col(col) >= ntz(f"{lo} 00:00:00")) & (F.col(col) < ntz(f"{hi} 00:00:00")))
    if now:
        rows = rows.where(F.col(col) <= ntz(now))
    return rows.orderBy(F.col(col).desc())


def neighbour_periods(df: DataFrame, col: str, unit: str) -> DataFrame:
    """For each period with data: the previous and next period with data.

    The distinct periods are few (calendar units), so their window is small.
    """
    from relweave.operators.windows import running, shifted, sort_keys

    per = df.where(F.col(col).isNotNull()).groupBy(tm.trunc(F.col(col), unit).alias("period")).agg(F.count("*").alias("n"))
    per = running(per, [], sort_keys("period"))
    per = shifted(per, [], "row_number", "period", "previous", 1)
    per = shifted(per, [], "row_number", "period", "next", -1)
    return per.select("period", "n", "previous", "next")
