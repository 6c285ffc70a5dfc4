"""Sort, slice, single rows, distinct-on and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.operators.windows import row_number, shifted, sort_keys
from relweave.operators.writes import first_per_key

order_by = sort_keys


def reversed_keys(*names: str) -> list[Column]:
    """Every key flipped, NULL placement too."""
    return [
        F.col(n[1:]).asc_nulls_last() if n.startswith("-") else F.col(n).desc_nulls_first()
        for n in names
    ]


class NotFound(LookupError):
    """No row matched."""


class MultipleFound(LookupError):
    """More than one row matched."""


def slice_rows(df: DataFrame, order: list[Column], start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """``rows[start:stop:step]`` in the given order; no negative bounds.

    A bounded slice is a top-k; an open or stepped one numbers rows over range
    partitions.
    """
    if start < 0 or (stop is not None and stop < 0) or step < 1:
        raise ValueError("slices take no negative numbers")
    if step == 1 and stop is not None:
        return df.orderBy(*order).offset(start).limit(max(stop - start, 0))
    rows = row_number(df, [], order, "__rn").where(F.col("__rn") > start)
    if stop is not None:
        rows = rows.where(F.col("__rn") <= stop)
    return rows.where((F.col("__rn") - 1 - start) % step == 0).drop("__rn")


def get_one(df: DataFrame):
    """The only row, as a Row."""
    found = df.take(2)
    if not found:
        raise NotFound("no row matches")
    if len(found) > 1:
        raise MultipleFound("more than one row matches")
    return found[0]


def first(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*sort_keys(*order)).limit(1)


def last(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*reversed_keys(*order)).limit(1)


earliest, latest = first, last


def in_bulk(df: DataFrame, ids: DataFrame, field: str) -> DataFrame:
    """Rows whose unique field is listed in ``ids``."""
    return df.join(ids.select(field), field, "left_semi")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key by order; combined before the shuffle, so hot keys
    cost nothing extra."""
    return first_per_key(df, keys, order)


def pages(df: DataFrame, order: list[Column], size: int, orphans: int = 0) -> DataFrame:
    """Page number on every row; up to ``orphans`` last rows join the page before."""
    rows = row_number(df, [], order, "__rn")
    last_page = page_count(rows.count(), size, orphans)
    page = F.least(F.floor((F.col("__rn") - 1) / size) + 1, F.lit(last_page))
    return rows.withColumn("page", page.cast("bigint")).drop("__rn")


def page_count(total: int, size: int, orphans: int = 0, allow_empty: bool = True) -> int:
    if total == 0 and not allow_empty:
        return 0
    return -(-max(1, total - orphans) // size)


def get_page(df: DataFrame, order: list[Column], number, size: int, orphans: int = 0) -> DataFrame:
    """One page; a bad number gives the first page, one too large the last."""
    total = df.count()
    last_page = page_count(total, size, orphans)
    try:
        n = int(number)
    except (TypeError, ValueError):
        n = 1
    else:
        n = last_page if n < 1 or n > last_page else n
    low = (n - 1) * size
    high = low + size
    return slice_rows(df, order, low, total if high + orphans >= total else high)


def neighbours(df: DataFrame, pk: str, *order: str) -> DataFrame:
    """Keys of the previous and next row by the order, ties broken by ``pk``."""
    rows = row_number(df, [], sort_keys(*order, pk))
    rows = shifted(rows, [], "row_number", pk, "previous", 1)
    return shifted(rows, [], "row_number", pk, "next", -1).drop("row_number")


def append_in_order(df: DataFrame, new: DataFrame, group: str, index: str, order: list[Column]) -> DataFrame:
    """Rows with an order index per group: new rows follow the largest one."""
    top = df.groupBy(group).agg(F.max(index).alias("__top"))
    numbered = row_number(new, [group], order, "__rn").join(top, group, "left")
    place = F.coalesce(F.col("__top") + 1, F.lit(0)) + F.col("__rn") - 1
    numbered = numbered.withColumn(index, place.cast("bigint")).drop("__rn", "__top")
    return df.unionByName(numbered)
