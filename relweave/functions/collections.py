"""Array and string-map operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(a: Column, b: Column) -> Column:
    """Every element of b is in a; a NULL element is in no array."""
    return (F.size(F.array_except(b, a)) == 0) & ~F.exists(b, lambda x: x.isNull())


def contained_by(a: Column, b: Column) -> Column:
    return contains(b, a)


def overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def length(a: Column) -> Column:
    """0 for an empty array, NULL for NULL."""
    return F.when(a.isNotNull(), F.array_size(a))


def at(a: Column, index: int) -> Column:
    """0-based element, NULL beyond the end."""
    return F.get(a, F.lit(index))


def between(a: Column, start: int, stop: int) -> Column:
    """Half-open 0-based slice."""
    return F.slice(a, start + 1, stop - start)


def fits(a: Column, size: int) -> Column:
    """Maximum size rule of a sized array."""
    return F.coalesce(F.size(a) <= size, F.lit(True))


def map_value(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def has_key(m: Column, key: str) -> Column:
    return F.map_contains_key(m, key)


def has_keys(m: Column, keys: list[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in keys])
    return F.size(F.array_except(wanted, F.map_keys(m))) == 0


def has_any_keys(m: Column, keys: list[str]) -> Column:
    return F.arrays_overlap(F.map_keys(m), F.array(*[F.lit(k) for k in keys]))


def map_contains(a: Column, b: Column) -> Column:
    """Every (key, value) of b is in a; NULL values compare as equal."""
    return F.size(F.array_except(F.map_entries(b), F.map_entries(a))) == 0
