"""User functions: named SQL functions, composed aggregates, row generators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[..., Column]] = {}


def func(name: str, *args: Column, arity: int | None = None) -> Column:
    """Any SQL function by name."""
    if arity is not None and len(args) != arity:
        raise TypeError(f"{name} takes {arity} arguments, got {len(args)}")
    return F.call_function(name, *args)


def register_aggregate(name: str, fn: Callable[..., Column]) -> None:
    """A custom aggregate made of built-in ones, so that it still combines
    map-side and never gathers a group."""
    AGGREGATES[name] = fn


def aggregate(name: str, *cols: Column) -> Column:
    return AGGREGATES[name](*cols)


def rows_of(df: DataFrame, name: str, items: Column) -> DataFrame:
    """Set-returning expression: one row per item."""
    return df.withColumn(name, F.explode(items))


register_aggregate("geometric_mean", lambda x: F.exp(F.avg(F.ln(x))))
register_aggregate("value_range", lambda x: F.max(x) - F.min(x))
