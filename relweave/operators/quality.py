"""Data-quality checks: rows that break a rule, as (rule, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.operators.ranges import overlap_join


def violations(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """All row rules in one pass. A rule is (condition, value shown); a row
    breaks it if the condition is false, NULL passes."""
    found = [
        F.when(~F.coalesce(cond, F.lit(True)), F.struct(F.lit(name).alias("rule"), value.cast("string").alias("value")))
        for name, (cond, value) in rules.items()
    ]
    hits = df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*found))).alias("v"))
    return hits.select("v.rule", "key", "v.value")


def check(df: DataFrame, cond: Column) -> DataFrame:
    """Rows on which the condition is false; NULL passes."""
    return df.where(~F.coalesce(cond, F.lit(True)))


def duplicates(df: DataFrame, keys: list[Column], names: list[str], where: Column | None = None,
               nulls_distinct: bool = True) -> DataFrame:
    """Key values (fields or expressions) held by more than one row."""
    rows = df if where is None else df.where(where)
    rows = rows.select(*[k.alias(n) for k, n in zip(keys, names)])
    if nulls_distinct:
        for n in names:
            rows = rows.where(F.col(n).isNotNull())
    return rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")


def exclusion(df: DataFrame, key: str, equal: list[str], lo: str, hi: str, width: float) -> DataFrame:
    """Pairs of rows, equal on some columns, whose [lo, hi) ranges overlap; a NULL bound is infinite."""
    a = df.select(key, *equal, lo, hi)
    b = a.select(*[F.col(c).alias(f"other_{c}") for c in a.columns])
    pairs = overlap_join(a, b, [(c, f"other_{c}") for c in equal], (lo, hi), (f"other_{lo}", f"other_{hi}"), width)
    return pairs.where(F.col(key) < F.col(f"other_{key}"))


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null foreign key has no parent."""
    keys = parent.select(F.col(parent_key).alias("__k"))
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__k"), "left_anti")


def required(col: Column, null: bool = False, blank: bool = False) -> Column:
    """Column may be NULL or '' only where allowed. Never NULL itself."""
    ok = F.lit(True)
    if not null:
        ok = ok & col.isNotNull()
    if not blank:
        ok = ok & (F.coalesce(col.cast("string"), F.lit("x")) != "")
    return ok


def unique_for(df: DataFrame, field: str, date: str, unit: str) -> DataFrame:
    """Values repeated within a day, a month number or a year number of a date."""
    part = {"date": F.to_date, "month": F.month, "year": F.year}[unit](date)
    rows = df.where(F.col(date).isNotNull() & F.col(field).isNotNull())
    return rows.groupBy(field, part.alias("period")).agg(F.count("*").alias("n")).where("n > 1")
