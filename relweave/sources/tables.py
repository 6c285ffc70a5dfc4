"""Base tables, SQL texts, result shapes and chunked reading."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.operators.windows import row_number


def table_scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def raw_sql(spark: SparkSession, sql: str, params: dict | list | None = None,
            translations: dict[str, str] | None = None, **tables: DataFrame) -> DataFrame:
    """Parameterised SQL over named DataFrames (``{orders}``), result columns
    renamed by ``translations``."""
    out = spark.sql(sql, args=params, **tables)
    return out.withColumnsRenamed(translations or {})


def extra(df: DataFrame, select: dict[str, str] | None = None, where: list[str] = (), order_by: list[Column] = (),
          tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """SQL fragments added to a query.

    ``tables`` are further tables, which fragments name as ``name.column``. A row comes
    once for each combination that fulfils ``where``, whose equalities become the join
    keys; without any condition there is nothing to join by, which is an error.
    """
    if tables:
        if not where:
            raise ValueError("further tables need a condition that joins them")
        own, df = df.columns, df.alias("__own")
        for name, table in tables.items():
            df = df.join(table.alias(name))
        for cond in where:
            df = df.where(cond)
        made = [F.expr(expr).alias(name) for name, expr in (select or {}).items()]
        df, select, where = df.select(*[F.col(f"__own.`{c}`") for c in own if c not in (select or {})], *made), None, ()
    for cond in where:
        df = df.where(cond)
    for name, expr in (select or {}).items():
        df = df.withColumn(name, F.expr(expr))
    return df.orderBy(*order_by) if order_by else df


def shaped(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns in order; a repeated name gets a counter: a, a2, a3."""
    out, seen = [], {}
    for c in columns:
        col = F.col(c) if isinstance(c, str) else c
        name = c if isinstance(c, str) else df.select(c).columns[0]
        seen[name] = seen.get(name, 0) + 1
        out.append(col.alias(name if seen[name] == 1 else f"{name}{seen[name]}"))
    return df.select(*out)


def as_dicts(df: DataFrame) -> Iterator[dict]:
    return (r.asDict() for r in iterate(df))


def flat(df: DataFrame, column: str) -> Iterator:
    return (r[0] for r in iterate(df.select(column)))


def iterate(df: DataFrame) -> Iterator:
    """Rows one partition at a time, the next one fetched ahead."""
    return df.toLocalIterator(prefetchPartitions=True)


def chunks(df: DataFrame, order: list[Column], size: int = 2000) -> DataFrame:
    """Chunk number on every row, for work done chunk by chunk in tasks."""
    if size < 1:
        raise ValueError("chunk size must be positive")
    rows = row_number(df, [], order, "__rn")
    return rows.withColumn("chunk", F.floor((F.col("__rn") - 1) / size).cast("bigint")).drop("__rn")
