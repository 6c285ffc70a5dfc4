"""Window functions that hold up when one partition has a third of the rows.

A plain window sends each partition to one task. Here rows are range-split by
(partition keys, order keys) into blocks; windows run inside blocks, and what
earlier blocks of the same partition contribute is carried over from one
summary row per (partition, block). A partition spans at most as many blocks
as there are tasks, so the carry-over itself stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.runtime import cut_lineage, null_safe_join

BLOCK, TIE = "__block", "__tie"
#: Rows a frame window takes together.
STRETCH = 100_000


def _cols(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def sort_keys(*names: str) -> list[Column]:
    """``name`` ascending with NULLs last, ``-name`` descending with NULLs first."""
    return [
        F.col(n[1:]).desc_nulls_first() if n.startswith("-") else F.col(n).asc_nulls_last()
        for n in names
    ]


def blocks(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Range-split rows; the block id is stored, as sampling may differ on a rerun.
    Rows of one order value are told apart by a hash, so that they may be split."""
    rows = df.withColumn(TIE, F.xxhash64(*_cols(df.columns)))
    split = rows.repartitionByRange(*_cols(keys), *order, F.col(TIE))
    return cut_lineage(split.withColumn(BLOCK, F.spark_partition_id()))


def _carry(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per (partition, block): totals over the earlier blocks of the partition."""
    w = Window.partitionBy(*_cols(keys)).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*keys, BLOCK).agg(*[c.alias(n) for n, c in sums.items()])
    return per.select(*keys, BLOCK, *[F.sum(n).over(w).alias(n) for n in sums])


def running(df: DataFrame, keys: list[str], order: list[Column], name: str = "row_number",
            sums: dict[str, str] | None = None) -> DataFrame:
    """Row number and running sums (ROWS from the start to the current row)."""
    sums = sums or {}
    rows = blocks(df, keys, order)
    carried = {"__n": F.count(F.lit(1))}
    carried |= {f"__s_{out}": F.sum(col) for out, col in sums.items()}
    before = _carry(rows, keys, carried)
    w = Window.partitionBy(*_cols(keys), F.col(BLOCK)).orderBy(*order, F.col(TIE))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn(name, F.row_number().over(w))
    for out, col in sums.items():
        local = local.withColumn(out, F.sum(col).over(upto))
    out_df = null_safe_join(local, before, [*keys, BLOCK], "left")
    out_df = out_df.withColumn(name, (F.col(name) + F.coalesce("__n", F.lit(0))).cast("bigint"))
    for out in sums:
        prior = F.col(f"__s_{out}")
        total = F.when(prior.isNull(), F.col(out)).otherwise(prior + F.coalesce(out, F.lit(0)))
        out_df = out_df.withColumn(out, total)
    return out_df.drop(BLOCK, TIE, *carried)


def row_number(df: DataFrame, keys: list[str], order: list[Column], name: str = "row_number") -> DataFrame:
    return running(df, keys, order, name)


def rank_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """row_number, rank, dense_rank, percent_rank, cume_dist and ``group_size``.

    ``order`` names columns, descending with a leading minus. Ties share their
    order values, so ranks come from one row per distinct value.
    """
    ties, sort = [o.lstrip("-") for o in order], sort_keys(*order)
    rows = running(df, keys, sort)
    peers = rows.groupBy(*keys, *ties).agg(
        F.min("row_number").alias("rank"), F.max("row_number").alias("__last")
    )
    peers = running(peers, keys, sort, "dense_rank")
    out = null_safe_join(rows, peers, [*keys, *ties])
    if keys:
        size = rows.groupBy(*keys).agg(F.count("*").alias("group_size"))
        out = null_safe_join(out, size, keys)
    else:
        out = out.withColumn("group_size", F.lit(rows.count()))
    n = F.col("group_size")
    return (
        out.withColumn("percent_rank", F.when(n > 1, (F.col("rank") - 1) / (n - 1)).otherwise(F.lit(0.0)))
        .withColumn("cume_dist", F.col("__last") / n)
        .drop("__last")
    )


def ntile(df: DataFrame, buckets: int, number: str = "row_number", size: str = "group_size", name: str = "ntile") -> DataFrame:
    """Bucket 1..buckets from a row number and a group size; larger buckets first."""
    if buckets < 1:
        raise ValueError("ntile needs a positive bucket count")
    rn, base, extra = F.col(number) - 1, F.floor(F.col(size) / buckets), F.col(size) % buckets
    head = extra * (base + 1)
    tile = F.when(rn < head, F.floor(rn / (base + 1))).otherwise(
        extra + F.floor((rn - head) / F.greatest(base, F.lit(1)))
    )
    return df.withColumn(name, (tile + 1).cast("bigint"))


def shifted(df: DataFrame, keys: list[str], number: str, value: str, name: str,
            offset: int, default: Column | None = None) -> DataFrame:
    """lag (offset > 0) or lead (offset < 0) by a join on the row number."""
    other = df.select(*keys, (F.col(number) + offset).alias(number), F.col(value).alias(name), F.lit(True).alias("__hit"))
    out = null_safe_join(df, other, [*keys, number], "left")
    if default is not None:
        out = out.withColumn(name, F.when(F.col("__hit").isNull(), default).otherwise(F.col(name)))
    return out.drop("__hit")


def nth_value(df: DataFrame, keys: list[str], number: str, value: str, n: int, name: str) -> DataFrame:
    """n-th value of the whole partition on every row."""
    if n < 1:
        raise ValueError("n counts from 1")
    picked = df.where(F.col(number) == n).select(*keys, F.col(value).alias(name))
    if not keys:
        row = picked.first()
        return df.withColumn(name, F.lit(row[0] if row else None).cast(df.schema[value].dataType))
    return null_safe_join(df, picked, keys, "left")


def _stretches(df: DataFrame, keys: list[str], number: str, start: int, end: int) -> DataFrame:
    """Rows cut into stretches of STRETCH by row number, with the rows that frames
    of [start, end] reach beyond a stretch copied to it.

    ``__own`` is a row's stretch, ``__at`` the one this copy serves.
    """
    own = F.floor((F.col(number) - 1) / STRETCH)
    low = F.floor((F.col(number) - 1 - max(end, 0)) / STRETCH)
    high = F.floor((F.col(number) - 1 - min(start, 0)) / STRETCH)
    at = F.explode(F.sequence(F.greatest(low, F.lit(0)), high))
    return df.withColumn("__own", own).withColumn("__at", at)


def framed(df: DataFrame, keys: list[str], number: str, start: int, end: int, **exprs: Column) -> DataFrame:
    """Window expressions over ROWS [start, end] around each row, both ends bounded.

    ``number`` is the row number in the partition. Spark's own windows run inside
    stretches, so sums, NULLs, first, last and n-th values are what they are there.
    """
    if start > end:
        raise ValueError("a frame cannot start after its end")
    rows = _stretches(df, keys, number, start, end)
    w = Window.partitionBy(*_cols(keys), F.col("__at")).orderBy(number).rowsBetween(start, end)
    rows = rows.select("*", *[e.over(w).alias(n) for n, e in exprs.items()])
    return rows.where("__own = __at").drop("__own", "__at")


def _plus(a: Column, b: Column) -> Column:
    """Sum in which NULL is nothing."""
    return F.coalesce(a + b, a, b)


def _onward(df: DataFrame, keys: list[str], place: Column, value: str, name: str) -> DataFrame:
    """(keys, __place, name): running sum of ``value`` along ``place`` (from 1)."""
    slim = df.select(*keys, place.alias("__place"), F.col(value).alias("__v"))
    slim = slim.withColumn("__at", F.floor((F.col("__place") - 1) / STRETCH))
    totals = slim.groupBy(*keys, "__at").agg(F.sum("__v").alias("__t"))
    earlier = Window.partitionBy(*_cols(keys)).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__at", F.sum("__t").over(earlier).alias("__before"))
    inside = Window.partitionBy(*_cols(keys), F.col("__at")).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    slim = slim.withColumn("__in", F.sum("__v").over(inside))
    out = null_safe_join(slim, totals, [*keys, "__at"])
    return out.select(*keys, "__place", _plus(F.col("__before"), F.col("__in")).alias(name))


def frame_sum(df: DataFrame, keys: list[str], number: str, value: str, size: str,
              start: int | None, end: int | None, name: str) -> DataFrame:
    """Sum of ``value`` over ROWS [start, end] around each row; None is an open end.

    NULL where the frame holds no value. ``size`` is the partition size. With one
    open end the sums run from that end, never as a difference of larger sums.
    """
    if start is not None and end is not None:
        return framed(df, keys, number, start, end, **{name: F.sum(value)})
    if start is None and end is None:
        start, end = None, 2**62  # the last row's running sum
    if start is None:
        sums = _onward(df, keys, F.col(number), value, name)
        place = F.least(F.col(number) + end, F.col(size)) if end < 2**62 else F.col(size)
    else:
        sums = _onward(df, keys, F.col(size) - F.col(number) + 1, value, name)
        place = F.least(F.col(size) - F.col(number) + 1 - start, F.col(size))
    return null_safe_join(df.withColumn("__place", place), sums, [*keys, "__place"], "left").drop("__place")


def peer_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Sum and count per peer group (same order value), for range frames and
    for frames that leave out the current row, its peers or its ties."""
    aggs = [F.sum(c).alias(n) for n, c in values.items()] + [F.count("*").alias("peers")]
    return null_safe_join(df, df.groupBy(*keys, *order).agg(*aggs), [*keys, *order])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], low: int, high: int) -> DataFrame:
    """Rows with low < row number <= high per group.

    A row-number filter is cut down before the shuffle (window group limit),
    so a hot group sends at most ``high`` rows per task.
    """
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    ranked = df.withColumn("row_number", F.row_number().over(w)).where(F.col("row_number") <= high)
    return ranked.where(F.col("row_number") > low)


def chunked_lists(df: DataFrame, keys: list[str], order: list[Column], item: Column,
                  size: int = 1000, name: str = "items") -> DataFrame:
    """Ordered lists per group, split into chunks of ``size`` so that no group
    has to fit into one row: (keys, chunk, items)."""
    rows = row_number(df, keys, order, "__rn")
    rows = rows.withColumn("chunk", F.floor((F.col("__rn") - 1) / size).cast("bigint"))
    packed = F.struct(F.col("__rn").alias("rn"), item.alias("v"))
    lists = rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(packed)).alias(name))
    return lists.withColumn(name, F.transform(name, lambda x: x["v"]))
