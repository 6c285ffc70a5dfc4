"""Trees of prefetched children: every level reads only what the level above reached.

A level has its own rows (filtered as the caller likes), order and, if wanted, a
number of children each parent takes. Lists of at most ``take`` children are nested
into their parents, from the lowest level up. Lists without such a bound stay beside
them in chunks, so that no parent has to fit into one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.operators.windows import chunked_lists, sort_keys


@dataclass(frozen=True)
class Prefetch:
    """Children ``rows`` whose ``key`` equals the parent's ``parent_key``.

    ``fields`` are the columns a child's struct holds, ``order`` its place among its
    siblings (``-name`` descends; name a unique column last, else ties fall as they
    may), ``take`` the most children a parent gets, ``inner`` the next level's trees.
    """

    name: str
    rows: DataFrame
    key: str
    parent_key: str
    fields: tuple[str, ...]
    order: tuple[str, ...]
    take: int | None = None
    inner: tuple["Prefetch", ...] = ()


def prefetch(parents: DataFrame, *trees: Prefetch, chunk: int = 1000) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(parents, lists): parents with an array column per bounded tree, and the others' chunks.

    A parent without children has an empty array. ``lists`` has, under the names of its
    levels joined by ``__``, the rows (key, chunk, name) of each tree without ``take``;
    a parent without children has none there. A NULL key has no children. Children of
    several parents (a key that repeats above) are read once.
    """
    lists: dict[str, DataFrame] = {}
    return _with_children(parents, trees, "", chunk, lists), lists


def _with_children(parents: DataFrame, trees: tuple[Prefetch, ...], above: str, chunk: int, lists: dict[str, DataFrame]) -> DataFrame:
    for tree in trees:
        path = f"{above}__{tree.name}" if above else tree.name
        wanted = parents.select(F.col(tree.parent_key).alias("__wanted")).distinct()
        reached = tree.rows.join(wanted, F.col(tree.key) == F.col("__wanted"), "left_semi")
        if tree.take is not None:
            nth = F.row_number().over(Window.partitionBy(tree.key).orderBy(*sort_keys(*tree.order)))
            reached = reached.withColumn("__nth", nth).where(F.col("__nth") <= tree.take)
        reached = _with_children(reached, tree.inner, path, chunk, lists)
        item = F.struct(*tree.fields, *[t.name for t in tree.inner if t.take is not None])
        if tree.take is None:
            lists[path] = chunked_lists(reached, [tree.key], sort_keys(*tree.order), item, chunk, tree.name)
        else:
            parents = _nested(parents, reached, tree, item)
    return parents


def _nested(parents: DataFrame, reached: DataFrame, tree: Prefetch, item: Column) -> DataFrame:
    packed = reached.select(F.col(tree.key).alias("__key"), F.struct("__nth", item.alias("v")).alias("p"))
    whole = packed.groupBy("__key").agg(F.array_sort(F.collect_list("p")).alias("__list"))
    items = whole.select("__key", F.transform("__list", lambda x: x["v"]).alias(tree.name))
    kind = items.schema[tree.name].dataType
    joined = parents.join(items, F.col(tree.parent_key) == F.col("__key"), "left").drop("__key")
    return joined.withColumn(tree.name, F.coalesce(tree.name, F.array().cast(kind)))
