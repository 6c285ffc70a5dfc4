"""Helpers the corpus operators share: worker state, ranks, connected components."""

from __future__ import annotations

import gc
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relweave.runtime import cut_lineage, scratch_path

#: What a word is, wherever an operator counts words.
WORD = r"[^\x20\x09-\x0D]+"
#: Members from which a bucket is crowded.
CROWD = 32
#: Rows of a settled table that make a part.
PART_ROWS = 500_000


def worker_state(name: str, make):
    """Object kept for the life of a Python worker, which serves many tasks.

    Task functions travel by value, so module globals start empty in each task;
    vocabularies and caches live here instead and are loaded once per worker.
    """
    home = sys.modules.setdefault("_relweave_worker_state", types.ModuleType("_relweave_worker_state"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def word_count(text: Column) -> Column:
    """Number of words in a text; NULL counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, column: str, rank: str) -> DataFrame:
    """0-based position of each row in the order of a distinct ``column``, NULL last.

    Rows are range-split; one count per range carries over, so no task sees
    more than a range.
    """
    ranges = cut_lineage(
        df.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("__range", F.spark_partition_id())
    )
    counts = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(F.col(column).asc_nulls_last()))
    return (
        ranges.join(starts, "__range")
        .withColumn(rank, F.col("__before") + inside - 1)
        .drop("__range", "__before")
    )


def settled(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in as many parts as its rows need, which later shuffles start from."""
    out = cut_lineage(df)
    parts = out.rdd.getNumPartitions()
    rows = out.coalesce(max(1, parts // 16)).count()
    return out.coalesce(max(1, min(parts, 1 + rows // PART_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the smallest node.

    Alternating large and small stars: every round each node's neighbours are
    hooked to the least node around. Minima combine before the shuffle and the
    joins are plain equi-joins, so a node with very many neighbours is split by
    AQE. Nodes without an edge to another node give no row. Each round is a
    reliable checkpoint; only a count and a checksum reach the driver.
    """
    links = settled(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = settled(small.unionByName(root.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = _mark(links)
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def linked_in_buckets(members: DataFrame, verify, crowded=None) -> DataFrame:
    """Links that connect all similar members of common buckets: rows (a, b).

    ``members`` has distinct (key, id, weight); ``verify`` keeps the distinct
    similar pairs of a frame (a, b). First every member meets the heaviest member
    of its bucket. Then members meet pairwise only if the first links left them in
    different components. So a bucket of copies costs one row each, and pairs left
    out are connected already. ``crowded`` may find the similar pairs of different
    roots in another exact way, from the (id, root) of all members of buckets over
    CROWD; before it does, such buckets meet further members, one a round, as long
    as a round settles a fifth of what was open.
    """
    pivot = members.groupBy("key").agg(F.max(F.struct("weight", "id"))["id"].alias("b"))
    star = settled(verify(members.select("key", F.col("id").alias("a")).join(pivot, "key").where("a != b").select("a", "b")))
    roots = components(star)
    named = members.join(roots, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    open_rows = settled(_open(named))
    few = open_rows if crowded is None else open_rows.where(F.col("k") <= CROWD)
    left = few.select("key", F.col("id").alias("a"), F.col("root").alias("ra"))
    right = few.select("key", F.col("id").alias("b"), F.col("root").alias("rb"))
    links = star.unionByName(verify(left.join(right, "key").where("ra < rb").select("a", "b")))
    if crowded is None:
        return links
    crowd = open_rows.where(F.col("k") > CROWD).drop("k")
    waiting, turn = crowd.count(), 0
    while waiting:
        turn += 1
        # any member serves: one of a large component comes up most often
        lead = crowd.groupBy("key").agg(F.max(F.struct(F.xxhash64("id", F.lit(turn)), "id", "root")).alias("p"))
        apart = crowd.join(lead, "key").where("root != p.root").select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
        met = settled(verify(apart))
        links = links.unionByName(met)
        of = lambda name: crowd.select(F.col("id").alias(name), F.col("root").alias(f"r{name}")).distinct()
        joined = met.join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        lifted = components(joined).select(F.col("node").alias("old"), F.col("root").alias("new"))
        moved = crowd.join(lifted, F.col("root") == F.col("old"), "left").select("key", "id", F.coalesce("new", "root").alias("root"))
        crowd = settled(_open(moved).drop("k"))
        now = crowd.count()
        if now > 0.8 * waiting:
            break
        waiting = now
    return links.unionByName(crowded(crowd.select("id", "root").distinct()))


def _open(named: DataFrame) -> DataFrame:
    """Rows (key, id, root) of the buckets with several roots, with their size ``k``."""
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo < hi")
    return named.join(mixed.select("key", "k"), "key")


def let_go(spark: SparkSession) -> None:
    """Has the driver drop plans nobody holds any more, and with them the shuffle files
    they left on the executors, which else stay until its memory happens to run low."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again; what led to it is let go."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    let_go(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes ``stored`` tables that no later plan reads. Results derived from them must
    be stored before."""
    spark = tables[0].sparkSession
    for path in {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    let_go(spark)


def wider(df: DataFrame, **types: str) -> StructType:
    """Schema of ``df`` with further columns behind, leaving the frame's own alone."""
    more = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in types.items()))
    return StructType([*df.schema.fields, *more.fields])
