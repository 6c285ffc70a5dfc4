"""Exact top-k by inner product in three phases with a uniform threshold.

A vector's components are split into slices; each slice of each block of vectors
is a node that knows one part of the score. Phase 1: every node hands in its best
entries and its least part score per query. The totals of these entries give a
safe cutoff: the k-th best of them can't be above the true k-th best. Phase 2: a
total that reaches the cutoff has some slice that reaches its slice's floor plus
an equal share of the slack; nodes hand in all entries that do. Phase 3: entries
whose upper bound misses the cutoff go, the missing parts of the others are
resolved from the vectors, and the final rank is exact.

Both sides are packed into blocks of bounded size, and each query block meets
each vector block of its slice once. Equal vectors are one candidate that carries
its ``k + 1`` least ids, so a vector shared by a third of all rows costs one.

Edge cases: vectors that are NULL or empty or hold a NULL or a non-finite
component take no part, nor do rows without an id; vectors only meet vectors of
their own length; ties go to the smaller id; rows that repeat an id count each.
Inner products must fit a long.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.runtime import cut_lineage

SCALE = 1024
BLOCK_ROWS = 1024


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (vec_id, v array<long>) of the vectors that take part."""
    x = F.col("x")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
        .where(F.col("vec_id").isNotNull() & good)
        .select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))
    )


def _blocks(rows: DataFrame, slices: int, block: str, extra: list[str]) -> DataFrame:
    """One packed row per (dim, slice, block): ids, the slice's components, ``extra``.

    The block of a row comes from its hash and the count of rows, so that a block
    holds about BLOCK_ROWS of them whatever the size of the table.
    """
    n = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    width = F.ceil(F.col("dim") / slices).cast("int")
    part = F.slice("v", F.col("slice") * width + 1, width)
    return (
        rows.withColumn(block, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        .groupBy("dim", "slice", block)
        .agg(F.collect_list(F.struct("id", part.alias("part"), *[F.col(f"extra.{c}").alias(c) for c in extra])).alias(f"{block}_rows"))
    )


def _unpack(column, i, names):
    """Ids, float64 or int64 matrix and further fields of packed row ``i``."""
    import numpy as np

    items = column[i].values
    ids = items.field("id").to_numpy(zero_copy_only=False)
    parts = items.field("part")
    flat = parts.flatten().to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(ids), len(flat) // len(ids))
    return ids, matrix.astype(np.int64), [items.field(c).to_numpy(zero_copy_only=False) for c in names]


def _scores(q, c):
    """Inner products as int64; by floats only where these are exact."""
    import numpy as np

    if q.size == 0 or c.size == 0:
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
    if bound < 2.0**52:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _best(pairs):
    """Phase 1 on one node: per query its best entries and its least part score."""
    import numpy as np
    import pyarrow as pa

    for batch in pairs:
        for i in range(batch.num_rows):
            top = batch.column("top")[i].as_py()
            qi, q, _ = _unpack(batch.column("qblock_rows"), i, [])
            ci, c, _ = _unpack(batch.column("block_rows"), i, [])
            s = _scores(q, c)
            k = min(top, len(ci))
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(qi, k)),
                    pa.array(ci[at].ravel()),
                    pa.array(np.full(len(qi) * k, batch.column("slice")[i].as_py(), np.int32)),
                    pa.array(np.take_along_axis(s, at, 1).ravel()),
                    pa.array(np.repeat(s.min(axis=1), k)),
                ],
                names=["q", "c", "slice", "score", "floor"],
            )


def _reaching(pairs):
    """Phase 2 on one node: all entries that reach their query's threshold."""
    import numpy as np
    import pyarrow as pa

    for batch in pairs:
        for i in range(batch.num_rows):
            k = batch.column("slice")[i].as_py()
            qi, q, (needs,) = _unpack(batch.column("qblock_rows"), i, ["needs"])
            ci, c, _ = _unpack(batch.column("block_rows"), i, [])
            s = _scores(q, c)
            floor = np.array([n[k] for n in needs], np.float64)
            a, b = np.nonzero(s >= floor[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(qi[a]), pa.array(ci[b]), pa.array(np.full(len(a), k, np.int32)), pa.array(s[a, b])],
                names=["q", "c", "slice", "score"],
            )


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, slices: int = 2) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for quantised (vec_id, v) tables.

    A candidate with the query's own id is left out.
    """
    dim = F.size("v").alias("dim")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = candidates.groupBy("v", "vec_id").agg(F.count("*").alias("n")).withColumn("nth", nth).where(F.col("nth") <= k + 1)
    counted = F.sort_array(F.collect_list(F.struct("vec_id", F.least("n", F.lit(k)).cast("int").alias("n"))))
    reps = cut_lineage(
        few.groupBy("v").agg(F.flatten(F.transform(counted, lambda x: F.array_repeat(x["vec_id"], x["n"]))).alias("ids"))
        .select(F.monotonically_increasing_id().alias("id"), "v", "ids", dim, F.struct().alias("extra"))
    )
    asked = cut_lineage(
        queries.select("vec_id", "v").select(F.monotonically_increasing_id().alias("id"), "vec_id", "v", dim, F.struct().alias("extra"))
    )
    vectors = cut_lineage(_blocks(reps, slices, "block", []))
    blocks = asked.select("id", "v", "dim", "extra")

    def meet(packed_queries):
        return vectors.join(packed_queries, ["dim", "slice"]).repartition("dim", "slice", "block", "qblock")

    packed = _blocks(blocks, slices, "qblock", [])
    entries = cut_lineage(
        meet(packed).select("slice", F.lit(k + 1).alias("top"), "qblock_rows", "block_rows")
        .mapInArrow(_best, "q long, c long, slice int, score long, floor long")
    )

    def exact(pairs):
        """Score of (q, c) pairs from the vectors themselves, with ids."""
        dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)
        return (
            pairs.join(asked.select(F.col("id").alias("q"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "q")
            .join(reps.select(F.col("id").alias("c"), "v", "ids"), "c")
            .select("q", "query_id", dot.alias("score"), "ids")
        )

    def ranked(scored):
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        return (
            scored.withColumn("vec_id", F.explode("ids"))
            .where("vec_id != query_id")
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
        )

    cutoff = ranked(exact(entries.select("q", "c").distinct())).where(F.col("rank") == k).select("q", F.col("score").alias("cut"))
    floors = entries.groupBy("q", "slice").agg(F.min("floor").alias("floor"))
    floors = floors.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("slice", "floor"))).alias("f"))
    low = F.aggregate("f", F.lit(0).cast("long"), lambda a, b: a + b["floor"])
    share = (F.col("cut") - low) / F.lit(float(slices))
    needs = F.transform("f", lambda x: F.when(F.col("cut").isNull(), F.lit(float("-inf"))).otherwise(x["floor"] + share))
    bounds = cut_lineage(floors.join(cutoff, "q", "left").select("q", "cut", needs.alias("needs")))
    informed = blocks.join(bounds, F.col("id") == F.col("q")).select("id", "v", "dim", F.struct("needs").alias("extra"))
    found = (
        meet(_blocks(informed, slices, "qblock", ["needs"]))
        .select("slice", "qblock_rows", "block_rows")
        .mapInArrow(_reaching, "q long, c long, slice int, score long")
    )
    known = found.groupBy("q", "c").agg(F.sum("score").alias("sum"), F.collect_list("slice").alias("seen"))
    missing = F.aggregate(
        F.transform("needs", lambda x, i: F.when(F.array_contains("seen", i), F.lit(0.0)).otherwise(x)),
        F.lit(0.0), lambda a, b: a + b,
    )
    alive = known.join(bounds, "q").where(F.col("cut").isNull() | (F.col("sum") + missing >= F.col("cut")))
    final = ranked(exact(alive.select("q", "c")))
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
