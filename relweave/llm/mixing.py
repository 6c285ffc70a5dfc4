"""Mixing sources to target weights by weighted fair queueing.

Each source sends its documents in shuffled order, twice over if need be. A
document's virtual finish time is its source's words up to and with it, over the
source's target. All documents are ordered by that time and the mix is cut where
the words reach the total budget, so every source has been served in proportion
to its target when the cut comes.

Running sums never pass one task: (source, hash bucket) sums give each bucket its
start, and virtual time is cut into bins whose sums show which bin holds the cut.

Edge cases: a NULL text has size 0, a NULL source is a source of its own, last in
order; documents of size 0 are taken if their time is before the cut; a source
without words has target 0 and takes nothing but empty documents; rows that
repeat a doc_id and text are separate documents in a stable order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relweave.llm.common import global_rank, word_count
from relweave.runtime import cut_lineage

#: Fixed by the contract: weights by source order, share of all words, times a document may come.
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_COPIES = 2
#: Rows a bucket or bin should hold; the number of buckets follows the table.
BUCKET_ROWS = 4096
#: Values a running sum takes in one run.
FAN = 1000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = MAX_COPIES) -> DataFrame:
    """Rows (place, source, source_size, target) from (source, size).

    Sources with more than ``cap`` times their size stop there, and what they
    leave is shared again by weight; only two sums per round reach the driver.
    """
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(grouped, "source", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = cut_lineage(ranked.select("place", "source", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("most")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        # a source is full if the level would lift it above its cap
        full = F.col("w") * F.lit(level) > F.col("most")
        spent, open_weight = table.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))
        ).first()
        if not open_weight:
            break
        raised = (share_percent / 100 * total - spent) / open_weight
        if raised <= level:
            break
        level = raised
    full = F.col("w") * F.lit(level) > F.col("most")
    target = F.when(full, F.col("most").cast("double")).otherwise(F.col("w") * F.lit(level))
    return table.select("place", "source", "source_size", target.alias("target"))


def _offsets(sums: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order, before): the sum of ``part`` over smaller ``order`` of the same keys.

    Runs of FAN values are summed first, so that a window sees FAN rows inside a
    run and one row per run above.
    """
    runs = sums.withColumn("__run", F.floor(F.col(order) / FAN))
    by_run = runs.groupBy(*keys, "__run").agg(F.sum("part").alias("__part"))
    above = Window.partitionBy(*keys).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_run.withColumn("__start", F.coalesce(F.sum("__part").over(above), F.lit(0))).drop("__part")
    inside = Window.partitionBy(*keys, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        runs.withColumn("__in", F.coalesce(F.sum("part").over(inside), F.lit(0)))
        .join(starts, [*keys, "__run"])
        .select(*keys, order, (F.col("__start") + F.col("__in")).alias("before"))
    )


def fair_queue(docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, cap: int = MAX_COPIES) -> DataFrame:
    """The mix, one row per distinct document row.

    (doc_id, tag, n_rows, size, source_size, target, laps): ``tag`` hashes all
    columns, so (doc_id, tag) names ``n_rows`` equal rows, and ``laps`` says how
    often the mix takes them together.
    """
    shuffled = F.conv(F.substring(F.md5(F.concat_ws("|", "doc_id", "source")), 1, 12), 16, 10).cast("long")
    items = cut_lineage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("tag"),
        ).withColumn("h", shuffled)
    )
    targets = cut_lineage(source_targets(items, weights, share_percent, cap))
    n = max(1, math.ceil(items.count() / BUCKET_ROWS))
    named = items.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")
    buckets = cut_lineage(named.withColumn("bucket", F.floor(F.col("h") / F.lit(float(2**48)) * n).cast("long")))
    starts = _offsets(buckets.groupBy("place", "bucket").agg(F.sum("size").alias("part")), ["place"], "bucket")
    upto = F.sum("size").over(
        Window.partitionBy("place", "bucket").orderBy("h", "doc_id", "tag").rowsBetween(Window.unboundedPreceding, 0)
    )
    lap = F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))
    queue = buckets.withColumn("upto", upto).join(starts, ["place", "bucket"]).withColumn("lap", lap)
    served = F.col("before") + F.col("upto") + F.col("lap") * F.col("source_size")
    finish = F.when(F.col("target") > 0, served / F.col("target")).otherwise(F.col("lap").cast("double"))
    at = F.least(F.floor(F.col("finish") * n), F.lit(4 * n)).cast("long")
    queue = cut_lineage(
        queue.withColumn("finish", finish).withColumn("bin", at)
        .select("doc_id", "tag", "size", "place", "h", "source_size", "target", "lap", "finish", "bin")
    )
    bins = queue.groupBy("bin").agg(F.sum("size").alias("part")).withColumn("all", F.lit(0))
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    budget = F.lit(min(share_percent * total / 100, float(cap * total)))
    state = F.when(F.col("before") + F.col("part") <= budget, 1).when(F.col("before") <= budget, 0).otherwise(-1)
    cuts = bins.join(_offsets(bins, ["all"], "bin").drop("all"), "bin").select("bin", "before", state.alias("state"))
    queue = queue.join(cuts, "bin")
    order = Window.partitionBy("bin").orderBy("finish", "lap", "place", "h", "doc_id", "tag").rowsBetween(Window.unboundedPreceding, 0)
    edge = queue.where("state = 0").withColumn("upto", F.col("before") + F.sum("size").over(order))
    rest = queue.where("state != 0").withColumn("upto", F.lit(None).cast("long"))
    taken = F.when(F.col("state") == 0, F.col("upto") <= budget).otherwise(F.col("state") == 1).cast("long")
    return (
        edge.unionByName(rest)
        .groupBy("doc_id", "tag", "size", "source_size", "target")
        .agg(F.sum(F.when(F.col("lap") == 0, 1).otherwise(0)).alias("n_rows"), F.sum(taken).alias("laps"))
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per document row."""
    one = F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("nth")
    laps = F.expr("laps div n_rows + if(nth <= laps % n_rows, 1, 0)")
    return (
        fair_queue(docs).select("*", one)
        .select("doc_id", "size", "source_size", "target", (F.col("size") * laps).cast("long").alias("taken"))
    )


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it."""
    queue = fair_queue(docs).where("laps > 0").select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), "n_rows", "laps")
    queue = queue.select("__id", "__tag", F.col("n_rows").alias("__rows"), F.col("laps").alias("__laps"))
    tag = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    nth = F.row_number().over(Window.partitionBy("__id", "__tag").orderBy(F.lit(0)))
    joined = docs.withColumn("__own", tag).join(
        queue, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__tag"))
    )
    # equal rows share their laps; only they need numbering
    single = joined.where("__rows = 1").withColumn("__n", F.lit(1))
    several = joined.where("__rows > 1").withColumn("__n", nth)
    times = F.expr("cast(__laps div __rows + if(__n <= __laps % __rows, 1, 0) as int)")
    return (
        single.unionByName(several).withColumn("__times", times).where("__times > 0")
        .withColumn("__lap", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
