"""Closures and orders over the call graph, many start functions at once.

Each round works on the new frontier only and is checkpointed, so a lost
executor costs one round. Rounds end when nothing new is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.operators.resolve import resolve_basic
from relweave.runtime import stored

# Driver functions left out of scored results unless certain.
ORCHESTRATION = (
    "main", "run_basic_analysis", "run_advanced_analysis", "run_comprehensive_pipeline",
    "compare_analysis_approaches", "generate_sample_data",
)


def reach(starts: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, name, depth): everything reachable over edges(source, target);
    depth is the fewest steps. The start itself has depth 0."""
    step = stored(edges.select("source", "target").distinct())
    frontier = stored(starts.select("start", F.col("start").alias("name"), F.lit(0).alias("depth")).distinct())
    seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = frontier.join(step, frontier["name"] == step["source"])
        new = new.select("start", F.col("target").alias("name")).distinct()
        new = new.join(seen.hint("merge"), ["start", "name"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = stored(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # each part is stored; nothing is rewritten
    return seen


def basic_edges(functions: DataFrame) -> DataFrame:
    """Resolved call edges (source, call, target)."""
    calls = functions.select(F.col("name").alias("source"), F.explode("calls").alias("call"))
    return resolve_basic(calls, functions)


def dependency_closure(starts: DataFrame, functions: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(start, name, depth) of resolved calls; unknown starts give no rows."""
    edges = basic_edges(functions) if edges is None else edges
    known = starts.join(functions.select(F.col("name").alias("start")), "start", "left_semi")
    return reach(known, edges.where(F.col("target").isNotNull()))


def raw_calls(closure: DataFrame, functions: DataFrame) -> DataFrame:
    """(start, call): all calls, resolved or not, of the reached functions."""
    calls = functions.select("name", F.explode("calls").alias("call"))
    return closure.join(calls, "name").select("start", "call").distinct()


def scored_closure(starts: DataFrame, matches: DataFrame, max_depth: int = 5, min_confidence: float = 0.3,
                   comprehensive: bool = True, excluded: tuple[str, ...] = ORCHESTRATION,
                   functions: DataFrame | None = None) -> DataFrame:
    """(start, name): the start and the targets matched within ``max_depth``
    levels. Orchestration names stay only if matched with 0.9 or more. Starts
    that are no name in ``functions``, if given, yield no row."""
    if functions is not None:
        starts = starts.join(functions.select(F.col("name").alias("start")), "start", "left_semi")
    used = matches if comprehensive else matches.where(F.col("confidence") > min_confidence)
    seen = reach(starts, used, max_depth - 1)
    hit = seen.join(used, seen["name"] == used["source"]).select("start", "target", "confidence")
    hit = hit.where(~F.col("target").isin(*excluded) | (F.col("confidence") >= 0.9))
    out = hit.select("start", F.col("target").alias("name"))
    return out.unionByName(starts.select("start", F.col("start").alias("name"))).distinct()


def peel(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of (start, name) under edges(start, name, needs): a member's level
    is one above the last of its needs. Members on or behind a cycle get NULL."""
    keys = ["start", "name"]
    inside = edges.join(members.select("start", F.col("name").alias("needs")), ["start", "needs"], "left_semi")
    inside = stored(inside.join(members.select(*keys), keys, "left_semi").select(*keys, "needs").distinct())
    left = stored(members.select(*keys).distinct())
    done, level = None, 0
    while True:
        ready = left.join(inside.select(*keys).distinct(), keys, "left_anti").withColumn("level", F.lit(level))
        ready = stored(ready)
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = stored(left.join(ready.select(*keys), keys, "left_anti"))
        if left.isEmpty():
            break
        gone = ready.select("start", F.col("name").alias("needs"))
        inside = stored(inside.join(gone, ["start", "needs"], "left_anti"))
        level += 1
    stuck = left.withColumn("level", F.lit(None).cast("int"))
    return stuck if done is None else done.unionByName(stuck)


def topo_order(closure: DataFrame, functions: DataFrame) -> DataFrame:
    """(start, name, level) counting only calls equal to a function's name;
    members of cycles get level NULL and are dropped by ``ordered``.

    A closure holds whatever its members call by name, so a function has the same
    level and the same cycles under every start. They are worked out once per
    function and joined to the closure.
    """
    one = F.lit(0).alias("start")
    edges = functions.select(one, "name", F.explode("calls").alias("needs"))
    levels = stored(peel(functions.select(one, "name"), edges).select("name", "level"))
    return closure.select("start", "name").distinct().join(levels, "name").select("start", "name", "level")


def ordered(levels: DataFrame) -> DataFrame:
    return levels.where(F.col("level").isNotNull())


def cycle_members(levels: DataFrame) -> DataFrame:
    return levels.where(F.col("level").isNull()).select("start", "name")


def topo_order_scored(members: DataFrame, matches: DataFrame, min_confidence: float = 0.3) -> DataFrame:
    """Same over the best match of each call that lies among the members;
    members left over are appended after the last level."""
    good = matches.where(F.col("confidence") > min_confidence).select(F.col("source").alias("name"), "call", "target", "position")
    inside = members.join(good, "name")
    inside = inside.join(members.select("start", F.col("name").alias("target")), ["start", "target"], "left_semi")
    best = inside.groupBy("start", "name", "call").agg(F.min_by("target", "position").alias("needs"))
    levels = peel(members, best.select("start", "name", "needs"))
    last = levels.groupBy("start").agg(F.coalesce(F.max("level"), F.lit(-1)).alias("top"))
    out = levels.join(last, "start")
    return out.select("start", "name", F.coalesce("level", F.col("top") + 1).alias("level"), F.col("level").isNull().alias("in_cycle"))


def dependency_report(levels: DataFrame, functions: DataFrame) -> DataFrame:
    """Ordered dependency rows with what is known of each function."""
    cols = ["file_path", "line_number", "signature", "source_code", "docstring", "complexity_score", "parameter_types", "return_type"]
    out = levels.join(functions.select("name", *cols), "name")
    return out.select("start", "level", "name", *cols).orderBy("start", "level", "name")
