"""Dated URL lists: validity intervals and an as-of join, in DataFrame operations only.

A list is a history of dated entries: from its date on, an ``add`` makes a pattern
count and a ``remove`` ends it. Histories become half-open intervals; a capture
meets, by equality on host and path patterns of any depth, the entries active when
it was fetched.

Edge cases: of several entries of one pattern and list on one date the removal
wins; a history that opens with a removal has no interval before its first add;
an entry with a NULL field is void; a capture with a NULL or unparsable URL or a
NULL fetch time is kept and meets no entry; rows that repeat a ``capture_id`` are one
capture if URL and time are equal, and otherwise each is judged by its own, and each
gets its row; one without an id is judged as well. Entries count once however often
they are listed. Other columns are carried along, but columns named like a result
give way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, pattern, dated, action) -> (list, verdict, pattern, start, stop); stop NULL = open."""
    history = (
        entries.dropna(subset=["list", "verdict", "pattern", "dated", "action"])
        .groupBy("list", "verdict", "pattern", "dated")
        .agg(F.min(F.col("action") == "add").alias("on"))
    )
    nxt = F.lead("dated").over(Window.partitionBy("list", "verdict", "pattern").orderBy("dated"))
    return (
        history.withColumn("stop", nxt).where("on").select("list", "verdict", "pattern", F.col("dated").alias("start"), "stop")
    )


def host_of(url):
    """Lower-case host of a URL without user, port and a closing dot; NULL if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(host, r"\.$", "")), F.lit(""))


def path_of(url):
    """Path of a URL, at least '/'."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def patterns_of(url):
    """Every pattern a URL can match, most specific last.

    Host patterns are the host and its parent domains from two labels up
    (``a.b.c`` gives ``b.c``, ``a.b.c``); path patterns are the host with each folder
    of the path (``a.b.c/de/``, ``a.b.c/de/fg/``) and with the whole path
    (``a.b.c/de/fg/page.html``).
    """
    labels = F.split(host_of(url), r"\.")
    size = F.size(labels)
    at_least = F.greatest(F.lit(1), F.least(F.lit(2), size))
    suffix = F.transform(F.sequence(at_least, size), lambda n: F.array_join(F.slice(labels, size - n + 1, n), "."))
    # '/de/fg/page.html' is split into '', 'de', 'fg', 'page.html': the last part is no folder
    parts = F.split(path_of(url), "/")
    depth = F.size(parts)
    folders = F.transform(F.sequence(F.lit(2), F.greatest(depth - 1, F.lit(2))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    folders = F.when(depth > 2, folders).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.element_at(parts, -1) != "", F.array(F.array_join(parts, "/"))).otherwise(F.array().cast("array<string>"))
    paths = F.transform(F.concat(folders, whole), lambda p: F.concat(host_of(url), p))
    return F.when(host_of(url).isNull(), F.array().cast("array<string>")).otherwise(F.concat(suffix, F.array_distinct(paths)))


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with n_active, matched (list:pattern of the deciding entry) and blocked.

    The most specific active pattern decides: more labels first, a path before
    its host; on one pattern an allowing list beats a blocking one.
    """
    asked = captures.select("url", "fetched").distinct().select("url", "fetched", F.explode(patterns_of(F.col("url"))).alias("asked_pattern"))
    spans = intervals(entries)
    active = asked.join(
        spans,
        (F.col("asked_pattern") == F.col("pattern")) & (F.col("start") <= F.col("fetched"))
        & (F.col("stop").isNull() | (F.col("fetched") < F.col("stop"))),
    )
    rank = F.struct(
        F.contains(F.col("pattern"), F.lit("/")).cast("int").alias("path"),
        F.length("pattern").alias("size"),
        (F.col("verdict") == "allow").cast("int").alias("allow"),
        F.col("list"), F.col("pattern"),
    )
    decided = active.groupBy(F.col("url").alias("__url"), F.col("fetched").alias("__at")).agg(F.count("*").alias("__n"), F.max(rank).alias("__top"))
    kept = [F.col(f"`{c}`") for c in captures.columns if c not in ("n_active", "matched", "blocked")]
    return captures.join(decided, (F.col("url") == F.col("__url")) & (F.col("fetched") == F.col("__at")), "left").select(
        *kept,
        F.coalesce("__n", F.lit(0)).alias("n_active"),
        F.concat_ws(":", "__top.list", "__top.pattern").alias("matched"),
        F.coalesce(F.col("__top.allow") == 0, F.lit(False)).alias("blocked"),
    )
