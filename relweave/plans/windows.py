"""Window functions; all of them stay even when one customer holds most orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.operators import windows as win
from relweave.plans.registry import Data, query

BY = ["o_custkey"]
ORDER = ["-o_totalprice", "o_orderkey"]


def slim(d: Data):
    return d.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


def ranked(d: Data):
    return win.rank_rows(slim(d), BY, ORDER)


@query("row_number_rank_dense_rank", """
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr FROM orders
WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)""")
def row_number_rank_dense_rank(d: Data):
    base = d.orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    rank = win.rank_rows(base, ["o_orderpriority"], ["o_orderdate"])
    rank = rank.select("o_orderkey", F.col("rank").alias("rk"), F.col("dense_rank").alias("dr"))
    num = win.row_number(base, ["o_orderpriority"], win.sort_keys("o_orderdate", "o_orderkey"), "rn")
    return num.select("o_orderkey", "rn").join(rank, "o_orderkey")


@query("percent_rank_cume_dist_ntile", """
SELECT o_orderkey, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, ntile(4) OVER w AS tile FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def percent_rank_cume_dist_ntile(d: Data):
    out = win.ntile(ranked(d), 4, name="tile")
    return out.select("o_orderkey", F.round("percent_rank", 8).alias("pr"), F.round("cume_dist", 8).alias("cd"), "tile")


@query("lag_lead", """
SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, -1.0) OVER w AS next2 FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lag_lead(d: Data):
    rows = win.row_number(slim(d), BY, win.sort_keys("o_orderdate", "o_orderkey"))
    rows = win.shifted(rows, BY, "row_number", "o_totalprice", "prev", 1)
    rows = win.shifted(rows, BY, "row_number", "o_totalprice", "next2", -2, F.lit(-1.0))
    return rows.select("o_orderkey", "prev", "next2")


@query("first_last_nth_value", """
SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key, nth_value(o_orderkey, 2) OVER w AS second_key FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def first_last_nth_value(d: Data):
    """Whole-partition frame: ordered minima and maxima per key, joined back."""
    order = F.struct("o_orderdate", "o_orderkey")
    ends = slim(d).groupBy(*BY).agg(
        F.min_by("o_orderkey", order).alias("first_key"), F.max_by("o_orderkey", order).alias("last_key"))
    rows = win.row_number(slim(d), BY, win.sort_keys("o_orderdate", "o_orderkey"))
    rows = win.nth_value(rows, BY, "row_number", "o_orderkey", 2, "second_key")
    return rows.join(ends, BY).select("o_orderkey", "first_key", "last_key", "second_key")


@query("aggregate_over_window", """
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, count(*) OVER w AS n, round(o_totalprice / sum(o_totalprice) OVER w, 6) AS share
FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def aggregate_over_window(d: Data):
    per = d.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"), F.count("*").alias("n"))
    out = slim(d).join(per, BY)
    share = F.round(F.col("o_totalprice") / F.col("t"), 6).alias("share")
    return out.select("o_orderkey", F.round("t", 2).alias("total"), "n", share)


@query("row_range_frame", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3,
 round(sum(o_totalprice) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 2) AS next2,
 round(sum(o_totalprice) OVER (w ROWS BETWEEN 2 FOLLOWING AND 3 FOLLOWING), 2) AS after,
 round(sum(o_totalprice) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING), 2) AS before,
 round(sum(o_totalprice) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 2) AS rest,
 first_value(o_orderkey) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS first_near,
 nth_value(o_orderkey, 3) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS third_near,
 round(sum(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS upto
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def row_range_frame(d: Data):
    rows = win.running(slim(d), BY, win.sort_keys("o_orderdate", "o_orderkey"), sums={"upto": "o_totalprice"})
    price = F.sum("o_totalprice")
    size = slim(d).groupBy(*BY).agg(F.count("*").alias("group_size"))
    rows = rows.join(size, BY)
    rows = win.framed(rows, BY, "row_number", -2, 0, last3=price)
    rows = win.framed(rows, BY, "row_number", 0, 1, next2=price)
    rows = win.framed(rows, BY, "row_number", 2, 3, after=price)
    rows = win.framed(rows, BY, "row_number", -3, -2, before=price)
    rows = win.framed(rows, BY, "row_number", -1, 1, first_near=F.first("o_orderkey"), third_near=F.nth_value("o_orderkey", 3))
    rows = win.frame_sum(rows, BY, "row_number", "o_totalprice", "group_size", 1, None, "rest")
    sums = [F.round(c, 2).alias(c) for c in ("last3", "next2", "after", "before", "rest", "upto")]
    return rows.select("o_orderkey", *sums, "first_near", "third_near")


@query("value_range_frame", """
SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS upto,
 round(sum(value) OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts) RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2) AS onward FROM events""")
def value_range_frame(d: Data):
    """Peers (same day) enter the frame together: sum per peer group first,
    then run over the few distinct days."""
    ev = d.events.select("event_id", "event_type", "value", F.to_date("ts").alias("day"))
    per = ev.groupBy("event_type", "day").agg(F.sum("value").alias("v"))
    run = win.running(per, ["event_type"], win.sort_keys("day"), sums={"upto": "v"})
    total = per.groupBy("event_type").agg(F.sum("v").alias("total"))
    run = run.join(total, "event_type").withColumn("onward", F.col("total") - F.col("upto") + F.col("v"))
    out = ev.join(run, ["event_type", "day"])
    return out.select("event_id", F.round("upto", 2).alias("upto"), F.round("onward", 2).alias("onward"))


_EXCLUDED = ", ".join(
    f"""round(coalesce(sum(value) OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts)
 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {kind}), 0), 2) AS {name}"""
    for kind, name in [("CURRENT ROW", "no_row"), ("GROUP", "no_group"), ("TIES", "no_ties"), ("NO OTHERS", "no_others")]
)


@query("frame_exclusion", f"SELECT event_id, {_EXCLUDED} FROM events")
def frame_exclusion(d: Data):
    """Whole-partition frame minus the row, its peer group, or its ties."""
    ev = d.events.select("event_id", "event_type", "value", F.to_date("ts").alias("day"))
    total = ev.groupBy("event_type").agg(F.sum("value").alias("t"))
    out = win.peer_sums(ev, ["event_type"], ["day"], {"p": "value"}).join(total, "event_type")
    r = lambda c, n: F.round(c, 2).alias(n)
    return out.select(
        "event_id", r(F.col("t") - F.col("value"), "no_row"), r(F.col("t") - F.col("p"), "no_group"),
        r(F.col("t") - F.col("p") + F.col("value"), "no_ties"), r(F.col("t"), "no_others"))


@query("filter_on_window", """
SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 3""")
def filter_on_window(d: Data):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return slim(d).withColumn("r", F.rank().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")
