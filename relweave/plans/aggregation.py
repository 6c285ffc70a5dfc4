"""Aggregates, grouping, facets and date archives."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from relweave.operators import aggregates as ag
from relweave.operators import windows as win
from relweave.plans.projection import rows
from relweave.plans.registry import Data, query

R = F.round


@query("aggregate_all", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def aggregate_all(d: Data):
    p = "o_totalprice"
    return d.orders.agg(
        F.count("*").alias("n"), R(F.sum(p), 2).alias("total"), R(F.avg(p), 4).alias("mean"),
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("aggregate_sliced", "SELECT round(avg(o_totalprice), 4) AS mean, count(DISTINCT o_custkey) AS buyers FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000)")
def aggregate_sliced(d: Data):
    top = d.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1000)
    return top.agg(R(F.avg("o_totalprice"), 4).alias("mean"), F.count_distinct("o_custkey").alias("buyers"))


@query("count_exists_contains", "SELECT count(*) AS n, bool_or(o_totalprice > 400000) AS any_large, bool_or(o_orderkey = 17) AS has_17 FROM orders")
def count_exists_contains(d: Data):
    return d.orders.agg(
        F.count("*").alias("n"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"),
        F.bool_or(F.col("o_orderkey") == 17).alias("has_17"))


@query("group_by_values", "SELECT n_name AS nation__n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def group_by_values(d: Data):
    return rows(d, "customer").count_by("nation__n_name", "c_mktsegment", n=F.count("*"), balance=R(F.sum("c_acctbal"), 2))


@query("group_by_rows", "SELECT c_custkey, c_name, c_acctbal, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def group_by_rows(d: Data):
    out = ag.per_parent(d.customer, "c_custkey", d.orders, "o_custkey", n_orders=F.count("*"), spent=F.sum("o_totalprice"))
    return out.select("c_custkey", "c_name", "c_acctbal", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), R("spent", 2).alias("spent"))


@query("multi_relation_aggregates", """
SELECT n_nationkey, count(c_custkey) AS crossed, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def multi_relation_aggregates(d: Data):
    """Two to-many relations multiply each other. The crossed count is the
    product of the two counts, so the cross product is never formed."""
    out = ag.per_parent(d.nation, "n_nationkey", d.customer, "c_nationkey", c=F.count("*"))
    out = ag.per_parent(out, "n_nationkey", d.supplier, "s_nationkey", s=F.count("*"))
    c, s = F.coalesce("c", F.lit(0)), F.coalesce("s", F.lit(0))
    return out.select("n_nationkey", (c * F.greatest(s, F.lit(1))).alias("crossed"), c.alias("customers"), s.alias("suppliers"))


@query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def having(d: Data):
    return d.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 15")


@query("agg_count", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def agg_count(d: Data):
    return d.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"))


@query("agg_sum", "SELECT l_linestatus, sum(l_quantity) AS qty, sum(DISTINCT l_quantity) AS qty_distinct, CAST(sum(date_diff('day', o_orderdate, l_shipdate)) * 86400 AS DOUBLE) AS waited FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def agg_sum(d: Data):
    """Also over durations; their sum in microseconds would pass 64 bits, so seconds are summed as decimals."""
    from relweave.functions.temporal import interval_seconds

    j = d.lineitem.join(d.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    gap = interval_seconds(F.col("l_shipdate") - F.col("o_orderdate")).cast("decimal(20,6)")
    return j.groupBy("l_linestatus").agg(
        F.sum("l_quantity").alias("qty"), F.sum_distinct("l_quantity").alias("qty_distinct"), F.sum(gap).cast("double").alias("waited"))


@query("agg_avg", "SELECT p_brand, round(avg(p_retailprice), 7) AS mean, round(avg(DISTINCT p_size), 4) AS mean_size FROM part GROUP BY 1")
def agg_avg(d: Data):
    return d.part.groupBy("p_brand").agg(R(F.avg("p_retailprice"), 7).alias("mean"), R(F.expr("avg(distinct p_size)"), 4).alias("mean_size"))


@query("agg_min_max", "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first, max(o_orderpriority) AS prio FROM orders GROUP BY 1")
def agg_min_max(d: Data):
    return d.orders.groupBy("o_orderstatus").agg(
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.min("o_orderdate").alias("first"), F.max("o_orderpriority").alias("prio"))


@query("agg_stddev_variance", "SELECT p_type, round(stddev_pop(p_retailprice), 4) AS sd, round(stddev_samp(p_retailprice), 4) AS sds, round(var_pop(p_size), 4) AS v, round(var_samp(p_size), 4) AS vs FROM part GROUP BY 1")
def agg_stddev_variance(d: Data):
    return d.part.groupBy("p_type").agg(
        R(F.stddev_pop("p_retailprice"), 4).alias("sd"), R(F.stddev_samp("p_retailprice"), 4).alias("sds"),
        R(F.var_pop("p_size"), 4).alias("v"), R(F.var_samp("p_size"), 4).alias("vs"))


@query("agg_any_value", "SELECT l_orderkey, any_value(o_custkey) AS buyer FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def agg_any_value(d: Data):
    j = d.lineitem.join(d.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_orderkey").agg(F.any_value("o_custkey").alias("buyer"))


@query("agg_string", """
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority DESC) AS priorities, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1""")
def agg_string(d: Data):
    """Distinct values per key are reduced map-side, so the text stays short."""
    text = lambda c, sep, asc: F.array_join(F.sort_array(F.collect_set(c), asc), sep)
    return d.orders.groupBy("o_custkey").agg(
        text("o_orderpriority", "; ", False).alias("priorities"), text("o_orderstatus", "", True).alias("statuses"))


@query("agg_array", """
SELECT o_custkey, (row_number - 1) // 1000 AS chunk, list(o_orderkey ORDER BY row_number) AS keys FROM
 (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS row_number FROM orders) GROUP BY ALL""")
def agg_array(d: Data):
    """Ordered array aggregate, in chunks of 1000 so a hot key never fills a task."""
    src = d.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return win.chunked_lists(src, ["o_custkey"], win.sort_keys("o_totalprice", "o_orderkey"), F.col("o_orderkey"), name="keys")


PRIORITIES = """(SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)"""


@query("agg_string_ordered", f"""
SELECT o_custkey, (rn - 1) // 1000 AS chunk, string_agg(o_orderpriority, ', ' ORDER BY rn) AS priorities FROM {PRIORITIES} GROUP BY ALL""")
def agg_string_ordered(d: Data):
    """All values in order, repeats kept; the text of a hot key comes in chunks."""
    src = d.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    lists = win.chunked_lists(src, ["o_custkey"], win.sort_keys("o_orderdate", "o_orderkey"), F.col("o_orderpriority"), name="p")
    return lists.select("o_custkey", "chunk", F.array_join("p", ", ").alias("priorities"))


@query("agg_json_ordered", f"""
SELECT o_custkey, (rn - 1) // 1000 AS chunk, '[' || string_agg('{{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '"}}', ',' ORDER BY rn) || ']' AS rows FROM {PRIORITIES} GROUP BY ALL""")
def agg_json_ordered(d: Data):
    """Objects in order as JSON arrays, chunked in the same way."""
    src = d.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    item = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"))
    lists = win.chunked_lists(src, ["o_custkey"], win.sort_keys("o_orderdate", "o_orderkey"), item, name="r")
    return lists.select("o_custkey", "chunk", F.to_json("r").alias("rows"))


@query("agg_array_distinct", "SELECT l_returnflag, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS numbers FROM lineitem GROUP BY 1")
def agg_array_distinct(d: Data):
    return d.lineitem.groupBy("l_returnflag").agg(F.array_sort(F.collect_set("l_linenumber")).alias("numbers"))


@query("agg_json_array", """
SELECT c_nationkey, '["' || string_agg(DISTINCT c_mktsegment, '","' ORDER BY c_mktsegment) || '"]' AS segments FROM customer GROUP BY 1""")
def agg_json_array(d: Data):
    return d.customer.groupBy("c_nationkey").agg(F.to_json(F.array_sort(F.collect_set("c_mktsegment"))).alias("segments"))


@query("agg_bits", "SELECT p_brand, bit_and(p_size) AS b_and, bit_or(p_size) AS b_or, bit_xor(p_size) AS b_xor FROM part GROUP BY 1")
def agg_bits(d: Data):
    return d.part.groupBy("p_brand").agg(F.bit_and("p_size").alias("b_and"), F.bit_or("p_size").alias("b_or"), F.bit_xor("p_size").alias("b_xor"))


@query("agg_bools", "SELECT o_custkey, bool_and(o_totalprice > 5000) AS every, bool_or(o_totalprice > 300000) AS some FROM orders GROUP BY 1")
def agg_bools(d: Data):
    p = F.col("o_totalprice")
    return d.orders.groupBy("o_custkey").agg(F.bool_and(p > 5000).alias("every"), F.bool_or(p > 300000).alias("some"))


@query("agg_corr_covar", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS c, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs FROM lineitem GROUP BY 1")
def agg_corr_covar(d: Data):
    y, x = "l_extendedprice", "l_quantity"
    return d.lineitem.groupBy("l_returnflag").agg(
        R(F.corr(y, x), 6).alias("c"), R(F.covar_pop(y, x), 2).alias("cp"), R(F.covar_samp(y, x), 2).alias("cs"))


@query("agg_regression", """
SELECT l_linestatus, round(regr_avgx(y, x), 4) AS ax, round(regr_avgy(y, x), 4) AS ay, regr_count(y, x) AS n, round(regr_intercept(y, x), 2) AS i,
 round(regr_r2(y, x), 6) AS r2, round(regr_slope(y, x), 4) AS s, round(regr_sxx(y, x), 1) AS sxx, round(regr_sxy(y, x) / 1000, 0) AS sxy, round(regr_syy(y, x) / 1000000, 0) AS syy
FROM (SELECT l_linestatus, l_extendedprice AS y, l_quantity AS x FROM lineitem) GROUP BY 1""")
def agg_regression(d: Data):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    spec = [("ax", F.regr_avgx(y, x), 4), ("ay", F.regr_avgy(y, x), 4), ("i", F.regr_intercept(y, x), 2), ("r2", F.regr_r2(y, x), 6),
            ("s", F.regr_slope(y, x), 4), ("sxx", F.regr_sxx(y, x), 1), ("sxy", F.regr_sxy(y, x) / 1000, 0), ("syy", F.regr_syy(y, x) / 1000000, 0)]
    return d.lineitem.groupBy("l_linestatus").agg(F.regr_count(y, x).alias("n"), *[R(c, k).alias(n) for n, c, k in spec])


@query("filtered_aggregate", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 0), 2) AS open_value FROM orders GROUP BY 1")
def filtered_aggregate(d: Data):
    s = F.col("o_orderstatus")
    return d.orders.groupBy("o_custkey").agg(
        ag.only(F.count, F.lit(1), s == "F").alias("done"),
        R(ag.with_default(ag.only(F.sum, F.col("o_totalprice"), s != "F"), 0.0), 2).alias("open_value"))


@query("aggregate_default", "SELECT coalesce(sum(o_totalprice), -1.0) AS total, count(*) AS n, max(o_orderkey) AS top FROM orders WHERE o_totalprice < 0")
def aggregate_default(d: Data):
    none = d.orders.where("o_totalprice < 0")
    return none.agg(ag.with_default(F.sum("o_totalprice"), -1.0).alias("total"), F.count("*").alias("n"), F.max("o_orderkey").alias("top"))


@query("ordered_aggregate", "SELECT l_orderkey, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR DESC) AS numbers FROM lineitem GROUP BY 1")
def ordered_aggregate(d: Data):
    nums = d.lineitem.select("l_orderkey", F.col("l_linenumber").cast("string").alias("n")).distinct()
    return nums.groupBy("l_orderkey").agg(F.expr("listagg(n, ',') WITHIN GROUP (ORDER BY n DESC)").alias("numbers"))


@query("composed_aggregates", """
SELECT c_mktsegment, round(avg(spent), 2) AS mean_spent, round(max(spent) / sum(n), 4) AS ratio FROM
 (SELECT c_custkey, c_mktsegment, sum(o_totalprice) AS spent, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL) GROUP BY 1""")
def composed_aggregates(d: Data):
    """Arithmetic over aggregates; an aggregate of aggregates takes two levels."""
    per = d.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("n"))
    j = d.customer.join(per, F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("c_mktsegment").agg(R(F.avg("spent"), 2).alias("mean_spent"), R(F.max("spent") / F.sum("n"), 4).alias("ratio"))


@query("dates", "SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS month FROM orders ORDER BY 1 DESC")
def dates(d: Data):
    return ag.dates(d.orders, "o_orderdate", "month", descending=True)


@query("facet_counts", """
SELECT 'status' AS facet, s AS choice, count(o_orderkey) AS n FROM (SELECT unnest(['F', 'O', 'P', '-']) AS s) LEFT JOIN orders ON o_orderstatus = s AND o_totalprice >= 100000 GROUP BY s
UNION ALL SELECT 'price', 'low', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000
UNION ALL SELECT 'price', 'high', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000
UNION ALL SELECT 'date', 'any', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000
UNION ALL SELECT 'date', 'today', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_orderdate = '1997-06-15'
UNION ALL SELECT 'date', 'past 7 days', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_orderdate >= '1997-06-08' AND o_orderdate < '1997-06-16'
UNION ALL SELECT 'date', 'this month', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND o_orderdate >= '1997-06-01' AND o_orderdate < '1997-07-01'
UNION ALL SELECT 'date', 'this year', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND year(o_orderdate) = 1997
UNION ALL SELECT 'date', 'no date', 0 UNION ALL SELECT 'date', 'has date', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000""")
def facet_counts(d: Data):
    p = F.col("o_totalprice")
    facets = {
        "status": ag.null_safe_choices("o_orderstatus", ["F", "O", "P"]),
        "price": {"low": p < 100000, "high": p >= 100000},
        "date": ag.past_ranges("o_orderdate", dt.date(1997, 6, 15)),
    }
    return ag.facet_counts(d.orders, facets, {"status": F.col("o_orderstatus") == "F", "price": p >= 100000})


@query("date_hierarchy", "SELECT 'day' AS level, ts::DATE AS start, count(*) AS n FROM events GROUP BY 2")
def date_hierarchy(d: Data):
    return ag.date_hierarchy(d.events, "ts")


@query("date_archive", """
SELECT 'year' AS period, o_orderkey FROM orders WHERE year(o_orderdate) = 1998
UNION ALL SELECT 'month', o_orderkey FROM orders WHERE o_orderdate >= '1998-02-01' AND o_orderdate < '1998-03-01'
UNION ALL SELECT 'week', o_orderkey FROM orders WHERE o_orderdate >= '1998-02-09' AND o_orderdate < '1998-02-16'
UNION ALL SELECT 'day', o_orderkey FROM orders WHERE o_orderdate >= '1998-02-11' AND o_orderdate < '1998-02-12'""")
def date_archive(d: Data):
    out = None
    for period in ("year", "month", "week", "day"):
        part = ag.date_archive(d.orders, "o_orderdate", period, dt.date(1998, 2, 11))
        part = part.select(F.lit(period).alias("period"), "o_orderkey")
        out = part if out is None else out.union(part)
    return out


@query("neighbour_periods", """
SELECT period, n, lag(period) OVER (ORDER BY period) AS previous, lead(period) OVER (ORDER BY period) AS next FROM
 (SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS period, count(*) AS n FROM orders GROUP BY 1)""")
def neighbour_periods(d: Data):
    return ag.neighbour_periods(d.orders, "o_orderdate", "week")
