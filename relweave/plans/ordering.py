"""Sort, slice, top-k, distinct, paging and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.operators import ordering as od
from relweave.operators.windows import sort_keys
from relweave.plans.projection import nullable_orders, rows
from relweave.plans.registry import Data, query

NULLABLE = "(SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS cust FROM orders)"


@query("order_by", "SELECT o_orderkey, c_name AS customer__c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY c_name DESC, o_totalprice, o_orderkey")
def order_by(d: Data):
    r, col, _ = rows(d, "orders").resolve("customer__c_name")
    out = r.df.orderBy(col.desc(), "o_totalprice", "o_orderkey")
    return out.select("o_orderkey", "customer__c_name")


@query("nulls_first_last", f"""
(SELECT 'last' AS form, o_orderkey, cust FROM {NULLABLE} ORDER BY cust ASC NULLS LAST, o_orderkey)
UNION ALL (SELECT 'first', o_orderkey, cust FROM {NULLABLE} ORDER BY cust DESC NULLS FIRST, o_orderkey)""")
def nulls_first_last(d: Data):
    df = nullable_orders(d)
    a = df.orderBy(*sort_keys("cust", "o_orderkey")).select(F.lit("last").alias("form"), "o_orderkey", "cust")
    b = df.orderBy(*sort_keys("-cust", "o_orderkey")).select(F.lit("first").alias("form"), "o_orderkey", "cust")
    return a.union(b)


@query("reverse_order", f"SELECT o_orderkey, cust FROM {NULLABLE} ORDER BY cust DESC NULLS FIRST, o_totalprice ASC NULLS LAST, o_orderkey DESC")
def reverse_order(d: Data):
    keys = od.reversed_keys("cust", "-o_totalprice", "o_orderkey")
    return nullable_orders(d).orderBy(*keys).select("o_orderkey", "cust")


@query("slice", """
(SELECT 'bounded' AS form, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 20)
UNION ALL SELECT 'stepped', o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn > 10 AND (rn - 11) % 100 = 0""")
def slice_(d: Data):
    keys = sort_keys("-o_totalprice", "o_orderkey")
    a = od.slice_rows(d.orders, keys, 20, 60).select(F.lit("bounded").alias("form"), "o_orderkey")
    slim = d.orders.select("o_orderkey", "o_totalprice")
    b = od.slice_rows(slim, keys, 10, None, 100).select(F.lit("stepped").alias("form"), "o_orderkey")
    return a.union(b)


@query("get", "SELECT * FROM orders WHERE o_orderkey = 33")
def get(d: Data):
    """Reads at most two rows; more or none is an error."""
    hit = d.orders.where("o_orderkey = 33")
    od.get_one(hit)
    return hit


@query("first_last", "(SELECT 'first' AS form, o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1) UNION ALL (SELECT 'last', o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)")
def first_last(d: Data):
    keys = ("o_orderdate", "o_orderkey")
    pick = lambda df, form: df.select(F.lit(form).alias("form"), "o_orderkey")
    return pick(od.first(d.orders, *keys), "first").union(pick(od.last(d.orders, *keys), "last"))


@query("earliest_latest", "SELECT o_custkey, min(o_orderdate) AS earliest, max(o_orderdate) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_key FROM orders GROUP BY 1")
def earliest_latest(d: Data):
    """Batch form per customer: ordered minima combine map-side."""
    return d.orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("earliest"), F.max("o_orderdate").alias("latest"),
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_key"))


@query("in_bulk", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09)")
def in_bulk(d: Data):
    ids = d.lineitem.where("l_quantity = 50 AND l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return od.in_bulk(d.part, ids, "p_partkey").select("p_partkey", "p_name")


@query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct(d: Data):
    return d.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(d: Data):
    src = d.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return od.distinct_on(src, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])


@query("page", """
SELECT o_orderkey, least((rn - 1) // 64 + 1, greatest(ceil(greatest(n - 30, 1) / 64), 1))::BIGINT AS page FROM
 (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)""")
def page(d: Data):
    out = od.pages(d.orders.select("o_orderkey", "o_orderdate"), sort_keys("o_orderdate", "o_orderkey"), 64, orphans=30)
    return out.select("o_orderkey", "page")


@query("next_previous_row", "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)")
def next_previous_row(d: Data):
    return od.neighbours(d.orders.select("o_orderkey", "o_orderdate"), "o_orderkey", "o_orderdate").select("o_orderkey", "previous", "next")


@query("group_order_index", """
WITH old AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders WHERE o_orderstatus = 'F'),
 new AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'F')
SELECT o_custkey, o_orderkey, idx FROM old UNION ALL
SELECT o_custkey, o_orderkey, coalesce(top + 1, 0) + rn - 1 FROM new LEFT JOIN (SELECT o_custkey, max(idx) AS top FROM old GROUP BY 1) USING (o_custkey)""")
def group_order_index(d: Data):
    from relweave.operators.windows import row_number

    slim = d.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    done = row_number(slim.where("o_orderstatus = 'F'"), ["o_custkey"], sort_keys("o_orderkey"), "idx")
    done = done.withColumn("idx", F.col("idx") - 1)
    out = od.append_in_order(done, slim.where("o_orderstatus <> 'F'"), "o_custkey", "idx", sort_keys("o_orderkey"))
    return out.select("o_custkey", "o_orderkey", "idx")


@query("union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def union(d: Data):
    n, r = d.nation.select(F.col("n_name").alias("name")), d.region.select("r_name")
    return n.union(r).distinct().union(n)


@query("intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersection(d: Data):
    a = d.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = d.orders.where("o_orderstatus = 'P'").select("o_custkey")
    return a.intersect(b).intersect(d.customer.where("c_acctbal > 0").select("c_custkey"))


@query("difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def difference(d: Data):
    big = d.orders.where("o_totalprice > 300000").select("o_custkey")
    urgent = d.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return d.customer.select(F.col("c_custkey").alias("k")).subtract(big).subtract(urgent)
