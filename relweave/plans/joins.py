"""Joins along relations, semi and anti joins, correlated subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.operators import relations as rel
from relweave.operators import windows as win
from relweave.operators.prefetch import Prefetch, prefetch
from relweave.plans.projection import nullable_orders, rows
from relweave.plans.registry import Data, query

NULLABLE = "(SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS cust FROM orders)"


def nullable_rows(d: Data) -> rel.Rows:
    """Orders with a nullable customer relation."""
    cat = rel.star_catalog().foreign_key(
        "nullable_orders", "buyer", "customer", ("cust", "c_custkey"), reverse="bought", nullable=True
    )
    cat.table("nullable_orders", "o_orderkey")
    load = lambda t: nullable_orders(d) if t == "nullable_orders" else d.table(t)
    return rel.Rows(rel.Store(cat, load), "nullable_orders")


@query("forward_join", f"""
SELECT o_orderkey, c_name AS buyer__c_name, n_name AS buyer__nation__n_name FROM {NULLABLE} o
LEFT JOIN customer ON cust = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def forward_join(d: Data):
    """LEFT because the first relation is nullable, and so on down the path."""
    return nullable_rows(d).values("o_orderkey", "buyer__c_name", "buyer__nation__n_name")


@query("reverse_join", """
SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000""")
def reverse_join(d: Data):
    """Children multiply the parent."""
    r = rows(d, "customer")
    return r.join([r.store.catalog.hop("customer", "orders")], "inner").df.where(
        "orders__o_totalprice > 200000"
    ).select("c_custkey", F.col("orders__o_orderkey").alias("o_orderkey"))


@query("reverse_one_to_one", "SELECT d.doc_id, quality AS label__quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def reverse_one_to_one(d: Data):
    return rows(d, "documents").values("doc_id", "label__quality")


@query("many_to_many_join", """
SELECT DISTINCT p_partkey, s_name FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_brand = 'Brand#11'""")
def many_to_many_join(d: Data):
    r = rows(d, "part").filter(p_brand="Brand#11")
    hops, _ = r._split("suppliers__s_name")
    out = r.join(hops, "inner").df
    return out.select("p_partkey", F.col("lines__supplier__s_name").alias("s_name")).distinct()


@query("composite_key_join", """
SELECT a.l_orderkey, a.l_linenumber, b.n, a.l_partkey FROM lineitem a JOIN
 (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) b
 ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def composite_key_join(d: Data):
    per = d.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    pairs = [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")]
    out = rel.hop_join(d.lineitem.alias("a"), per.alias("b"), pairs, "inner")
    return out.select("a.l_orderkey", "a.l_linenumber", "n", "a.l_partkey")


@query("join_promotion", f"""
SELECT o_orderkey FROM {NULLABLE} o LEFT JOIN customer ON cust = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE n_name = 'NATION_3' OR o_totalprice > 300000""")
def join_promotion(d: Data):
    return nullable_rows(d).any_of(
        {"buyer__nation__n_name": "NATION_3"}, {"o_totalprice__gt": 300000}
    ).values("o_orderkey")


@query("multi_valued_filter", """
SELECT 'same' AS form, c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey
 WHERE o_orderstatus = 'F' AND o_totalprice > 250000 GROUP BY ALL
UNION ALL SELECT 'any', c_custkey, count(*) FROM customer JOIN orders a ON c_custkey = a.o_custkey
 JOIN orders b ON c_custkey = b.o_custkey WHERE a.o_orderstatus = 'F' AND b.o_totalprice > 250000 GROUP BY ALL""")
def multi_valued_filter(d: Data):
    """One call tests the same child, two calls may match different children."""
    base = rows(d, "customer")
    same = base.filter(orders__o_orderstatus="F", orders__o_totalprice__gt=250000)
    count = lambda r, name: r.df.groupBy("c_custkey").agg(F.count("*").alias(name))
    # rows of the second form are pairs of children: counted per parent, not formed
    one, other = base.filter(orders__o_orderstatus="F"), base.filter(orders__o_totalprice__gt=250000)
    anyc = count(one, "x").join(count(other, "y"), "c_custkey").select("c_custkey", (F.col("x") * F.col("y")).alias("n"))
    return count(same, "n").withColumn("form", F.lit("same")).unionByName(anyc.withColumn("form", F.lit("any")))


@query("exclude_to_many", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def exclude_to_many(d: Data):
    return rows(d, "customer").exclude(orders__o_totalprice__gt=250000).values("c_custkey")


@query("filtered_relation", """
SELECT c_custkey, count(o_orderkey) AS urgent FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def filtered_relation(d: Data):
    """The condition belongs to the ON clause; children are counted per key
    before the join, so the join carries one row per customer."""
    urgent = d.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("urgent"))
    out = d.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("urgent", F.lit(0)).alias("urgent"))


@query("select_related", """
SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def select_related(d: Data):
    out = rel.select_related(rows(d, "orders"), "customer", "customer__nation")
    return out.select("o_orderkey", F.col("customer.c_name").alias("c_name"), F.col("customer__nation.n_name").alias("n_name"))


@query("prefetch_related", """
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey) AS n
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)),
 p AS (SELECT o_custkey, (rn - 1) // 1000 AS chunk, any_value(n) AS n, list(o_orderkey ORDER BY rn) AS keys FROM o GROUP BY ALL)
SELECT c_custkey, coalesce(chunk, 0) AS chunk, coalesce(n, 0) AS n_orders, coalesce(keys, []) AS order_keys FROM customer LEFT JOIN p ON c_custkey = o_custkey""")
def prefetch_related(d: Data):
    """Ordered child lists per parent and their number; lists come in chunks of
    1000, and a parent without children gets one empty list."""
    counts = d.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumnRenamed("o_custkey", "k")
    lists = win.chunked_lists(
        d.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"],
        win.sort_keys("-o_orderdate", "o_orderkey"), F.col("o_orderkey"), name="order_keys",
    )
    out = d.customer.join(counts, F.col("c_custkey") == F.col("k"), "left").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    empty = F.coalesce("order_keys", F.array().cast("array<bigint>"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return out.select("c_custkey", zero("chunk", "chunk"), zero("n", "n_orders"), empty.alias("order_keys"))


TREE = """WITH l AS (SELECT * FROM lineitem WHERE l_quantity > 10 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 2),
 o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F' QUALIFY rn <= 3),
 ol AS (SELECT o_custkey, rn, o_orderkey, coalesce(list(l_linenumber ORDER BY l_extendedprice DESC, l_linenumber) FILTER (l_linenumber IS NOT NULL), []) AS lines
  FROM o LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query("prefetch_tree", f"""{TREE}
SELECT n_nationkey, c_custkey, rn::INT AS place, o_orderkey, lines FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN ol ON o_custkey = c_custkey
WHERE n_name LIKE 'A%' OR n_regionkey = 2""")
def prefetch_tree(d: Data):
    """Three levels under some nations: all customers in chunks, three closed orders of
    each, and two large lines of these."""
    lines = Prefetch("lines", d.lineitem.where("l_quantity > 10"), "l_orderkey", "o_orderkey", ("l_linenumber",), ("-l_extendedprice", "l_linenumber"), take=2)
    orders = Prefetch("orders", d.orders.where("o_orderstatus = 'F'"), "o_custkey", "c_custkey", ("o_orderkey",), ("-o_totalprice", "o_orderkey"), take=3, inner=(lines,))
    customers = Prefetch("customers", d.customer, "c_nationkey", "n_nationkey", ("c_custkey",), ("c_custkey",), inner=(orders,))
    _, lists = prefetch(d.nation.where("n_name like 'A%' or n_regionkey = 2"), customers)
    one = lists["customers"].select(F.col("c_nationkey").alias("n_nationkey"), F.explode("customers").alias("c"))
    placed = one.select("n_nationkey", F.col("c.c_custkey").alias("c_custkey"), F.posexplode_outer("c.orders").alias("place", "o"))
    numbers = F.transform("o.lines", lambda x: x["l_linenumber"])
    return placed.select("n_nationkey", "c_custkey", (F.col("place") + 1).alias("place"), F.col("o.o_orderkey").alias("o_orderkey"), numbers.alias("lines"))


@query("sliced_prefetch", """
SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn > 1 AND rn <= 4""")
def sliced_prefetch(d: Data):
    top = win.top_per_group(
        d.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"],
        win.sort_keys("-o_totalprice", "o_orderkey"), 1, 4,
    )
    return top.select("o_custkey", "o_orderkey", F.col("row_number").cast("bigint").alias("rn"))


@query("generic_relation", """
WITH links AS (SELECT o_orderkey AS id, 'order' AS kind, o_orderkey AS object_id FROM orders
 UNION ALL SELECT p_partkey, 'part', p_partkey + 5 FROM part)
SELECT id, kind, CASE kind WHEN 'order' THEN o_orderstatus ELSE p_name END AS title FROM links
 LEFT JOIN orders ON kind = 'order' AND object_id = o_orderkey LEFT JOIN part ON kind = 'part' AND object_id = p_partkey""")
def generic_relation(d: Data):
    links = d.orders.select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("object_id"))
    links = links.unionByName(d.part.select(
        F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), (F.col("p_partkey") + 5).alias("object_id")))
    out = rel.generic_join(
        links, "kind", "object_id",
        {"order": (d.orders, "o_orderkey"), "part": (d.part, "p_partkey")},
        {"title": {"order": "o_orderstatus", "part": "p_name"}},
    )
    return out.select("id", "kind", "title")


@query("parent_table_join", "SELECT d.doc_id, lang, quality, toxic FROM labels JOIN documents d USING (doc_id)")
def parent_table_join(d: Data):
    """A labelled document as a child table of documents, joined by parent link."""
    return rows(d, "labels").values(
        doc_id="doc_id", lang="document__lang", quality="quality", toxic="toxic")


@query("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000)")
def semi_join(d: Data):
    return rows(d, "customer").filter_exists(
        orders__o_orderstatus="F", orders__o_totalprice__gt=200000).values("c_custkey")


@query("anti_join", f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM {NULLABLE} WHERE cust = c_custkey)")
def anti_join(d: Data):
    """NULL keys on the right never exclude anything."""
    used = nullable_orders(d).select("cust")
    return d.customer.join(used, F.col("c_custkey") == F.col("cust"), "left_anti").select("c_custkey")


@query("scalar_subquery", """
SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer""")
def scalar_subquery(d: Data):
    """First by order per key: an ordered minimum combines before the shuffle."""
    best = d.orders.groupBy("o_custkey").agg(
        F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), F.col("o_orderkey"))).alias("best"))
    out = d.customer.join(best, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", "best")


@query("array_subquery", """
SELECT n_nationkey, coalesce((SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey), []) AS segments FROM nation""")
def array_subquery(d: Data):
    """Distinct values are reduced before they are gathered."""
    seg = d.customer.select("c_nationkey", "c_mktsegment").distinct()
    seg = seg.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_mktsegment")).alias("segments"))
    out = d.nation.join(seg, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return out.select("n_nationkey", F.coalesce("segments", F.array().cast("array<string>")).alias("segments"))


@query("join_restriction", """
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'""")
def join_restriction(d: Data):
    """A relation that only ever sees pending high-priority orders."""
    only = lambda df: df.where("o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'")
    cat = rel.star_catalog()
    hop = rel.Relation("customer", "pending", "orders", (("c_custkey", "o_custkey"),), many=True, nullable=True, only=only)
    cat.hops["customer", "pending"] = hop
    r = rel.Rows(rel.Store(cat, d.table), "customer").join([hop])
    return r.df.select("c_custkey", F.col("pending__o_orderkey").alias("o_orderkey"))


@query("ip_range_join", """
WITH ranges AS (SELECT n_nationkey, (n_nationkey + 1) * 4194304 AS lo, (n_nationkey + 1) * 4194304 + 3000000 AS hi, n_name AS country FROM nation),
 ev AS (SELECT event_id, 4194304 + (user_id * 7919 * 13) % 113246208 AS ip FROM events)
SELECT event_id, country, CAST(n_nationkey * 3 AS DOUBLE) AS lat FROM ev LEFT JOIN ranges ON ip BETWEEN lo AND hi""")
def ip_range_join(d: Data):
    from relweave.operators.ranges import ip_enrich, ip_number

    n = F.col("n_nationkey").cast("bigint")
    base = (n + 1) * 4194304
    ranges = d.nation.select(
        base.alias("lo"), (base + 3000000).alias("hi"), F.col("n_name").alias("country"), (n * 3).cast("double").alias("lat"))
    num = F.lit(4194304) + (F.col("user_id") * 7919 * 13) % 113246208
    octets = [F.floor(num / 2**s) % 256 for s in (24, 16, 8, 0)]
    ip = F.concat_ws(".", *[o.cast("string") for o in octets])
    events = d.events.select("event_id", ip_number(ip).alias("ip"))
    return ip_enrich(events, ranges, "ip", ["country", "lat"]).select("event_id", "country", "lat")


# Networks from a /3 to a single address; 4-in-6 addresses and 'fe80::1' fall into none.
NETWORKS = {
    "wide": ("2000::", "3fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), "one": ("fd00::2a", "fd00::2a"), "local": ("fc00::", "fcff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"),
    "mapped": ("::ffff:10.0.0.0", "::ffff:10.255.255.255"), "home": ("::1", "::1"),
}


@query("ip6_range_join", """
SELECT event_id, CASE user_id % 7 WHEN 0 THEN 'wide' WHEN 1 THEN CASE WHEN event_id % 5 = 0 THEN 'one' END WHEN 2 THEN 'local' WHEN 3 THEN 'mapped'
 WHEN 4 THEN 'home' END AS country FROM events""")
def ip6_range_join(d: Data):
    """IPv6 and IPv4 addresses against networks of very different sizes."""
    from relweave.operators.ranges import ip6_key, ip_enrich

    i, u = F.col("event_id"), F.col("user_id")
    octets = F.concat_ws(".", F.lit("10"), (i % 256).cast("string"), (u % 256).cast("string"), F.lit("9"))
    address = (
        F.when(u % 7 == 0, F.concat(F.element_at(F.array(F.lit("2"), F.lit("3")), (i % 2 + 1).cast("int")), F.lpad(F.lower(F.hex(i % 4096)), 3, "0"), F.lit("::"), F.lower(F.hex(u % 65536))))
        .when(u % 7 == 1, F.when(i % 5 == 0, F.lit("fd00::2a")).otherwise(F.lit("fd00::2b")))
        .when(u % 7 == 2, F.concat(F.lit("FC"), F.lpad(F.hex(i % 256), 2, "0"), F.lit("::9:"), F.hex(u % 65536)))
        .when(u % 7 == 3, octets).when(u % 7 == 4, F.lit("::1")).when(u % 7 == 5, F.lit("not an address"))
    )
    nets = d.spark.createDataFrame([(n, *ends) for n, ends in NETWORKS.items()], "country string, a string, b string")
    nets = nets.select("country", ip6_key("a").alias("lo"), ip6_key("b").alias("hi"))
    return ip_enrich(d.events.select("event_id", ip6_key(address).alias("ip")), nets, "ip", ["country"]).select("event_id", "country")
