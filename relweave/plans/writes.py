"""Writes as new tables: inserts, upserts, updates, deletes, links, TTL store."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.operators import writes as wr
from relweave.operators.windows import sort_keys
from relweave.plans.registry import Data, query
from relweave.runtime import ntz


def small_orders(d: Data):
    return d.orders.select("o_orderkey", "o_custkey", "o_totalprice")


def incoming(d: Data):
    """Changed prices of finished orders, and the pending ones under new keys."""
    old = small_orders(d).join(d.orders.where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", "left_semi")
    old = old.withColumn("o_totalprice", F.lit(1.0))
    new = d.orders.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), "o_custkey", "o_totalprice")
    return old.unionByName(new)


BASE = "(SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders)"
NEW = "(SELECT o_orderkey + 10000000 AS o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P')"


@query("bulk_create", f"""
SELECT o_orderkey, o_custkey, o_totalprice FROM {BASE} UNION ALL
SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_orderkey), o_custkey, o_totalprice FROM {NEW}""")
def bulk_create(d: Data):
    """Rows without a key are numbered after the largest one in use."""
    table = small_orders(d)
    new = d.orders.where("o_orderstatus = 'P'").select(
        F.lit(None).cast("bigint").alias("o_orderkey"), "o_custkey", "o_totalprice", F.col("o_orderkey").alias("at"))
    numbered = wr.number_new(table, new, "o_orderkey", sort_keys("at")).drop("at")
    return wr.bulk_create(table, numbered)


@query("bulk_create_ignore", f"SELECT o_orderkey, o_custkey, o_totalprice FROM {BASE} UNION ALL SELECT * FROM {NEW}")
def bulk_create_ignore(d: Data):
    """Clashes with the table and repeats inside the batch are skipped."""
    batch = incoming(d).withColumn("at", F.lit(1))
    again = batch.withColumn("at", F.lit(2)).withColumn("o_totalprice", F.lit(-1.0))
    table = small_orders(d).withColumn("at", F.lit(0))
    return wr.insert_ignore(table, batch.unionByName(again), ["o_orderkey"], [F.col("at")]).drop("at")


@query("bulk_create_upsert", f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM {BASE} UNION ALL SELECT * FROM {NEW}")
def bulk_create_upsert(d: Data):
    return wr.upsert(small_orders(d), incoming(d), ["o_orderkey"], ["o_totalprice"])


@query("bulk_update", f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus = 'F' AS changed FROM {BASE}")
def bulk_update(d: Data):
    return wr.bulk_update(small_orders(d), incoming(d), "o_orderkey", ["o_totalprice"])


@query("update", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 250000 THEN o_totalprice / 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def update(d: Data):
    p = F.col("o_totalprice")
    out = wr.update_where(d.orders, p > 250000, o_orderstatus=F.lit("X"), o_totalprice=p / 2)
    return out.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("update_or_create", f"""
SELECT o_orderkey, o_custkey, 1.0 AS o_totalprice, FALSE AS created FROM {BASE} WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, 5.0, TRUE FROM {NEW}""")
def update_or_create(d: Data):
    return wr.update_or_create(small_orders(d), incoming(d), ["o_orderkey"], ["o_totalprice"], {"o_totalprice": F.lit(5.0)})


@query("get_or_create", f"""
SELECT o_orderkey, o_custkey, o_totalprice, FALSE AS created FROM {BASE} WHERE o_orderstatus = 'F' UNION ALL SELECT *, TRUE FROM {NEW}""")
def get_or_create(d: Data):
    return wr.get_or_create(small_orders(d), incoming(d), ["o_orderkey"])


@query("delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def delete(d: Data):
    return wr.delete_where(d.orders, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 100000)).select("o_orderkey")


TREE = "(SELECT p_partkey AS id, CASE WHEN p_partkey // 3 > 0 THEN p_partkey // 3 END AS parent_id, p_size FROM part)"


@query("cascade_delete", f"""
WITH RECURSIVE t AS (SELECT * FROM {TREE}), gone AS (SELECT id FROM t WHERE p_size = 7 UNION SELECT t.id FROM t JOIN gone ON t.parent_id = gone.id)
SELECT 'tree' AS tbl, id::VARCHAR AS key, parent_id AS ref FROM t WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'lines', k, max(ref) FROM (SELECT l_orderkey || '/' || l_linenumber AS k, CASE WHEN l_partkey IN (SELECT id FROM gone) THEN NULL ELSE l_partkey END AS ref FROM lineitem) GROUP BY k
UNION ALL SELECT 'count', 'tree', (SELECT count(*) FROM gone)""")
def cascade_delete(d: Data):
    """Parts of size 7 go with their whole subtrees; line items lose the link."""
    parent = F.floor(F.col("p_partkey") / 3)
    tree = d.part.select(F.col("p_partkey").alias("id"), F.when(parent > 0, parent).alias("parent_id"), "p_size")
    lines = d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    rules = [
        wr.OnDelete("tree", ("parent_id",), "tree", ("id",), "cascade"),
        wr.OnDelete("lines", ("l_partkey",), "tree", ("id",), "set_null"),
        wr.OnDelete("lines", ("l_orderkey",), "tree", ("id",), "do_nothing"),
    ]
    new, counts = wr.cascade_delete(
        {"tree": tree, "lines": lines}, {"tree": ("id",), "lines": ("l_orderkey", "l_linenumber")}, rules, "tree", tree.where("p_size = 7"))
    left = new["tree"].select(F.lit("tree").alias("tbl"), F.col("id").cast("string").alias("key"), F.col("parent_id").alias("ref"))
    key = F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key")
    links = new["lines"].groupBy(key).agg(F.max("l_partkey").alias("ref")).select(F.lit("lines").alias("tbl"), "key", "ref")
    total = d.region.limit(1).select(F.lit("count").alias("tbl"), F.lit("tree").alias("key"), F.lit(counts["tree"]).cast("bigint").alias("ref"))
    return left.unionByName(links).unionByName(total)


PAIRS = "(SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem)"


def pairs(d: Data):
    return d.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).distinct()


@query("link_add", f"SELECT part, supp FROM {PAIRS} UNION SELECT p_partkey, 1 FROM part")
def link_add(d: Data):
    return wr.link_add(pairs(d), d.part.select(F.col("p_partkey").alias("part"), F.lit(1).cast("bigint").alias("supp")))


@query("link_remove", f"SELECT part, supp FROM {PAIRS} WHERE supp NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def link_remove(d: Data):
    bad = d.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("supp"))
    return wr.link_remove(pairs(d), pairs(d).join(bad, "supp", "left_semi").select("part", "supp"))


@query("link_set_clear", f"""
SELECT part, supp FROM {PAIRS} WHERE part NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) AND part NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1')
UNION ALL SELECT p_partkey, p_size FROM part WHERE p_size < 10 AND p_brand <> 'Brand#1'""")
def link_set_clear(d: Data):
    wanted = d.part.where("p_size < 10").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("bigint").alias("supp"))
    out = wr.link_set(pairs(d), wanted, "part")
    return wr.link_clear(out, d.part.where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("part")), "part")


@query("link_symmetric", """
WITH e AS (SELECT DISTINCT user_id AS a, CAST(value AS BIGINT) AS b FROM events), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT a, b FROM s WHERE NOT (a IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR b IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))""")
def link_symmetric(d: Data):
    """Symmetric self relation: both directions are added and removed."""
    e = d.events.select(F.col("user_id").alias("a"), F.rint("value").cast("bigint").alias("b"))
    both = wr.link_add(e.where(F.lit(False)), e, symmetric=True)
    out = d.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("a"))
    return wr.link_remove(both, both.join(out, "a", "left_semi"), symmetric=True)


@query("purge_expired", "SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY >= TIMESTAMP '2024-01-20'")
def purge_expired(d: Data):
    rows = d.events.withColumn("expires", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    return wr.purge_expired(rows, "expires", ntz("2024-01-20 00:00:00")).select("event_id")


def operations(d: Data):
    """Event log as store operations."""
    op = F.when(F.col("event_id") % 10 < 6, "set").when(F.col("event_id") % 10 < 9, "touch").otherwise("delete")
    return d.events.select(
        F.col("user_id").cast("string").alias("key"), op.alias("op"), F.col("value"), "ts",
        ((F.col("event_id") % 5 + 1) * 86400).cast("int").alias("timeout"), F.col("event_id").alias("seq"))


TTL = """WITH o AS (SELECT user_id::VARCHAR AS key, CASE WHEN event_id % 10 < 6 THEN 'set' WHEN event_id % 10 < 9 THEN 'touch' ELSE 'delete' END AS op, value, ts, (event_id % 5 + 1) * 86400 AS timeout, event_id FROM events),
 w AS (SELECT DISTINCT ON (key) * FROM o WHERE op <> 'touch' ORDER BY key, ts DESC, event_id DESC),
 t AS (SELECT DISTINCT ON (o.key) o.key, o.ts, o.timeout FROM o JOIN w ON o.key = w.key AND o.op = 'touch' AND (o.ts, o.event_id) > (w.ts, w.event_id) ORDER BY o.key, o.ts DESC, o.event_id DESC),
 s AS (SELECT w.key, w.value, coalesce(t.ts + to_seconds(t.timeout), w.ts + to_seconds(w.timeout)) AS expires FROM w LEFT JOIN t USING (key) WHERE op = 'set'),
 live AS (SELECT * FROM s WHERE expires > TIMESTAMP '2024-01-29')"""


@query("ttl_store", f"{TTL} SELECT key, value, expires FROM live")
def ttl_store(d: Data):
    return wr.ttl_state(operations(d), ntz("2024-01-29 00:00:00"))


@query("ttl_add_cull", f"""
{TTL}, a AS (SELECT * FROM live UNION ALL SELECT c_custkey::VARCHAR, 0.0, TIMESTAMP '2024-02-01' FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT key FROM live)),
 r AS (SELECT *, row_number() OVER (ORDER BY key) AS rn, count(*) OVER () AS n FROM a)
SELECT key, value, expires FROM r WHERE n <= 500 OR rn > n // 3""")
def ttl_add_cull(d: Data):
    now = ntz("2024-01-29 00:00:00")
    state = wr.ttl_state(operations(d), now)
    new = d.customer.select(F.col("c_custkey").cast("string").alias("key"), F.lit(0.0).alias("value"), ntz("2024-02-01 00:00:00").alias("expires"))
    return wr.cull(wr.add_if_absent(state, new, now), 500)
