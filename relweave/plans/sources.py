"""Scans, fixture files and sinks; files go to the shared scratch folder."""

from __future__ import annotations

import io
import lzma
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from relweave.operators.windows import sort_keys
from relweave.plans.registry import Data, query
from relweave.runtime import scratch_path
from relweave.sources import fixtures as fx
from relweave.sources import tables as tb


@query("table_scan", "SELECT n_nationkey, n_name FROM nation")
def table_scan(d: Data):
    return tb.table_scan(d.spark, f"{d.folder}/nation.parquet", ["n_nationkey", "n_name"])


@query("raw_sql", "SELECT o_custkey AS customer, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY 1")
def raw_sql(d: Data):
    sql = "SELECT o_custkey AS k, count(*) AS n FROM {orders} WHERE o_totalprice > :low AND o_orderstatus = :status GROUP BY o_custkey"
    return tb.raw_sql(d.spark, sql, {"low": 100000, "status": "F"}, {"k": "customer"}, orders=d.orders)


@query("extra_sql_fragment", "SELECT p_partkey, p_size * 2 AS double_size FROM part WHERE p_size > 10 AND p_name LIKE '%r%'")
def extra_sql_fragment(d: Data):
    return tb.extra(d.part, {"double_size": "p_size * 2"}, ["p_size > 10", "p_name LIKE '%r%'"]).select("p_partkey", "double_size")


@query("extra_sql_tables", "SELECT n_name, s_suppkey, r_name AS region FROM nation, supplier, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND s_acctbal > 0")
def extra_sql_tables(d: Data):
    joined = tb.extra(
        d.nation, {"region": "r.r_name", "s_suppkey": "s.s_suppkey"},
        ["s.s_nationkey = n_nationkey", "n_regionkey = r.r_regionkey", "s.s_acctbal > 0"], tables={"s": d.supplier, "r": d.region})
    return joined.select("n_name", "s_suppkey", "region")


def customers(d: Data):
    """Customers as fixture rows; the balance is unknown for every ninth."""
    c = d.customer.withColumn("balance", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")))
    return fx.fixture_rows(c, "shop.customer", F.col("c_custkey"), ["c_name", "c_nationkey", "balance"])


CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS balance FROM customer"
SCHEMA = "c_name string, c_nationkey int, balance double"


def back(fixture):
    return fx.model_rows(fixture, "shop.customer", SCHEMA, "c_custkey")


@query("json_fixture", CUSTOMERS)
def json_fixture(d: Data):
    """dump_json, then load_json."""
    path = scratch_path(d.spark, "json")
    fx.dump_json(customers(d), path)
    return back(fx.load_json(d.spark, path))


@query("jsonl_fixture", CUSTOMERS)
def jsonl_fixture(d: Data):
    path = scratch_path(d.spark, "jsonl")
    fx.dump_jsonl(customers(d), path)
    return back(fx.load_jsonl(d.spark, path))


@query("xml_fixture", CUSTOMERS)
def xml_fixture(d: Data):
    path = scratch_path(d.spark, "xml")
    fx.dump_xml(customers(d), path)
    return back(fx.load_xml(d.spark, path))


@query("load_compressed", f"SELECT 'gzip' AS kind, * FROM ({CUSTOMERS}) UNION ALL SELECT 'bzip2', * FROM ({CUSTOMERS}) UNION ALL SELECT 'xz', * FROM ({CUSTOMERS}) UNION ALL SELECT 'zip', * FROM ({CUSTOMERS})")
def load_compressed(d: Data):
    out = None
    for kind in ("gzip", "bzip2"):
        path = scratch_path(d.spark, kind)
        fx.dump_jsonl(customers(d), path, kind)
        part = back(fx.load_jsonl(d.spark, path)).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    lines = customers(d).select(F.to_json(F.struct("model", "pk", "fields"), {"ignoreNullFields": "false"}).alias("v"))

    def zipped(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("part.jsonl", text)
        return out.getvalue()

    def pack(batches):
        for b in batches:
            text = "\n".join(b["v"]).encode()
            if text:
                yield pd.DataFrame({"path": ["part.jsonl.xz", "part.zip"], "content": [lzma.compress(text), zipped(text)]})

    packed = lines.mapInPandas(pack, "path string, content binary")
    for kind in ("xz", "zip"):
        out = out.unionByName(back(fx.load_packed(packed.where(F.col("path").endswith(kind)))).withColumn("kind", F.lit(kind)))
    return out


@query("load_natural_keys", """
SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN n_nationkey END AS nation, c_custkey % 10 = 0 AS unresolved FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def load_natural_keys(d: Data):
    """Customers name their nation; every tenth names one that does not exist."""
    named = d.customer.join(d.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    named = named.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "Atlantis").otherwise(F.col("n_name")).alias("nation_name"))
    return fx.resolve_natural(named, ["nation_name"], d.nation, ["n_name"], "n_nationkey", "nation")


@query("dump_natural_keys", "SELECT c_custkey AS pk, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS nation, FALSE AS unresolved FROM customer")
def dump_natural_keys(d: Data):
    """Customers dumped with their nation's name instead of its key; every seventh has none."""
    rows = d.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("nation"))
    named = fx.with_natural(rows, "nation", d.nation, "n_nationkey", ["n_name"])
    path = scratch_path(d.spark, "natural")
    fx.dump_jsonl(fx.fixture_rows(named, "shop.customer", F.col("c_custkey"), ["c_name", "nation"]), path)
    loaded = fx.model_rows(fx.load_jsonl(d.spark, path), "shop.customer", "c_name string, nation array<string>", "pk")
    loaded = loaded.select("pk", F.get("nation", F.lit(0)).alias("nation_name"))
    return fx.resolve_natural(loaded, ["nation_name"], d.nation, ["n_name"], "n_nationkey", "nation").select("pk", "nation", F.coalesce("unresolved", F.lit(False)).alias("unresolved"))


@query("dump_links", """
SELECT s_suppkey AS pk, list(DISTINCT p_size ORDER BY p_size) AS sizes FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def dump_links(d: Data):
    """Many-to-many values inside the dumped fields; distinct before gathering."""
    pairs = d.lineitem.join(d.part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_size").distinct()
    rows = fx.with_links(d.supplier.select("s_suppkey", "s_name"), "s_suppkey", pairs, "l_suppkey", "p_size", "sizes")
    path = scratch_path(d.spark, "links")
    fx.dump_jsonl(fx.fixture_rows(rows, "shop.supplier", F.col("s_suppkey"), ["s_name", "sizes"]), path)
    loaded = fx.model_rows(fx.load_jsonl(d.spark, path), "shop.supplier", "s_name string, sizes array<int>", "pk")
    return loaded.where(F.size("sizes") > 0).select("pk", "sizes")


@query("table_load_order", " UNION ALL ".join(
    f"SELECT '{t}' AS name, {lv} AS level, (SELECT count(*) FROM {t}) AS n"
    for t, lv in [("region", 0), ("part", 0), ("nation", 1), ("customer", 2), ("supplier", 2), ("orders", 3), ("lineitem", 4)]))
def table_load_order(d: Data):
    from relweave.operators.relations import star_catalog

    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
    needs = [(h.source, h.target) for h in star_catalog().hops.values() if h.source in names and not h.nullable]
    order = fx.table_load_order(d.spark, needs, names)
    sizes = None
    for t in names:
        one = d.table(t).agg(F.count("*").alias("n")).withColumn("name", F.lit(t))
        sizes = one if sizes is None else sizes.unionByName(one)
    return order.join(sizes, "name").select("name", "level", "n")


@query("chunked_iteration", "SELECT (rn - 1) // 2000 AS chunk, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1")
def chunked_iteration(d: Data):
    rows = tb.chunks(d.orders.select("o_orderkey"), sort_keys("o_orderkey"), 2000)
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("row_shapes", "SELECT c_custkey, c_name, c_custkey AS c_custkey2, c_name AS c_name2 FROM customer")
def row_shapes(d: Data):
    return tb.shaped(d.customer, "c_custkey", "c_name", "c_custkey", "c_name")
