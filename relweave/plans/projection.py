"""Projection, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions import lookups as lk
from relweave.operators.relations import Rows, Store, star_catalog
from relweave.plans.registry import Data, query


def rows(d: Data, table: str) -> Rows:
    return Rows(Store(star_catalog(), d.table), table)


def nullable_orders(d: Data):
    """Orders whose customer is unknown on every seventh key."""
    key = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))
    return d.orders.withColumn("cust", key)


NULLABLE = """(SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS cust FROM orders)"""


@query("flagship_revenue", """
SELECT r_name AS region, CAST(year(o_orderdate) AS INTEGER) AS year,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS line_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('ASIA', 'EUROPE', 'AMERICA') GROUP BY ALL
ORDER BY revenue DESC, region, year LIMIT 10""")
def flagship_revenue(d: Data):
    lines = rows(d, "lineitem").filter(
        order__customer__nation__region__r_name__in=["ASIA", "EUROPE", "AMERICA"]
    )
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = lines.count_by(
        "order__customer__nation__region__r_name",
        "order__o_orderdate__year",
        revenue=F.round(F.sum(revenue), 4),
        line_count=F.count("*"),
    ).toDF("region", "year", "revenue", "line_count")
    return out.orderBy(F.desc("revenue"), "region", "year").limit(10)


@query("select_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def select_columns(d: Data):
    return rows(d, "orders").values("o_orderkey", "o_totalprice")


@query("defer_columns", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def defer_columns(d: Data):
    return d.customer.drop("c_acctbal")


@query("annotate", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def annotate(d: Data):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return rows(d, "lineitem").annotate(net=net).values("l_orderkey", "l_linenumber", "l_partkey", "net")


@query("alias", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity * l_tax > 3")
def alias(d: Data):
    taxed = rows(d, "lineitem").annotate(taxed=F.col("l_quantity") * F.col("l_tax"))
    return taxed.df.where("taxed > 3").select("l_orderkey", "l_linenumber", "l_partkey")


@query("filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def filter_(d: Data):
    return rows(d, "orders").filter(o_orderstatus="F", o_totalprice__gt=200000).values("o_orderkey")


@query("exclude", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 200000)")
def exclude(d: Data):
    return rows(d, "orders").exclude(o_orderstatus="F", o_totalprice__gt=200000).values("o_orderkey")


@query("null_safe_exclude", f"SELECT o_orderkey, cust FROM {NULLABLE} WHERE NOT coalesce(cust = 10, FALSE)")
def null_safe_exclude(d: Data):
    return nullable_orders(d).where(lk.negate(F.col("cust") == 10)).select("o_orderkey", "cust")


@query("condition_trees", """
SELECT o_orderkey FROM orders WHERE ((o_orderstatus = 'F')::INT + (o_totalprice > 150000)::INT
  + (o_orderpriority = '1-URGENT')::INT) % 2 = 1 AND NOT (o_custkey < 100 OR o_custkey > 1400)""")
def condition_trees(d: Data):
    odd = lk.xor_of(
        F.col("o_orderstatus") == "F",
        F.col("o_totalprice") > 150000,
        F.col("o_orderpriority") == "1-URGENT",
    )
    outside = lk.any_of(F.col("o_custkey") < 100, F.col("o_custkey") > 1400)
    return d.orders.where(odd & lk.negate(outside)).select("o_orderkey")


@query("merge_row_sets", """
SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND o_orderkey IN
 (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500)""")
def merge_row_sets(d: Data):
    """Merged filters of two row sets, and with a sliced one by key."""
    top = d.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(500)
    merged = d.orders.where(lk.any_of(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 300000))
    return merged.join(top.select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey")


@query("none", "SELECT o_orderkey FROM orders WHERE FALSE")
def none(d: Data):
    return d.orders.where(F.lit(False)).select("o_orderkey")


@query("where_having_qualify", """
SELECT nation, n FROM (SELECT n_name AS nation, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r
 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name HAVING count(*) > 5) WHERE r <= 4""")
def where_having_qualify(d: Data):
    """Conditions before grouping, on the groups, and on the ranking."""
    from relweave.operators.windows import rank_rows

    per = rows(d, "customer").filter(c_acctbal__gt=0).count_by("nation__n_name", n=F.count("*"))
    per = per.where("n > 5").withColumnRenamed("nation__n_name", "nation")
    return rank_rows(per, [], ["-n"]).where("rank <= 4").select("nation", "n")


@query("lookup_exact", "SELECT c_custkey, 'exact' AS test FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'iexact' FROM customer WHERE upper(c_mktsegment) = upper('building')")
def lookup_exact(d: Data):
    base = rows(d, "customer")
    a = base.filter(c_mktsegment="BUILDING").values("c_custkey", test=F.lit("exact"))
    return a.union(base.filter(c_mktsegment__iexact="building").values("c_custkey", test=F.lit("iexact")))


@query("lookup_order", "SELECT p_partkey, p_size FROM part WHERE p_size > 10.5 AND p_size <= 40 AND p_retailprice >= 905 AND p_retailprice < 1900")
def lookup_order(d: Data):
    return rows(d, "part").filter(
        p_size__gt=10.5, p_size__lte=40, p_retailprice__gte=905, p_retailprice__lt=1900
    ).values("p_partkey", "p_size")


@query("lookup_in", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (1, 3, 5, 7) OR s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def lookup_in(d: Data):
    """Literal list with None dropped; a subquery becomes a semi join."""
    by_list = rows(d, "supplier").filter(s_nationkey__in=[1, None, 3, 5, 7]).df
    asia = rows(d, "nation").filter(n_regionkey=2).values("n_nationkey")
    by_query = d.supplier.join(asia, d.supplier.s_nationkey == asia.n_nationkey, "left_semi")
    return by_list.union(by_query).select("s_suppkey", "s_nationkey").distinct()


@query("lookup_range", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 2000")
def lookup_range(d: Data):
    return rows(d, "orders").filter(o_totalprice__range=(1000, 2000)).values("o_orderkey")


@query("lookup_isnull", f"SELECT (cust IS NULL) AS missing, count(*) AS n FROM {NULLABLE} GROUP BY 1")
def lookup_isnull(d: Data):
    df = nullable_orders(d)
    missing = lk.predicate(F.col("cust"), ["isnull"], True)
    return df.groupBy(missing.alias("missing")).agg(F.count("*").alias("n"))


@query("lookup_pattern", """
SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'late') AND p_type LIKE 'S%'
UNION ALL SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING' AND p_brand ILIKE 'brand%'
UNION ALL SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'HOT%' AND p_name LIKE '%rod'
UNION ALL SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%OLD%' """)
def lookup_pattern(d: Data):
    base = rows(d, "part")
    sets = [
        {"p_name__contains": "late", "p_type__startswith": "S"},
        {"p_name__iendswith": "RING", "p_brand__istartswith": "brand"},
        {"p_name__istartswith": "HOT", "p_name__endswith": "rod"},
        {"p_name__icontains": "OLD"},
    ]
    parts = [base.filter(**s).values("p_partkey", "p_name") for s in sets]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("lookup_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(hot|old) r') OR regexp_matches(p_name, 'PL[A-Z]TE$', 'i')")
def lookup_regex(d: Data):
    return rows(d, "part").any_of({"p_name__regex": "^(hot|old) r"}, {"p_name__iregex": "PL[A-Z]TE$"}).values("p_partkey")


@query("lookup_year", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def lookup_year(d: Data):
    return rows(d, "orders").filter(o_orderdate__year=1997).values("o_orderkey", "o_orderdate")


@query("lookup_uuid_text", "SELECT c_custkey FROM customer WHERE contains(md5(c_name), 'ab1') OR starts_with(md5(c_name), '0a')")
def lookup_uuid_text(d: Data):
    """Hyphens are ignored on both sides of a text test on an identifier."""
    h = F.md5("c_name")
    uid = F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
    plain = F.replace(uid, F.lit("-"), F.lit(""))
    hit = plain.contains("a-b1".replace("-", "")) | plain.startswith("0a")
    return d.customer.where(hit).select("c_custkey")


@query("lookup_tuple", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey > 59000 OR (l_orderkey = 59000 AND l_linenumber >= 2))
 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey < 40 OR (l_orderkey = 40 AND l_linenumber < 3))
 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey = 7 AND l_linenumber = 1) OR (l_orderkey = 8 AND l_linenumber = 2)""")
def lookup_tuple(d: Data):
    key = [F.col("l_orderkey"), F.col("l_linenumber")]
    tests = [
        lk.tuple_compare(key, "gte", [59000, 2]),
        lk.tuple_compare(key, "lt", [40, 3]),
        lk.tuple_in(key, [(7, 1), (8, 2), (9, None)]),
    ]
    out = None
    for t in tests:
        part = d.lineitem.where(t & lk.tuple_isnull(key, False)).select("l_orderkey", "l_linenumber")
        out = part if out is None else out.union(part)
    return out


@query("lookup_related", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (5, 6, 7) OR o_custkey >= 1490")
def lookup_related(d: Data):
    """Tests on a relation compare the key column: the join is trimmed."""
    return rows(d, "orders").any_of({"customer__in": [5, 6, 7]}, {"customer__gte": 1490}).values("o_orderkey", "o_custkey")


@query("lookup_expression", "SELECT o_orderkey, o_totalprice > 250000 AS big, year(o_orderdate) = 1996 AS in_1996 FROM orders")
def lookup_expression(d: Data):
    return d.orders.select(
        "o_orderkey",
        lk.predicate(F.col("o_totalprice"), ["gt"], 250000).alias("big"),
        lk.predicate(F.col("o_orderdate"), ["year"], 1996).alias("in_1996"),
    )


@query("arithmetic", """
SELECT p_partkey, p_size + 2 AS plus, p_size - 2 AS minus, p_size * 3 AS times, p_size // 4 AS quotient,
 p_size % 7 AS remainder, CAST(p_size AS DOUBLE) ** 2 AS square, round(p_retailprice / p_size, 4) AS ratio FROM part""")
def arithmetic(d: Data):
    """Integer division truncates, as the database does for integer operands."""
    s = F.col("p_size")
    return d.part.select(
        "p_partkey", (s + 2).alias("plus"), (s - 2).alias("minus"), (s * 3).alias("times"),
        F.expr("cast(p_size div 4 as int)").alias("quotient"), (s % 7).alias("remainder"),
        F.pow(s, F.lit(2)).alias("square"), F.round(F.col("p_retailprice") / s, 4).alias("ratio"),
    )


@query("bit_operators", "SELECT p_partkey, p_size & 12 AS band, p_size | 12 AS bor, xor(p_size, 12) AS bxor, p_size << 2 AS bleft, p_size >> 1 AS bright FROM part")
def bit_operators(d: Data):
    s = F.col("p_size")
    return d.part.select(
        "p_partkey", s.bitwiseAND(F.lit(12)).alias("band"), s.bitwiseOR(F.lit(12)).alias("bor"),
        s.bitwiseXOR(F.lit(12)).alias("bxor"), F.shiftleft(s, 2).alias("bleft"), F.shiftright(s, 1).alias("bright"),
    )


@query("string_slice", "SELECT p_partkey, substring(p_name, 3, 4) AS mid, substring(p_name, 5) AS tail, substring(p_name, 2, 1) AS one FROM part")
def string_slice(d: Data):
    from relweave.functions.text import slice_text

    n = F.col("p_name")
    return d.part.select("p_partkey", slice_text(n, 2, 6).alias("mid"), slice_text(n, 4).alias("tail"), slice_text(n, 1, 2).alias("one"))


@query("temporal_arithmetic", """
SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) AS ship_days,
 l_shipdate + INTERVAL 36 HOUR AS due, o_orderdate - INTERVAL 1 DAY AS before,
 CAST(2 * date_diff('day', o_orderdate, l_shipdate) * 86400 AS DOUBLE) AS doubled
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def temporal_arithmetic(d: Data):
    from relweave.functions.temporal import interval_seconds

    gap = F.col("l_shipdate") - F.col("order__o_orderdate")
    j = rows(d, "lineitem").join(rows(d, "lineitem")._split("order")[0]).df
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        (interval_seconds(gap) / 86400).cast("bigint").alias("ship_days"),
        (F.col("l_shipdate") + F.expr("INTERVAL 36 HOUR")).alias("due"),
        (F.col("order__o_orderdate") - F.expr("INTERVAL 1 DAY")).alias("before"),
        interval_seconds(gap * 2).alias("doubled"),
    )


@query("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' END AS bucket FROM orders")
def case_when(d: Data):
    p = F.col("o_totalprice")
    return d.orders.select("o_orderkey", F.when(p > 300000, "large").when(p > 100000, "medium").alias("bucket"))


@query("negated_and_wrapped", "SELECT o_orderkey, NOT (o_orderstatus = 'F') AS open, CAST(o_totalprice AS BIGINT) AS whole FROM orders")
def negated_and_wrapped(d: Data):
    return d.orders.select(
        "o_orderkey", (~(F.col("o_orderstatus") == "F")).alias("open"),
        F.rint("o_totalprice").cast("bigint").alias("whole"),
    )


@query("generated_column", "SELECT c_custkey, lower(c_mktsegment) || '-' || c_nationkey AS slot FROM customer")
def generated_column(d: Data):
    from relweave.operators.writes import with_generated

    slot = F.concat(F.lower("c_mktsegment"), F.lit("-"), F.col("c_nationkey").cast("string"))
    return with_generated(d.customer, slot=slot).select("c_custkey", "slot")


@query("column_defaults", f"SELECT o_orderkey, coalesce(cust, -1) AS cust FROM {NULLABLE}")
def column_defaults(d: Data):
    from relweave.operators.writes import fill_defaults

    return fill_defaults(nullable_orders(d), cust=F.lit(-1).cast("bigint")).select("o_orderkey", "cust")
