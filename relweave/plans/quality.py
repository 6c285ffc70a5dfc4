"""Data-quality checks over the tables and over derived dirty columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions import validators as va
from relweave.operators import quality as qu
from relweave.plans.projection import nullable_orders
from relweave.plans.registry import Data, query

NULLABLE = "(SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS cust FROM orders)"

# Texts per remainder of the key: (text, valid).
EMAILS = [
    ("user{}@example.com", True), ("user{}@localhost", True), ("user{}@[127.0.0.1]", True), ("user{}", False),
    ("a..b{}@example.com", False), ('"q!u{}"@example.org', True), ("user{}@-bad.com", False), ("u@x@ex{}.com", False), ("u{}@bücher.de", True),
]
URLS = [
    ("http://example.com/{}", True), ("https://user:pw@example.org:8080/p?q={}", True), ("ftp://10.0.0.1/{}", True), ("http://exa mple.com/{}", False),
    ("javascript:alert({})", False), ("http://[::1]/{}", True), ("http://[::zz]/{}", False), ("http://example.com:123456/{}", False), ("http://localhost/{}", True),
]
DOMAINS = [("shop{}.example.com", True), ("-a{}.com", False), ("a{}", False), ("x{}.xn--p1ai", True), ("a{}.com.", True), ("a_{}.com", False), ("a{}-.com", False)]
IPS = [("10.0.{}.1", True), ("10.0.0.0{}", False), ("256.1.1.{}", False), ("::{}", True), ("1::2::{}", False), ("::ffff:1.2.3.{}", True), ("fe80::1%{}", False)]
SLUGS = [("ab-{}", True), ("a_b{}", True), ("a b{}", False), ("é{}", False), ("a.{}", False)]
INTS = [("-{}", True), ("{}", True), ("{}.0", False), ("+{}", False)]
LISTS = [("{},2", True), ("{}", True), ("{},", False), ("1,,{}", False)]
NAMES = [("a{}.PDF", True), ("a{}.txt", False), ("pdf{}", False), ("x{}.tar.pdf", True)]
DECIMALS = [("1.{}", True), ("123456.7", False), ("0.0001{}", False), ("NaN", False), ("-12.34", True), ("1234", False)]


def texts(samples, key: str, span: int = 9):
    """Text of the row's remainder, with a digit of the key put in."""
    digit = (F.col(key) % span).cast("string")
    out = None
    for i, (t, _) in enumerate(samples):
        value = F.replace(F.lit(t), F.lit("{}"), digit)
        cond = F.col(key) % len(samples) == i
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def bad_sql(rule: str, samples, key: str = "c_custkey", table: str = "customer") -> str:
    bad = ", ".join(str(i) for i, (_, ok) in enumerate(samples) if not ok)
    return f"SELECT '{rule}' AS rule, {key}::VARCHAR AS key FROM {table} WHERE {key} % {len(samples)} IN ({bad})"


def broken(d: Data, rules: dict) -> F:
    """rules: name -> (samples, validator)."""
    dirty = d.customer.select("c_custkey", *[texts(s, "c_custkey").alias(n) for n, (s, _) in rules.items()])
    named = {n: (check(F.col(n)), F.col(n)) for n, (_, check) in rules.items()}
    return qu.violations(dirty, "c_custkey", named).select("rule", "key")


@query("check_constraint", f"SELECT o_orderkey FROM {NULLABLE} WHERE NOT coalesce(cust < 1400 AND o_totalprice > 2000, TRUE)")
def check_constraint(d: Data):
    cond = (F.col("cust") < 1400) & (F.col("o_totalprice") > 2000)
    return qu.check(nullable_orders(d), cond).select("o_orderkey")


@query("unique_constraint", f"""
SELECT 'key' AS rule, l_orderkey || '/' || l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'partial', cust::VARCHAR, count(*) FROM {NULLABLE} WHERE o_orderstatus = 'F' AND cust IS NOT NULL GROUP BY cust HAVING count(*) > 1
UNION ALL SELECT 'nulls', coalesce(cust::VARCHAR, 'NULL'), count(*) FROM {NULLABLE} GROUP BY cust HAVING count(*) > 1""")
def unique_constraint(d: Data):
    key = qu.duplicates(d.lineitem, [F.col("l_orderkey"), F.col("l_linenumber")], ["a", "b"])
    key = key.select(F.lit("key").alias("rule"), F.concat_ws("/", "a", "b").alias("value"), "n")
    done = qu.duplicates(nullable_orders(d), [F.col("cust")], ["a"], F.col("o_orderstatus") == "F")
    done = done.select(F.lit("partial").alias("rule"), F.col("a").cast("string").alias("value"), "n")
    every = qu.duplicates(nullable_orders(d), [F.col("cust")], ["a"], nulls_distinct=False)
    every = every.select(F.lit("nulls").alias("rule"), F.coalesce(F.col("a").cast("string"), F.lit("NULL")).alias("value"), "n")
    return key.unionByName(done).unionByName(every)


@query("exclusion_constraint", """
WITH b AS (SELECT event_id AS id, user_id AS room, epoch(ts) AS lo, CASE WHEN event_id % 31 <> 0 THEN epoch(ts) + value * 30 END AS hi FROM events)
SELECT a.id, b.id AS other_id FROM b a JOIN b ON a.room = b.room AND a.id < b.id AND (b.hi IS NULL OR a.lo < b.hi) AND (a.hi IS NULL OR b.lo < a.hi)""")
def exclusion_constraint(d: Data):
    """No two bookings of a room may overlap; some are open-ended."""
    lo = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    hi = F.when(F.col("event_id") % 31 != 0, lo + F.col("value") * 30)
    b = d.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("room"), lo.alias("lo"), hi.alias("hi"))
    return qu.exclusion(b, "id", ["room"], "lo", "hi", 1800.0).select("id", "other_id")


@query("foreign_key_check", f"SELECT o_orderkey, cust + 200 AS ref FROM {NULLABLE} WHERE cust IS NOT NULL AND cust + 200 NOT IN (SELECT c_custkey FROM customer)")
def foreign_key_check(d: Data):
    rows = nullable_orders(d).withColumn("ref", F.col("cust") + 200)
    return qu.orphans(rows, "ref", d.customer, "c_custkey").select("o_orderkey", "ref")


@query("null_blank_choices_length", f"""
SELECT 'null' AS rule, o_orderkey::VARCHAR AS key FROM {NULLABLE} WHERE cust IS NULL
UNION ALL SELECT 'blank', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT 'choices', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'max_length', o_orderkey::VARCHAR FROM orders WHERE length(o_orderpriority) > 8""")
def null_blank_choices_length(d: Data):
    note = F.when(F.col("o_orderkey") % 11 == 0, F.lit("")).otherwise("ok")
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return qu.violations(nullable_orders(d), "o_orderkey", {
        "null": (qu.required(F.col("cust"), blank=True), F.col("cust")),
        "blank": (qu.required(note), note),
        "choices": (s.isin("F", "O"), s),
        "max_length": (F.length(p) <= 8, p),
    }).select("rule", "key")


@query("unique_for_date", """
SELECT 'date' AS unit, o_custkey, o_orderdate::DATE::VARCHAR AS period, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'month', o_custkey, month(o_orderdate)::VARCHAR, count(*) FROM orders GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'year', o_custkey, year(o_orderdate)::VARCHAR, count(*) FROM orders GROUP BY ALL HAVING count(*) > 1""")
def unique_for_date(d: Data):
    out = None
    for unit in ("date", "month", "year"):
        part = qu.unique_for(d.orders, "o_custkey", "o_orderdate", unit)
        part = part.select(F.lit(unit).alias("unit"), "o_custkey", F.col("period").cast("string").alias("period"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("min_max_step_length", """
SELECT 'min' AS rule, p_partkey::VARCHAR AS key FROM part WHERE p_size < 5 UNION ALL SELECT 'max', p_partkey::VARCHAR FROM part WHERE p_retailprice > 1800
UNION ALL SELECT 'step', p_partkey::VARCHAR FROM part WHERE (p_size - 1) % 3 <> 0
UNION ALL SELECT 'min_length', p_partkey::VARCHAR FROM part WHERE length(p_name) < 8 UNION ALL SELECT 'max_length', p_partkey::VARCHAR FROM part WHERE length(p_name) > 11""")
def min_max_step_length(d: Data):
    size, price, name = F.col("p_size"), F.col("p_retailprice"), F.col("p_name")
    return qu.violations(d.part, "p_partkey", {
        "min": (size >= 5, size), "max": (price <= 1800, price), "step": (va.step(size / 10, 0.3, 0.1), size),
        "min_length": (F.length(name) >= 8, name), "max_length": (F.length(name) <= 11, name),
    }).select("rule", "key")


@query("decimal_digits", bad_sql("decimal", DECIMALS))
def decimal_digits(d: Data):
    return broken(d, {"decimal": (DECIMALS, lambda c: va.decimal_shape(c, 5, 2))})


@query("email_url_domain", " UNION ALL ".join([bad_sql("email", EMAILS), bad_sql("url", URLS), bad_sql("domain", DOMAINS)]))
def email_url_domain(d: Data):
    return broken(d, {"email": (EMAILS, va.email), "url": (URLS, va.url), "domain": (DOMAINS, va.domain)})


@query("page_urls", "SELECT page_id, regexp_matches(url, '^https?://[a-z0-9.-]+\\.[a-z]{2,}(/\\S*)?$') AS valid FROM pages")
def page_urls(d: Data):
    return d.pages.select("page_id", va.url(F.col("url")).alias("valid"))


@query("ip_addresses", bad_sql("ip", IPS))
def ip_addresses(d: Data):
    return broken(d, {"ip": (IPS, va.ip)})


@query("slug_integer_list_extension", " UNION ALL ".join([bad_sql("slug", SLUGS), bad_sql("integer", INTS), bad_sql("list", LISTS), bad_sql("extension", NAMES)]))
def slug_integer_list_extension(d: Data):
    return broken(d, {
        "slug": (SLUGS, va.slug), "integer": (INTS, va.integer), "list": (LISTS, va.integer_list),
        "extension": (NAMES, lambda c: va.file_extension(c, ["pdf"]) & va.no_nul(c) & va.matches(c, r"\.")),
    })
