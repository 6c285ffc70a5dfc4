"""Function registration: scalars, lookups, aggregates, row generators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.functions import lookups as lk
from relweave.functions import registry as rg
from relweave.plans.projection import rows
from relweave.plans.registry import Data, query


@query("scalar_function", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, levenshtein(o_orderpriority, '1-URGENT')::INT AS d FROM orders")
def scalar_function(d: Data):
    return d.orders.select(
        "o_orderkey", rg.func("date_format", F.col("o_orderdate"), F.lit("yyyy-MM")).alias("month"),
        rg.func("levenshtein", F.col("o_orderpriority"), F.lit("1-URGENT"), arity=2).alias("d"))


@query("registered_lookups", "SELECT p_partkey, 'odd' AS test FROM part WHERE p_size % 2 = 1 UNION ALL SELECT p_partkey, 'initials' FROM part WHERE left(p_name, 2) = 'ho' UNION ALL SELECT p_partkey, 'bare' FROM part WHERE replace(p_name, ' ', '') = replace('hot rod', ' ', '')")
def registered_lookups(d: Data):
    """A new lookup, a new transform and one that applies to both sides."""
    lk.register_lookup("is_odd", lambda c, v: (c % 2 == 1) == F.lit(v))
    lk.register_transform("initials", lambda c: F.left(c, F.lit(2)))
    lk.register_transform("bare", lambda c: F.replace(c, F.lit(" "), F.lit("")), bilateral=True)
    base = rows(d, "part")
    pick = lambda name, **kw: base.filter(**kw).values("p_partkey", test=F.lit(name))
    return pick("odd", p_size__is_odd=True).union(pick("initials", p_name__initials="ho")).union(pick("bare", p_name__bare="hot rod"))


@query("custom_aggregate", "SELECT p_brand, round(geomean(p_retailprice), 6) AS g, round(max(p_retailprice) - min(p_retailprice), 2) AS r FROM part GROUP BY 1")
def custom_aggregate(d: Data):
    p = F.col("p_retailprice")
    return d.part.groupBy("p_brand").agg(F.round(rg.aggregate("geometric_mean", p), 6).alias("g"), F.round(rg.aggregate("value_range", p), 2).alias("r"))


@query("set_returning_function", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def set_returning_function(d: Data):
    return rg.rows_of(d.part.select("p_partkey", "p_name"), "word", F.split("p_name", " ")).select("p_partkey", "word")


@query("engine_side_functions", "SELECT doc_id, regexp_matches(text, '\\bthe\\b') AS hit, md5(lang) AS h, repeat(lang, 2) AS r, ((doc_id % 7)::INT // 2)::BIGINT AS q FROM documents")
def engine_side_functions(d: Data):
    return d.documents.select(
        "doc_id", F.col("text").rlike(r"\bthe\b").alias("hit"), F.md5("lang").alias("h"), F.repeat("lang", 2).alias("r"), F.expr("(doc_id % 7) div 2").alias("q"))


def large(limit: float):
    def run(df: DataFrame) -> DataFrame:
        return df.where(F.col("o_totalprice") > limit)

    return run


def per_customer(df: DataFrame) -> DataFrame:
    return df.groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("reusable_query_methods", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY 1")
def reusable_query_methods(d: Data):
    return d.orders.transform(large(150000)).transform(per_customer)
