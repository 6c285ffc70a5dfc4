"""String, date, number, array, map and JSON functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions import collections as co
from relweave.functions import documents as js
from relweave.functions import temporal as tm
from relweave.functions import text as tx
from relweave.plans.registry import Data, query
from relweave.runtime import ntz


@query("upper_lower", "SELECT doc_id, upper(source) AS u, lower(upper(source)) AS l FROM documents")
def upper_lower(d: Data):
    return d.documents.select("doc_id", F.upper("source").alias("u"), F.lower(F.upper("source")).alias("l"))


@query("length", "SELECT doc_id, length(text) AS n FROM documents")
def length(d: Data):
    return d.documents.select("doc_id", F.char_length("text").alias("n"))


@query("trim_functions", "SELECT p_partkey, trim('  ' || p_name || ' ') AS t, ltrim('  ' || p_name) || '|' AS l, '|' || rtrim(p_name || '  ') || '|' AS r FROM part")
def trim_functions(d: Data):
    n = F.col("p_name")
    return d.part.select(
        "p_partkey", F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"),
        F.concat(F.ltrim(F.concat(F.lit("  "), n)), F.lit("|")).alias("l"),
        F.concat(F.lit("|"), F.rtrim(F.concat(n, F.lit("  "))), F.lit("|")).alias("r"))


@query("pad_functions", "SELECT p_partkey, lpad(p_name, 10, '*') AS l, rpad(p_name, 10, ' ') AS r FROM part")
def pad_functions(d: Data):
    return d.part.select("p_partkey", tx.pad(F.col("p_name"), 10, "*").alias("l"), tx.pad(F.col("p_name"), 10, side="right").alias("r"))


@query("left_right", "SELECT c_custkey, left(c_name, 4) AS l, right(c_name, 3) AS r FROM customer")
def left_right(d: Data):
    n = F.col("c_name")
    return d.customer.select("c_custkey", tx.left(n, 4).alias("l"), tx.right(n, 3).alias("r"))


@query("substr", "SELECT c_custkey, substring(c_name, 3) AS tail, substring(c_name, 2, 5) AS mid FROM customer")
def substr(d: Data):
    n = F.col("c_name")
    return d.customer.select("c_custkey", F.substring(n, F.lit(3), F.char_length(n)).alias("tail"), F.substring(n, 2, 5).alias("mid"))


@query("str_index", "SELECT p_partkey, instr(p_name, 'r') AS at, instr(p_name, 'zzz') AS absent FROM part")
def str_index(d: Data):
    n = F.col("p_name")
    return d.part.select("p_partkey", tx.str_index(n, F.lit("r")).alias("at"), tx.str_index(n, F.lit("zzz")).alias("absent"))


@query("concat", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END, '') || '-' || o_custkey::VARCHAR AS tag FROM orders")
def concat(d: Data):
    part = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))
    return d.orders.select("o_orderkey", tx.concat_text(part, F.lit("-"), F.col("o_custkey")).alias("tag"))


@query("repeat_replace_reverse", "SELECT p_partkey, repeat(p_brand, 2) AS rp, replace(p_name, 'a', '') AS rl, reverse(p_name) AS rv FROM part")
def repeat_replace_reverse(d: Data):
    n = F.col("p_name")
    return d.part.select("p_partkey", F.repeat("p_brand", 2).alias("rp"), F.replace(n, F.lit("a"), F.lit("")).alias("rl"), F.reverse(n).alias("rv"))


@query("chr_ord", "SELECT doc_id, chr(CAST(200 + doc_id % 20000 AS INTEGER)) AS c, unicode(text) AS o FROM documents WHERE length(text) > 0")
def chr_ord(d: Data):
    code = (F.lit(200) + F.col("doc_id") % 20000).cast("int")
    return d.documents.where(F.length("text") > 0).select("doc_id", tx.char_of(code).alias("c"), tx.code_of(F.col("text")).alias("o"))


@query("digests", "SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s256 FROM documents")
def digests(d: Data):
    t = F.col("text")
    return d.documents.select("doc_id", F.md5(t).alias("m"), F.sha1(t).alias("s1"), F.sha2(t, 256).alias("s256"))


@query("digests_long")
def digests_long(d: Data):
    t = F.col("text")
    return d.documents.select("doc_id", *[F.sha2(t, n).alias(f"s{n}") for n in (224, 384, 512)])


@query("collate", "SELECT p_partkey FROM part WHERE lower(p_name) = lower('RED Plate') OR lower(p_type) < 'f'")
def collate(d: Data):
    ci = tx.fold_case(F.col("p_name"))
    return d.part.where((ci == F.lit("RED Plate")) | (tx.fold_case(F.col("p_type")) < F.lit("f"))).select("p_partkey")


@query("unaccent", "SELECT doc_id, lang FROM documents WHERE contains(strip_accents(lower(replace(replace(replace(text, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'))), 'etre')")
def unaccent(d: Data):
    return d.documents.where(tx.unaccent(F.lower("text")).contains("etre")).select("doc_id", "lang")


@query("case_insensitive_columns", "SELECT lower(p_type) AS kind, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS p_type FROM part) GROUP BY 1")
def case_insensitive_columns(d: Data):
    """Grouping on a case-insensitive column joins the spellings."""
    mixed = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    per = d.part.select(tx.fold_case(mixed).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    return per.select(F.lower(F.collate("kind", "UTF8_BINARY")).alias("kind"), "n")


@query("extract_date_parts", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, quarter(o_orderdate)::INT AS q FROM orders")
def extract_date_parts(d: Data):
    t = F.col("o_orderdate")
    return d.orders.select("o_orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("d"), F.quarter(t).alias("q"))


@query("extract_iso", "SELECT o_orderkey, isoyear(o_orderdate)::INT AS iy, week(o_orderdate)::INT AS w FROM orders")
def extract_iso(d: Data):
    t = F.col("o_orderdate")
    return d.orders.select("o_orderkey", tm.iso_year(t).alias("iy"), F.weekofyear(t).alias("w"))


@query("extract_week_day", "SELECT o_orderkey, (dayofweek(o_orderdate) + 1)::INT AS wd, isodow(o_orderdate)::INT AS iwd FROM orders")
def extract_week_day(d: Data):
    t = F.col("o_orderdate")
    return d.orders.select("o_orderkey", F.dayofweek(t).alias("wd"), tm.iso_week_day(t).alias("iwd"))


@query("extract_clock", "SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS m, second(ts)::INT AS s, date_diff('day', TIMESTAMP '2024-01-01', ts)::INT AS days FROM events")
def extract_clock(d: Data):
    t = F.col("ts")
    gap = F.extract(F.lit("day"), t - ntz("2024-01-01 00:00:00"))
    return d.events.select("event_id", F.hour(t).alias("h"), F.minute(t).alias("m"), tm.whole_second(t).alias("s"), gap.alias("days"))


UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


@query("trunc_units", "SELECT event_id, " + ", ".join(f"date_trunc('{u}', ts)::TIMESTAMP AS t_{u}" for u in UNITS) + " FROM events")
def trunc_units(d: Data):
    return d.events.select("event_id", *[tm.trunc(F.col("ts"), u).alias(f"t_{u}") for u in UNITS])


@query("trunc_in_zone", "SELECT event_id, date_trunc('day', timezone('America/New_York', timezone('UTC', ts)))::TIMESTAMP AS local_day FROM events")
def trunc_in_zone(d: Data):
    """The zone shift comes before the truncation."""
    return d.events.select("event_id", tm.trunc(tm.in_zone(F.col("ts"), "America/New_York"), "day").alias("local_day"))


@query("trunc_date_time", "SELECT event_id, ts::DATE AS day, epoch(ts - date_trunc('day', ts)) AS clock FROM events")
def trunc_date_time(d: Data):
    t = F.col("ts")
    return d.events.select("event_id", F.to_date(t).alias("day"), F.round(tm.interval_seconds(tm.time_of_day(t)), 6).alias("clock"))


@query("now", "SELECT count(*) AS n, TRUE AS fixed FROM events WHERE ts < now()::TIMESTAMP")
def now(d: Data):
    """One value per statement, and per transaction."""
    t = F.current_timestamp()
    past = d.events.where(F.col("ts") < F.localtimestamp())
    return past.select(t.alias("a"), F.current_timestamp().alias("b")).agg(
        F.count("*").alias("n"), ((F.count_distinct("a") == 1) & F.bool_and(F.col("a") == F.col("b"))).alias("fixed"))


@query("parse_dates", """
SELECT o_orderkey, o_orderdate::DATE AS d1, CASE WHEN month(o_orderdate) < 3 THEN NULL ELSE o_orderdate::DATE END AS d2,
 o_orderdate + INTERVAL 3723 SECOND AS ts, (3720.5 + o_orderkey % 60)::DOUBLE AS clock, ((o_orderkey % 9) * 86400 + 10923.25)::DOUBLE AS gap FROM orders""")
def parse_dates(d: Data):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    loose = F.when(F.month("o_orderdate") < 3, F.lit("2020-13-40")).otherwise(F.date_format("o_orderdate", "yyyy-M-d"))
    key = F.col("o_orderkey")
    clock = F.concat(F.lit("1:02:"), (key % 60).cast("string"), F.lit(".5"))
    gap = F.concat((key % 9).cast("string"), F.lit(" days, 03:02:03.25"))
    return d.orders.select(
        "o_orderkey", tm.parse_date(day).alias("d1"), tm.parse_date(loose).alias("d2"),
        tm.parse_timestamp(F.concat(day, F.lit("T01:02:03"))).alias("ts"),
        tm.interval_seconds(tm.parse_time(clock)).alias("clock"), tm.interval_seconds(tm.parse_duration(gap)).alias("gap"))


def _unit(value: str, name: str) -> str:
    return f"{value} || chr(160) || '{name}' || CASE WHEN {value} = 1 THEN '' ELSE 's' END"


def _run(*units: tuple[str, str]) -> str:
    """SQL text of the first non-zero unit and the next one if non-zero."""
    cases = ""
    for (v, n), after in zip(units, [*units[1:], None]):
        more = f" || CASE WHEN {after[0]} > 0 THEN ', ' || {_unit(*after)} ELSE '' END" if after else ""
        cases += f" WHEN {v} > 0 THEN {_unit(v, n)}{more}"
    return f"CASE{cases} ELSE '0' || chr(160) || 'minutes' END"


@query("time_since", f"""
WITH m AS (SELECT *, date_diff('month', o_orderdate, TIMESTAMP '1998-05-20') - (CASE WHEN day(o_orderdate) > 20 THEN 1 ELSE 0 END) AS m FROM orders WHERE o_orderdate < '1998-05-20'),
 r AS (SELECT *, date_diff('day', o_orderdate + to_months(m::INT), TIMESTAMP '1998-05-20') AS r FROM m),
 p AS (SELECT o_orderkey, (m // 12) AS y, (m % 12) AS mo, (r // 7) AS w, (r % 7) AS dd FROM r)
SELECT o_orderkey, {_run(("y", "year"), ("mo", "month"), ("w", "week"), ("dd", "day"))} AS age FROM p
UNION ALL SELECT o_orderkey, '0' || chr(160) || 'minutes' FROM orders WHERE o_orderdate >= '1998-05-20'""")
def time_since(d: Data):
    return d.orders.select("o_orderkey", tm.elapsed(F.col("o_orderdate"), ntz("1998-05-20 00:00:00")).alias("age"))


@query("abs_sign_ceil_floor", "SELECT c_custkey, abs(c_acctbal) AS a, sign(c_acctbal)::DOUBLE AS s, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f FROM customer")
def abs_sign_ceil_floor(d: Data):
    b = F.col("c_acctbal")
    return d.customer.select("c_custkey", F.abs(b).alias("a"), F.signum(b).alias("s"), F.ceil(b).alias("c"), F.floor(b).alias("f"))


@query("round", "SELECT o_orderkey, round(sqrt(o_totalprice), 1) AS r1, round(sqrt(o_totalprice)) AS r0, round(o_totalprice::BIGINT, -3)::BIGINT AS rn FROM orders")
def round_(d: Data):
    """Square roots never lie half-way, so every engine rounds them alike."""
    p = F.sqrt("o_totalprice")
    return d.orders.select("o_orderkey", F.round(p, 1).alias("r1"), F.round(p, 0).alias("r0"), F.round(F.rint("o_totalprice").cast("bigint"), -3).alias("rn"))


@query("mod_power_sqrt_exp", "SELECT p_partkey, p_size % 7 AS m, pow(p_size, 3) AS p, round(sqrt(p_size), 8) AS s, round(exp(p_size / 25.0), 8) AS e FROM part")
def mod_power_sqrt_exp(d: Data):
    s = F.col("p_size")
    return d.part.select("p_partkey", (s % 7).alias("m"), F.pow(s, F.lit(3)).alias("p"), F.round(F.sqrt(s), 8).alias("s"), F.round(F.exp(s / 25.0), 8).alias("e"))


@query("logarithms", "SELECT p_partkey, round(ln(p_size), 8) AS l, round(ln(p_retailprice) / ln(3), 8) AS l3 FROM part")
def logarithms(d: Data):
    return d.part.select("p_partkey", F.round(F.ln("p_size"), 8).alias("l"), F.round(F.log(3.0, F.col("p_retailprice")), 8).alias("l3"))


@query("trigonometry", """
SELECT vec_id, round(sin(x), 8) AS s, round(cos(x), 8) AS c, round(tan(x), 8) AS t, round(1 / tan(x + 2), 6) AS ct, round(asin(x), 8) AS "as",
 round(acos(x), 8) AS ac, round(atan(x), 8) AS at, round(atan2(x, 0.5), 8) AS at2 FROM (SELECT vec_id, embedding[1]::DOUBLE AS x FROM embeddings)""")
def trigonometry(d: Data):
    v = d.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    x = F.col("x")
    fns = {"s": F.sin(x), "c": F.cos(x), "t": F.tan(x), "as": F.asin(x), "ac": F.acos(x), "at": F.atan(x), "at2": F.atan2(x, F.lit(0.5))}
    return v.select("vec_id", F.round(F.cot(x + 2), 6).alias("ct"), *[F.round(c, 8).alias(n) for n, c in fns.items()])


@query("degrees_radians_pi", "SELECT p_partkey, round(degrees(p_size), 6) AS d, round(radians(p_size), 8) AS r, round(pi() * p_size, 8) AS p FROM part")
def degrees_radians_pi(d: Data):
    s = F.col("p_size")
    return d.part.select("p_partkey", F.round(F.degrees(s), 6).alias("d"), F.round(F.radians(s), 8).alias("r"), F.round(F.pi() * s, 8).alias("p"))


@query("random", "SELECT count(*) AS n, TRUE AS in_range FROM orders")
def random(d: Data):
    r = d.orders.select(F.rand(7).alias("r"))
    return r.agg(F.count("*").alias("n"), F.bool_and((F.col("r") >= 0) & (F.col("r") < 1)).alias("in_range"))


@query("random_uuid", "SELECT count(*) AS n, count(*) AS different, TRUE AS version_4 FROM orders")
def random_uuid(d: Data):
    ids = d.orders.select(F.expr("uuid()").alias("u"))
    return ids.agg(F.count("*").alias("n"), F.count_distinct("u").alias("different"), F.bool_and(F.substring("u", 15, 1) == "4").alias("version_4"))


@query("cast", "SELECT o_orderkey, o_orderkey::VARCHAR AS s, sqrt(o_totalprice)::DECIMAL(12, 1)::DOUBLE AS dec, o_orderdate::DATE AS day, try_cast(o_orderpriority AS INTEGER) AS bad, left(o_orderpriority, 1)::INT AS good FROM orders")
def cast(d: Data):
    return d.orders.select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("s"), F.sqrt("o_totalprice").cast("decimal(12,1)").cast("double").alias("dec"),
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").try_cast("int").alias("bad"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("good"))


@query("coalesce_nullif", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS s FROM orders")
def coalesce_nullif(d: Data):
    return d.orders.select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("F")), F.lit("done")).alias("s"))


@query("greatest_least", "SELECT p_partkey, greatest(p_size, 25, CASE WHEN p_partkey % 3 = 0 THEN 40 END) AS g, least(p_size, 25, CASE WHEN p_partkey % 3 = 0 THEN 10 END) AS l FROM part")
def greatest_least(d: Data):
    """NULL arguments are skipped."""
    s, third = F.col("p_size"), F.col("p_partkey") % 3 == 0
    return d.part.select("p_partkey", F.greatest(s, F.lit(25), F.when(third, 40)).alias("g"), F.least(s, F.lit(25), F.when(third, 10)).alias("l"))


def tagged(d: Data):
    """Parts with word tags and a string map."""
    attrs = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")))
    return d.part.select("p_partkey", F.split("p_name", " ").alias("tags"), attrs.alias("attrs"))


TAGS = "(SELECT p_partkey, string_split(p_name, ' ') AS tags FROM part)"


@query("array_contains_overlap", f"SELECT p_partkey, list_has_all(tags, ['hot', 'rod']) AS c, list_has_all(['hot', 'old', 'rod'], tags) AS b, list_has_any(tags, ['ring', 'red']) AS o FROM {TAGS}")
def array_contains_overlap(d: Data):
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    t = F.col("tags")
    return tagged(d).select(
        "p_partkey", co.contains(t, lit("hot", "rod")).alias("c"), co.contained_by(t, lit("hot", "old", "rod")).alias("b"), co.overlap(t, lit("ring", "red")).alias("o"))


@query("array_exact_in", f"SELECT p_partkey FROM {TAGS} WHERE tags = ['hot', 'rod'] OR tags IN (['red', 'plate'], ['old', 'ring'])")
def array_exact_in(d: Data):
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    wanted = tagged(d).sparkSession.createDataFrame([(["red", "plate"],), (["old", "ring"],)], "tags array<string>")
    listed = tagged(d).join(wanted, "tags", "left_semi").select("p_partkey")
    return listed.union(tagged(d).where(F.col("tags") == lit("hot", "rod")).select("p_partkey")).distinct()


@query("array_len", f"SELECT p_partkey, len(tags) AS n, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 0 END AS z FROM {TAGS}")
def array_len(d: Data):
    none = F.when(F.col("p_partkey") % 4 != 0, F.array().cast("array<string>"))
    return tagged(d).select("p_partkey", co.length(F.col("tags")).alias("n"), co.length(none).alias("z"))


@query("array_index_slice", f"SELECT p_partkey, tags[1] AS first, tags[5] AS beyond, tags[1:1] AS head, tags[2:5] AS rest FROM {TAGS}")
def array_index_slice(d: Data):
    t = F.col("tags")
    return tagged(d).select("p_partkey", co.at(t, 0).alias("first"), co.at(t, 4).alias("beyond"), co.between(t, 0, 1).alias("head"), co.between(t, 1, 5).alias("rest"))


@query("array_literal_nested", "SELECT p_partkey, [[p_size, p_size + 1], [0]] AS nested, TRUE AS fits FROM part")
def array_literal_nested(d: Data):
    s = F.col("p_size")
    nested = F.array(F.array(s, s + 1), F.array(F.lit(0)))
    return d.part.select("p_partkey", nested.alias("nested"), co.fits(nested, 2).alias("fits"))


@query("map_key_access", "SELECT p_partkey, p_brand AS brand, CASE WHEN p_size > 10 THEN p_size::VARCHAR END AS size, NULL::VARCHAR AS missing FROM part")
def map_key_access(d: Data):
    return tagged(d).select("p_partkey", *[co.map_value(F.col("attrs"), k).alias(k) for k in ("brand", "size", "missing")])


@query("map_keys_values", "SELECT p_partkey, ['brand', 'size', 'type'] AS keys, p_brand || ',' || p_type AS vals FROM part")
def map_keys_values(d: Data):
    a = F.col("attrs")
    return tagged(d).select("p_partkey", F.array_sort(F.map_keys(a)).alias("keys"), F.concat_ws(",", F.slice(F.map_values(a), 1, 2)).alias("vals"))


@query("map_has_keys", "SELECT p_partkey, TRUE AS one, FALSE AS every, TRUE AS some FROM part")
def map_has_keys(d: Data):
    a = F.col("attrs")
    return tagged(d).select("p_partkey", co.has_key(a, "size").alias("one"), co.has_keys(a, ["brand", "colour"]).alias("every"), co.has_any_keys(a, ["brand", "colour"]).alias("some"))


@query("map_contains", "SELECT p_partkey, p_brand = 'Brand#11' AS c, p_brand = 'Brand#11' AND p_type = 'PROMO' AND p_size <= 10 AS b FROM part")
def map_contains(d: Data):
    a = F.col("attrs")
    some = F.create_map(F.lit("brand"), F.lit("Brand#11"))
    full = F.create_map(F.lit("brand"), F.lit("Brand#11"), F.lit("type"), F.lit("PROMO"), F.lit("size"), F.lit(None).cast("string"))
    return tagged(d).select("p_partkey", co.map_contains(a, some).alias("c"), co.map_contains(full, a).alias("b"))


def json_docs(d: Data):
    """Events as nested JSON documents, with a null and a missing key."""
    k = F.get_json_object("props", "$.k")
    doc = F.concat(
        F.lit('{"k":'), k, F.lit(',"user":{"id":'), F.col("user_id").cast("string"), F.lit(',"type":"'), F.col("event_type"),
        F.lit('"},"tags":["'), F.col("event_type"), F.lit('",'), k, F.lit("]"),
        F.when(F.col("event_id") % 3 == 0, F.lit(',"note":null')).otherwise(F.lit("")), F.lit("}"))
    return d.events.select("event_id", "props", doc.alias("data"))


DOCS = """(SELECT event_id, props, user_id, event_type, (props->>'k')::INT AS k, event_id % 3 = 0 AS noted FROM events)"""


@query("json_path", f"SELECT event_id, user_id::BIGINT AS uid, event_type AS tag, k::VARCHAR AS second, NULL::VARCHAR AS gone FROM {DOCS}")
def json_path(d: Data):
    v = F.col("data")
    return json_docs(d).select(
        "event_id", js.value_at(v, "user", "id", kind="bigint").alias("uid"), js.value_at(v, "tags", 0).alias("tag"),
        js.value_at(v, "tags", 1).alias("second"), js.value_at(v, "a", 3).alias("gone"))


@query("json_contains", f"SELECT event_id, k = 5 AS flat, event_type = 'click' AS nested, user_id = 3 AS deep, k = 7 AS inside FROM {DOCS}")
def json_contains(d: Data):
    v = F.col("data")
    return json_docs(d).select(
        "event_id", js.contains(v, {"k": 5}).alias("flat"), js.contains(v, {"tags": ["click"]}).alias("nested"),
        js.contains(v, {"user": {"id": 3}}).alias("deep"), js.contained_by(F.col("props"), {"k": 7, "z": [1]}).alias("inside"))


@query("json_has_key", f"SELECT event_id, noted AS note, noted AS every, TRUE AS some, TRUE AS idx FROM {DOCS}")
def json_has_key(d: Data):
    v = F.col("data")
    return json_docs(d).select(
        "event_id", js.has_key(v, "note").alias("note"), js.has_keys(v, ["note", "k"]).alias("every"),
        js.has_any_keys(v, ["zz", "k"]).alias("some"), js.has_path(v, "tags", 1).alias("idx"))


@query("json_key_lookups", f"""
SELECT event_id, k > 50 AS gt, k IN (1, 2, 3) AS isin, event_type ILIKE 'c%' AS istarts, contains(event_type, 'ur') AS has,
 noted AS is_null, NOT noted AS missing, regexp_matches(event_type, 'i.w$') AS rx FROM {DOCS}""")
def json_key_lookups(d: Data):
    v = F.col("data")
    kind = js.value_at(v, "user", "type")
    k = js.value_at(v, "k", kind="int")
    return json_docs(d).select(
        "event_id", (k > 50).alias("gt"), k.isin(1, 2, 3).alias("isin"), F.lower(kind).startswith("c").alias("istarts"),
        kind.contains("ur").alias("has"), js.is_null_value(v, "note").alias("is_null"), (~js.has_path(v, "note")).alias("missing"), kind.rlike("i.w$").alias("rx"))


@query("json_exact", f"SELECT event_id, k = 42 AS same, contains(lower(props), '\"k\": 4') AS has FROM {DOCS}")
def json_exact(d: Data):
    return d.events.select("event_id", js.same_document(F.col("props"), {"k": 42}).alias("same"), F.lower("props").contains('"k": 4').alias("has"))


@query("json_build", """
SELECT o_orderkey, '{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","none":null}' AS obj, '[' || o_custkey || ',"' || o_orderpriority || '",null]' AS arr FROM orders""")
def json_build(d: Data):
    none = F.lit(None).cast("string")
    return d.orders.select(
        "o_orderkey", js.build_object(key=F.col("o_orderkey"), status=F.col("o_orderstatus"), none=none).alias("obj"),
        js.build_array(F.col("o_custkey"), F.col("o_orderpriority"), none).alias("arr"))
