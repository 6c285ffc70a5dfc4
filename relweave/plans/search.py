"""Full-text, trigram and keyword search."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.operators import search as se
from relweave.plans.registry import Data, query

TOKS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
POST = f"(SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1)::INT AS position FROM (SELECT doc_id, {TOKS.format('text')} AS t FROM documents))"


@query("search_vector", f"""
SELECT doc_id, token, position, CASE WHEN position = 1 THEN 'A' ELSE 'D' END AS weight FROM
 (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1)::INT AS position FROM (SELECT doc_id, [lower(source)] || {TOKS.format('text')} AS t FROM documents))""")
def search_vector(d: Data):
    return se.postings(d.documents, "doc_id", A=("source",), D=("text",))


@query("search_match", f"""
WITH t AS (SELECT doc_id, {TOKS.format('text')} AS t, ' ' || array_to_string({TOKS.format('text')}, ' ') || ' ' AS s FROM documents)
SELECT doc_id, list_has_all(t, ['the', 'and']) AS plain, contains(s, ' of the ') AS phrase,
 contains(s, ' in the ') AND (list_contains(t, 'der') OR list_contains(t, 'and')) AND NOT list_contains(t, 'les') AS web,
 (list_contains(t, 'die') OR list_contains(t, 'la')) AND NOT list_contains(t, 'of') AS combined FROM t""")
def search_match(d: Data):
    df = d.documents.select("doc_id", se.words(F.col("text")).alias("t"))
    t = F.col("t")
    return df.select(
        "doc_id", se.plain(t, "the AND").alias("plain"), se.phrase(t, "of the").alias("phrase"),
        se.websearch(t, '"in the" der OR and -les').alias("web"),
        ((se.term(t, "die") | se.term(t, "la")) & ~se.term(t, "of")).alias("combined"))


@query("search_match_postings", f"SELECT doc_id FROM {POST} WHERE token IN ('the', 'and', 'of') GROUP BY 1 HAVING count(DISTINCT token) = 3")
def search_match_postings(d: Data):
    return se.match_postings(se.postings(d.documents, "doc_id", ["the", "and", "of"], D=("text",)), "doc_id", ["the", "and", "of"])


@query("search_rank", f"""
SELECT doc_id, round(sum(0.1 / (j * j)) / (pi() * pi() / 6) / 2 / (1 + ln(n)), 8) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY doc_id, token ORDER BY position) AS j FROM {POST} WHERE token IN ('the', 'and'))
 JOIN (SELECT doc_id, len({TOKS.format('text')}) AS n FROM documents) USING (doc_id) GROUP BY doc_id, n""")
def search_rank(d: Data):
    out = se.rank_texts(d.documents, "doc_id", ["the", "and"], normalization=1, D=("text",))
    return out.select("doc_id", F.round("rank", 8).alias("rank"))


@query("search_rank_cover", f"""
WITH h AS (SELECT doc_id, position, max(CASE WHEN token = 'and' THEN position END) OVER w AS a, max(CASE WHEN token = 'the' THEN position END) OVER w AS b
 FROM {POST} WHERE token IN ('the', 'and') WINDOW w AS (PARTITION BY doc_id ORDER BY position)),
 s AS (SELECT doc_id, least(a, b) AS start, min(position - least(a, b) + 1) AS span FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)
SELECT doc_id, round(sum(1.0 / span), 6)::DOUBLE AS rank FROM s GROUP BY 1""")
def search_rank_cover(d: Data):
    out = se.cover_rank_texts(d.documents, "doc_id", ["the", "and"], D=("text",))
    return out.select("doc_id", F.round("rank", 6).alias("rank"))


@query("headline")
def headline(d: Data):
    toks = se.words(F.col("text"))
    hits = d.documents.where(se.term(toks, "the") | se.term(toks, "der"))
    return hits.select("doc_id", se.headline(F.col("text"), ["the", "der"], max_words=12, lead=3).alias("headline"))


@query("headline_fragments")
def headline_fragments(d: Data):
    pieces = se.headline_fragments(F.col("text"), ["the", "der"], max_fragments=3, max_words=8, min_words=4)
    return d.documents.select("doc_id", pieces.alias("headline"))


GRAMS = "list_distinct(flatten(list_transform({t}, lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
PGRAMS = GRAMS.format(t="string_split(p_name, ' ')")
QGRAMS = GRAMS.format(t="['hot', 'plates']")


@query("trigram_similarity", f"""
SELECT p_partkey, round(i / (len(a) + len(b) - i), 6)::DOUBLE AS similarity, round(1 - i / (len(a) + len(b) - i), 6)::DOUBLE AS distance FROM
 (SELECT *, len(list_intersect(a, b)) AS i FROM (SELECT p_partkey, {PGRAMS} AS a, {QGRAMS} AS b FROM part))""")
def trigram_similarity(d: Data):
    n, q = F.col("p_name"), F.lit("hot plates")
    return d.part.select("p_partkey", F.round(se.similarity(n, q), 6).alias("similarity"), F.round(se.distance(n, q), 6).alias("distance"))


@query("trigram_word_similarity")
def trigram_word_similarity(d: Data):
    n, q = F.col("p_name"), F.lit("plat")
    names = d.part.select("p_name").distinct()
    return names.select(
        "p_name", F.round(se.word_similarity(q, n), 6).alias("word"), F.round(1 - se.word_similarity(q, n), 6).alias("word_distance"),
        F.round(se.strict_word_similarity(q, n), 6).alias("strict"))


NAMES = """(SELECT DISTINCT p_name || ' ' || lower(p_type) AS text FROM part)"""


@query("trigram_similarity_join", f"""
WITH t AS (SELECT text, {GRAMS.format(t="string_split(text, ' ')")} AS g FROM {NAMES}),
 p AS (SELECT x.text AS a, y.text AS b, len(list_intersect(x.g, y.g)) AS i, len(x.g) + len(y.g) AS n FROM t x JOIN t y ON x.text < y.text)
SELECT a, b, round(i / (n - i), 6)::DOUBLE AS similarity FROM p WHERE i / (n - i) >= 0.7""")
def trigram_similarity_join(d: Data):
    names = d.part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"))
    out = se.similarity_join(names, names, 0.7).where("a < b")
    return out.withColumn("similarity", F.round("similarity", 6))


@query("keyword_search", "SELECT p_partkey FROM part WHERE (p_name ILIKE '%ring%' OR p_type ILIKE 'ring%' OR lower(p_brand) = 'ring') AND (p_name ILIKE '%promo%' OR p_type ILIKE 'promo%' OR lower(p_brand) = 'promo')")
def keyword_search(d: Data):
    return d.part.where(se.keyword_condition("Ring PROMO", ["p_name", "^p_type", "=p_brand"])).select("p_partkey")


@query("keyword_search_related", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority ILIKE '%urgent%' AND o_orderstatus ILIKE 'f%')")
def keyword_search_related(d: Data):
    """Fields on a to-many path: a semi join, so no parent repeats."""
    hits = d.orders.where(se.keyword_condition("urgent", ["o_orderpriority"]) & se.keyword_condition("f", ["^o_orderstatus"]))
    return d.customer.join(hits, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")
