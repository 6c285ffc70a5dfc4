"""Text-cleaning columns over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.operators import cleaning as cl
from relweave.plans.registry import Data, query


@query("strip_tags")
def strip_tags(d: Data):
    return d.pages.select("page_id", cl.strip_tags(F.col("html")).alias("text"))


@query("strip_tags_simple", "SELECT doc_id, text AS stripped FROM documents")
def strip_tags_simple(d: Data):
    """A document wrapped in tags comes back as it was."""
    inner = F.regexp_replace("text", "[<>&]", " ")
    marked = F.concat(F.lit("<p class='a'>"), inner, F.lit("</p><br/>"))
    same = cl.strip_tags(marked) == inner
    return d.documents.select("doc_id", F.when(same, F.col("text")).otherwise("differs").alias("stripped"))


@query("spaces_and_newlines", "SELECT page_id, length(regexp_replace(html, '>\\s+<', '><', 'g')) AS n, length(replace(url || chr(10), chr(13), '')) AS u FROM pages")
def spaces_and_newlines(d: Data):
    url = cl.normalize_newlines(F.concat("url", F.lit("\r\n")))
    return d.pages.select("page_id", F.length(cl.collapse_between_tags(F.col("html"))).alias("n"), F.length(url).alias("u"))


@query("escape_linebreaks", """
SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped,
 md5('<p>' || replace(regexp_replace(replace(text, chr(13), chr(10)), '\\n{2,}', '</p>' || chr(1) || chr(1) || '<p>', 'g'), chr(10), '<br>').replace(chr(1), chr(10)) || '</p>') AS broken FROM documents""")
def escape_linebreaks(d: Data):
    t = F.col("text")
    return d.documents.select("doc_id", F.md5(cl.escape(t)).alias("escaped"), F.md5(cl.linebreaks(t)).alias("broken"))


@query("extract_links")
def extract_links(d: Data):
    docs = cl.extract_links(d.documents, "doc_id", "text")
    pages = cl.extract_links(d.pages.select(F.col("page_id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("("), "url", F.lit(").")), "html").alias("text")), "doc_id", "text")
    return docs.unionByName(pages)


@query("extract_links_simple", """
SELECT c_custkey, w AS word, u AS url FROM customer, (VALUES (0, 'www.shop.com', 'http://www.shop.com'), (1, 'https://a.io/x?y=1', 'https://a.io/x?y=1'), (2, 'me@example.org', 'mailto:me@example.org'), (3, 'example.net/p', 'http://example.net/p')) v(r, w, u) WHERE c_custkey % 5 = r""")
def extract_links_simple(d: Data):
    texts = ["see (www.shop.com).", "at https://a.io/x?y=1, now", 'mail "me@example.org"!', "[example.net/p]", "none here: v1.2"]
    pick = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("c_custkey") % 5).cast("int"))
    out = cl.extract_links(d.customer.select("c_custkey", pick.alias("text")), "c_custkey", "text")
    return out.select("c_custkey", "word", "url")


@query("slugify", "SELECT c_custkey, lower(replace(c_name, '#', '')) || '-' || lower(c_mktsegment) || '-creme' AS slug FROM customer")
def slugify(d: Data):
    raw = F.concat(F.lit(" "), "c_name", F.lit(" -- "), "c_mktsegment", F.lit("! crème_ "))
    return d.customer.select("c_custkey", cl.slugify(raw).alias("slug"))


@query("truncate_chars", "SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 39) || '…' ELSE text END AS t FROM documents")
def truncate_chars(d: Data):
    return d.documents.select("doc_id", cl.truncate_chars(F.col("text"), 40).alias("t"))


@query("truncate_words", "SELECT doc_id, array_to_string(w[1:7], ' ') || CASE WHEN len(w) > 7 THEN ' …' ELSE '' END AS t FROM (SELECT doc_id, regexp_split_to_array(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '\\s+') AS w FROM documents)")
def truncate_words(d: Data):
    return d.documents.select("doc_id", cl.truncate_words(F.col("text"), 7).alias("t"))


@query("truncate_html")
def truncate_html(d: Data):
    h = F.col("html")
    return d.pages.select("page_id", cl.truncate_html(h, 60).alias("chars"), cl.truncate_html(h, 12, "words").alias("words"))


@query("word_count_wrap_lines", """
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, TRUE AS fits, '01. a' || chr(10) AS head FROM documents""")
def word_count_wrap_lines(d: Data):
    """A wrapped line is too long only if it is a single word."""
    t = F.col("text")
    long_line = F.exists(F.split(cl.wrap(t, 60), "\n"), lambda l: (F.length(l) > 60) & F.trim(l).contains(" "))
    ten = cl.line_numbers(F.lit("a\n" * 9))
    return d.documents.select("doc_id", cl.word_count(t).alias("words"), (~long_line).alias("fits"), F.left(ten, F.lit(6)).alias("head"))


@query("case_and_trim_filters", """
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' 3rd It''s' AS title, upper(p_name[1]) || p_name[2:] AS cap,
 replace(p_name, ' ', '') AS cut, rpad(p_name, 14, ' ') AS lj, lpad(p_name, 14, ' ') AS rj, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', '22233344455566677778889999') AS phone,
 'big ' || lower(p_type) AS spaced, 'a\\''b' AS slashed, '   ab  ' AS mid FROM part""")
def case_and_trim_filters(d: Data):
    n = F.col("p_name")
    return d.part.select(
        "p_partkey", cl.title(F.concat(n, F.lit(" 3rd it's"))).alias("title"), cl.capfirst(n).alias("cap"), cl.cut(n, " ").alias("cut"),
        cl.ljust(n, 14).alias("lj"), cl.rjust(n, 14).alias("rj"), cl.phone_digits(n).alias("phone"),
        cl.camel_to_spaces(F.concat(F.lit("big"), F.initcap("p_type"))).alias("spaced"), cl.addslashes(F.lit("a'b")).alias("slashed"),
        cl.center(F.lit("ab"), 7).alias("mid"))


@query("list_filters", """
SELECT p_partkey, w[1] AS first, w[-1] AS last, array_to_string(w, '+') AS joined, len(w) AS n, w[1:1] AS head, array_to_string(list_sort(w), ' ') AS up,
 array_to_string(list_reverse_sort(w), ' ') AS down, len(p_brand) AS letters FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)""")
def list_filters(d: Data):
    w = F.split("p_name", " ")
    items = F.transform(w, lambda x: F.struct(x.alias("k")))
    keys = lambda desc: F.array_join(F.transform(cl.dictsort(items, "k", desc), lambda s: s["k"]), " ")
    return d.part.select(
        "p_partkey", F.get(w, F.lit(0)).alias("first"), F.element_at(w, -1).alias("last"), F.array_join(w, "+").alias("joined"), F.size(w).alias("n"),
        F.slice(w, 1, 1).alias("head"), keys(False).alias("up"), keys(True).alias("down"), F.size(cl.make_list(F.col("p_brand"))).alias("letters"))


@query("value_filters", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size % 5 END AS d, coalesce(CASE WHEN p_size > 9 THEN p_size END, 7) AS dn, p_size % 3 = 0 AS by3,
 CASE WHEN length(p_partkey::VARCHAR) >= 2 THEN (p_partkey::VARCHAR)[-2:-2] ELSE '0' END AS digit, (p_size + 4)::VARCHAR AS added, p_brand || '4' AS glued,
 CASE WHEN p_size > 25 THEN 'on' WHEN p_size <= 25 THEN 'off' END AS yn FROM part""")
def value_filters(d: Data):
    s = F.col("p_size")
    return d.part.select(
        "p_partkey", cl.default(s % 5, -1).alias("d"), F.coalesce(F.when(s > 9, s), F.lit(7)).alias("dn"), cl.divisible_by(s, 3).alias("by3"),
        cl.get_digit(F.col("p_partkey"), 2).alias("digit"), cl.add(s, F.lit("4")).alias("added"), cl.add(F.col("p_brand"), F.lit("4")).alias("glued"),
        cl.yesno(s > 25, "on", "off", "unknown").alias("yn"))


@query("encodings", """
SELECT doc_id, md5(replace(url_encode(text), '%2F', '/')) AS quoted, text = text AS same, text AS back, doc_id AS n FROM documents""")
def encodings(d: Data):
    t = F.col("text")
    sample = F.concat(F.col("text"), F.lit(" é/?&"))
    trip = cl.url_decode(cl.url_encode(sample)) == sample
    b64 = cl.from_url_base64(cl.to_url_base64(F.encode("text", "UTF-8"))).cast("string")
    iri = cl.uri_to_iri(cl.iri_to_uri(F.lit("/café/?a=1"))) == F.lit("/café/?a=1")
    return d.documents.select(
        "doc_id", F.md5(cl.url_encode(t)).alias("quoted"), (trip & iri).alias("same"), b64.alias("back"), cl.from_base36(cl.to_base36(F.col("doc_id"))).alias("n"))


@query("valid_filename", "SELECT p_partkey, replace(p_name, ' ', '_') || '_v1.' || p_partkey || '.txt' AS name, NULL AS none FROM part")
def valid_filename(d: Data):
    raw = F.concat(F.lit("  "), "p_name", F.lit(" v1./:"), F.col("p_partkey").cast("string"), F.lit(".txt "))
    return d.part.select("p_partkey", cl.valid_filename(raw).alias("name"), cl.valid_filename(F.lit(" ..")).alias("none"))


@query("clean_corpus")
def clean_corpus(d: Data):
    return cl.clean_corpus(d.pages, "page_id", "html")
