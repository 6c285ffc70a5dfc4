"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import (
    collocations,
    html_text,
    line_rules,
    mixing,
    passages,
    pieces,
    postings,
    simhash,
    site_quality,
    topk,
    url_filter,
    vafile,
    wavelet,
)
from relweave.runtime import bounded_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL_TWINS: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL_TWINS[name] = sql.strip()
        return fn

    return wrap


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_site_quality")
def quality_posteriors(spark, folder):
    """Quality of every document from its text, its source and the source's languages."""
    return site_quality.posteriors(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op2_exact_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v from embeddings
           where embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select q.vec_id query_id, c.vec_id, unnest(q.v) a, unnest(c.v) b from v q join v c
          on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
s as (select query_id, vec_id, cast(sum(a * b) as bigint) score from parts group by all)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank, vec_id, score
from s qualify rank <= 10
""")
def exact_topk(spark, folder):
    """Ten best inner products of every hundredth embedding with all others."""
    rows = topk.quantised(_table(spark, folder, "embeddings"))
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


@_query("op3_html_consensus")
def html_consensus(spark, folder):
    """Main text of every page."""
    out = html_text.extracted(_table(spark, folder, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("t_text").alias("text"), F.length("t_text").cast("long").alias("n_chars"))


def _dated_lists(pages: DataFrame) -> DataFrame:
    """Dated list entries for the patterns the pages' URLs can match.

    A pattern's md5 says on which lists and days it is added and removed.
    """
    pattern = pages.select(F.explode(url_filter.patterns_of(F.col("url"))).alias("pattern")).distinct()
    m = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    event = lambda name, verdict, days, action: F.struct(
        F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"),
        F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int")).alias("dated"),
    )
    first, trusted = F.col("m") % 365, F.floor(F.col("m") / 7) % 365
    spam = F.array(
        event("spam", "block", first, "add"), event("spam", "block", first + 30 + F.col("m") % 90, "remove"),
        event("spam", "block", first + 150 + F.col("m") % 120, "add"),
    )
    allow = F.array(event("trusted", "allow", trusted, "add"), event("trusted", "allow", trusted + 200, "remove"))
    none = F.slice(spam, 1, 0)
    both = F.concat(F.when(F.col("m") % 3 == 0, spam).otherwise(none), F.when(F.col("m") % 5 == 0, allow).otherwise(none))
    return pattern.select("pattern", m.alias("m")).select("pattern", F.explode(both).alias("e")).select("pattern", "e.*")


@_query("op4_url_filter", r"""
with captures as (
  select page_id, url, cast(date '2024-01-01' + cast(page_id % 720 as integer) as date) fetched,
    nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', '')), '') host,
    string_split(coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/'), '/') parts from pages),
labels as (select *, string_split(host, '.') l from captures where host is not null),
asked as (
  select page_id, fetched, array_to_string(l[len(l) - n + 1 :], '.') pattern
  from (select *, unnest(range(greatest(1, least(2, len(l))), len(l) + 1)) n from labels)
  union select page_id, fetched, host || array_to_string(parts[1:n], '/') || '/' from (select *, unnest(range(2, len(parts))) n from labels)
  union select page_id, fetched, host || array_to_string(parts, '/') from labels where parts[-1] <> ''),
keyed as (select pattern, cast('0x' || substr(md5(pattern), 1, 6) as integer) m from (select distinct pattern from asked)),
events as (
  select 'spam' list, 'block' verdict, pattern, m % 365 d, 'add' a from keyed where m % 3 = 0
  union all select 'spam', 'block', pattern, m % 365 + 30 + m % 90, 'remove' from keyed where m % 3 = 0
  union all select 'spam', 'block', pattern, m % 365 + 150 + m % 120, 'add' from keyed where m % 3 = 0
  union all select 'trusted', 'allow', pattern, (m // 7) % 365, 'add' from keyed where m % 5 = 0
  union all select 'trusted', 'allow', pattern, (m // 7) % 365 + 200, 'remove' from keyed where m % 5 = 0),
h as (select list, verdict, pattern, d, min(a) = 'add' as on_list from events group by all),
spans as (select list, verdict, pattern, on_list, cast(date '2024-01-01' + d as date) start,
            cast(date '2024-01-01' + lead(d) over (partition by list, verdict, pattern order by d) as date) stop from h),
hits as (select a.page_id, s.list, s.pattern, s.verdict,
           row_number() over (partition by a.page_id order by contains(s.pattern, '/') desc, length(s.pattern) desc,
                              s.verdict = 'allow' desc, s.list desc, s.pattern desc) r,
           count(*) over (partition by a.page_id) n
         from asked a join spans s on a.pattern = s.pattern and s.on_list and s.start <= a.fetched
           and (s.stop is null or a.fetched < s.stop))
select c.page_id capture_id, c.url, c.fetched, coalesce(n, 0) n_active,
  case when list is null then '' else list || ':' || pattern end matched, coalesce(verdict = 'block', false) blocked
from captures c left join hits h on c.page_id = h.page_id and r = 1
""")
def url_filters(spark, folder):
    """Every page's URL against the list entries active on the day of its capture."""
    pages = _table(spark, folder, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 720).cast("int"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched"))
    return url_filter.verdicts(captures, _dated_lists(pages))


@_query("op5_simhash_components")
def simhash_components(spark, folder):
    """SimHash fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op6_line_rules")
def line_quality(spark, folder):
    """Base counts and the line-first verdict for every document."""
    out = line_rules.cleaned(_table(spark, folder, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", *[F.col(f"q_{c}").alias(c) for c in line_rules.COUNTS],
        F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"),
    )


@_query("op7_wavelet_shards")
def wavelet_shards(spark, folder):
    """Place, length and checksum of every document's ids, read back from the shard files."""
    return wavelet.round_trip(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op8_piece_codec")
def piece_codec(spark, folder):
    """Agenda encoding and decoding of every document, as digests."""
    return pieces.digests(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op9_fair_queue", r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
             cast('0x' || substr(md5(concat_ws('|', doc_id, source)), 1, 12) as bigint) h from documents),
s as (select source, cast(sum(size) as bigint) n, row_number() over (order by source nulls last) - 1 place from d group by source),
w as (select *, cast([3, 1, 2][cast(place % 3 + 1 as integer)] as double) w, 2 * n most from s),
t as (select cast(sum(n) as bigint) total from s),
c as (select *, coalesce(sum(most) over o, 0) spent, sum(w) over () - coalesce(sum(w) over o, 0) open_w from w
      window o as (order by most / w, place rows between unbounded preceding and 1 preceding)),
level as (select arg_min((1.5 * total - spent) / open_w, most / w) lv from c, t where (1.5 * total - spent) / open_w * w <= most),
g as (select source, place, n, case when w * lv > most then cast(most as double) else w * lv end target from w, level),
q as (select d.*, g.n, g.place, g.target, lap,
        (sum(size) over (partition by g.place, lap order by h, doc_id rows unbounded preceding) + lap * g.n) / target finish
      from d join g on d.source is not distinct from g.source, (values (0), (1)) l(lap)),
r as (select *, sum(size) over (order by finish, lap, place, h, doc_id rows unbounded preceding) upto from q)
select doc_id, cast(size as bigint) size, any_value(n) source_size, any_value(target) target,
  cast(sum(case when upto <= least(1.5 * total, 2 * total) then size else 0 end) as bigint) taken
from r, t group by doc_id, size
""")
def mix_sources(spark, folder):
    """Words that the mix takes of every document."""
    return mixing.mix_report(_table(spark, folder, "documents"))


@_query("op10_passage_dedup")
def passage_dedup(spark, folder):
    """Word spans to remove from every document and the documents that keep them."""
    spans = passages.removals(_table(spark, folder, "documents"))
    return spans.select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "kept_doc_ids")


@_query("op11_collocations", r"""
with docs as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
pieces as (select lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') w from docs),
grams as (select lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) g
          from pieces, (values (1), (2), (3)) s(size) where len(w) >= size),
f as materialized (select lang, size, g, count(*) n from grams group by all),
total as (select lang, cast(sum(n) as bigint) n from f where size = 1 group by lang),
cand as (select lang, size, g, n a, string_split(g, ' ') w from f where size > 1 and n >= 10),
longer as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) g, a from cand where size = 3),
most as (select lang, g, max(a) most from longer group by all),
kept as (select c.* from cand c left join most m using (lang, g) where c.size = 3 or most is null or 100 * most < 50 * a),
cuts as (select k.lang, k.g, k.a, c, x.n l, y.n r, (1000000::hugeint * a * a) // (x.n::hugeint * y.n) score
         from kept k, (values (1), (2)) v(c)
         join f x on x.lang = k.lang and x.g = array_to_string(k.w[1:c], ' ') and x.size = c
         join f y on y.lang = k.lang and y.g = array_to_string(k.w[c + 1 :], ' ') and y.size = k.size - c where c < k.size),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, c) = 1)
select lang, cast(row_number() over (partition by lang order by score desc, a desc, encode(g)) as integer) rank, g phrase, a, l, r, n, cast(score as bigint) score
from best join total using (lang) qualify rank <= 2000
""")
def phrase_collocations(spark, folder):
    """Each language's 2,000 best phrases of two and three words."""
    return collocations.collocations(_table(spark, folder, "documents").select("lang", "text"))


@_query("op12_posting_lists")
def posting_lists(spark, folder):
    """Ten nearest vectors found for every hundredth embedding."""
    rows = postings.usable(_table(bounded_batches(spark), folder, "embeddings"))
    return postings.nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


def _rounds_sql(rounds: int) -> str:
    """K-means rounds as a chain of tables: a_i assigns to c_i, c_(i+1) holds the new centroids."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} as (select r, k, sum((v.x - c.x) * (v.x - c.x)) d from v join c{i} c using (i) group by r, k),
a{i} as materialized (select r, arg_min(k, (d, k)) k, min(d) d from d{i} group by r)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} as materialized (select k, i, coalesce(m.x, c.x) x from c{i} c left join
  (select k, i, cast(floor(sum(x)::hugeint / count(*)) as bigint) x from v join a{i} using (r) group by k, i) m using (k, i))""")
    return ",".join(steps)


@_query("op13_vafile_clusters", f"""
with e as (select vec_id, embedding, row_number() over (order by vec_id) r from embeddings
           where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (select r, i, cast(floor(256 * cast(embedding[i] as double)) as bigint) x from e, range(1, 65) t(i)),
firsts as (select r, row_number() over (order by sha256('2:' || vec_id)) - 1 k from e qualify k < 40),
c0 as materialized (select k, i, x from v join firsts using (r)),{_rounds_sql(5)},
own as (select k, cast(sum(d) as bigint) cluster_inertia from a5 group by k),
names as (select k, sha256(string_agg(x, ',' order by i)) centroid_sha256 from c5 group by k)
select vec_id, cast(k as integer) as cluster, cast(d as bigint) distance, cluster_inertia,
  (select cast(sum(d) as bigint) from a5) inertia, centroid_sha256
from a5 join e using (r) join own using (k) join names using (k)
""")
def vafile_clusters(spark, folder):
    """Cluster of every embedding after five rounds of k-means, with the inertia."""
    return vafile.clustered(_table(spark, folder, "embeddings"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL_TWINS["pipeline"] = corpus_pipeline.ORACLE_SQL
