"""Corpus operators against brute force on small fixtures with hard rows."""

import hashlib
import html as html_lib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relweave.llm import html_text, line_rules, mixing, passages, pieces, simhash, site_quality, topk, url_filter, wavelet
from relweave.llm.common import components, global_rank
from tests.llm.test_pipeline import alike_groups

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, tag string, fp long, q_text string, h int, copies int"


def sentence(rng, n):
    return " ".join("".join(rng.choices("aeioustrnl", k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """NULLs, empty and long texts, ties, repeated rows, odd characters."""
    rng = random.Random(7)
    base = sentence(rng, 120)
    texts = [
        None, "", " ", "one", "two words", "\n\n", "a b  c", "é ß 中文 😀 ▁x <s> <0x41>", "x\x00y", base, base, base.upper(),
        base + " tail", base.replace(" ", "\n", 3), "a " * 3000, "w" * 5000, sentence(rng, 20000),
        "| a | b | c | d |\n" * 20 + base, "Buy!! Now!! Here!! " * 40, sentence(rng, 60) + "\n" + base, "\t lead  two  \n trail ",
    ]
    out = [(i * 3, t, "en" if i % 2 else None, [None, "b", "a", "ä"][i % 4], None if t is None else len(t), i, "t", i, "q", 1, 2) for i, t in enumerate(texts)]
    out += [out[9], (None, base, "en", "b", 1, 0, "t", 0, "q", 1, 2), (27, "same id, other text", None, "b", 1, 0, "t", 0, "q", 1, 2)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


# ---------------------------------------------------------------- helpers


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 540)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in want.items() if sum(x == r for x in want.values()) > 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_global_rank(spark):
    names = ["b", "a", None, "ä", "Z", "10"]
    got = {r.s: r.n for r in global_rank(spark.createDataFrame([(x,) for x in names], "s string"), "s", "n").collect()}
    assert got == {"10": 0, "Z": 1, "a": 2, "b": 3, "ä": 4, None: 5}


# ---------------------------------------------------------------- 1 quality classifier


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = site_quality.posteriors(docs, labels.where("doc_id % 2 = 0"))
    held = got.join(labels.where("doc_id % 2 = 1"), "doc_id").select("keep", "quality").collect()
    assert len(held) > 100 and sum(r.keep == bool(r.quality) for r in held) >= 0.97 * len(held)
    assert got.count() == docs.count()


def test_quality_shrinks_sparse_sites(spark):
    """A host of one bad document stays near the corpus rate, one of many does not."""
    rows = [(i, "Good plain words stand here. " * 20, "good", "en") for i in range(300)]
    rows += [(1000 + i, "BAD!! WORDS!! | | ## " * 20, "bad", "en") for i in range(300)]
    rows += [(5000, "BAD!! WORDS!! | | ## " * 20, "single", "en"), (5001, "Good plain words stand here. " * 20, "bad", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = docs.where("doc_id < 5000").select("doc_id", (F.col("source") == "good").cast("int").alias("quality"))
    got = {r.doc_id: r for r in site_quality.posteriors(docs, labels).where("doc_id in (0, 1000, 5000)").collect()}
    assert got[1000].path_rate < 0.1 < got[5000].path_rate < 0.9 < got[0].path_rate
    assert got[0].keep and not got[1000].keep and not got[5000].keep


def test_quality_edges(spark, docs, empty, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = site_quality.posteriors(docs, none).collect()
    assert len(out) == len(rows) and all(0 <= r.posterior <= 1 for r in out)
    one = spark.createDataFrame([(27, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert all(r.evidence > 0.5 for r in site_quality.posteriors(docs, one).collect())
    assert site_quality.posteriors(empty, none).count() == 0


# ---------------------------------------------------------------- 2 top-k


def brute_top(vectors, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_top_k(spark, slices):
    rng = np.random.default_rng(slices)
    data = [(i, [int(x) for x in rng.integers(-9, 9, 8)]) for i in range(700)]
    data += [(1000 + i, data[0][1]) for i in range(300)]  # one common vector, ties all over
    data += [(2000 + i, [i, 1]) for i in range(5)] + [(3000, [4])]
    frame = spark.createDataFrame(data, "vec_id long, v array<long>")
    asked = frame.where("vec_id % 100 = 0")
    got = sorted(map(tuple, topk.top_k(frame, asked, 10, slices).collect()))
    assert got == brute_top(data, [d for d in data if d[0] % 100 == 0], 10)


def test_top_k_of_repeated_own_rows(spark):
    """The query's own rows, however many, take no place from others with its vector."""
    data = [(0, [3, 4])] * 15 + [(i, [3, 4]) for i in (5, 5, 5, *range(10, 30))] + [(40 + i, [1, 2]) for i in range(5)]
    frame = spark.createDataFrame(data, "vec_id long, v array<long>")
    asked = [(0, [3, 4]), (5, [3, 4]), (40, [1, 2])]
    got = sorted(map(tuple, topk.top_k(frame, spark.createDataFrame(asked, frame.schema), 10).collect()))
    assert got == brute_top(data, asked, 10)


def test_top_k_quantises_and_skips(spark):
    data = [(0, [0.5, -0.0004], 1), (1, [float("nan"), 1.0], 1), (2, None, 1), (3, [1.0, None], 1), (None, [1.0, 1.0], 1),
            (4, [float("inf"), 1.0], 1), (5, [], 1), (6, [-0.25, 2.0], 1), (6, [0.0, 1.0], 1)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, q int")
    rows = topk.quantised(frame)
    assert sorted(map(tuple, rows.collect())) == [(0, [512, -1]), (6, [-256, 2048]), (6, [0, 1024])]
    assert sorted(map(tuple, topk.top_k(rows, rows.where("vec_id = 0")).select("vec_id", "score").collect())) == [(6, -133120), (6, -1024)]
    assert topk.top_k(rows.limit(0), rows.limit(0)).count() == 0


# ---------------------------------------------------------------- 3 HTML


def test_html_cases():
    take = lambda page: html_text.text_under(html_text.parse(page), {})
    assert take(None) == take("") == take("<!-- <p>x") == take("<script>var a = '<p>x</p>'</script>") == ""
    page = """<html><head><title>t</title></head><body><header>top</header><nav>menu</nav><div class="cookie-notice">ok?</div>
    <article class="post-12"><h1>Head &amp; tail</h1><p>One <b>two</b>\n three&nbsp;four<br>five<p>6 &lt; 7<script>if (a<b) x()</script>
    <ul><li>i<li>ii</ul><form>mail</form><div class="comments">first!</div></article><aside>more</aside><footer>end</footer>"""
    assert take(page) == "Head & tail\nOne two three four five\n6 < 7\ni\nii"
    assert take("<div id='ad-1'>x</div><p title=\"a>b\">y") == "y"
    assert take("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert take("5 < 6 and <" + "div" * 3) == "5 < 6 and <divdivdiv"
    assert take("<div>" * 3000 + "deep") == "deep"


def test_html_host_consensus(spark):
    """A page whose teaser outweighs its story follows its host's vote."""
    story = lambda n: f"<body><div class='story'><p>{'story words ' * n}</p></div><div class='teasers'><p>{'other things ' * 30}</p></div>"
    rows = [(i, "https://a.example/x", story(200), "h") for i in range(9)] + [(9, "https://a.example/y", story(10), "h")]
    rows += [(10, None, "<p>alone</p>", "h"), (11, "https://b.example/", None, "h"), (12, "https://a.example/z", "<p>no such path</p>", "h")]
    pages = spark.createDataFrame(rows + rows[-1:], "page_id long, url string, html string, host string")
    got = html_text.extracted(pages).collect()
    text = {r.page_id: r.t_text for r in got}
    assert len(got) == 14 and got[0].host == "h"
    assert text[9] == ("story words " * 10).strip() and text[0] == ("story words " * 200).strip()
    assert text[10] == "alone" and text[11] == "" and text[12] == "no such path"
    assert html_text.extracted(pages.limit(0)).count() == 0


LONG = "Plain words of a story that goes on for a while and says a few things, one after the other. " * 4


@pytest.mark.parametrize("page, text", [
    (f'<body><div class="menu">a b c</div><article class="post hentry comments-open"><p>{LONG}</p></article>', LONG.strip()),
    (f'<body><main class="content has-sidebar"><p>{LONG}</p></main><div class="sidebar"><p>side</p></div>', LONG.strip()),
    (f'<body><div class="re-search story"><p>{LONG}</p></div>', LONG.strip()),
    (f'<body><article id="widget-notice-42"><p>{LONG}</p></article>', LONG.strip()),
    (f'<body><div id="widget-notice-42"><p>{LONG}</p></div><div class="x"><p>small</p></div>', LONG.strip()),
    (f'<body><div class="wrap no-sidebar"><p>{LONG}</p></div><div><p>neighbour text</p></div>', LONG.strip()),
    (f'<body><div class="ad-free"><p>{LONG}</p></div><div class="related-posts"><p>{LONG[:90]}</p></div>', LONG.strip()),
    ("<p>see the <span class='search-term'>key</span> word", "see the key word"),
    ("<p>an <em class='related'>odd</em> case", "an odd case"),
    ("<div><p>one <script>var x = 1</script>two <svg><path d='M0'/></svg>three <noscript>no</noscript>four <button>b</button>five</p></div>", "one two three four five"),
    (f"<body><article><h1>{LONG[:60]}</h1><div class=intro><p>{LONG}</p></div><div class=body><p>{LONG}</p><p>{LONG}</p></div></article>",
     "\n".join([LONG[:60].strip(), LONG.strip(), LONG.strip(), LONG.strip()])),
    (f"<body><div class=post><h1>Title</h1><div class=intro><p>{LONG}</p></div><div class=body><p>{LONG}</p><p>{LONG}</p></div></div><footer>f</footer>",
     "\n".join(["Title", LONG.strip(), LONG.strip(), LONG.strip()])),
    (f"<body><header>site</header><article><header><h1>Own title</h1></header><p>{LONG}</p><footer>tags</footer></article>", f"Own title\n{LONG.strip()}"),
    (f"<body><form action='/'><div class=page><p>{LONG}</p></div></form>", LONG.strip()),
    (f"<body><div class='story'><p>{LONG}</p><div class='cookie-notice'>We use cookies</div><ul class='share-buttons'><li>mail</li></ul></div>", LONG.strip()),
])
def test_html_names_and_parts(page, text):
    assert html_text.text_under(html_text.parse(page), {}) == text


@pytest.mark.parametrize("templates", [2, 7])
def test_html_templates_of_one_host(spark, templates):
    """Every template has its own container; the others' containers hold a teaser on each page."""
    rows = []
    for i in range(12 * templates):
        boxes = [f"<div class='t{chr(97 + j)}'><p>{LONG * 3 if j == i % templates else f'teaser {i}'}</p></div>" for j in range(templates)]
        rows.append((i, "https://h.example/", "<body>" + "".join(boxes)))
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.t_text for r in got} == {(LONG * 3).strip()} and len(got) == len(rows)


def test_html_articles(spark):
    """Whole test pages: the article's blocks, found with plain patterns."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.extracted(pages).collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.t_text == "\n".join(b for b in blocks if b)


# ---------------------------------------------------------------- 4 URL lists


def test_url_lists(spark):
    day = lambda d: f"2024-01-{d:02d}"
    entries = [
        ("spam", "block", "bad.example", day(3), "add"), ("spam", "block", "bad.example", day(6), "remove"),
        ("spam", "block", "bad.example", day(9), "add"), ("spam", "block", "bad.example", day(9), "remove"),
        ("ok", "allow", "www.bad.example", day(5), "add"), ("spam", "block", "www.bad.example/x/", day(5), "add"),
        ("spam", "block", "late.example", day(2), "remove"), ("spam", "block", None, day(1), "add"), ("spam", "block", "n.example", None, "add"),
    ]
    lists = spark.createDataFrame(entries, "list string, verdict string, pattern string, dated string, action string")
    lists = lists.withColumn("dated", F.to_date("dated"))
    urls = ["http://WWW.bad.example/a", "http://www.bad.example/x/1", "http://u@bad.example:80", "no url", None, "http://late.example/", "http://badd.example/"]
    captures = [(10 * d + i, u, day(d), i, "p") for d in (2, 3, 5, 6, 9) for i, u in enumerate(urls)] + [(999, urls[0], None, 0, "p")]
    frame = spark.createDataFrame(captures, "capture_id long, url string, fetched string, n_active int, pattern string")
    got = {r.capture_id: r for r in url_filter.verdicts(frame.withColumn("fetched", F.to_date("fetched")), lists).collect()}
    assert len(got) == len(captures)
    blocked = {k for k, r in got.items() if r.blocked}
    assert blocked == {30, 31, 32, 51, 52, 61, 91}
    assert got[50].matched == "ok:www.bad.example" and got[50].n_active == 2 and got[51].n_active == 3
    assert got[999].matched == "" and got[24].n_active == 0
    assert url_filter.verdicts(frame.limit(0).withColumn("fetched", F.to_date("fetched")), lists.limit(0)).count() == 0


def test_url_patterns_of_any_depth(spark):
    urls = ["https://a.b.example.com/x/y/page.html?q=1#f", "http://h.example/x/y/", "http://h.example", "http://h.example/page", "http://h.example//x//", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.patterns_of(F.col("url"))).collect()
    a, h = "a.b.example.com", "h.example"
    assert [r[0] for r in rows] == [
        ["example.com", "b.example.com", a, f"{a}/x/", f"{a}/x/y/", f"{a}/x/y/page.html"], [h, f"{h}/x/", f"{h}/x/y/"], [h], [h, f"{h}/page"],
        [h, f"{h}//", f"{h}//x/", f"{h}//x//"], [],
    ]
    lists = spark.createDataFrame(
        [("l", "block", p, "2024-01-01", "add") for p in ("example.com/a/b/", "example.com/a/page.html", "example.com", "example.com")],
        "list string, verdict string, pattern string, dated string, action string",
    ).withColumn("dated", F.to_date("dated"))
    captures = [(1, "http://example.com/a/b/c/d", "2024-02-01"), (2, "http://example.com/a/page.html", "2024-02-01"), (3, "http://example.com/a/", "2024-02-01")]
    captures += [(1, "http://example.com/a/b/c/d", "2024-02-01"), (1, "http://example.com/", "2023-01-01"), (None, "http://example.com/", "2024-02-01")]
    frame = spark.createDataFrame(captures, "capture_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched"))
    got = sorted(((r.capture_id or 0), str(r.fetched), r.n_active, r.matched) for r in url_filter.verdicts(frame, lists).collect())
    assert got == [
        (0, "2024-02-01", 1, "l:example.com"), (1, "2023-01-01", 0, ""), (1, "2024-02-01", 2, "l:example.com/a/b/"), (1, "2024-02-01", 2, "l:example.com/a/b/"),
        (2, "2024-02-01", 2, "l:example.com/a/page.html"), (3, "2024-02-01", 1, "l:example.com"),
    ]


# ---------------------------------------------------------------- 5 SimHash


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    fps = sorted(set(prints))
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]
    return union_find(fps, pairs)


def test_simhash(docs, rows, empty):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    roots = brute_components([brute_print(r[1]) for r in rows])
    least = {}
    for r in rows:
        if r[0] is not None:
            root = roots[brute_print(r[1])]
            least[root] = min(least.get(root, r[0]), r[0])
    want = sorted((r[0] if r[0] is not None else -1, brute_print(r[1]), least.get(roots[brute_print(r[1])])) for r in rows)
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    # by five-word shingles; two texts of one id may stand for two groups
    first = {}
    for i, root in alike_groups({i: r[1] for i, r in enumerate(rows)}).items():
        if rows[i][0] is not None:
            first[root] = min(first.get(root, rows[i][0]), rows[i][0])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_simhash_links(spark, monkeypatch):
    """Chains and dense groups of fingerprints, given directly."""
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 3))}) for _ in range(150)}
    at = rng.getrandbits(64)
    for _ in range(30):  # a chain in steps of three bits
        fps.add(at)
        for _ in range(3):
            at ^= 1 << rng.randrange(64)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    frame = spark.createDataFrame(list(zip(range(len(signed)), signed)), "doc_id long, fp long").withColumn("tag", F.lit(0))
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle=3: docs)
    got = {r.fp & (2**64 - 1): r.component_id for r in simhash.near_duplicates(frame).collect()}
    roots = brute_components(fps)
    number = {f & (2**64 - 1): i for i, f in enumerate(signed)}
    assert got == {f: min(number[g] for g in fps if roots[g] == roots[f]) for f in fps}


# ---------------------------------------------------------------- 6 quality rules


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_line_rules(docs, rows, empty):
    out = line_rules.cleaned(docs).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    got = sorted(((r.doc_id, r.text, (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words)) for r in out), key=key)
    assert got == sorted(((r[0], r[1], brute_counts(r[1])) for r in rows), key=key)
    for r in out:
        n, repeat = r.q_n_words, r.q_n_repeat_words
        assert r.q_base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert r.q_kept == (not r.q_base_failed and 100 * r.q_n_lost_words <= 30 * n)
        assert len(WORD.findall(r.q_text)) == n - r.q_n_lost_words
    assert line_rules.cleaned(empty).count() == 0


@pytest.mark.parametrize("line,fault", [
    ("A plain sentence with nine words and a stop.", None), ("Title without a stop", None), ("NASA and ESA agree", None),
    ("home | news | sport | contact", "navigation"), ("home > news > sport", "navigation"), ("a## b$$ c%% d&&", "symbols"),
    ("BUY!! THIS!! NOW!! AND!! HERE!! SOON!!", "punctuation"), ("THIS WHOLE LINE IS LOUD AND LONG", "shouting"),
    ("it " * 20, "repetition"), ("Copyright 2020, all rights reserved.", "boilerplate"), ("", None), ("   ", None),
])
def test_line_faults(line, fault):
    words = line.encode().split()
    assert (line_rules.line_fault(line, words, line_rules.LineRules()) if words else None) == fault


def test_line_rules_agree_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    seen = line_rules.cleaned(docs).join(labels, "doc_id").where("not q_base_failed").select("q_kept", "quality").collect()
    assert sum(r.q_kept == bool(r.quality) for r in seen) >= 0.99 * len(seen)


# ---------------------------------------------------------------- 7 shard files


def test_shard_queries():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 5), (1, 1), (4095, 7), (20000, 16)):
        ids = np.minimum(rng.geometric(0.01, n), (1 << bits) - 1).astype("<u2")
        data = wavelet.pack(ids, bits, [5, None], [n, 0])
        shard = wavelet.Shard(data)
        assert (shard.tokens() == ids).all() and shard.doc_ids == [5, None] and shard.lengths.tolist() == [n, 0]
        for i in rng.integers(0, max(n, 1), 40 if n else 0).tolist():
            token = int(ids[i])
            assert shard.token(i) == token
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert shard.count(token, a, b) == int((ids[a:b] == token).sum())
            at = np.flatnonzero(ids == token)
            k = int(rng.integers(0, len(at)))
            assert shard.occurrence(token, k) == at[k]
        with pytest.raises(IndexError):
            shard.token(n)
        with pytest.raises(IndexError):
            shard.occurrence(0, n)
        assert shard.count(1 << bits) == 0


def test_unit_encoder_equals_library():
    encoder, rng = wavelet.TextEncoder(VOCABULARY), random.Random(5)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'s", " '", "don't", ".", "?\"", "...", " it's.", " x'", "_", "²", " é\u0301.", "<|endoftext|>", "123", "é", " ", "\x1c", "中", "!!", " \n", " "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(4000)]
    for text, data in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(data, encoder.kind).tolist() == encoder.library.encode(text, add_special_tokens=False).ids, text


def test_shards_round_trip(docs, rows, empty):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = sorted(map(tuple, wavelet.round_trip(docs, VOCABULARY).collect()), key=lambda r: r[1])
    assert [r[0] if r[0] is not None else -1 for r in got] == sorted(r[0] if r[0] is not None else -1 for r in rows)
    start, want = 0, Counter()
    for _, begin, n, _ in got:
        assert begin == start
        start += n
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((d, n, c) for d, _, n, c in got) == want
    assert wavelet.round_trip(empty, VOCABULARY).count() == 0


def test_added_tokens_as_the_library_has_them(spark):
    """The string of an added token anywhere in a text, against an untouched tokenizer."""
    tokenizer, rng = Tokenizer.from_file(VOCABULARY), random.Random(15)
    assert tokenizer.encode("end of part <|endoftext|> next part", add_special_tokens=False).ids == [437, 286, 636, 220, 50256, 1306, 636]
    bits = ["a", "the", " ", "  ", "\n", "<|endoftext|>", "<|endof", "text|>", "é", "don't"]
    texts = ["end of part <|endoftext|> next part", "<|endoftext|>", "x <|endoftext|>y"]
    texts += ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(2000)]
    encoder = wavelet.TextEncoder(VOCABULARY)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode_all(texts)] == want
    got = wavelet.round_trip(spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string"), VOCABULARY)
    crc = lambda ids: zlib.crc32(np.array(ids + [0], "<u4").tobytes())
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got.collect()} == {i: (len(x) + 1, crc(x)) for i, x in enumerate(want[:50])}


# ---------------------------------------------------------------- 8 pieces


def test_agenda_equals_library():
    codec, rng = pieces.Codec(MODEL), random.Random(9)
    parts = list("abcdefgh .,\n'") + ["the", "ing", "  ", "▁", "é", "中文", "😀", "<0x41>", "<s>", "\x00", "​", "ation"]
    for _ in range(8000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        ids = codec.library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids, text
    for _ in range(60):  # long words go through the heap
        text = "".join(rng.choices("abcdeinorst", k=rng.randint(40, 400)))
        ids = codec.library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids, text
    codec.verify()


def test_piece_digests(docs, rows, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter()
    for r in rows:
        ids = sp.encode(r[1] or "", add_bos=True, add_eos=True)
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, pieces.digests(docs, MODEL).collect())) == want
    assert pieces.digests(empty, MODEL).count() == 0
    back = pieces.decoded(pieces.encoded(docs, MODEL), MODEL)
    assert back.where("not (p_text <=> p_decoded)").count() == 0 and set(docs.columns) < set(back.columns)


# ---------------------------------------------------------------- 9 mixing


def brute_targets(sizes, share=1.5, cap=2):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left = share * total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: float(cap * sizes[s]) for s in over}
        free -= over
    return target


def check_mix(docs, rows):
    report = mixing.mix_report(docs)
    got = report.collect()
    assert len(got) == len(rows)
    assert Counter(map(tuple, got)) == Counter(map(tuple, report.collect())) == Counter(map(tuple, mixing.mix_report(docs.repartition(5)).collect()))
    sizes, source = Counter(), {}
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
        source[r[0], len(WORD.findall(r[1] or ""))] = r[3]
    target, taken = brute_targets(sizes), Counter()
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes) and sum(taken.values()) <= 1.5 * sum(sizes.values())
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(taken.values())


def test_mix(spark, docs, rows, empty):
    check_mix(docs, rows)
    assert mixing.mix_report(empty).count() == 0 and mixing.mixed(empty).count() == 0
    rng = random.Random(2)
    many = [(i, sentence(rng, rng.randint(0, 40)), "en", rng.choice(["hot"] * 6 + [None, "a", "b", "Ω", "tiny"][: 1 + i % 5]), 1) for i in range(1500)]
    check_mix(spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long"), many)


def test_mix_buckets(spark, monkeypatch):
    """Running sums carried over many small buckets and runs of them."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    monkeypatch.setattr(mixing, "FAN", 7)
    rng = random.Random(4)
    rows = [(i, sentence(rng, rng.randint(1, 30)), "en", rng.choice("abcd"), 1) for i in range(600)]
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows)


# ---------------------------------------------------------------- 10 passages


def test_passages(spark, empty):
    rng = random.Random(6)
    shared, line = sentence(rng, 51), sentence(rng, 60)
    near = " ".join(w if i != 30 else "changed" for i, w in enumerate(line.split()))
    own = lambda n=80: sentence(rng, n)
    rows = [(i, own(), "x") for i in range(0, 6)]
    rows += [(10 + i, f"{own(30)} {shared} {own(30)}", "x") for i in range(4)]  # inside a paragraph
    rows += [(20, f"{own()}\n{line}\n{own()}", "x"), (21, f"{own()}\n{near}\n{own()}", "x")]
    rows += [(30, own(200), "x")]
    rows += [(31, rows[-1][1], "x"), (31, rows[-1][1], "x"), (32, own(70) + "\n" + own(5), "x"), (33, None, "x"), (34, "", "x"), (None, rows[12][1], "x")]
    twice = own(60)
    rows += [(40, f"{twice}\n{own()}\n{twice}", "x")]  # a repeat inside one document
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string").repartition(4)
    found = passages.removals(docs).collect()
    kept = {}
    for r in found:
        kept.setdefault(r.doc_id, set()).update(r.kept_doc_ids)
    assert kept == {11: {10}, 12: {10}, 13: {10}, 21: {20}, 31: {30}}
    text = {r[0]: (r[1] or "").split() for r in rows}
    covered = Counter()
    for r in found:
        covered[r.doc_id] += r.end_word - r.first_word
        if r.doc_id in (11, 12, 13):
            assert " ".join(text[r.doc_id][r.first_word : r.end_word]) in shared
    assert covered[21] == 60 and covered[31] == 200 and all(covered[d] == 51 for d in (11, 12, 13))
    clean = passages.cleaned(docs)
    assert clean.columns == docs.columns
    out = {r.doc_id: r.text for r in clean.collect()}
    assert 31 not in out and set(out) == {r[0] for r in rows} - {31}
    assert out[21].split() == [w for i, w in enumerate(text[21]) if not 80 <= i < 140]
    assert all(out[r[0]] == r[1] for r in rows if r[0] not in kept and r[0] not in (31,))
    assert passages.removals(empty).count() == 0 and passages.cleaned(empty).count() == 0


def test_every_long_run_is_found(spark):
    """Runs of 47 equal words, put at random places, lose a passage everywhere but once."""
    rng = random.Random(8)
    runs = [sentence(rng, 47) for _ in range(40)]
    rows = [(i, f"{sentence(rng, rng.randint(0, 60))} {runs[i % 40]} {sentence(rng, rng.randint(0, 60))}") for i in range(120)]
    found = passages.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(40, 120))
    # two later documents may also be near copies of each other
    assert all({k % 40 for k in r.kept_doc_ids} == {r.doc_id % 40} for r in found)
    assert all(any(r.doc_id % 40 in x.kept_doc_ids for x in found if x.doc_id == r.doc_id) for r in found)


def test_long_runs_go_whole(spark):
    """Equal runs inside lines are removed to their last word, whichever smaller document has them."""
    rng = random.Random(18)
    rows, want = [], {}
    for i, n in enumerate([47, 51, 80, 200] * 6):
        run, head = sentence(rng, n), rng.randint(0, 60)
        rows += [(10 * i + 1, f"{sentence(rng, 30)} {run} {sentence(rng, 40)}"), (10 * i + 2, f"{sentence(rng, head)} {run} {sentence(rng, 25)}")]
        middle = " ".join(run.split()[n // 2 - 12 : n // 2 + 12])
        rows += [(10 * i, f"{sentence(rng, 30)} {middle} {sentence(rng, 30)}")]  # has a part only
        want[10 * i + 2] = head, head + n
    rows += [rows[1], rows[1]]
    found = passages.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.first_word, r.end_word))
    assert {d: got.get(d) for d in want} == {d: [x] for d, x in want.items()}


def test_paragraph_bands(spark):
    """Band recall at the threshold, and verification by exact Jaccard."""
    assert passages.bands_for() == 9 and 1 - (1 - 0.8**4) ** 9 >= 0.99
    rng = random.Random(12)
    rows, want = [], set()
    for i in range(60):
        words = sentence(rng, 100).split()
        other = list(words)
        for j in range(0, 100, 100 // (1 + i % 6)):
            other[j] = "edited"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = ({tuple(w[k : k + 5]) for k in range(96)} for w in (words, other))
        if len(a & b) / len(a | b) >= 0.8:
            want.add(2 * i + 1)
    monkey = passages.PASSAGE_WORDS
    passages.PASSAGE_WORDS = 1000  # paragraphs alone
    try:
        got = {r.doc_id for r in passages.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        passages.PASSAGE_WORDS = monkey
    assert got <= want and len(got) >= 0.95 * len(want)
