"""Cases that once went wrong: frames, late rows, bad archives, Unicode, caps."""

import datetime as dt
import io
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from relweave.functions import collections as ct
from relweave.functions import documents as js
from relweave.functions import lookups as lk
from relweave.functions import temporal as tm
from relweave.functions import validators as va
from relweave.operators import cleaning as cl
from relweave.operators import corpus as co
from relweave.operators import search as se
from relweave.operators import windows as win
from relweave.operators.relations import Rows, Store, star_catalog
from relweave.runtime import scratch_path
from relweave.sources import files as fl
from relweave.sources import fixtures as fx
from relweave.sources import tables as tb
from relweave.streaming import jobs


@pytest.fixture(scope="module")
def frame_rows(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", None if rng.random() < 0.3 or 40 < i < 60 else float(rng.randint(-50, 50)), i // 90) for i in range(400)]
    rows[5] = (5, "hot", 1e17, 0)
    return spark.createDataFrame(rows, "id long, k string, v double, day int").cache()


@pytest.mark.parametrize("start,end", [(2, 3), (-3, -2), (-2, 0), (0, 0), (-1, 30), (None, -2), (None, 3), (1, None), (-2, None), (None, None)])
def test_frames(frame_rows, monkeypatch, start, end):
    monkeypatch.setattr(win, "STRETCH", 11)
    w = Window.partitionBy("k").orderBy("day", "id")
    lo = Window.unboundedPreceding if start is None else start
    hi = Window.unboundedFollowing if end is None else end
    want = {r.id: r.s for r in frame_rows.select("id", F.sum("v").over(w.rowsBetween(lo, hi)).alias("s")).collect()}
    rows = win.row_number(frame_rows, ["k"], win.sort_keys("day", "id"))
    rows = rows.join(frame_rows.groupBy("k").agg(F.count("*").alias("n")), "k")
    got = {r.id: r.s for r in win.frame_sum(rows, ["k"], "row_number", "v", "n", start, end, "s").collect()}
    assert got.keys() == want.keys()
    # sums from the far end meet 1e17 in another order
    assert all(got[i] == want[i] or got[i] is not None and abs(got[i] - want[i]) <= 64 * (want[i] > 1e15 or start is None or end is None) for i in want)


def test_frame_first_last_nth(frame_rows, monkeypatch):
    monkeypatch.setattr(win, "STRETCH", 9)
    w = Window.partitionBy("k").orderBy("day", "id").rowsBetween(-2, 1)
    exprs = {"a": F.first("v"), "b": F.last("v", ignorenulls=True), "c": F.nth_value("v", 3), "n": F.count("v")}
    want = sorted(map(str, frame_rows.select("id", *[e.over(w).alias(n) for n, e in exprs.items()]).collect()))
    rows = win.row_number(frame_rows, ["k"], win.sort_keys("day", "id"))
    assert sorted(map(str, win.framed(rows, ["k"], "row_number", -2, 1, **exprs).select("id", *exprs).collect())) == want


def test_hot_order_value(spark):
    """One order value on all rows: numbers are still 1..n, ranks all 1."""
    rows = spark.range(3000).select(F.lit("x").alias("k"), F.lit(1).alias("d"), "id")
    out = win.rank_rows(rows, ["k"], ["d"]).agg(F.countDistinct("row_number"), F.max("row_number"), F.max("rank"), F.max("dense_rank")).first()
    assert tuple(out) == (3000, 3000, 1, 1)


def test_many_children(spark):
    """More children than fit a chunk: every child listed once, the count in full."""
    rows = spark.range(2500).select((F.col("id") % 1).alias("p"), "id")
    lists = win.chunked_lists(rows, ["p"], win.sort_keys("id"), F.col("id")).orderBy("chunk").collect()
    assert [len(r["items"]) for r in lists] == [1000, 1000, 500] and sum((r["items"] for r in lists), []) == list(range(2500))


def test_exclude_by_several_children(spark):
    tables = {
        "customer": spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long"),
        "orders": spark.createDataFrame([(1, 1, "F", 10.0), (2, 1, "P", 99.0), (3, 2, "F", 10.0)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"),
    }
    rows = Rows(Store(star_catalog(), tables.__getitem__), "customer")
    left = rows.exclude(orders__o_orderstatus="F", orders__o_totalprice__gt=50).df.select("c_custkey").collect()
    assert sorted(r[0] for r in left) == [2, 3]


def test_late_rows_do_not_overwrite(spark):
    path = scratch_path(spark, "late")
    order = [-F.col("ts"), -F.col("id")]
    body = jobs.bucketed_upsert(spark, path, ["k"], order)
    batches = [[("a", 5, 1, "new"), ("b", 1, 1, "b1")], [("a", 3, 2, "late"), ("b", 2, 2, "b2"), ("c", 1, 1, "c1")], [("a", 5, 0, "tie"), ("c", 1, 2, "c2")]]
    for n, rows in enumerate(batches):
        body(spark.createDataFrame(rows, "k string, ts long, id long, val string"), n)
    body(spark.createDataFrame(batches[2], "k string, ts long, id long, val string"), 2)  # a batch run again
    assert {r.k: r.val for r in jobs.bucketed_table(spark, path).collect()} == {"a": "new", "b": "b2", "c": "c2"}


def test_entry_without_timeout():
    class State:
        exists, kept, hasTimedOut = False, None, False

        def update(self, value):
            self.kept = value

        def getCurrentWatermarkMs(self):
            return 0

    at = pd.Timestamp("2024-01-01")
    batch = pd.DataFrame({"op": ["set", "touch"], "value": [1.5, None], "ts": [at, at + pd.Timedelta(1, "s")], "timeout": [10, None], "seq": [1, 2]})
    state = State()
    (out,) = jobs._fold(("k",), [batch], state)
    assert out.iloc[0]["live"] and pd.isna(out.iloc[0]["expires"]) and state.kept[7] is None


def zipped(method=zipfile.ZIP_DEFLATED):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", method) as z:
        z.writestr("a.txt", "x" * 5000)
        z.writestr("b.txt", "".join(map(chr, range(60, 120))) * 50)
    return bytearray(data.getvalue())


def test_bad_archives(spark):
    good, torn, locked, odd = zipped(), zipped(), zipped(), zipped()
    torn[40:60] = b"\xff" * 20
    at = locked.find(b"PK\x01\x02")
    locked[6] |= 1
    locked[at + 8] |= 1
    odd[8], odd[odd.find(b"PK\x01\x02") + 10] = 77, 77
    rows = [("g.zip", bytes(good)), ("t.zip", bytes(torn)), ("l.whl", bytes(locked)), ("o.zip", bytes(odd)), ("n.zip", b"no zip")]
    out = fl.archive_scan(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sorted(r.path for r in out if r.error is None) == ["a.txt", "b.txt"]
    assert sorted(r.archive for r in out if r.error) == ["l.whl", "n.zip", "o.zip", "t.zip"]


def test_no_default_caps(spark):
    rows = [(f"d{i}.py", 60 * 2**20 if i == 0 else 20, f"def größe{i}(a):\n    return ÉTÉ\n") for i in range(1200)]
    files = spark.createDataFrame(rows, "path string, length long, content string")
    assert fl.file_search(files, "*.PY").count() == 1200
    assert fl.content_search(files, "été").count() == 1200
    assert co.parse_functions(files).count() == 1200
    assert co.parse_functions(files, size_limit=2**20).count() == 1199
    assert [tuple(r) for r in fl.skipped_files(files, 2**20).collect()] == [("d0.py", 60 * 2**20)]
    found = co.locate_definitions(spark.createDataFrame([(1, "def GRÖSSE7(x):"), (2, "def größe7(x):")], "snippet_id long, text string"), files).collect()
    assert {(r.snippet_id, r.file_path) for r in found if r.file_path} == {(2, "d7.py")}


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_unicode_and_nulls(spark):
    hindi = F.lit("हिन्दी")
    got = one(
        spark, lk.LOOKUPS["iregex"](F.lit("ÉTÉ"), "été"), va.unicode_slug(hindi), cl.slugify(hindi, True), cl.valid_filename(hindi),
        cl.camel_to_spaces(F.lit("getHTTP2Server")), ct.contains(F.array(F.lit(1), F.lit(None)), F.array(F.lit(None).cast("int"))),
        js.value_at(F.lit('{"a": 1'), "a"), js.value_at(F.lit('{"a": "x"}'), "a"),
    )
    assert tuple(got) == (True, False, "हनद", "हनद", "get htt p2 server", False, None, "x")


def test_word_similarity_extent(spark):
    got = one(
        spark, se.word_similarity(F.lit("plate"), F.lit("plum xx yy zz late")), se.word_similarity(F.lit("word"), F.lit("two words")),
        se.word_similarity(F.lit("abc"), F.lit("")), se.word_similarity(F.lit("abc"), F.lit("xyz")),
    )
    assert tuple(got) == (0.5, 0.8, 0.0, 0.0)


def test_durations_and_offsets(spark):
    cases = {
        "3 days, 04:05:06.5": 3 * 86400 + 14706.5, "3 days 04:05:06": 3 * 86400 + 14706, "3 04:05:06": 3 * 86400 + 14706, "-1 day, 00:00:01": -86399,
        "4 days": 4 * 86400, "-01:00:00": -3600, "15": 15, "2:30": 150, "1 day -01:02:03": 86400 - 3723, "P3DT4H5M6.7S": 3 * 86400 + 14706.7, "-PT1M": -60, "P0.5D": 43200,
        "00:00:00,25": 0.25, "": None, "x": None, "1:2:3:4": None, "4 weeks": None, "1::2": None, " 15": None, "P1Y": None,
    }
    frame = spark.createDataFrame(list(cases), "string").withColumn("got", tm.interval_seconds(tm.parse_duration(F.col("value"))))
    # a bare P is an empty duration
    assert {r["value"]: r.got for r in frame.collect()} == pytest.approx(cases)
    times = {"2024-03-01T10:00:00Z": 10, "2024-03-01 10:00+02:00": 8, "2024-03-01T10:00:00-0530": 15.5, "2024-03-01 10:00": 10, "2024-03-01 10:00:00.5+03": 7, "2024-03-01T10:00x": None}
    frame = spark.createDataFrame(list(times), "string").withColumn("got", tm.parse_timestamp(F.col("value")))
    day = dt.datetime(2024, 3, 1)
    for r in frame.collect():
        want = times[r["value"]]
        assert (r.got is None) == (want is None) and (want is None or abs((r.got - day).total_seconds() - want * 3600) < 1), r


def test_urls(spark):
    good = ["http://a.example/", "https://u:p@a.example:8080/x?y#z", "ftp://[::1]:21/", "http://1.2.3.4", "HTTP://LOCALHOST/", "http://a.example?x=@:"]
    bad = ["http://", "a.example", "http://a.example:123456/", "http://a b.example/", "http://a.example/x y", "http://u:p:q@a.example/", "http://[::g]/", "http://-a.example", "http://256.1.1.1", "gopher://a.example/"]
    frame = spark.createDataFrame(good + bad, "string").withColumn("ok", va.url(F.col("value")))
    assert {r["value"] for r in frame.collect() if r.ok} == set(good)


@pytest.mark.parametrize("flags", [0, 1, 2, 4, 8, 16, 32, 1 | 8 | 32, 2 | 4 | 32])
def test_ranks_with_and_without_index(spark, flags):
    rng = random.Random(flags)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "d", "E"], k=rng.randint(0, 30))), rng.choice(["a x", "b", None])) for i in range(60)]
    texts = spark.createDataFrame(rows, "id long, body string, title string")
    index = se.postings(texts, "id", A=("title",), D=("body",))
    near = lambda df: {r.id: pytest.approx(r["rank"]) for r in df.collect()}
    exact = lambda df: {r.id: r["rank"] for r in df.collect()}
    assert exact(se.rank_texts(texts, "id", ["a", "E"], normalization=flags, A=("title",), D=("body",))) == near(se.rank(index, "id", ["a", "E"], normalization=flags))
    terms = ["a", "b", "c"]
    assert exact(se.cover_rank_texts(texts, "id", terms, flags, A=("title",), D=("body",))) == near(se.rank_cover(index, "id", terms, flags))


def test_unaccent(spark):
    from relweave.functions import text as tx

    cases = {"Łódź žaba Ærø": "Lodz zaba AEro", "Straße": "Strasse", "e\u0301t\u00e9": "ete", "Ελλάδα": "Ελλάδα", "Việt Đức": "Viet Duc", "ﬁn": "ﬁn"}
    frame = spark.createDataFrame(list(cases), "string").select("value", tx.unaccent(F.col("value")).alias("got"))
    assert {r["value"]: r.got for r in frame.collect()} == cases


def test_headline_fragments(spark):
    text = "alpha beta gamma cat delta cat epsilon zeta eta theta iota kappa lambda dog mu nu xi omicron pi rho sigma cat tau"
    f = lambda **o: se.headline_fragments(F.lit(text), ["cat", "dog"], **o)
    got = one(
        spark, f(max_fragments=1, max_words=5), f(max_fragments=2, max_words=5), f(max_fragments=3, max_words=3), f(max_fragments=1, max_words=5, short_word=4),
        f(highlight_all=True, start="[", stop="]"), se.headline_fragments(F.lit(text), ["none"], min_words=2), se.headline_fragments(F.lit(""), ["cat"]),
        se.headline_fragments(F.lit(None).cast("string"), ["cat"]), f(max_fragments=2, max_words=9, short_word=0, delimiter=" | "), se.headline_fragments(F.lit("Cat, a category"), ["cat"], short_word=0),
    )
    assert tuple(got) == (
        "gamma <b>cat</b> delta <b>cat</b> epsilon",
        "gamma <b>cat</b> delta <b>cat</b> epsilon ... kappa lambda <b>dog</b>",
        "<b>cat</b> delta <b>cat</b> ... lambda <b>dog</b> ... sigma <b>cat</b>",
        "gamma <b>cat</b> delta <b>cat</b> epsilon",
        text.replace("cat", "[cat]").replace("dog", "[dog]"), "alpha beta", "", None,
        "alpha beta gamma <b>cat</b> delta <b>cat</b> epsilon zeta eta | <b>dog</b> mu nu xi omicron pi rho sigma <b>cat</b>",
        "<b>Cat</b>, a category",
    )


def test_distance_between_stretches(spark):
    """Stretches (1, 2), (2, 5), (5, 6) have centres two apart; a single one has no distance."""
    texts = spark.createDataFrame([(1, "a e x x a e"), (2, "a e"), (3, "a x")], "id int, body string")
    ranks = lambda flags: {r.id: round(r["rank"], 6) for r in se.cover_rank_texts(texts, "id", ["a", "e"], flags, D=("body",)).collect()}
    assert ranks(0) == {1: 1.25, 2: 0.5} and ranks(4) == {1: round(1.25 / 3, 6), 2: 0.5}


def test_fragments_with_tables_and_natural_dumps(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, ref string")
    b = spark.createDataFrame([("x", 5), ("x", 6), ("y", 0)], "ref string, id long")
    got = tb.extra(a, {"n": "b.id"}, ["b.ref = __own.ref", "b.id > 0"], tables={"b": b})
    assert got.columns == ["id", "ref", "n"] and sorted(map(tuple, got.collect())) == [(1, "x", 5), (1, "x", 6)]
    with pytest.raises(ValueError):
        tb.extra(a, tables={"b": b})
    keys = spark.createDataFrame([(10, "x", "u")], "pk long, p string, q string")
    rows = spark.createDataFrame([(1, 10), (2, None)], "id long, link long")
    out = fx.with_natural(rows, "link", keys, "pk", ["p", "q"])
    assert {r.id: r.link for r in out.collect()} == {1: ["x", "u"], 2: None}
    with pytest.raises(Exception, match="points at no row"):
        fx.with_natural(spark.createDataFrame([(1, 11)], "id long, link long"), "link", keys, "pk", ["p"]).collect()
