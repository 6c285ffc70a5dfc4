"""Windows, spatial, search, writes, quality and cleaning on small fixtures."""

import datetime as dt
import io
import itertools
import json
import lzma
import math
import zipfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from relweave.functions import geometry as g
from relweave.functions import lookups as lk
from relweave.functions import ranges as rg
from relweave.functions import temporal as tm
from relweave.functions import validators as va
from relweave.operators import aggregates as ag
from relweave.operators import cleaning as cl
from relweave.operators import ordering as od
from relweave.operators import ranges as ro
from relweave.operators import search as se
from relweave.operators import spatial as sp
from relweave.operators import windows as win
from relweave.operators import writes as wr
from relweave.sources import fixtures as fx
from relweave.streaming import jobs


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, one is NULL, values repeat."""
    rows = [(1 if i % 4 else (None if i % 8 else i % 3), i, (i * 37) % 11, float(i % 7)) for i in range(400)]
    return spark.createDataFrame(rows, "k int, id int, v int, x double").repartition(6).cache()


def test_spread_windows_equal_plain(skewed):
    w = Window.partitionBy("k").orderBy(F.col("v").asc_nulls_last(), "id")
    plain = skewed.select("id", F.row_number().over(w).alias("rn"), F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    mine = win.running(skewed, ["k"], win.sort_keys("v", "id"), "rn", {"s": "x"}).select("id", "rn", "s")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, mine.collect()))


def test_spread_ranks_equal_plain(skewed):
    w = Window.partitionBy("k").orderBy(F.col("v").desc_nulls_first())
    fns = [F.rank(), F.dense_rank(), F.percent_rank(), F.cume_dist()]
    plain = skewed.select("id", *[f.over(w).alias(f"c{i}") for i, f in enumerate(fns)])
    mine = win.rank_rows(skewed, ["k"], ["-v"]).select("id", "rank", "dense_rank", "percent_rank", "cume_dist")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, mine.collect()))


def test_ntile_and_shift(skewed):
    w = Window.partitionBy("k").orderBy("id")
    plain = skewed.select("id", F.ntile(7).over(w).alias("t"), F.lag("v", 2, -1).over(w).alias("l"))
    rows = win.ntile(win.rank_rows(skewed, ["k"], ["id"]), 7, name="t")
    rows = win.shifted(rows, ["k"], "row_number", "v", "l", 2, F.lit(-1))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, rows.select("id", "t", "l").collect()))


def test_chunked_lists(skewed):
    rows = win.chunked_lists(skewed, ["k"], win.sort_keys("id"), F.col("id"), 16).collect()
    assert all(len(r["items"]) <= 16 for r in rows)
    hot = [i for r in sorted((r for r in rows if r.k == 1), key=lambda r: r.chunk) for i in r["items"]]
    assert hot == [i for i in range(400) if i % 4 or (i % 8 == 0 and i % 3 == 1)]


def test_empty_windows(spark):
    df = spark.createDataFrame([], "k int, id int, v int")
    assert win.rank_rows(df, ["k"], ["v"]).count() == 0
    assert od.pages(df, win.sort_keys("id"), 5).count() == 0


@pytest.mark.parametrize("number,first,last", [(1, 0, 9), ("x", 0, 9), (2, 10, 22), (9, 10, 22)])
def test_get_page(spark, number, first, last):
    df = spark.range(23)
    ids = [r.id for r in od.get_page(df, [F.col("id").asc()], number, 10, orphans=3).collect()]
    assert ids == list(range(first, last + 1))
    assert od.pages(df, [F.col("id").asc()], 10, 3).where("page = 2").count() == 13


def test_slice_get(spark):
    df = spark.range(10)
    key = [F.col("id").asc()]
    assert sorted(r.id for r in od.slice_rows(df, key, 1, 9, 3).collect()) == [1, 4, 7]
    with pytest.raises(ValueError):
        od.slice_rows(df, key, -1)
    with pytest.raises(od.NotFound):
        od.get_one(df.where("id > 50"))
    with pytest.raises(od.MultipleFound):
        od.get_one(df)


def test_lookup_errors(spark):
    with pytest.raises(ValueError):
        lk.predicate(F.col("a"), ["gt"], None)
    with pytest.raises(ValueError):
        lk.predicate(F.col("a"), ["isnull"], 3)
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a int, b int")
    assert df.where(lk.predicate(F.col("a"), ["in"], [])).count() == 0
    assert df.where(lk.tuple_isnull([F.col("a"), F.col("b")], True)).count() == 2
    assert df.where(lk.negate(F.col("a") == 1)).count() == 2


def test_year_range_is_pushed_down(data):
    plan = data.orders.where(lk.predicate(F.col("o_orderdate"), ["year"], 1997))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_path_join_prunes_and_trims(data):
    from relweave.plans.projection import rows

    trimmed = rows(data, "orders").filter(customer__c_custkey=5).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in trimmed
    plan = rows(data, "orders").values("o_orderkey", "customer__c_name")._jdf.queryExecution().executedPlan().toString()
    assert "c_mktsegment" not in plan


def test_date_hierarchy_levels(spark):
    mk = lambda days: spark.createDataFrame([(dt.datetime(2021, 1, 1) + dt.timedelta(days=d),) for d in days], "t timestamp_ntz")
    assert {r.level for r in ag.date_hierarchy(mk([0, 3]), "t").collect()} == {"day"}
    assert {r.level for r in ag.date_hierarchy(mk([0, 40]), "t").collect()} == {"month"}
    assert {r.level for r in ag.date_hierarchy(mk([0, 400]), "t").collect()} == {"year"}


def test_elapsed(spark):
    cases = [
        ("2013-02-10 00:00:00", "2014-03-10 00:00:00", "1 year, 1 month"), ("2007-08-10 00:00:00", "2008-09-10 00:00:00", "1 year, 1 month"),
        ("2020-01-31 00:00:00", "2020-03-01 00:00:00", "1 month"), ("2020-01-31 00:00:00", "2020-03-07 00:00:00", "1 month, 1 week"), ("2020-01-01 00:00:00", "2020-01-18 03:00:00", "2 weeks, 3 days"),
        ("2020-01-01 00:00:00", "2020-01-15 03:00:00", "2 weeks"), ("2020-01-01 10:00:00", "2020-01-01 11:05:59", "1 hour, 5 minutes"),
        ("2020-01-01 10:00:00", "2020-01-01 10:00:30", "0 minutes"), ("2021-01-01 00:00:00", "2020-01-01 00:00:00", "0 minutes"),
    ]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(b), w) for a, b, w in cases], "a timestamp_ntz, b timestamp_ntz, w string")
    for r in df.select("w", tm.elapsed(F.col("a"), F.col("b")).alias("got")).collect():
        assert r.got.replace(" ", " ") == r.w


def test_parse_values(spark):
    df = spark.createDataFrame([("3 days, 04:05:06.5", 3 * 86400 + 14706.5), ("-01:00:00", -3600.0), ("15", 15.0), ("2:30", 150.0), ("x", None)], "t string, w double")
    assert all(r.got == r.w for r in df.select("w", tm.interval_seconds(tm.parse_duration(F.col("t"))).alias("got")).collect())
    bad = spark.createDataFrame([("25:00",), ("10:61",), ("1:2:3:4",)], "t string")
    assert bad.where(tm.parse_time(F.col("t")).isNotNull()).count() == 0


def test_ranges(spark):
    vals = [(a, b) for a in (None, 1, 3) for b in (None, 3, 5)]
    rows = [(i, *p, *q) for i, (p, q) in enumerate(itertools.product(vals, vals))]
    df = spark.createDataFrame(rows, "i int, a int, b int, c int, d int")
    r, q = rg.make(F.col("a"), F.col("b")), rg.make(F.col("c"), F.col("d"))
    span = lambda lo, hi: {x for x in range(-9, 20) if (lo is None or x >= lo) and (hi is None or x < hi)}
    for row in df.select("*", rg.overlap(r, q).alias("o"), rg.contains(r, q).alias("h"), rg.fully_lt(r, q).alias("l"), rg.adjacent(r, q).alias("j")).collect():
        x, y = span(row.a, row.b), span(row.c, row.d)
        assert row.o == bool(x & y) and row.h == (y <= x)
        assert row.l == bool(x and y and max(x) < min(y))
        meets = bool(x and y) and ((row.b is not None and row.b == row.c) or (row.d is not None and row.d == row.a))
        assert row.j == meets


def test_overlap_join_brute(spark):
    rows = [(i, i % 2, float((i * 7) % 50), float((i * 7) % 50 + i % 13)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, k int, lo double, hi double")
    other = df.toDF("id2", "k2", "lo2", "hi2")
    got = sorted((r.id, r.id2) for r in ro.overlap_join(df, other, [("k", "k2")], ("lo", "hi"), ("lo2", "hi2"), 4.0).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3])
    assert got == want


def test_ip(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("1.2.3.400",), ("x",), (None,)], "ip string")
    assert [r[0] for r in df.select(ro.ip_number(F.col("ip"))).collect()] == [0x01020304, None, None, None]
    six = spark.createDataFrame([("2001:db8::1",), ("::1",)], "ip string").withColumn("ip", ro.ip6_key(F.col("ip")))
    nets = spark.createDataFrame([("20010db8" + "0" * 24, "20010db8" + "f" * 24, "X")], "lo string, hi string, country string")
    assert sorted(str(r.country) for r in ro.ip_enrich(six, nets, "ip", ["country"]).collect()) == ["None", "X"]


def test_nearest_brute(spark):
    t = [(i, math.sin(i * 12.9), math.cos(i * 78.2)) for i in range(50)] + [(99, 40.0, 40.0)]
    q = [(i, i * 0.3 - 1, 0.5 - i * 0.2) for i in range(8)] + [(50, 60.0, -60.0)]
    mk = lambda rows, n: spark.createDataFrame(rows, f"{n} int, x double, y double").select(n, g.point(F.col("x"), F.col("y")).alias("p" + n))
    out = sp.nearest(mk(q, "a"), mk(t, "b"), "a", "b", "pa", "pb", 4, leaf=3)
    got = {}
    for r in out.collect():
        got.setdefault(r.a, {})[r.position] = r.b
    for i, x, y in q:
        best = sorted(t, key=lambda p: (math.hypot(p[1] - x, p[2] - y), p[0]))[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == [b[0] for b in best]


def _cross(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


def test_polygons_brute(spark, data):
    from relweave.plans import spatial as ps

    rings = {r.id: [(p.x, p.y) for p in r.ring] for r in ps.polygons(data).collect()}

    def inside(p, ring):
        hits = 0
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            hits += (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax
        return hits % 2 == 1

    def meet(r, s):
        return any(_cross(a, b, c, d) for a, b in zip(r, r[1:]) for c, d in zip(s, s[1:])) or inside(r[0], s) or inside(s[0], r)

    got = {(r.id, r.other) for r in ps.polygons_intersect(data).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(rings), 2) if meet(rings[a], rings[b])}


def test_geometry_goldens(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in square],)], "r array<struct<x:double,y:double>>")
    r, p = F.col("r"), g.point(F.lit(3.0), F.lit(1.0))
    row = df.select(
        g.area(r).alias("area"), g.perimeter(r).alias("per"), g.bounding_circle(r)["radius"].alias("rad"), g.closest_point(r, p).alias("c"),
        g.line_locate_point(r, p).alias("at"), g.azimuth(g.point(F.lit(0), F.lit(0)), g.point(F.lit(1), F.lit(0))).alias("az"),
        g.within(g.point(F.lit(2.0), F.lit(1.0)), r).alias("edge_in"), g.covered_by(g.point(F.lit(2.0), F.lit(1.0)), r).alias("edge_on"),
        g.geohash(g.point(F.lit(-5.6), F.lit(42.6)), 5).alias("hash"), g.as_geojson(r).alias("js"), g.point_on_surface(r).alias("s"), g.as_wkb(r).alias("wkb"),
    ).first()
    assert row.area == 4 and row.per == 8 and abs(row.rad - math.sqrt(2)) < 1e-9 and (row.c.x, row.c.y) == (2.0, 1.0)
    assert row["at"] == 3 / 8 and abs(row.az - math.pi / 2) < 1e-12 and not row.edge_in and row.edge_on
    assert row.hash == "ezs42" and json.loads(row.js)["coordinates"][0][2] == [2.0, 2.0] and (row.s.x, row.s.y) == (1.0, 1.0)
    assert bytes(row.wkb)[:13].hex() == "01030000000100000005000000"


def test_trigram_join_brute(spark):
    texts = ["hot rod", "hot rods", "hat rod", "red plate", "red plates now", "plate", "rod hot", "x", "zebra", "Hot  Rod!"]
    df = spark.createDataFrame([(t,) for t in texts + texts[:3]], "text string")
    for t in (0.3, 0.6, 1.0):
        got = {(r.a, r.b) for r in se.similarity_join(df, df, t).collect()}
        all_pairs = df.distinct().toDF("a").crossJoin(df.distinct().toDF("b")).where(se.similarity(F.col("a"), F.col("b")) >= t)
        assert got == {(r.a, r.b) for r in all_pairs.collect()}


def test_word_similarity(spark):
    row = spark.range(1).select(
        se.similarity(F.lit("word"), F.lit("two words")).alias("s"), se.word_similarity(F.lit("word"), F.lit("two words")).alias("w"),
        se.strict_word_similarity(F.lit("word"), F.lit("two words")).alias("t"), se.headline(F.lit("one two the three four"), ["the"], max_words=3, lead=1).alias("h")).first()
    assert abs(row.s - 4 / 11) < 1e-9 and abs(row.w - 0.8) < 1e-9 and abs(row.t - 4 / 7) < 1e-9
    assert row.h == "two <b>the</b> three"


def test_cascade_rules(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    b = spark.createDataFrame([(10, 1), (11, 2)], "id int, a int")
    c = spark.createDataFrame([(100, 10)], "id int, b int")
    keys = {"a": ("id",), "b": ("id",), "c": ("id",)}
    rule = lambda t, col, target, act, value=None: wr.OnDelete(t, (col,), target, ("id",), act, value)
    run = lambda rules: wr.cascade_delete({"a": a, "b": b, "c": c}, keys, rules, "a", a.where("id = 1"))
    new, counts = run([rule("b", "a", "a", "cascade"), rule("c", "b", "b", "cascade")])
    assert counts == {"a": 1, "b": 1, "c": 1} and new["c"].count() == 0
    new, counts = run([rule("b", "a", "a", "set_value", 3)])
    assert sorted(r.a for r in new["b"].collect()) == [2, 3]
    with pytest.raises(wr.ProtectedRows):
        run([rule("b", "a", "a", "protect")])
    with pytest.raises(wr.ProtectedRows):
        run([rule("b", "a", "a", "cascade"), rule("c", "b", "b", "restrict")])
    # restricted rows may go if another cascade takes them too
    new, counts = run([rule("b", "a", "a", "cascade"), wr.OnDelete("c", ("b",), "b", ("id",), "cascade"), rule("c", "b", "b", "restrict")])
    assert counts["c"] == 1


def test_links(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "a int, b int")
    new = spark.createDataFrame([(1, 3), (4, 1)], "a int, b int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(wr.link_add(pairs, new)) == [(1, 2), (1, 3), (2, 1), (4, 1)]
    assert rows(wr.link_add(pairs, new, symmetric=True)) == [(1, 2), (1, 3), (1, 4), (2, 1), (3, 1), (4, 1)]
    assert rows(wr.link_set(pairs, spark.createDataFrame([(1, 9)], "a int, b int"), "a")) == [(1, 9), (2, 1)]


def test_markup(spark):
    pairs = [
        ("<p>a &amp; b</p><script>x</script>", "a &amp; bx"), ("a < b and c > d", "a < b and c > d"), ("<<b>i>x</i>", "x"), ("plain", "plain"),
    ]
    df = spark.createDataFrame(pairs, "t string, w string")
    got = [r[0] for r in df.select(cl.strip_tags(F.col("t"))).collect()]
    assert got[0] == pairs[0][1] and got[1] == pairs[1][1] and got[3] == "plain" and "<b>" not in got[2]
    html = "<p>one <b>two three</b><br>four</p>"
    row = spark.createDataFrame([(html,)], "h string").select(
        cl.truncate_html(F.col("h"), 2, "words").alias("w"), cl.truncate_html(F.col("h"), 6).alias("c"), cl.truncate_html(F.col("h"), 100).alias("all")).first()
    assert row.w == "<p>one <b>two …</b></p>" and row.c == "<p>one <b>t…</b></p>" and row.all == html


def test_links_extracted(spark):
    text = "See (http://a.com/x_(y)), www.b.org! or cc.net/p; d@e.com. &lt;http://f.com&gt; not.this nor http:x 'gg.edu'"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = {r.url for r in cl.extract_links(df, "id", "t").collect()}
    assert {"http://a.com/x_(y)", "http://www.b.org", "http://cc.net/p", "mailto:d@e.com", "http://gg.edu"} <= got
    assert not any("not.this" in u for u in got)


def test_filters(spark):
    row = spark.range(1).select(
        cl.title(F.lit("joe's 1st o'NEIL it's")).alias("title"), cl.slugify(F.lit(" Hëllo, Wörld -- _x_ ")).alias("slug"), cl.slugify(F.lit("Ünï 日本"), True).alias("uslug"),
        cl.truncate_chars(F.lit("éééé"), 3).alias("nfc"), cl.camel_to_spaces(F.lit("someHTTPThing")).alias("camel"),
        cl.get_digit(F.lit("12a"), 1).alias("d1"), cl.get_digit(F.lit(123), 9).alias("d2"), cl.yesno(F.lit(None).cast("boolean"), "a", "b").alias("yn"),
        cl.wrap(F.lit("aaa bbb ccc\n\nlongwordhere x\n"), 7).alias("wrap"), cl.uri_to_iri(F.lit("/%20caf%C3%A9%FF")).alias("iri"), cl.add(F.lit("a"), F.lit("1")).alias("add")).first()
    assert row.title == "Joe's 1st O'Neil It's" and row.slug == "hello-world-_x" and row.uslug == "ünï-日本" and row.nfc == "éé…"
    assert row.camel == "some http thing" and row.d1 == "12a" and row.d2 == "0" and row.yn == "b"
    assert row.wrap == "aaa bbb\nccc\n\nlongwordhere\nx\n" and row.iri == "/%20café%FF" and row.add == "a1"


def test_validators(spark):
    good = [("email", "a.b+c@ex-ample.co.uk"), ("url", "http://user@ex.com/p?q#f"), ("domain", "bücher.example"), ("ip", "2001:db8::8a2e:370:7334"), ("slug", "a-b_9")]
    bad = [("email", "a@b"), ("email", "a b@c.com"), ("url", "http://"), ("url", "http://a.com/\n"), ("domain", "a..com"), ("ip", "1.2.3"), ("ip", "1.2.3.04"), ("slug", "")]
    df = spark.createDataFrame([(k, v, True) for k, v in good] + [(k, v, False) for k, v in bad], "k string, v string, w boolean")
    for kind, fn in (("email", va.email), ("url", va.url), ("domain", va.domain), ("ip", va.ip), ("slug", va.slug)):
        for r in df.where(F.col("k") == kind).select("v", "w", fn(F.col("v")).alias("got")).collect():
            assert r.got == r.w, (kind, r.v)
    nums = spark.createDataFrame([("123.45", True), ("0.01", True), ("1234", False), ("0.001", False), ("Infinity", False), (".5", True)], "v string, w boolean")
    assert all(r.w == r.got for r in nums.select("w", va.decimal_shape(F.col("v"), 5, 2).alias("got")).collect())


def test_packed_fixtures(spark):
    items = [{"model": "m", "pk": i, "fields": {"a": i, "b": None}} for i in range(3)]
    lines = "\n".join(json.dumps(i) for i in items)
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("x.json", json.dumps(items))
    df = spark.createDataFrame([("a.xz", lzma.compress(lines.encode())), ("b.zip", zipped.getvalue()), ("c.lzma", lzma.compress(lines.encode(), lzma.FORMAT_ALONE))], "path string, content binary")
    rows = fx.model_rows(fx.load_packed(df), "m", "a int, b string", "id").collect()
    assert sorted(r.a for r in rows) == [0, 0, 0, 1, 1, 1, 2, 2, 2] and all(r.b is None for r in rows)


def test_json_files_are_arrays(spark, tmp_path):
    df = spark.range(5).repartition(2)
    fx.dump_json(fx.fixture_rows(df, "m", F.col("id"), ["id"]), str(tmp_path / "o"))
    got = [o["pk"] for p in (tmp_path / "o").glob("part*") for o in json.loads(p.read_text())]
    assert sorted(got) == list(range(5))


def test_load_order_cycle(spark):
    with pytest.raises(ValueError):
        fx.table_load_order(spark, [("a", "b"), ("b", "a")], ["a", "b", "c"])
    got = {r.name: r.level for r in fx.table_load_order(spark, [("a", "b"), ("b", "a"), ("d", "c")], ["a", "b", "c", "d"], allow_cycles=True).collect()}
    assert got == {"c": 0, "d": 1, "a": 2, "b": 2}


def test_streams_in_small_batches(spark, data, tmp_path):
    """Several micro-batches give what one batch job gives."""
    from relweave.plans import writes as pw
    from relweave.runtime import ntz

    src = str(tmp_path / "in")
    ops = pw.operations(data)
    ops.repartition(4).write.parquet(src)
    stream = jobs.file_stream(spark, src, ops, 1)
    rows = jobs.keep_newest(jobs.ttl_updates(stream, "60 days"), str(tmp_path / "out"), str(tmp_path / "c1"), ["key"])
    live = rows.withColumn("expires", F.col("expires").cast("timestamp_ntz"))
    live = live.where(F.col("live") & (F.col("expires") > ntz("2024-01-29 00:00:00"))).select("key", "value", "expires")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, wr.ttl_state(ops, ntz("2024-01-29 00:00:00")).collect()))
    table = jobs.keep_newest(jobs.file_stream(spark, src, ops, 1).select("key", "value", "seq"), str(tmp_path / "t"), str(tmp_path / "c2"), ["key"], [F.col("seq")])
    assert table.count() == ops.select("key").distinct().count()
