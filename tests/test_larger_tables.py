"""What grows with the tables stays off the driver and out of single tasks."""

import json
import random
from datetime import date
from difflib import SequenceMatcher
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from relweave.functions import geometry as g
from relweave.operators import similarity as sm
from relweave.operators import spatial as sp
from relweave.operators.ranges import overlap_join, point_in_range_join
from relweave.plans import aggregation as pa
from relweave.plans import corpus as pc
from relweave.sources import fixtures as fx


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def parts(spark):
    k = F.col("id")  # a table of known, small size, as a file has it
    rows = spark.range(120).select(k.alias("p_partkey"), (k % 50 + 1).cast("int").alias("p_size"), F.concat(F.lit("part "), k).alias("p_name"))
    return SimpleNamespace(spark=spark, part=rows)


def test_import_resolution_sends_no_side_of_a_join_whole(parts):
    out = pc.import_resolution(parts)
    assert "BroadcastHashJoin" not in plan(out)
    assert {(r.source, r.target) for r in out.collect()} == {(a, b) for a in ("util_3", "util_23") for b in ("util_3", "util_23")}


def test_plain_calls_meet_no_method(spark):
    from relweave.operators.resolve import resolve_basic

    functions = spark.createDataFrame([("A.m", "a.py", 1), ("m2", "a.py", 5)], "name string, file_path string, line_number int")
    calls = spark.createDataFrame([("m",), ("x.m",), ("m2",), (None,), (".m",)], "call string")
    found = {r.call: r.target for r in resolve_basic(calls, functions).collect()}
    assert found == {"m": None, "x.m": "A.m", "m2": "m2", None: None, ".m": "A.m"}


def test_locate_definition_sends_no_side_of_a_join_whole(parts):
    out = pc.locate_definition(parts)
    assert "BroadcastHashJoin" not in plan(out)
    assert out.where("function_name = 'unknown'").count() == sum(k % 4 == 3 and k % 50 != 1 for k in range(120))


@pytest.mark.parametrize("name", ["topo_order", "cycle_detection", "dependency_report", "dependency_closure", "dependency_raw_calls"])
def test_closures_send_no_side_of_a_join_whole(parts, name):
    assert "BroadcastHashJoin" not in plan(getattr(pc, name)(parts))


@pytest.fixture(scope="module")
def spans(spark):
    k = F.col("id")
    ends = F.when(k % 5 != 0, k + k % 7)
    return spark.range(60).select(k.alias("a"), (k % 3).alias("room"), F.when(k % 11 != 0, k.cast("double")).alias("lo"), ends.cast("double").alias("hi"))


def inside(x, y):
    return (x.lo is None or y.hi is None or x.lo < y.hi) and (x.lo is None or x.hi is None or x.lo < x.hi)


def test_range_overlap_join_sends_no_side_whole(spans):
    other = spans.toDF("b", "room2", "lo2", "hi2")
    out = overlap_join(spans, other, [("room", "room2")], ("lo", "hi"), ("lo2", "hi2"), 2.0)
    assert "BroadcastHashJoin" not in plan(out) and "SortMergeJoin" in plan(out)
    rows = spans.collect()
    want = sorted((x.a, y.a) for x in rows for y in rows if x.room == y.room and inside(x, y) and inside(y, x))
    assert sorted((r.a, r.b) for r in out.collect()) == want


def test_range_point_join_sends_no_side_whole(spark, spans):
    points = spark.range(60).select(F.col("id").alias("p"), (F.col("id") % 3).alias("of"), (F.col("id") + 0.5).alias("at"))
    out = point_in_range_join(points, spans, "at", "lo", "hi", 2.0, [("of", "room")], "[)")
    assert "BroadcastHashJoin" not in plan(out) and "SortMergeJoin" in plan(out)
    rows = spans.collect()
    want = sorted((p, x.a) for p in range(60) for x in rows if p % 3 == x.room and (x.lo is None or x.lo <= p + 0.5) and (x.hi is None or p + 0.5 < x.hi))
    assert sorted((r.p, r.a) for r in out.collect()) == want


def test_agg_sum_over_durations_of_more_than_64_bits(spark):
    k = F.col("id")
    day = lambda text: F.expr(f"timestamp_ntz'{text}'")
    items = spark.range(100).select(
        k.alias("l_orderkey"), F.when(k % 2 == 0, "F").otherwise("O").alias("l_linestatus"), F.lit(1.5).alias("l_quantity"),
        F.when(k % 2 == 0, day("9000-01-01 00:00:00")).otherwise(day("2000-01-02 00:00:00.25")).alias("l_shipdate"))
    orders = spark.range(100).select(k.alias("o_orderkey"), F.when(k % 2 == 0, day("1000-01-01 00:00:00")).otherwise(day("2000-01-01 00:00:00")).alias("o_orderdate"))
    got = {r.l_linestatus: (r.qty, r.qty_distinct, r.waited) for r in pa.agg_sum(SimpleNamespace(lineitem=items, orders=orders)).collect()}
    days = (date(9000, 1, 1) - date(1000, 1, 1)).days
    assert got == {"F": (75.0, 1.5, 50 * days * 86400.0), "O": (75.0, 1.5, 50 * 86400.25)}


def test_json_fixture_is_written_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    k = F.col("id")
    rows = fx.fixture_rows(spark.range(0, 95, 1, 1).withColumn("name", F.concat(F.lit("é\n"), k)), "m", k, ["name"])
    monkeypatch.setattr(fx, "FILE_ROWS", 10)
    fx.dump_json(rows, str(tmp_path / "many"))
    files = [json.loads(f.read_text()) for f in (tmp_path / "many").glob("part-*")]
    assert len(files) == 10 and max(map(len, files)) <= 20 and sum(map(len, files)) == 95
    back = fx.load_json(spark, str(tmp_path / "many")).collect()
    assert sorted((int(r.pk), json.loads(r.fields)["name"]) for r in back) == [(i, f"é\n{i}") for i in range(95)]
    fx.dump_json(rows.where("false"), str(tmp_path / "none"))
    assert fx.load_json(spark, str(tmp_path / "none")).count() == 0


def test_json_fixture_keeps_the_text_of_numbers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"model": "m", "pk": 1.10, "fields": {"b": 1.10,\n "a": 12345678901234567890123.450}},\n {"model": "n"}]')
    (tmp_path / "b.json").write_text('{"model": "one", "pk": "7", "fields": {}}')
    got = {(r.model, r.pk, r.fields) for r in fx.load_json(spark, str(tmp_path)).collect()}
    assert got == {("m", "1.10", '{"b": 1.10,\n "a": 12345678901234567890123.450}'), ("n", None, None), ("one", "7", "{}")}


def shapes(spark):
    """Pairs of a triangle, a square or an odd ring with others on a grid, many of which touch."""
    k = F.col("id")
    at = lambda x, y: g.point(x, y)
    x, y = (k % 5).cast("double") / 2, F.floor(k / 5).cast("double") / 2
    square = F.array(at(x, y), at(x + 1, y), at(x + 1, y + 1), at(x, y + 1), at(x, y))
    triangle = F.array(at(x, y), at(x + 1.5, y + 0.25), at(x + 0.5, y + 2), at(x, y))
    nothing = F.lit(None).cast(square_type := "array<struct<x:double,y:double>>")
    odd = F.when(k % 7 == 0, F.array().cast(square_type)).when(k % 7 == 1, nothing).when(k % 7 == 2, F.array(at(x, y))).when(
        k % 7 == 3, F.array(at(x, y), F.lit(None).cast("struct<x:double,y:double>"), at(x + 1, y))).when(
        k % 7 == 4, F.array(at(x, y), at(F.lit(float("nan")), y), at(x, y + 1), at(x, y))).otherwise(triangle)
    ring = F.when(k % 3 == 0, square).when(k % 3 == 1, triangle).otherwise(odd)
    return spark.range(0, 25, 1, 2).select(k.alias("id"), at(x + 0.5, y + 0.5).alias("p"), ring.alias("ring"))


def test_geometry_in_batches_tells_what_the_expressions_tell(spark, monkeypatch):
    monkeypatch.setattr(g, "BLOCK", 16)
    one = shapes(spark)
    both = one.crossJoin(one.toDF("other", "p2", "ring2"))
    tests = ((g.many_rings_intersect, g.rings_intersect, "ring", "ring2"), (g.many_within, g.within, "p2", "ring"), (g.many_covered_by, g.covered_by, "p2", "ring"))
    cols = [f(F.col(a), F.col(b)).alias(f"{kind}{i}") for i, (many, plain, a, b) in enumerate(tests) for kind, f in (("m", many), ("p", plain))]
    rows = both.select(*cols).collect()
    for i in range(3):
        assert [r[f"m{i}"] for r in rows] == [r[f"p{i}"] for r in rows]
        assert {True, False, None} >= {r[f"p{i}"] for r in rows} >= {True, False}


def test_spatial_joins_send_no_side_whole_and_find_all(spark):
    k = F.col("id")
    ring = F.array(*[g.point(k % 9 / 10 + x, F.floor(k / 9) / 10 + y) for x, y in ((0, 0), (0.2, 0.05), (0.1, 0.25), (0, 0))])
    polygons = spark.range(60).select(k.alias("id"), ring.alias("ring"))
    points = spark.range(200).select(k.alias("vec_id"), g.point(k % 20 / 19, F.floor(k / 20) / 11).alias("p"))
    pairs = points.crossJoin(polygons)
    for test, edge in ((g.within, False), (g.covered_by, True)):
        want = sorted((r.vec_id, r.id) for r in pairs.where(test(F.col("p"), F.col("ring"))).collect())
        out = sp.point_in_polygon(points, polygons, "p", "ring", 0.1, boundary=edge)
        assert "BroadcastHashJoin" not in plan(out) and sorted((r.vec_id, r.id) for r in out.collect()) == want
        held = sp.point_in_polygon(points, polygons, "p", "ring", 0.1, boundary=edge, holders=True)
        assert held.columns == ["id", "ring"] and {r.id for r in held.collect()} == {b for _, b in want}
        own = points.withColumn("own", F.col("vec_id") % 60)
        got = sp.point_in_polygon(own, polygons, "p", "ring", 0.1, boundary=edge, own=("own", "id"))
        assert sorted((r.vec_id, r.id) for r in got.collect()) == [(a, b) for a, b in want if a % 60 == b]
    other = polygons.toDF("other", "ring2")
    meet = g.BOX_TESTS["bboverlaps"](g.box(F.col("ring")), g.box(F.col("ring2"))) & g.rings_intersect(F.col("ring"), F.col("ring2"))
    want = sorted((r.id, r.other) for r in polygons.crossJoin(other).where((k < F.col("other")) & meet).collect())
    out = sp.polygons_intersect(polygons, other, "ring", "ring2", 0.1, k < F.col("other"))
    assert "BroadcastHashJoin" not in plan(out) and sorted((r.id, r.other) for r in out.collect()) == want


@pytest.mark.parametrize("variants", [0, 6, 600])
def test_names_that_meet_by_deletion_or_by_tokens(spark, monkeypatch, variants):
    monkeypatch.setattr(sm, "VARIANTS", variants)
    pick = random.Random(5)
    names = ["".join(pick.choice("abé_") for _ in range(pick.randint(1, 14))) for _ in range(150)] + ["Total", "total", "TOTALS", "", None]
    near = [n[: (i := pick.randrange(len(n)))] + pick.choice("xab") + n[i + 1 :] for n in names[:60]] + ["aaaaaaaaaaaa", "Total"]
    frame = lambda ns: spark.createDataFrame([(n,) for n in ns], "name string")
    want = set()
    for a in {n for n in names if n}:
        for b in set(near):
            r = SequenceMatcher(None, "", "")
            r.set_seq2(b.lower())
            r.set_seq1(a.lower())
            if r.ratio() >= 0.8:
                want.add((a, b, r.ratio()))
    got = sm.ratio_join(frame(names), frame(near), 0.8).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 60


def test_random_names_make_few_candidates(spark):
    """Of 3,000 random names the tokens of each meet about 700 others."""
    k = F.col("id")
    names = lambda low: spark.range(low, low + 3000).select(F.concat(F.lit("f"), F.substring(F.md5(k.cast("string")), 1, 12)).alias("name"))
    listed = [sm._left_overs(names(low).withColumnRenamed("name", "n"), {13: {11}}) for low in (0, 2990)]
    pairs = listed[0].join(listed[1].withColumnRenamed("n", "b"), "key").select("n", "b").distinct()
    assert 10 <= pairs.count() < 50
    assert sm._classes({13: 9}, {13: 9}, 0.8)[1] == {(13, 13)}


def test_a_file_is_walked_once(monkeypatch):
    """Functions inside functions do not have their trees read again."""
    from relweave.operators import corpus as co

    walked = []
    plain = co.ast.walk
    monkeypatch.setattr(co.ast, "walk", lambda node: walked.append(node) or plain(node))
    source = "import a\nclass C:\n    def m(self, x: int) -> str:\n        import b\n        def inner(y=h(1)):\n            return self.n(y) if y and x or g.f.k() else o.p()\n        while x:\n            self.q()\n        return inner\n"
    rows = co._functions_of("a.py", source)
    assert not walked
    assert [(r[0], r[4], r[5], r[8], r[9], r[10]) for r in rows] == [
        ("C.m", ["C.n", "C.q", "h", "k", "n", "o.p", "p", "q", "self.n", "self.q"], ["a"], {"x": "int"}, "str", 4.0),
        ("C.inner", ["C.n", "h", "k", "n", "o.p", "p", "self.n"], ["a", "b"], {}, None, 3.0)]


def test_fragments_split_a_text_once(spark):
    """Words bound once; as part of each use they were made again for every word looked at."""
    from relweave.operators import search as se

    df = spark.createDataFrame([("a cat and a dog " * 30,)], "text string").select(se.headline_fragments(F.col("text"), ["cat"], max_fragments=3, max_words=8).alias("pieces"))
    made = df._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("split(") == 1 and made.count("RLIKE") == 1


def test_batches_of_long_texts_are_bounded_in_bytes(spark, tmp_path):
    """10,000 rows a batch is Spark's other limit, whatever they hold."""
    from relweave.plans import registry

    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches)
    was = spark.conf.get(name)
    spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 400).alias("t")).write.parquet(str(tmp_path / "long.parquet"))
    try:
        spark.conf.set(name, "64m")
        registry.query("batch_sizes")(lambda d: d.long.mapInPandas(seen, "n int"))
        sizes = [r.n for r in registry.QUERIES["batch_sizes"](spark, str(tmp_path)).collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000
        spark.conf.set(name, "1m")  # a smaller limit of the session's own stays
        assert max(r.n for r in registry.QUERIES["batch_sizes"](spark, str(tmp_path)).collect()) < 500
    finally:
        registry.QUERIES.pop("batch_sizes", None)
        registry.MODULES.pop("batch_sizes", None)
        spark.conf.set(name, was)


def test_the_earlier_run_is_parsed_once(parts):
    """Its rows are read for the reused functions and for the known files."""
    out = pc.incremental_analysis(parts)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert "BroadcastHashJoin" not in plan(out)
    got = out.where("file_path = 'pkg0/mod_8.py' or file_path = 'pkg0/mod_9.py'").select("file_path", "reused").distinct().collect()
    assert sorted(map(tuple, got)) == [("pkg0/mod_8.py", False), ("pkg0/mod_9.py", True)]


def test_calls_of_hot_names_are_not_shuffled(spark, parts, monkeypatch):
    from relweave.operators import resolve as rs

    calls = spark.createDataFrame([(i, "dumps" if i % 2 else "f" if i % 4 else f"g{i % 3}") for i in range(200)] + [(200, None)], "id int, call string")
    named = spark.createDataFrame([("f", 1), ("g0", 2), ("g1", 3), ("h", 4)], "call string, n int").hint("merge")
    monkeypatch.setattr(rs, "HOT", 40)
    for how in ("inner", "left"):
        out, want = rs.join_called(calls, named, "call", how), calls.join(named, "call", how)
        key = lambda r: tuple(map(str, r))
        assert out.columns == want.columns and sorted(out.collect(), key=key) == sorted(want.collect(), key=key)
        assert plan(out).count("BroadcastHashJoin") == 1 and plan(out).count("SortMergeJoin") == 1
    monkeypatch.undo()
    want = sorted(pc.context_score(parts).collect())
    monkeypatch.setattr(rs, "HOT", 3)
    assert sorted(pc.context_score(parts).collect()) == want and want


def broadcast_bytes(df):
    """What Spark holds for each broadcast side once the query has run."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "BroadcastExchange":
            found.append(node.metrics().apply("dataSize").value())
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_rows_of_hot_names_are_held_in_no_page_of_64_mb(spark, monkeypatch):
    from relweave.operators import resolve as rs

    calls = spark.createDataFrame([(i, "dumps" if i % 2 else "f") for i in range(200)] + [(200, None), (201, "g")], "id int, call string")
    named = spark.createDataFrame([("f", 1), ("dumps", 2), ("g", None)], "call string, n int").hint("merge")
    monkeypatch.setattr(rs, "HOT", 40)
    out = rs.join_called(calls, named, "call", "left")
    assert out.columns == ["call", "id", "n"]
    assert {(r.call, r.n) for r in out.collect()} == {("f", 1), ("dumps", 2), ("g", None), (None, None)} and out.count() == 202
    sizes = broadcast_bytes(out)
    assert len(sizes) == 1 and 0 < sizes[0] < 4 << 20


@pytest.mark.parametrize("name", ["topo_order", "cycle_detection", "dependency_report"])
def test_hot_names_change_no_order(parts, monkeypatch, name):
    from relweave.operators import resolve as rs

    rows = lambda: sorted(getattr(pc, name)(parts).collect(), key=str)
    want = rows()
    monkeypatch.setattr(rs, "HOT", 3)
    assert rows() == want and want
