"""Interval joins without grid cells, as-of look-ups, streams whose state ends."""

import ipaddress
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from relweave.operators import quality as qu
from relweave.operators import ranges as ro
from relweave.operators import writes as wr
from relweave.runtime import ntz
from relweave.streaming import jobs


@pytest.fixture(scope="module")
def spans():
    rng = random.Random(5)
    rows = []
    for i in range(260):
        lo = rng.choice([None, round(rng.uniform(0, 5000), 1), float(rng.randint(0, 40))])
        size = rng.choice([0.0, 0.5, 3.0, 900.0, 3.2e8, -1.0])
        hi = None if rng.random() < 0.1 else (rng.uniform(0, 3000) if lo is None else lo + size)
        rows.append((i, i % 3, lo, hi))
    return rows + [(1000, 0, None, None), (1001, None, 1.0, 2.0), (1002, 1, 5.0, 6.0), (1003, 1, 5.0, 6.0)]


def low(x):
    return -math.inf if x is None else x


def high(x):
    return math.inf if x is None else x


def test_overlaps_with_open_ends(spark, spans):
    df = spark.createDataFrame(spans, "id int, k int, lo double, hi double")
    other = df.toDF("id2", "k2", "lo2", "hi2")
    got = sorted((r.id, r.id2) for r in ro.overlap_join(df, other, [("k", "k2")], ("lo", "hi"), ("lo2", "hi2"), 4.0).collect())
    good = [r for r in spans if r[1] is not None and low(r[2]) < high(r[3])]
    want = sorted((a[0], b[0]) for a in good for b in good if a[1] == b[1] and low(a[2]) < high(b[3]) and low(b[2]) < high(a[3]))
    assert got == want
    pairs = qu.exclusion(df, "id", ["k"], "lo", "hi", 4.0).collect()
    assert sorted((r.id, r.other_id) for r in pairs) == [p for p in want if p[0] < p[1]]


@pytest.mark.parametrize("bounds", ["[]", "[)", "(]", "()"])
def test_points_in_ranges(spark, spans, bounds):
    points = [(i, x) for i, x in enumerate([None, -7.0, 0.0, 5.0, 6.0, 39.0, 40.0, 2999.5, 1e8, 9e9] + [r[2] for r in spans[:50]])]
    df = spark.createDataFrame(points, "n int, x double")
    out = ro.point_in_range_join(df, spark.createDataFrame(spans, "id int, k int, lo double, hi double"), "x", "lo", "hi", 2.0, bounds=bounds)
    left = (lambda a, b: a <= b) if bounds[0] == "[" else (lambda a, b: a < b)
    right = (lambda a, b: a <= b) if bounds[1] == "]" else (lambda a, b: a < b)
    want = sorted((n, r[0]) for n, x in points if x is not None for r in spans if left(low(r[2]), x) and right(x, high(r[3])))
    assert sorted((r.n, r.id) for r in out.collect()) == want


def test_covers_stay_short(spark, spans):
    df = spark.createDataFrame(spans, "id int, k int, lo double, hi double").where("lo is null or hi is null or lo < hi")
    base, top = ro.dyadic_level(4.0, (df, "lo", "hi"))
    rows = df.select("id", "lo", "hi", ro.dyadic_cover(F.col("lo"), F.col("hi"), base, 4.0, top).alias("c")).collect()
    ends = [x for r in spans for x in r[2:] if x is not None]
    assert max(len(r.c) for r in rows) < 2 * math.log2((max(ends) - min(ends)) / 4.0)
    for r in rows:  # the cells of the cover are those of the range, each once
        cells = sorted(c for n in r.c for c in (n["at"] << n["level"], (n["at"] + 1) << n["level"]))
        assert cells[0] == (0 if r.lo is None else math.floor((r.lo - base) / 4.0))
        assert cells[-1] == (1 << top if r.hi is None else math.floor((r.hi - base) / 4.0) + 1)
        assert all(a == b for a, b in zip(cells[1:-1:2], cells[2:-1:2]))
    assert {tuple(r.c) for r in rows if r.lo is None and r.hi is None} == {((top, 0),)}
    nothing = spark.createDataFrame([], "id int, k int, lo double, hi double")
    assert ro.overlap_join(nothing, nothing.toDF("a", "b", "c", "d"), [], ("lo", "hi"), ("c", "d"), 1.0).count() == 0


def test_addresses_in_networks(spark):
    nets = ["2000::/3", "fd00::2a/128", "fc00::/8", "::ffff:10.0.0.0/104", "::1/128", "fe80::/10"]
    bounds = [(n, str(ipaddress.ip_network(n)[0]), str(ipaddress.ip_network(n)[-1])) for n in nets]
    rng = random.Random(1)
    ips = [None, "x", "10.1.2.3", "11.0.0.1", "::1", "::2", "fd00::29", "fd00::2a", "fd00::2b", "fe80::9", "ffff::"] + ["2001:db8::7"] * 300
    ips += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(300)]
    events = spark.createDataFrame(list(enumerate(ips)), "id int, ip string").repartition(5).withColumn("key", ro.ip6_key("ip"))
    ranges = spark.createDataFrame(bounds, "net string, a string, b string").select("net", ro.ip6_key("a").alias("lo"), ro.ip6_key("b").alias("hi"))
    got = {r.id: r.net for r in ro.ip_enrich(events, ranges, "key", ["net"]).collect()}

    def holder(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        a = ipaddress.IPv6Address(f"::ffff:{a}") if a.version == 4 else a
        return next((n for n in nets if a in ipaddress.ip_network(n)), None)

    assert got == {i: holder(x) for i, x in enumerate(ips)}
    assert ro.ip_enrich(events.limit(0), ranges, "key", ["net"]).count() == 0
    assert {r.net for r in ro.ip_enrich(events, ranges.limit(0), "key", ["net"]).collect()} == {None}


OPS = "key string, op string, value double, ts timestamp, timeout int, seq long"


def test_state_of_expired_entries_leaves(spark, tmp_path):
    """Three micro-batches: state rows fall after expiry, the table is the batch store's."""
    from datetime import datetime

    day = lambda n: datetime(2024, 1, n)
    batches = [
        [(f"short{i}", "set", float(i), day(1), 3600, i) for i in range(40)] + [("long", "set", 1.0, day(1), 86400 * 60, 90), ("ever", "set", 2.0, day(1), None, 91)],
        [("long", "touch", 0.0, day(5), 86400 * 40, 100), ("gone", "set", 3.0, day(5), 86400 * 50, 101), ("gone", "delete", 0.0, day(6), 0, 102), ("new", "set", 4.0, day(9), 86400 * 30, 103)],
        [("new", "set", 5.0, day(8), 9, 104), ("last", "set", 6.0, day(12), 86400 * 30, 105), ("long", "set", 9.0, day(1), 1, 1)],
    ]
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    states = []
    for rows in batches:
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(src)
        stream = jobs.file_stream(spark, src, spark.createDataFrame([], OPS))
        body = jobs.bucketed_upsert(spark, out, ["key"])
        q = jobs.ttl_updates(stream, "1 day").writeStream.foreachBatch(body).option("checkpointLocation", mark)
        q = q.outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
        states.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    assert states[0] == 42 and states[1] <= 4 and states[2] == 4  # long, ever, new, last
    now = ntz("2024-01-20 00:00:00")
    live = jobs.bucketed_table(spark, out).where("live").select("key", "value", F.col("expires").cast("timestamp_ntz").alias("expires"))
    ops = spark.createDataFrame([r for b in batches for r in b], OPS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = {tuple(r) for r in wr.ttl_state(ops, now).collect()}
    assert {tuple(r) for r in live.where(F.col("expires").isNull() | (F.col("expires") > now)).collect()} == want and len(want) == 4


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k long, ts long, v string"
    body = jobs.bucketed_upsert(spark, path, ["k"], [-F.col("ts")], 200)

    def files():
        return {(p, f) for p, _, names in os.walk(f"{path}/table") for f in names if f.endswith(".parquet")}

    first = [(k, 10, f"a{k}") for k in range(5000)]
    body(spark.createDataFrame(first, schema), 0)
    before = files()
    assert len(before) == 200
    ten = [(k, 20, f"b{k}") for k in range(0, 1000, 100)]
    body(spark.createDataFrame(ten, schema), 1)
    after = files()
    assert 0 < len(after - before) <= 10 and len(before & after) >= 190
    want = {k: f"b{k}" if k in range(0, 1000, 100) else f"a{k}" for k in range(5000)}
    table = lambda: {r.k: r.v for r in jobs.bucketed_table(spark, path).collect()}
    assert table() == want
    body(spark.createDataFrame(ten, schema), 1)  # replayed
    assert table() == want
    body(spark.createDataFrame([(0, 15, "late"), (1, 30, "c1"), (9999, 1, "new")], schema), 2)
    assert table() == want | {1: "c1", 9999: "new"}
    body(spark.createDataFrame([], schema), 3)
    assert table() == want | {1: "c1", 9999: "new"}
