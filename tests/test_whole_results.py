"""Whole results, and rows that grow no faster than the tables."""

import random
import time
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relweave.operators import ranges as rg
from relweave.operators import resolve as rs
from relweave.operators import similarity as sm
from relweave.runtime import cut_lineage


def test_import_resolution_names_every_function(spark):
    """Seven functions of files that import lib.util hold the call's name."""
    names = [f"util_{i}" for i in range(7)]
    functions = spark.createDataFrame([(n, f"{n}.py", ["util"], ["lib.util"]) for n in names], "name string, file_path string, calls array<string>, imports array<string>")
    calls = functions.select(F.col("name").alias("source"), F.col("file_path").alias("source_file"), F.explode("calls").alias("call"))
    imports = functions.select("file_path", F.explode("imports").alias("import"))
    got = rs._import_matches(calls, functions, imports).collect()
    assert sorted((r.source, r.target) for r in got) == [(a, b) for a in names for b in names]
    few = rs._import_matches(calls, functions, imports, rs.BEST).collect()
    assert sorted((r.source, r.target) for r in few) == [(a, b) for a in names for b in names[:5]]


def odd_spans(spark, rows=300):
    """Ranges of very different lengths, some open, empty or turned round."""
    pick = random.Random(3)
    out = []
    for i in range(rows):
        lo = pick.choice([None, *[pick.uniform(0, 1000)] * 9])
        hi = None if pick.random() < 0.1 else (lo or 0.0) + pick.choice([-5.0, 0.0, 0.3, 2.0, 40.0, 700.0]) * pick.random()
        out.append((i, i % 4, lo, hi))
    return spark.createDataFrame(out, "a int, room int, lo double, hi double")


def test_ranges_and_points_are_listed_few_times(spark, monkeypatch):
    spans, sizes = odd_spans(spark), []
    listed = rg._listed

    def counted(*args):
        sides = listed(*args)
        sizes.append([s.count() for s in sides])
        return sides

    monkeypatch.setattr(rg, "_listed", counted)
    points = spark.range(400).select(F.col("id").alias("p"), (F.col("id") % 4).alias("of"), (F.col("id") * 2.5 + 0.1).alias("at"))
    rows, at = spans.collect(), points.collect()
    hold = lambda r, v: (r.lo is None or r.lo <= v) and (r.hi is None or v < r.hi)
    for cost in (40, 0):  # few levels, all levels
        monkeypatch.setattr(rg, "ROW_PAIRS", cost)
        got = rg.point_in_range_join(points, spans, "at", "lo", "hi", 0.5, [("of", "room")], "[)").collect()
        assert sorted((r.p, r.a) for r in got) == sorted((p.p, r.a) for p in at for r in rows if p.of == r.room and hold(r, p.at))
        full = [r for r in rows if r.lo is None or r.hi is None or r.lo < r.hi]
        meet = lambda x, y: (x.lo is None or y.hi is None or x.lo < y.hi) and (y.lo is None or x.hi is None or y.lo < x.hi)
        got = rg.overlap_join(spans, spans.toDF("b", "room2", "lo2", "hi2"), [("room", "room2")], ("lo", "hi"), ("lo2", "hi2"), 0.5).collect()
        assert sorted((r.a, r.b) for r in got) == sorted((x.a, y.a) for x in full for y in full if x.room == y.room and meet(x, y))
    assert sizes[0][0] <= 3 * 400 and sizes[0][1] <= 2 * 300  # before: eleven rows a point


def test_levels_follow_the_cheaper_sum():
    assert rg.chosen_levels({}, 10, {}, 1) == []
    assert rg.chosen_levels({0: 10, 9: 5}, 10, {0: 10, 9: 1}, 1) == [9]
    spots = {0: 1 << 17, 4: 1 << 13, 17: 1}
    assert rg.chosen_levels({0: 10**6, 4: 10**5, 17: 10**4}, 10**6, spots, 1) == [0, 4, 17]


@pytest.mark.parametrize("width", [1.0, 1e-9])
def test_ranges_without_rows(spark, width):
    spans = odd_spans(spark, 8)
    points = spark.createDataFrame([(1, 0, None)], "p int, of int, at double")
    assert rg.point_in_range_join(points, spans, "at", "lo", "hi", width).count() == 0
    assert rg.point_in_range_join(spark.createDataFrame([(1, 0, 5.0)], points.schema), spans.where("false"), "at", "lo", "hi", width).count() == 0


def close_names(ratio=0.8):
    """Names of 11 to 18 characters and others made of them by leaving out or adding some."""
    pick = random.Random(7)
    made = lambda k: "".join(pick.choice("abcd") for _ in range(k))
    left = [made(pick.choice([11, 12, 13])) for _ in range(120)]
    right = [made(pick.choice([13, 16, 18])) for _ in range(60)]
    for n in left:
        chars = list(n)
        for _ in range(pick.randrange(3)):
            del chars[pick.randrange(len(chars))]
        for _ in range(pick.randrange(6)):
            chars.insert(pick.randrange(len(chars) + 1), pick.choice("abcdx"))
        right.append("".join(chars))
    want = set()
    for a in set(left):
        for b in set(right):
            m = SequenceMatcher(None, a, b)
            if m.ratio() >= ratio:
                want.add((a, b))
    return left, right, want


@pytest.mark.parametrize("goes", [1, 5])
def test_names_that_meet_by_halves_in_several_goes(spark, monkeypatch, goes):
    left, right, want = close_names()
    lengths = [{k: sum(len(n) == k for n in set(ns)) for k in {len(n) for n in ns}} for ns in (left, right)]
    never = lambda k: 1e-9  # noqa: E731  so unlikely that halves are always taken
    monkeypatch.setattr(sm, "FEW_KEYS", 0)
    monkeypatch.setattr(sm, "VARIANTS", 0)
    monkeypatch.setattr(sm, "_alike", lambda *args: (never, never))
    keep, done, _ = sm._classes(*lengths, 0.8, (never, never))
    plain = sm._classes({**lengths[0]}, {k: 1000 * n for k, n in lengths[1].items()}, 0.8)[0]
    ways = lambda k: sum(lengths[i][n] * sm._ways(s, n) for i in (0, 1) for n, specs in k[i].items() for s in specs)
    assert any(isinstance(s, tuple) for specs in keep[1].values() for s in specs) and ways(keep) < ways(plain) / 3
    monkeypatch.setattr(sm, "ROUND_KEYS", -(-ways(keep) // goes))
    frame = lambda ns: spark.createDataFrame([(n,) for n in ns], "name string")
    got = sm.ratio_join(frame(left), frame(right), 0.8).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 100


def test_what_a_checkpoint_shuffled_is_deleted(spark):
    import glob
    import os

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in root for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    kept = cut_lineage(spark.range(50_000).repartition(4).groupBy((F.col("id") % 977).alias("k")).agg(F.count("*").alias("n")))
    assert kept.count() == 977 and kept.agg(F.sum("n")).first()[0] == 50_000
    until = time.time() + 20
    while time.time() < until and any(os.path.getsize(f) > 5_000 for f in files() - before):
        time.sleep(0.2)
    assert not any(os.path.getsize(f) > 5_000 for f in files() - before)


def test_few_pairs_are_compared_block_by_block(monkeypatch):
    """Names of random digits share few characters, which a bit table tells at once."""
    pick = random.Random(2)
    names = ["".join(pick.choice("abcdef0123456789é") for _ in range(pick.randint(0, 16))) for _ in range(60)] + ["x" * 70, "x" * 64 + "y", "A\x00b", "a\x00"]
    a, b = zip(*((x, y) for x in names for y in names))

    def longest(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if c == d else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    got = sm.common_characters(list(a), list(b))
    assert [int(v) for v in got] == [longest(x, y) if max(len(x), len(y)) <= 63 else min(len(x), len(y)) for x, y in zip(a, b)]
    calls = []
    ratio = SequenceMatcher.ratio
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda m: calls.append(1) or ratio(m))
    least = pd.Series([0.6] * len(a))
    found = sm.match_ratio_from.func(pd.Series(a), pd.Series(b), least)
    few = len(calls)
    for x, y, r in zip(a, b, found):
        m = SequenceMatcher(None, "", "")
        m.set_seq2(y.lower())
        m.set_seq1(x.lower())
        want = ratio(m)
        assert r == want if want >= 0.6 else pd.isna(r) or r == want
    assert few < len(a) / 4


def test_rows_for_many_lists_come_in_small_batches():
    """A query that reads every list is copied thousands of times."""
    from relweave.llm import postings

    v = pa.array(np.arange(300 * 64, dtype=float).reshape(300, 64).tolist())
    part = pa.RecordBatch.from_arrays([pa.array(range(300)), v], names=["q", "v"])
    rows, lists = np.repeat(np.arange(300), 200), np.tile(np.arange(200, dtype=np.int32), 300)
    out = list(postings.copied(part, rows, lists, ["q", "v"]))
    assert max(b.nbytes for b in out) < 2 * postings.BATCH_BYTES < 30_000_000 < sum(b.nbytes for b in out)
    assert np.concatenate([b.column("q") for b in out]).tolist() == rows.tolist()
    assert np.concatenate([b.column("list") for b in out]).tolist() == lists.tolist()


def test_common_starts_and_ends_are_not_taken_for_rare(spark):
    """A third of the names end alike; by their single characters a thousandth would."""
    frame = lambda ns: spark.createDataFrame([(n,) for n in ns], "n string")
    pick = random.Random(4)
    ends = [".init_", "packed", "uvwxyz"]
    names = ["".join(pick.choice("0123456789") for _ in range(10)) + ends[i % 3] for i in range(60)]
    start, end = sm._alike([frame(names), frame(names)], [{16: 60}, {16: 60}], 0.8)
    assert abs(end(6) - 1 / 3) < 1e-9 and 0.0 < start(6) < 0.05
