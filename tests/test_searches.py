"""Nearest points, lines that hold a text and word similarity, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from relweave.functions import geometry as g
from relweave.operators import corpus as co
from relweave.operators import search as se
from relweave.operators import spatial as sp


def near(spark, asked, targets, k, **sizes):
    def side(rows, name):
        df = spark.createDataFrame(rows, f"{name} long, x double, y double").repartition(3)
        return df.select(name, F.when(F.col("x").isNotNull(), g.point(F.col("x"), F.col("y"))).alias("x"))

    return sp.nearest(side(asked, "q"), side(targets, "t"), "q", "t", "x", "x", k, **sizes)


def brute(asked, targets, k):
    good = lambda r: r[1] is not None and r[2] is not None and math.isfinite(r[1]) and math.isfinite(r[2])
    out = set()
    for i, x, y in filter(good, asked):
        best = sorted((math.sqrt((a - x) ** 2 + (b - y) ** 2), t) for t, a, b in targets if good((t, a, b)))[:k]
        out |= {(i, t, n + 1) for n, (_, t) in enumerate(best)}
    return out


@pytest.mark.parametrize("leaf, depth", [(4, 24), (64, 24), (1, 2)])
def test_nearest_on_clusters_outliers_and_copies(spark, leaf, depth):
    rng = random.Random(leaf)
    targets = [(i, 5 + rng.gauss(0, 1e-3), 5 + rng.gauss(0, 1e-3)) for i in range(300)]
    targets += [(1000 + i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(60)]
    targets += [(2000 + i, 3.0, 3.0) for i in range(200)]  # a third on one point
    targets += [(3000, 1e6, -1e6), (3001, None, 1.0), (3002, math.nan, 1.0), (3003, math.inf, 1.0)]
    asked = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(25)] + [(50, 5.0, 5.0), (51, 3.0, 3.0), (52, -1e7, 0.0), (53, None, None)]
    got = {(r.q, r.t, r.position) for r in near(spark, asked, targets, 5, leaf=leaf, depth=depth).collect()}
    assert got == brute(asked, targets, 5)


def test_nearest_of_few_or_no_targets(spark):
    asked = [(1, 0.0, 0.0), (2, 9.0, 9.0)]
    few = [(7, 1.0, 1.0), (8, 1.0, 1.0)]
    assert {(r.q, r.t, r.position) for r in near(spark, asked, few, 5).collect()} == brute(asked, few, 5)
    none = near(spark, asked, [(1, None, None)], 5)
    assert none.columns == ["q", "t", "distance", "position"] and none.count() == 0


def test_lines_with(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abC ") for _ in range(n))
    rows = [(f"f{i % 40}", i, text(rng.randint(0, 30))) for i in range(600)] + [("a", 1, "Common line of every file"), ("b", 1, None), ("c", 2, "")]
    rows += [(f"g{i}", 5, "common LINE of every file") for i in range(300)]
    needles = ["common line", "a", "zz", "ab", "cab", "", None, "line of every f", "absent text here", "bca a"] * 2
    needles += [rows[i][2][2:14].lower() for i in range(0, 600, 7)]
    lines = spark.createDataFrame(rows, "path string, line_number int, line string").repartition(4)
    found = co.lines_with(spark.createDataFrame([(n,) for n in needles], "needle string"), lines, F.struct("path", "line_number"))
    got = {(r.needle, r.low, tuple(r["at"])) for r in found.collect()}
    want = {}
    for path, n, line in rows:
        for needle in {x for x in needles if x}:
            if line and needle in line.lower():
                key = (needle, line.lower())
                want[key] = min(want.get(key, (path, n)), (path, n))
    assert found.count() == len(got) and got == {(*k, v) for k, v in want.items()}
    assert co.lines_with(spark.createDataFrame([(None,)], "needle string"), lines, F.struct("path", "line_number")).count() == 0


def grams(word):
    p = f"  {word} "
    return [p[i:i + 3] for i in range(len(word) + 1)]


def best_extent(needle, units):
    t = {x for w in needle.split() for x in grams(w)}
    best = 0.0
    for i in range(len(units)):
        seen = set()
        for unit in units[i:]:
            seen |= set(unit)
            best = max(best, len(t & seen) / len(t | seen))
    return best


def test_word_similarity_is_the_best_extent(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 3))), " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, n string, t string").repartition(4)
    got = df.select("id", se.word_similarity(F.col("n"), F.col("t")), se.strict_word_similarity(F.col("n"), F.col("t"))).collect()
    for (i, n, t), r in zip(rows, sorted(got)):
        loose = best_extent(n, [[x] for w in t.split() for x in grams(w)])
        strict = best_extent(n, [grams(w) for w in t.split()])
        assert (r[1], r[2]) == (pytest.approx(loose), pytest.approx(strict)), (n, t)


def test_word_similarity_of_long_texts(spark):
    rng = random.Random(6)
    long = " ".join(["plum"] + ["pla"] * 9000 + ["".join(rng.choice("aelptx") for _ in range(6)) for _ in range(11000)] + ["hot", "plates"])
    df = spark.createDataFrame([("hot plates", long), ("hot plates", None), (None, long), ("", "x")], "n string, t string")
    got = {(r.n, r.t is None): (r.w, r.s) for r in df.select("n", "t", se.word_similarity(F.col("n"), F.col("t")).alias("w"), se.strict_word_similarity(F.col("n"), F.col("t")).alias("s")).collect()}
    assert got == {("hot plates", False): (1.0, 1.0), ("hot plates", True): (0.0, 0.0), (None, False): (0.0, 0.0), ("", False): (0.0, 0.0)}
