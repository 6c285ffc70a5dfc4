"""Phrase graph, posting lists and VA-file against brute force on small fixtures with hard rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from relweave.llm import collocations, postings, vafile

DOCS = "doc_id long, text string, lang string, n long, kind int, phrase string, bucket long"
VECTORS = "vec_id long, embedding array<float>, label int, dim int, v int, row long, cluster int, q long"


# phrase collocations


def brute_phrases(rows, least, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        longer = [n for (other, q), n in f.items() if other == lang and len(q) == 3 and len(p) == 2 and n >= least and p in (q[:2], q[1:])]
        if any(100 * n >= 50 * a for n in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {
        (lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
        for lang, hits in found.items() for i, (s, a, p, left, right) in enumerate(sorted(hits)[:top])
    }


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(3)
    common = ["new", "york", "city", "the", "of", "é", " x", "a\x00b", "ÄB", "straße", "<s>"]
    long_run = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "en"), ("", "en"), (" \t ", None), ("one", "de"), (".,;:!?\n\r", "en"), ("New York City! new york city" * 6, None)]
    rows += [(" ".join(rng.choices(common, k=rng.randint(1, 40))) + rng.choice([".", ",", "\t", "\n", " "]), rng.choice(["en", "de", None, ""])) for _ in range(300)]
    rows += [(f"x{i} {long_run} y{i}", "en") for i in range(12)]  # a path with many ways in and out
    rows += [(long_run.upper() + ".", "de") for _ in range(11)]  # starts and ends with the piece
    rows += [("go go go go go go", "de")] * 5 + [("a b c d a b c d a b", "fr")] * 7
    return rows


def phrase_frame(spark, rows):
    return spark.createDataFrame([(i % 50, t, lang, 1, 2, "p", 3) for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)


@pytest.mark.parametrize("least, top, segment", [(10, 2000, 512), (3, 25, 4), (1, 10**6, 2)])
def test_collocations(spark, phrase_rows, monkeypatch, least, top, segment):
    monkeypatch.setattr(collocations, "SEGMENT", segment)
    monkeypatch.setattr(collocations, "RUN_CHARS", 700)  # many runs, many parcels
    rows = phrase_rows if least > 1 else phrase_rows[:40]
    out = collocations.collocations(phrase_frame(spark, rows), least, top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, least, top)


def test_paths_are_compacted(spark, phrase_rows):
    counts = collocations.flows(phrase_frame(spark, phrase_rows), 10)
    nodes = counts.where("kind = 2").select("lang", F.col("phrase").alias("node"), F.col("n").alias("f"))
    head = F.concat_ws(" ", F.substring_index("phrase", " ", -1), "next")
    edges = counts.where("kind = 3").select("lang", F.col("phrase").alias("u"), head.alias("v"), F.col("next").alias("z"), "n").cache()
    paths = collocations.compacted(edges, nodes).collect()
    seen = Counter((p.lang, " ".join(p.words[i : i + 3])) for p in paths for i in range(len(p.words) - 2))
    assert seen == Counter((e.lang, f"{e.u} {e.z}") for e in edges.collect())
    run = [p for p in paths if "w30" in p.words]
    assert sorted((p.lang, len(p.words), p.weight, p.first_flow, p.last_flow) for p in run) == [("de", 60, 11, 11, 11), ("en", 60, 12, 12, 12)]


def test_split_nodes_add_up(spark, monkeypatch):
    """A node that holds most edges is dealt over many buckets and still counts once."""
    rows = [(" ".join(f"of the n{(7 * i + j) % 90}" for j in range(40)), "en") for i in range(60)]
    frame = phrase_frame(spark, rows)
    hot = collocations.hot_words(frame, 60)
    assert b"of" in hot and b"the" in hot
    sent = collocations.parcels(frame, 512, hot)
    assert sent.select("bucket").distinct().count() > 200
    assert {tuple(r) for r in collocations.collocations(frame).collect()} == brute_phrases(rows, 10, 2000)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(phrase_frame(spark, [(None, None), (" ", "en")])).count() == 0


def test_scores_past_64_bits(spark):
    a, left, right = 3_037_000_500_123, 4_000_000_000_007, 3_100_000_000_019
    row = spark.createDataFrame([(a, left, right), (10, 10, 10), (9, 3, 10**17)], "a long, l long, r long")
    got = [r[0] for r in row.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * a * a // (left * right), 10**6, 0]


# vectors


def odd_vectors(rng, n, dim):
    """Clusters, exact copies, near copies and rows that take no part."""
    hubs = rng.normal(size=(12, dim))
    x = (hubs[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, dim))).astype(np.float32)
    x[: n // 3] = x[0]  # a third of all rows is one vector
    x[n // 3 : n // 3 + 40] = x[n // 3] + 1e-6 * rng.normal(size=(40, dim)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [0.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 1.0]]
    rows += [(10_000 + 100 * i, v) for i, v in enumerate(bad)] + [(None, rows[5][1]), rows[100], rows[100], (100, rows[101][1])]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4, 5) for i, v in rows], VECTORS).repartition(4)


def brute_nearest(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out.setdefault(q, []).append(near)
    return out


@pytest.fixture(scope="module")
def vectors():
    return odd_vectors(np.random.default_rng(11), 3000, 24)


def test_posting_lists(spark, vectors):
    rows = postings.usable(frame_of(spark, vectors))
    got = {}
    for r in postings.nearest(rows, rows.where("vec_id % 100 = 0"), k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_nearest(vectors, 10)
    assert set(got) == {q for q, lists in want.items() if any(lists)}
    true = dict((i, np.array(v)) for i, v in vectors if i is not None and i != 100 and v and None not in v)
    hits = total = 0
    for q, lists in want.items():
        if len(lists) > 1 or not lists[0]:
            continue
        near = sorted(got[q])
        assert [n for n, _, _ in near] == list(range(1, len(near) + 1)) and q not in [i for _, i, _ in near]
        assert [(s, i) for _, i, s in near] == sorted((s, i) for _, i, s in near)
        for _, i, s in near:
            if q in true and i in true:
                assert s == pytest.approx(float(np.sqrt(((true[q] - true[i]) ** 2).sum())), rel=1e-12, abs=1e-12)
        wanted = Counter(round(s, 9) for s, _ in lists[0])
        hits += sum((wanted & Counter(round(s, 9) for _, _, s in near)).values())
        total += len(lists[0])
    assert hits / total >= 0.95
    # a vector that a third of all rows share: the ids are the smallest ones
    assert [i for _, i, _ in sorted(got[200])] == list(range(10))
    assert [i for _, i, _ in sorted(got[0])] == list(range(1, 11))


def test_recall_on_the_embeddings(spark, data):
    """Recall against brute force over the whole table; without clear clusters, the hard case."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = postings.usable(table)
    found = postings.nearest(rows, rows.where("vec_id % 100 = 0"), k=10).toPandas()
    pdf = table.toPandas()
    x = np.array(pdf["embedding"].tolist(), np.float64)
    ids = pdf["vec_id"].to_numpy()
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q][0]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hits += len(set(found["vec_id"][found["query_id"] == q]) & set(ids[np.lexsort((ids, d))[:10]]))
    assert hits / (10 * (ids % 100 == 0).sum()) >= 0.9


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(size=(300, 8)), rng.normal(size=(200, 8)) + 30])  # two far islands
    index = postings.Centroids(points)
    x = np.vstack([rng.normal(size=(60, 8)), rng.normal(size=(60, 8)) + 30, points[:20]])
    ids, d = index.search(x, 0.3, 3)
    hits = total = 0
    for row, v in enumerate(x):
        true = ((points - v) ** 2).sum(axis=1)
        want = set(np.flatnonzero(true <= true.min() * 1.3**2)) | set(np.argsort(true)[:3])
        got = ids[row][np.isfinite(d[row])]
        assert len(set(got)) == len(got)
        hits, total = hits + len(want & set(got)), total + len(want)
    assert hits / total > 0.95


def test_lists_are_balanced_and_boundaries_replicated():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(4096, 16))
    sample[:1500] = sample[0] + 1e-7 * rng.normal(size=(1500, 16))  # near copies don't make one long list
    parts = postings.halved(sample, 64, rng)
    assert {len(p) for p in parts} == {64} and sorted(np.concatenate(parts).tolist()) == list(range(4096))


def test_posting_lists_of_nothing(spark):
    rows = postings.usable(spark.createDataFrame([], VECTORS))
    assert postings.nearest(rows, rows).count() == 0
    lone = postings.usable(frame_of(spark, [(0, [1.0, 0.0]), (100, [1.0]), (None, [1.0, 1.0])]))
    assert postings.nearest(lone, lone).count() == 0


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, np.array([math.floor(256 * float(np.float32(c))) for c in v], object)) for i, v in rows if v and len(v) == dim and None not in v and all(map(math.isfinite, v))]
    order = sorted((n for n in range(len(kept)) if kept[n][0] is not None), key=lambda n: (hashlib.sha256(f"2:{kept[n][0]}".encode()).hexdigest(), list(kept[n][1])))
    centroids = [kept[n][1] for n in order[:k]]
    for at in range(rounds + 1):
        own = [min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids)) for _, v in kept]
        if at < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, m) in zip(kept, own) if m == j]
                if mine:
                    centroids[j] = np.array([sum(col) // len(mine) for col in zip(*mine)], object)
    inertia, names = Counter(), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    for d, j in own:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), names[j]) for (i, _), (d, j) in zip(kept, own))


@pytest.mark.parametrize("bits", [2, 6, 8])
def test_clusters(spark, vectors, bits):
    rows = vectors[900:1700] + vectors[2995:] + [(77, [4000.0] * 24), (78, [-1e-9] * 24)]
    got = vafile.clustered(frame_of(spark, rows), k=9, rounds=4, components=24, bits=bits)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute_clusters(rows, 9, 4, 24)


def test_few_or_no_vectors(spark):
    assert vafile.clustered(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0]), (4, [1e9, 0.0]), (5, [1.0])]
    got = vafile.clustered(frame_of(spark, rows), k=40, components=2)
    assert Counter(tuple(r) for r in got.collect()) == brute_clusters(rows[:3], 40, 5, 2)


def test_cells_settle_most_vectors(spark):
    """The intervals do their work even on vectors without clear clusters."""
    table = vafile.scaled(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 64, 256).cache()
    edges = vafile.cell_edges(table, 64, vafile.CELL_BITS)
    x = np.array([r.v for r in table.orderBy("row").select("v").collect()])
    state = vafile.approximated(table, edges, vafile.CELL_BITS).withColumn("cluster", F.lit(-1))
    told = vafile.judged(state, x[:40], edges, vafile.CELL_BITS).orderBy("row").select("now").collect()
    true = ((x[:, None, :] - x[None, :40, :]) ** 2).sum(axis=2).argmin(axis=1)
    settled = [(r.now, t) for r, t in zip(told, true.tolist()) if r.now is not None]
    assert all(a == b for a, b in settled) and len(settled) > 0.4 * len(x)
