"""The pipeline's stages, each against brute force on what it was given."""

import random
import re
import subprocess
import sys
from collections import Counter

import pytest

import corpus_pipeline
from relweave.llm import line_rules, mixing, passages
from relweave.llm.common import stored
from tests.conftest import ROOT, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def results(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(results):
    for df in results[1:-1]:
        assert df.columns == results[0].columns
        assert df.where("n_chars <> length(text)").count() == 0


def test_quality_stage(results):
    want = {}
    for doc, text in texts(results[0]).items():
        (n, _, _, _, repeat, _, lost), clean = line_rules.judge(text, line_rules.LineRules())
        if n >= 50 and 100 * repeat <= 50 * n and 100 * lost <= 30 * n:
            want[doc] = clean
    assert texts(results[1]) == want


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def alike_groups(given):
    """doc_id -> least doc_id reachable over pairs of five-word Jaccard 0.8 or more."""
    sets, root = {d: shingle_set(t) for d, t in given.items()}, {d: d for d in given}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_near_dedup_stage(results):
    given = texts(results[1])
    assert texts(results[2]) == {d: given[d] for d, r in alike_groups(given).items() if d == r}


def test_near_dedup_recall_and_hard_rows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    given = {}
    for i in range(200):
        words = [word() for _ in range(rng.randint(60, 300))]
        given[i] = " ".join(words)
        for _ in range(max(1, len(words) // 60)):  # a changed word costs five shingles
            words[rng.randrange(len(words))] = word()
        given[1000 + i] = " ".join(words).upper()
    odd = [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "One two"), (2005, "one three"), (None, "one two"), (None, "alone"), (None, "alone"), (2003, "one two")]
    rows = [(*r, 7) for r in [*given.items(), *odd]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int").repartition(5)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    roots = alike_groups(given)
    doomed = {d for d, r in roots.items() if d != r}
    found = {d for d in given if (d, given[d]) not in left}
    assert len(doomed) > 100 and found <= doomed and len(found) >= 0.97 * len(doomed)
    assert {k: n for k, n in left.items() if k[0] not in given} == {(2000, None): 1, (2003, "one two"): 1, (2005, "one three"): 1, (None, "alone"): 1}
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), SF).count() == 0


def test_substring_stage(results):
    given, left = texts(results[2]), texts(results[3])
    spans = {}
    for r in passages.removals(results[2]).collect():
        spans.setdefault(r.doc_id, []).append((r.first_word, r.end_word))
    for doc, text in given.items():
        words = WORD.findall(text)
        for a, b in sorted(spans.get(doc, []), reverse=True):
            del words[a:b]
        assert WORD.findall(left.get(doc, "")) == words
    seen = {}
    for doc in sorted(left):
        words = left[doc].split()
        for i in range(len(words) - 46):
            assert seen.setdefault(tuple(words[i : i + 47]), doc) == doc


def test_mix_stage(results):
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix_report(results[3]).collect()}
    copies = Counter(r.doc_id for r in results[4].select("doc_id").collect())
    assert all(copies[d] * size == words for d, (size, words) in taken.items())


def test_encode_stage_and_run(spark, results):
    got = Counter(map(tuple, results[5].collect()))
    assert sum(got.values()) == results[4].count()
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == got


def test_entry_without_the_subpackage():
    """The contract module imports and keeps its other queries if this subpackage is gone."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('relweave.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'filter' in e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
