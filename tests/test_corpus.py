"""Corpus operators on a small hand-written corpus and against brute force."""

import itertools
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from relweave.runtime import cut_lineage
from relweave.operators import corpus as co
from relweave.operators import graph as gr
from relweave.operators import resolve as rs
from relweave.operators import similarity as sm
from relweave.sources import files as fl

FILES = {
    "app/main.py": (
        "import os\nfrom lib.tools import load\n\ndef main(argv, *rest, **opts):\n    '''Entry.'''\n    data = load(argv)\n"
        "    s = Store(data)\n    s.save(data)\n    if data and argv or rest:\n        os.path.join('a')\n    def nested(x):\n        return helper(x)\n    return nested(data)\n"
    ),
    "app/store.py": (
        "class Store:\n    def __init__(self, rows: list):\n        self.rows = rows\n    def save(self, rows) -> bool:\n        self.flush()\n        return True\n"
        "    async def flush(self):\n        for r in self.rows:\n            try:\n                yield r\n            except ValueError:\n                pass\n"
    ),
    "lib/tools.py": "import os\n\ndef load(path):\n    return parse(path)\n\ndef parse(path):\n    return load(path)\n",
    "lib/more.py": "def load(path, mode=1):\n    return os.open(path)\n\ndef lode(path):\n    return 1\n",
    "bad.py": "def broken(:\n",
    "notes.txt": "def not_code(\n",
    "empty.py": "",
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, len(t), t) for p, t in FILES.items()]
    return spark.createDataFrame(rows, "path string, length bigint, content string")


@pytest.fixture(scope="module")
def functions(files):
    return co.last_definitions(co.parse_functions(files)).cache()


def test_parse(files):
    rows = {(r.file_path, r.name): r for r in co.parse_functions(files).collect()}
    main = rows["app/main.py", "main"]
    assert main.signature == "main(argv, *rest, **opts)" and main.docstring == "Entry." and main.line_number == 4
    assert set(main.calls) == {"load", "Store", "s.save", "save", "join", "nested", "helper"}
    assert main.imports == ["lib.tools.load", "os"]
    assert main.complexity_score == 1 + 1 + 1 + 1  # if, or, and
    assert ("app/main.py", "nested") in rows
    save = rows["app/store.py", "Store.save"]
    assert save.return_type == "bool" and {"self.flush", "flush", "Store.flush"} <= set(save.calls)
    assert rows["app/store.py", "Store.__init__"].parameter_types == {"rows": "list"}
    assert rows["app/store.py", "Store.flush"].complexity_score == 3
    assert not any(p in ("bad.py", "notes.txt") for p, _ in rows)


def test_last_definition_wins(functions):
    assert functions.where("name = 'load'").first().file_path == "lib/tools.py"


def test_variable_types(spark):
    src = "a = C()\nb = a\nb = D()\nx = y\ndef f(p: int, q: list[int]):\n    r = p\n"
    df = spark.createDataFrame([("m.py", len(src), src)], "path string, length bigint, content string")
    got = {r.variable: r.types for r in co.variable_types(df).collect()}
    assert got == {"a": ["C"], "b": ["C", "D"], "p": ["int"], "r": ["int"]}


def test_resolve_basic(spark, functions):
    calls = spark.createDataFrame([("load",), ("Store",), ("s.save",), ("os.path",), ("gone",)], "call string")
    got = {r.call: r.target for r in rs.resolve_basic(calls, functions).collect()}
    assert got == {"load": "load", "Store": "Store.__init__", "s.save": "Store.save", "os.path": None, "gone": None}


def naive_scored(functions):
    """Plain reading of the scoring rules, one call at a time."""
    rows = sorted(functions.collect(), key=lambda r: (r.file_path, r.line_number))
    by_name = {r.name: r for r in rows}
    imports = {}
    for r in rows:
        imports.setdefault(r.file_path, set()).update(r.imports)
    ratio = lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio()

    def context(target, src):
        t = by_name[target]
        s = 0.4 * (t.file_path == src.file_path) + 0.2 * (t.file_path.split("/")[0] == src.file_path.split("/")[0])
        s += 0.3 * (t.file_path in imports[src.file_path]) + 0.1 * ratio(target, src.name)
        return min(s, 0.95)

    out = set()
    for src in rows:
        for dep in src.calls:
            if dep in by_name:
                out.add((src.name, dep, dep, 1.0, "direct"))
                continue
            found = []
            if f"{dep}.__init__" in by_name:
                found.append((0.95, 1, f"{dep}.__init__", "constructor"))
            if "." in dep:
                m = dep.split(".", 1)[1]
                found += [(context(n, src), 2, n, "method") for n in by_name if "." in n and n.split(".", 1)[1] == m]
            if not found or max(f[0] for f in found) < 0.7:
                found += [(ratio(dep, n) * 0.7 + context(n, src) * 0.3, 3, n, "fuzzy") for n in by_name if ratio(dep, n) >= 0.8]
            for imp in imports[src.file_path]:
                if dep in imp:
                    for p, held in imports.items():
                        if imp in held:
                            found += [(0.8, 4, r.name, "import") for r in rows if r.file_path == p and dep in r.name]
            found = sorted(set(found), key=lambda f: (-round(f[0], 9), f[1], f[2]))[:5]
            out |= {(src.name, dep, n, round(c, 6), k) for c, _, n, k in found}
    return out


@pytest.mark.parametrize("chunk", [2, 1000])
def test_resolve_scored(functions, chunk):
    got = {(r.source, r.call, r.target, round(r.confidence, 6), r.match_type) for r in rs.resolve_scored(functions, chunk).collect()}
    assert got == naive_scored(functions)


def test_match_details_and_counts(spark, data):
    from relweave.plans import corpus as pc

    ratio = lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio()
    rows = cut_lineage(rs.resolve_scored(pc.functions(data)))
    found = rows.withColumn("why", rs.reasoning()).collect()
    assert all(r.why for r in found)
    for r in found:
        if r.match_type == "fuzzy":
            assert r.why == f"Fuzzy match: {r.call} ~= {r.target} (sim: {ratio(r.call, r.target):.2f})"
        if r.match_type == "import":
            assert r.call in r.detail and r.why.endswith(f" via {r.detail}")
        if r.match_type in ("direct", "constructor", "method"):
            assert r.detail is None
    kinds = {r.match_type for r in found}
    got = {r.match_type: (r.matches, r.calls) for r in rs.match_counts(rows).collect()}
    assert {"fuzzy", "import"} <= kinds
    assert got == {k: (sum(r.match_type == k for r in found), len({(r.source, r.call) for r in found if r.match_type == k})) for k in kinds}


def test_resolve_scored_generated(spark, data):
    from relweave.plans import corpus as pc

    f = pc.functions(data)
    got = {(r.source, r.call, r.target, round(r.confidence, 6), r.match_type) for r in rs.resolve_scored(f, 7).collect()}
    assert got == naive_scored(f)


NAMES = ["a", "ab", "axb", "abc", "abcd", "load", "lode", "Load", "loader", "loaded_rows", "load_rows", "Store.save", "Store.saved", "Shop.save", "x.y", "xy", "aaaa", "aaab", "bbbb"]


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_ratio_join_misses_nothing(spark, threshold):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {(r.a, r.b) for r in sm.ratio_join(df, df, threshold).collect()}
    want = {(a, b) for a, b in itertools.product(NAMES, NAMES) if SequenceMatcher(None, a.lower(), b.lower()).ratio() >= threshold}
    assert got == want


def test_similar_functions(spark):
    sigs = ["f(a, b)", "f(self)", "f(a)", "f(b, c)", "f()"]
    rows = []
    for i, n in enumerate(NAMES):
        rows.append((n, ["p/x.py", "p/y.py", "q/z.py", "r.py"][i % 4], i + 1, sigs[i % 5]))
        rows.append((n + "_2", ["p/x.py", "q/z.py"][i % 2], 100 + i, sigs[i % 3]))
    df = spark.createDataFrame(rows, "name string, file_path string, line_number int, signature string")
    got = {(r.function, r.similar): round(r.similarity, 9) for r in sm.similar_functions(df).collect()}
    params = lambda s: {p.strip() for p in s[s.index("(") + 1 : -1].split(",") if p.strip() and p.strip() != "self"}
    want = {}
    for x, y in itertools.combinations(sorted(rows, key=lambda r: (r[1], r[2], r[0])), 2):
        a, b = params(x[3]), params(y[3])
        jac = 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / len(a | b)
        place = 1.0 if x[1] == y[1] else 0.5 if x[1].split("/")[0] == y[1].split("/")[0] else 0.0
        score = SequenceMatcher(None, x[0].lower(), y[0].lower()).ratio() * 0.5 + jac * 0.3 + place * 0.2
        if score > 0.7:
            want[x[0], y[0]] = round(score, 9)
    assert got == want


def test_closure_and_order(spark, functions):
    starts = spark.createDataFrame([("main",), ("load",), ("nobody",)], "start string")
    reach = gr.dependency_closure(starts, functions)
    got = {}
    for r in reach.collect():
        got.setdefault(r.start, set()).add(r.name)
    assert got["load"] == {"load", "parse"} and "nobody" not in got
    assert {"main", "load", "parse", "Store.__init__", "Store.save", "Store.flush", "nested"} <= got["main"]
    levels = gr.topo_order(reach, functions)
    assert {(r.start, r.name) for r in gr.cycle_members(levels).collect()} >= {("load", "load"), ("load", "parse"), ("main", "main")}
    order = {(r.start, r.name): r.level for r in gr.ordered(levels).collect()}
    assert order["main", "Store.save"] > order["main", "Store.flush"]
    report = gr.dependency_report(gr.ordered(levels), functions)
    assert "signature" in report.columns and report.count() == len(order)


def test_scored_order_appends_cycles(spark, functions):
    matches = rs.resolve_scored(functions)
    starts = spark.createDataFrame([("main",)], "start string")
    members = gr.scored_closure(starts, matches, comprehensive=False, excluded=())
    rows = gr.topo_order_scored(members, matches).collect()
    cyc = {r.name for r in rows if r.in_cycle}
    assert {"load", "parse"} <= cyc
    top = max(r.level for r in rows)
    assert all(r.level == top for r in rows if r.in_cycle)


def test_closure_depth(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i+1}") for i in range(9)], "source string, target string")
    starts = spark.createDataFrame([("n0",)], "start string")
    assert gr.reach(starts, edges, 3).count() == 4
    assert gr.reach(starts, edges).count() == 10


def test_snippets(spark, files):
    rows = [(1, "def load(path):\n    pass"), (2, "async def  flush (self"), (3, "class Store(:"), (4, "S.ROWS = rows"), (5, "nothing at all here"), (6, "  self.rows = ROWS")]
    df = spark.createDataFrame(rows, "snippet_id bigint, text string")
    names = {r.snippet_id: r.function_name for r in co.snippet_names(df).collect()}
    assert names == {1: "load", 2: "flush", 3: "Store", 4: None, 5: None, 6: None}
    got = {r.snippet_id: (r.function_name, r.file_path, r.line_number, r.search_method) for r in co.locate_definitions(df, files).collect()}
    assert got == {
        1: ("load", "lib/more.py", 1, "function_definition"), 2: ("flush", "app/store.py", 7, "function_definition"),
        3: ("Store", "app/store.py", 1, "function_definition"), 6: ("unknown", "app/store.py", 3, "content_match"),
    } | ({4: ("unknown", "app/store.py", 3, "content_match")} if "s.rows = rows" in FILES["app/store.py"].lower() else {})


def test_search(files):
    hits = fl.content_search(files, "def load(", ["*.py"]).collect()
    assert [(h.file_path, h.line_number) for h in hits] == [("lib/more.py", 1), ("lib/tools.py", 3)]
    assert fl.content_search(files, "DEF", max_results=3).count() == 3
    assert fl.files_searched(files).first()[0] == 7
    assert [r.path for r in fl.file_search(files, "*STORE*").collect()] == ["app/store.py"]
    assert fl.matching_patterns(files, ["*.py", "m*"]).count() == 6 + 2


def test_line_breaks(spark):
    df = spark.createDataFrame([("a.txt", 1, "x\r\ny\n\nz w\n"), ("b.txt", 0, "")], "path string, length bigint, content string")
    assert [r.line for r in fl.lines_of(df).orderBy("path", "line_number").collect()] == "x\r\ny\n\nz w\n".splitlines()


def test_archives_from_disk(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.whl", "w") as z:
        for p, t in FILES.items():
            z.writestr(p, t)
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    (tmp_path / "c.tar").write_bytes(b"x")
    raw = spark.read.format("binaryFile").load(str(tmp_path))
    out = fl.archive_scan(raw).collect()
    assert {r.path for r in out if r.error is None} == set(FILES)
    assert len([r for r in out if r.error]) == 1
    members = fl.archive_scan(raw).where("error is null").select("path", "length", "content")
    assert co.parse_functions(members).count() == 9


def test_tree_and_limits(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_bytes(b"x = 1")
    (tmp_path / "pkg" / "b.pyc").write_bytes(b"x")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    tree = fl.read_tree(spark, str(tmp_path))
    assert [r.path for r in fl.source_tree_scan(tree).select("path").collect()] == ["bad.py", "pkg/a.py"]
    assert fl.decoded(tree, 10, strict=True).where("path = 'bad.py'").count() == 0
    assert fl.decoded(tree, 10, strict=False).where("path = 'bad.py'").first().content == ""
    assert fl.decoded(tree, 4, strict=True).where("path like '%a.py'").count() == 0


def test_incremental(files):
    first = co.incremental_functions(files, None)
    changed = files.withColumn("content", F.when(F.col("path") == "lib/more.py", F.lit("def new():\n    pass\n")).otherwise(F.col("content")))
    rows = co.incremental_functions(changed, first).collect()
    assert {r.name for r in rows if not r.reused} == {"new"}
    assert {r.file_path for r in rows if r.reused} == {"app/main.py", "app/store.py", "lib/tools.py"}


def test_manifest(spark, files):
    text = F.col("content")
    first, told = co.analyse_changes(files, 1)
    assert {(r.file_path, r.n_functions, r.version, r.deleted) for r in told.collect()} >= {("empty.py", 0, 1, False), ("bad.py", 0, 1, False), ("lib/more.py", 2, 1, False)}
    assert "notes.txt" not in {r.file_path for r in told.collect()}
    # one file gets other text, one is gone, one has no text any more
    changed = files.where("path != 'lib/tools.py'").withColumn("content", F.when(F.col("path") == "lib/more.py", "def new():\n    pass\n").when(F.col("path") != "app/main.py", text))
    second, told = co.analyse_changes(changed, 2, first, told)
    rows = {r.file_path: (r.n_functions, r.version, r.deleted) for r in told.collect()}
    assert rows["empty.py"] == (0, 1, False) and rows["bad.py"] == (0, 1, False)  # not parsed again
    assert rows["lib/more.py"] == (1, 2, False) and rows["lib/tools.py"] == (0, 2, True) and rows["app/main.py"] == (0, 2, False)
    assert {r.file_path for r in second.collect()} == {"app/store.py", "lib/more.py"}
    # the deleted file comes back as it was; the tombstone goes
    third, told = co.analyse_changes(files, 3, second, told)
    rows = {r.file_path: r.version for r in told.where("not deleted").collect()}
    assert rows == {"app/main.py": 3, "app/store.py": 1, "lib/tools.py": 3, "lib/more.py": 3, "bad.py": 1, "empty.py": 1}
    key = lambda df: sorted((r.file_path, r.name, r.file_hash) for r in df.collect())
    assert key(third) == key(first)
    none = files.where("false")
    last, told = co.analyse_changes(none, 4, third, told)
    assert last.count() == 0 and told.where("not deleted").count() == 0 and co.analyse_changes(none, 1)[1].count() == 0
