"""Code-corpus analytics over a Python corpus generated from the part table.

Part k becomes one file; its functions call those of parts 3k+1 and 3k+2, every
25th closes a cycle, every 10th adds a class, every 20th shares helper names
with other files, and one file in 50 does not parse.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.operators import corpus as co
from relweave.operators import graph as gr
from relweave.operators import resolve as rs
from relweave.operators import similarity as sm
from relweave.plans.registry import Data, query
from relweave.runtime import stored
from relweave.sources import files as fl

def key() -> Column:
    return F.col("p_partkey")


def fn_name(k: Column) -> Column:
    return F.concat(F.lit("f"), F.substring(F.md5(k.cast("string")), 1, 12))


def box_name(k: Column) -> Column:
    return F.concat(F.lit("B"), F.substring(F.md5(F.concat(F.lit("c"), k.cast("string"))), 1, 10))


def text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def source_files(d: Data) -> DataFrame:
    child, second = fn_name(key() * 3 + 1), fn_name(key() * 3 + 2)
    # Every 15th misspells its second call by one letter.
    second = F.when(key() % 15 == 7, F.expr("left(n2, 12)")).otherwise(F.col("n2"))
    tail = F.when(key() % 25 == 0, text("    return ", fn_name(F.floor(key() / 3)), "(json.dumps(total))\n")).otherwise("    return json.dumps(total)\n")
    body = text(
        "import json\nfrom lib.mod_", key() * 3 + 1, " import ", child, "\n\ndef ", fn_name(key()), "(item, size=", F.col("p_size"), '):\n    """',
        F.col("p_name"), '."""\n    total = ', child, "(item)\n    if total and size:\n        total = ", second, "(total)\n", tail)
    box = text(
        "\nclass ", box_name(key()), ":\n    def __init__(self, item: str):\n        self.item = item\n    async def pack(self, other: ", box_name(key()),
        ") -> str:\n        self.unpack(other)\n        return ", box_name(key() + 10), "(self.item)\n    def unpack(self, other):\n        box = ", box_name(key()),
        "(other)\n        def inner(x):\n            return box.pack(x)\n        return inner(other)\n")
    helper = text("\nimport lib.util\n\ndef util_", key() % 40, "(value):\n    return util(value)\n")
    content = F.when(key() % 50 == 1, "def broken(:\n    pass\n").when(key() % 10 == 0, F.concat(body, box)).when(
        key() % 20 == 3, F.concat(body, helper)).otherwise(body)
    path = text("pkg", F.floor(key() / 200), "/mod_", key(), ".py")
    # Few narrow rows become long texts and are parsed: use every core.
    parts = sm.spread(d.part.select("p_partkey", "p_size", "p_name"))
    files = parts.withColumn("n2", fn_name(key() * 3 + 2)).select(path.alias("path"), content.alias("content"))
    return files.select("path", F.length("content").cast("bigint").alias("length"), "content")


def functions(d: Data) -> DataFrame:
    """Parsed once and stored; later steps reuse the rows."""
    return stored(co.last_definitions(co.parse_functions(source_files(d))))


# The same corpus as SQL: one row per function, its name, place and facts.
FN = "('f' || md5(({})::VARCHAR)[1:12])"
FILES = "(SELECT *, p_partkey AS k, 'pkg' || p_partkey // 200 || '/mod_' || p_partkey || '.py' AS path FROM part)"
BX = "('B' || md5('c' || ({}))[1:10])"
ALL_FUNCTIONS = f"""(
 SELECT {FN.format('k')} AS name, path, 4 AS line, {FN.format('k')} || '(item, size)' AS signature, p_name || '.' AS docstring, 3.0 AS complexity, k FROM {FILES} WHERE k % 50 <> 1
 UNION ALL SELECT 'util_' || k % 40, path, 13, 'util_' || k % 40 || '(value)', '', 1.0, k FROM {FILES} WHERE k % 20 = 3
 UNION ALL SELECT {BX.format('k')} || '.' || m, path, l, m || '(' || a || ')', '', 1.0, k FROM {FILES},
  (VALUES ('__init__', 12, 'self, item'), ('pack', 14, 'self, other'), ('unpack', 17, 'self, other'), ('inner', 19, 'x')) v(m, l, a) WHERE k % 10 = 0)"""
LAST = f"(SELECT DISTINCT ON (name) * FROM {ALL_FUNCTIONS} ORDER BY name, path DESC, line DESC)"
CALLS = f"""(
 SELECT 'util_' || k % 40 AS caller, 'util' AS call, k FROM {FILES} WHERE k % 20 = 3 UNION ALL
 SELECT {FN.format('k')} AS caller, c AS call, k FROM {FILES}, unnest([{FN.format('3*k+1')}, CASE WHEN k % 15 = 7 THEN {FN.format('3*k+2')}[1:12] ELSE {FN.format('3*k+2')} END, 'json.dumps', 'dumps', CASE WHEN k % 25 = 0 THEN {FN.format('k//3')} END]) u(c) WHERE k % 50 <> 1 AND c IS NOT NULL
 UNION ALL SELECT {BX.format('k')} || '.pack', c, k FROM {FILES}, unnest(['self.unpack', 'unpack', {BX.format('k')} || '.unpack', {BX.format('k + 10')}]) u(c) WHERE k % 10 = 0
 UNION ALL SELECT {BX.format('k')} || '.unpack', c, k FROM {FILES}, unnest([{BX.format('k')}, 'box.pack', 'pack', 'inner']) u(c) WHERE k % 10 = 0
 UNION ALL SELECT {BX.format('k')} || '.inner', c, k FROM {FILES}, unnest(['box.pack', 'pack']) u(c) WHERE k % 10 = 0)"""
# Plain resolution of a call: exact, constructor, first method of that name.
RESOLVED = f"""(SELECT caller, call, coalesce(
  (SELECT min(name) FROM {LAST} f WHERE f.name = c.call), (SELECT min(name) FROM {LAST} f WHERE f.name = c.call || '.__init__'),
  CASE WHEN contains(call, '.') THEN (SELECT arg_min(name, (path, line)) FROM {LAST} f WHERE contains(name, '.') AND split_part(f.name, '.', 2) = split_part(c.call, '.', 2)) END) AS target
 FROM {CALLS} c)"""


def archives(d: Data) -> DataFrame:
    """Fifty files per wheel, built in tasks; every tenth archive is cut short."""
    def build(batch: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p, c in sorted(zip(batch["path"], batch["content"])):
                z.writestr(p, c)
        name = batch["archive"].iloc[0]
        blob = out.getvalue()
        return pd.DataFrame({"path": [name], "content": [blob[:40] if name.endswith("0.whl") else blob]})

    files = source_files(d).withColumn("k", F.regexp_extract("path", r"mod_(\d+)", 1).cast("bigint"))
    files = files.withColumn("archive", text("lib_", F.floor(F.col("k") / 50), ".whl"))
    return files.groupBy("archive").applyInPandas(build, "path string, content binary")


@query("archive_scan", f"""
SELECT archive, CASE WHEN archive LIKE '%0.whl' THEN NULL ELSE path END AS path, CASE WHEN archive LIKE '%0.whl' THEN 'Invalid or corrupted archive: ' || archive END AS error
FROM (SELECT 'lib_' || k // 50 || '.whl' AS archive, path FROM {FILES}) GROUP BY ALL""")
def archive_scan(d: Data):
    return fl.archive_scan(archives(d)).select("archive", "path", "error")


@query("source_tree_scan", f"SELECT path FROM {FILES} WHERE k % 9 <> 0 AND NOT contains(path, 'pkg3')")
def source_tree_scan(d: Data):
    files = source_files(d).withColumn("k", F.regexp_extract("path", r"mod_(\d+)", 1).cast("bigint"))
    files = files.withColumn("path", F.when(F.col("k") % 9 == 0, text("lib/__pycache__/", F.col("k"), ".bin")).otherwise(F.col("path")))
    return fl.source_tree_scan(files, ["pkg3"]).select("path")


@query("text_file_scan", "SELECT path FROM (SELECT source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.MD' WHEN 1 THEN '.txt' WHEN 2 THEN '.bin' ELSE '' END AS path, doc_id FROM documents) WHERE doc_id % 4 < 2")
def text_file_scan(d: Data):
    ext = F.expr("case doc_id % 4 when 0 then '.MD' when 1 then '.txt' when 2 then '.bin' else '' end")
    return fl.text_file_scan(d.documents.select(text(F.col("source"), "/", F.col("doc_id"), ext).alias("path"))).select("path")


@query("size_capped_read", "SELECT doc_id::VARCHAR || '.txt' AS path, length(text) AS n FROM documents WHERE strlen(text) <= 5000")
def size_capped_read(d: Data):
    files = d.documents.select(text(F.col("doc_id"), ".txt").alias("path"), F.octet_length("text").cast("bigint").alias("length"), F.encode("text", "UTF-8").alias("content"))
    return fl.decoded(files, 5000, strict=True).select("path", F.char_length("content").alias("n"))


@query("file_search", f"SELECT path FROM {FILES} WHERE path ILIKE 'PKG1/%~_1%.py' ESCAPE '~' UNION ALL SELECT path FROM {FILES} WHERE contains(path, '_19')")
def file_search(d: Data):
    f = source_files(d)
    return fl.file_search(f, "PKG1/*_1*.py", None).union(fl.file_search(f, "_19", None))


@query("content_search", """
SELECT file_path, line_number::INT AS line_number, trim(line) AS line_content, 1.0::DOUBLE AS match_score FROM
 (SELECT source || '/' || doc_id || '.txt' AS file_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)
 WHERE regexp_matches(line, 'the\\s+\\w+ing\\b', 'i')""")
def content_search(d: Data):
    files = d.documents.select(text(F.col("source"), "/", F.col("doc_id"), ".txt").alias("path"), F.octet_length("text").cast("bigint").alias("length"), F.col("text").alias("content"))
    return fl.content_search(files, r"the\s+\w+ing\b", ["*.txt"], is_regex=True, max_results=None)


@query("file_pattern_filter", f"SELECT path, '*_1*.py' AS pattern FROM {FILES} WHERE path LIKE '%/mod~_1%' ESCAPE '~' UNION ALL SELECT path, 'mod_?0.py' FROM {FILES} WHERE regexp_matches(path, '/mod_.0.py$')")
def file_pattern_filter(d: Data):
    """A file that matches two patterns appears twice."""
    return fl.matching_patterns(source_files(d), ["*_1*.py", "mod_?0.py"]).select("path", "pattern")


@query("parse_functions", f"SELECT name, path AS file_path, line::INT AS line_number, signature, docstring FROM {ALL_FUNCTIONS}")
def parse_functions(d: Data):
    return co.parse_functions(source_files(d)).select("name", "file_path", "line_number", "signature", "docstring")


@query("call_extraction", f"SELECT DISTINCT caller, call FROM {CALLS}")
def call_extraction(d: Data):
    return co.call_edges(co.parse_functions(source_files(d))).distinct()


@query("import_extraction", f"SELECT path AS file_path, i AS import FROM {FILES}, unnest(['json', 'lib.mod_' || (3*k+1) || '.' || {FN.format('3*k+1')}]) u(i) WHERE k % 50 <> 1 UNION ALL SELECT path, 'lib.util' FROM {FILES} WHERE k % 20 = 3")
def import_extraction(d: Data):
    return co.import_table(co.parse_functions(source_files(d)))


@query("param_and_return_types", f"""
SELECT name, CASE WHEN name LIKE 'B%.__init__' THEN 'str' WHEN name LIKE 'B%.pack' THEN split_part(name, '.', 1) END AS param_type,
 CASE WHEN name LIKE 'B%.pack' THEN 'str' END AS return_type FROM {ALL_FUNCTIONS}""")
def param_and_return_types(d: Data):
    f = co.parse_functions(source_files(d))
    t = F.col("parameter_types")
    return f.select("name", F.coalesce(F.try_element_at(t, F.lit("item")), F.try_element_at(t, F.lit("other"))).alias("param_type"), "return_type")


@query("variable_type_flow", f"""
SELECT path AS file_path, 'total' AS variable, list_sort([{FN.format('3*k+1')}, CASE WHEN k % 15 = 7 THEN {FN.format('3*k+2')}[1:12] ELSE {FN.format('3*k+2')} END]) AS types FROM {FILES} WHERE k % 50 <> 1
UNION ALL SELECT path, v, [CASE v WHEN 'box' THEN {BX.format('k')} ELSE t END] FROM {FILES}, (VALUES ('item', 'str'), ('box', 'Box')) x(v, t) WHERE k % 10 = 0""")
def variable_type_flow(d: Data):
    return co.variable_types(source_files(d))


@query("cyclomatic_complexity", f"SELECT name, path AS file_path, complexity::DOUBLE AS complexity_score FROM {ALL_FUNCTIONS}")
def cyclomatic_complexity(d: Data):
    return co.parse_functions(source_files(d)).select("name", "file_path", "complexity_score")


@query("class_method_index", f"""
WITH f AS (SELECT * FROM {LAST})
SELECT 'class' AS index, split_part(name, '.', 1) AS key, split_part(name, '.', 2) AS value FROM f WHERE contains(name, '.')
UNION SELECT 'method', split_part(name, '.', 2), name FROM f WHERE contains(name, '.')
UNION SELECT 'file', path, name FROM f UNION SELECT 'package', split_part(path, '/', 1), name FROM f
UNION SELECT 'import', 'lib.util', path FROM f WHERE starts_with(name, 'util_') UNION SELECT 'import', i, path FROM f, unnest(['json', 'lib.mod_' || (3*k+1) || '.' || {FN.format('3*k+1')}]) u(i)""")
def class_method_index(d: Data):
    return co.class_method_index(co.last_definitions(co.parse_functions(source_files(d))))


@query("resolve_basic", f"SELECT DISTINCT caller AS source, call, target FROM {RESOLVED}")
def resolve_basic(d: Data):
    return gr.basic_edges(functions(d)).select("source", "call", "target")


@query("resolve_scored")
def resolve_scored(d: Data):
    out = rs.resolve_scored(functions(d))
    return out.select("source", "call", "target", F.round("confidence", 6).alias("confidence"), "match_type", "position", rs.reasoning().alias("reasoning"))


@query("resolve_scored_direct", f"SELECT DISTINCT caller AS source, call, call AS target, 1.0::DOUBLE AS confidence FROM {CALLS} WHERE call IN (SELECT name FROM {LAST})")
def resolve_scored_direct(d: Data):
    out = rs.resolve_scored(functions(d)).where("match_type = 'direct'")
    return out.select("source", "call", "target", "confidence")


@query("resolve_scored_constructor", f"SELECT DISTINCT caller AS source, call, call || '.__init__' AS target, 0.95::DOUBLE AS confidence FROM {CALLS} WHERE call || '.__init__' IN (SELECT name FROM {LAST})")
def resolve_scored_constructor(d: Data):
    out = rs.resolve_scored(functions(d)).where("match_type = 'constructor'")
    return out.select("source", "call", "target", "confidence")


@query("context_score", f"""
SELECT DISTINCT c.caller AS source, call AS target, round(0.0 + CASE WHEN a.path = b.path THEN 0.4 ELSE 0 END + CASE WHEN split_part(a.path, '/', 1) = split_part(b.path, '/', 1) THEN 0.2 ELSE 0 END, 2)::DOUBLE AS place_score
FROM {CALLS} c JOIN {LAST} a ON a.name = c.caller JOIN {LAST} b ON b.name = c.call""")
def context_score(d: Data):
    """Scores of the exact edges; the name part is taken off for the comparison."""
    f = functions(d)
    edges = f.select(F.col("name").alias("source"), F.col("file_path").alias("source_file"), F.explode("calls").alias("target"))
    pairs = rs.join_called(edges, f.select(F.col("name").alias("target"), F.col("file_path").alias("target_file")), "target")
    scored = rs.context_scores(pairs, co.import_table(f))
    return scored.select("source", "target", F.round(F.col("score") - sm.match_ratio("target", "source") * 0.1, 2).alias("place_score"))


@query("fuzzy_match_join", f"""
SELECT {FN.format('3*k+2')}[1:12] AS call, {FN.format('3*k+2')} AS target, round(24 / 25.0, 6)::DOUBLE AS ratio FROM {FILES} p WHERE k % 15 = 7 AND k % 50 <> 1
 AND {FN.format('3*k+2')} IN (SELECT name FROM {LAST})
UNION ALL SELECT {BX.format('k')}, {BX.format('k')} || '.pack', round(22 / 27.0, 6)::DOUBLE FROM {FILES} WHERE k % 10 = 0
UNION ALL SELECT DISTINCT 'util', 'util_3', 0.8::DOUBLE FROM {FILES} WHERE k % 40 = 3""")
def fuzzy_match_join(d: Data):
    """Unresolved function calls against all function names, ratio 0.8 or more."""
    f = functions(d)
    calls = co.call_edges(f).select("call").distinct().join(f.select(F.col("name").alias("call")), "call", "left_anti")
    pairs = sm.ratio_join(calls.withColumnRenamed("call", "name"), f.select("name"), rs.FUZZY_THRESHOLD)
    return pairs.select(F.col("a").alias("call"), F.col("b").alias("target"), F.round("ratio", 6).alias("ratio"))


@query("import_resolution", f"SELECT a.name AS source, 'util' AS call, b.name AS target, 0.8::DOUBLE AS confidence FROM {LAST} a, {LAST} b WHERE starts_with(a.name, 'util_') AND starts_with(b.name, 'util_')")
def import_resolution(d: Data):
    f = functions(d)
    calls = f.select(F.col("name").alias("source"), F.col("file_path").alias("source_file"), F.explode("calls").alias("call"))
    return rs._import_matches(calls, f, co.import_table(f)).select("source", "call", "target", "confidence")


@query("function_similarity_join")
def function_similarity_join(d: Data):
    return sm.similar_functions(functions(d)).withColumn("similarity", F.round("similarity", 6))


def snippets(d: Data) -> DataFrame:
    """A snippet per part: parsable, unparsable, a class, or plain text."""
    shape = F.when(key() % 4 == 0, text("def ", fn_name(key()), "(item, size=1):\n    return item")).when(
        key() % 4 == 1, text("  async def ", fn_name(key()), " (item:\n")).when(
        key() % 4 == 2, text("class ", box_name(key()), "(:")).otherwise(text("total = ", fn_name(key() * 3 + 1), "(item)"))
    return sm.spread(d.part.select("p_partkey")).select(key().alias("snippet_id"), shape.alias("text"))


@query("snippet_function_name", f"SELECT k AS snippet_id, CASE k % 4 WHEN 0 THEN {FN.format('k')} WHEN 1 THEN {FN.format('k')} WHEN 2 THEN {BX.format('k')} END AS function_name FROM {FILES}")
def snippet_function_name(d: Data):
    return co.snippet_names(snippets(d)).select("snippet_id", "function_name")


@query("locate_definition", f"""
WITH f AS (SELECT * FROM {FILES})
SELECT k AS snippet_id, {FN.format('k')} AS function_name, path AS file_path, 4 AS line_number, 'function_definition' AS search_method FROM f WHERE k % 4 < 2 AND k % 50 <> 1
UNION ALL SELECT a.k, {BX.format('a.k')}, min(b.path), 11, 'function_definition' FROM f a JOIN f b ON b.k = a.k WHERE a.k % 4 = 2 AND a.k % 10 = 0 GROUP BY a.k
UNION ALL SELECT k, 'unknown', path, 6, 'content_match' FROM f WHERE k % 4 = 3 AND k % 50 <> 1""")
def locate_definition(d: Data):
    return co.locate_definitions(snippets(d), source_files(d))


@query("name_or_method_lookup", f"""
WITH f AS (SELECT * FROM {LAST}), n AS (SELECT {FN.format('k')} AS n FROM {FILES} UNION SELECT unnest(['pack', 'unpack', 'inner', 'gone']))
SELECT n AS function_name, coalesce((SELECT min(name) FROM f WHERE name = n), (SELECT arg_min(name, (path, line)) FROM f WHERE contains(name, '.') AND split_part(name, '.', 2) = n)) AS found FROM n""")
def name_or_method_lookup(d: Data):
    names = d.part.select(fn_name(key()).alias("function_name"))
    short = d.part.select(F.explode(F.array(*[F.lit(n) for n in ("pack", "unpack", "inner", "gone")])).alias("function_name"))
    return co.find_functions(names.union(short).distinct(), functions(d))


def roots(f: DataFrame) -> DataFrame:
    """Functions that no other one calls by name."""
    return f.select(F.col("name").alias("start")).join(co.call_edges(f).select(F.col("call").alias("start")), "start", "left_anti")


ROOTS = f"(SELECT name FROM {LAST} WHERE name NOT IN (SELECT call FROM {CALLS}))"
CLOSURE = f"""WITH RECURSIVE f AS MATERIALIZED (SELECT * FROM {LAST}), r AS MATERIALIZED (SELECT DISTINCT * FROM {RESOLVED} WHERE target IS NOT NULL AND caller IN (SELECT name FROM f)),
 c AS (SELECT name AS start, name FROM {ROOTS} UNION SELECT c.start, r.target FROM c JOIN r ON r.caller = c.name)"""


@query("dependency_closure", f"{CLOSURE} SELECT start, name FROM c")
def dependency_closure(d: Data):
    f = functions(d)
    return gr.dependency_closure(roots(f), f).select("start", "name")


@query("dependency_raw_calls", f"{CLOSURE} SELECT DISTINCT start, call FROM c JOIN {CALLS} k ON k.caller = c.name")
def dependency_raw_calls(d: Data):
    f = functions(d)
    return gr.raw_calls(gr.dependency_closure(roots(f), f), f)


@query("dependency_closure_scored")
def dependency_closure_scored(d: Data):
    f = functions(d)
    matches = stored(rs.resolve_scored(f))
    return gr.scored_closure(roots(f), matches, comprehensive=False, functions=f)


MEMBERS = f"""{CLOSURE}, e AS MATERIALIZED (SELECT DISTINCT a.start, a.name, b.name AS needs FROM c a JOIN {CALLS} k ON k.caller = a.name JOIN c b ON b.start = a.start AND b.name = k.call),
 stuck AS (SELECT start, name, needs AS tip FROM e UNION SELECT s.start, s.name, e.needs FROM stuck s JOIN e ON e.start = s.start AND e.name = s.tip),
 cyc AS (SELECT DISTINCT start, name FROM stuck WHERE name = tip),
 bad AS (SELECT start, name FROM cyc UNION SELECT s.start, s.name FROM stuck s JOIN cyc ON cyc.start = s.start AND cyc.name = s.tip)"""


@query("topo_order", f"""{MEMBERS}, lv AS (SELECT start, name, 0 AS level FROM c UNION SELECT e.start, e.name, lv.level + 1 FROM lv JOIN e ON e.start = lv.start AND e.needs = lv.name
  WHERE (e.start, e.name) NOT IN (SELECT start, name FROM bad))
SELECT start, name, max(level)::INT AS level FROM lv WHERE (start, name) NOT IN (SELECT start, name FROM bad) GROUP BY ALL""")
def topo_order(d: Data):
    f = functions(d)
    return gr.ordered(gr.topo_order(gr.dependency_closure(roots(f), f), f))


@query("topo_order_scored")
def topo_order_scored(d: Data):
    f = functions(d)
    matches = stored(rs.resolve_scored(f))
    members = stored(gr.scored_closure(roots(f), matches, comprehensive=False))
    return gr.topo_order_scored(members, matches)


@query("cycle_detection", f"{MEMBERS} SELECT DISTINCT start, name FROM bad")
def cycle_detection(d: Data):
    f = functions(d)
    return gr.cycle_members(gr.topo_order(gr.dependency_closure(roots(f), f), f))


@query("dependency_report")
def dependency_report(d: Data):
    f = functions(d)
    levels = gr.ordered(gr.topo_order(gr.dependency_closure(roots(f), f), f))
    out = gr.dependency_report(levels, f)
    return out.drop("parameter_types")


@query("corpus_stats", f"SELECT (SELECT count(*) FROM part) AS files, count(*) AS functions, count(DISTINCT CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) END) AS classes, round(avg(complexity), 6)::DOUBLE AS average_complexity FROM {LAST}")
def corpus_stats(d: Data):
    files = source_files(d)
    f = co.last_definitions(co.parse_functions(files))
    return co.corpus_stats(files, f).withColumn("average_complexity", F.round("average_complexity", 6))


@query("match_type_counts")
def match_type_counts(d: Data):
    return rs.match_counts(rs.resolve_scored(functions(d))).withColumn("average_confidence", F.round("average_confidence", 6))


@query("incremental_analysis", f"SELECT name, path AS file_path, k % 4 <> 0 AS reused FROM {ALL_FUNCTIONS}")
def incremental_analysis(d: Data):
    """The earlier run saw other text in every fourth file."""
    now = source_files(d)
    k = F.regexp_extract("path", r"mod_(\d+)", 1).cast("bigint")
    before = now.withColumn("content", F.when(k % 4 == 0, F.concat("content", F.lit("\nx = 1\n"))).otherwise(F.col("content")))
    previous = co.incremental_functions(before, None)
    return co.incremental_functions(now, previous).select("name", "file_path", "reused")


@query("incremental_manifest", f"""
SELECT path AS file_path, CASE WHEN f.k % 6 = 0 THEN 0 ELSE coalesce(n, 0) END::BIGINT AS n_functions,
 CASE WHEN f.k % 6 = 0 THEN 3 WHEN f.k % 5 = 0 OR f.k % 4 = 0 THEN 2 ELSE 1 END AS version, f.k % 6 = 0 AS deleted
FROM {FILES} f LEFT JOIN (SELECT path, count(*) AS n FROM {ALL_FUNCTIONS} GROUP BY 1) USING (path)""")
def incremental_manifest(d: Data):
    """Three runs: the first lacks every fifth file and sees other text in every fourth; the last lacks every sixth."""
    now, k = source_files(d), F.regexp_extract("path", r"mod_(\d+)", 1).cast("bigint")
    other = F.when(k % 4 == 0, F.concat("content", F.lit("\nx = 1\n"))).otherwise(F.col("content"))
    found = co.analyse_changes(now.where(k % 5 != 0).withColumn("content", other), 1)
    found = co.analyse_changes(now, 2, *found)
    return co.analyse_changes(now.where(k % 6 != 0), 3, *found)[1].drop("file_hash")


@query("codebase_language", f"SELECT 'pkg' || p_partkey // 200 AS package, 'python' AS language FROM part GROUP BY 1 UNION ALL SELECT DISTINCT source, 'unknown' FROM documents")
def codebase_language(d: Data):
    code = source_files(d).select(co.package_of(F.col("path")).alias("package"), "path")
    docs = d.documents.select(F.col("source").alias("package"), text(F.col("doc_id"), ".txt").alias("path"))
    return fl.codebase_language(code.unionByName(docs), "package")
