"""Calls to functions: plain and scored resolution."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.operators.corpus import import_table, with_names
from relweave.operators.similarity import match_ratio, ratio_join, spread
from relweave.operators.windows import chunked_lists
from relweave.runtime import stored

# Fixed values of the target behaviour.
FUZZY_THRESHOLD = 0.8
SAME_FILE, SAME_PACKAGE, IMPORT_LINK, NAME_RATIO = 0.4, 0.2, 0.3, 0.1
CONTEXT_CAP = 0.95
CONSTRUCTOR, IMPORTED = 0.95, 0.8
FUZZY_BELOW = 0.7
BEST = 5
# Calls from which a name is joined apart.
HOT = 100_000


def resolve_basic(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls(call, ..) + ``target``: the name itself, else its constructor, else
    for a dotted call the first function (by path, line) named ``*.method``."""
    exact = functions.select(F.col("name").alias("call"), F.col("name").alias("t_exact"))
    init = functions.where(F.col("name").endswith(".__init__")).select(
        F.expr("left(name, length(name) - 9)").alias("call"), F.col("name").alias("t_init"))
    methods = functions.where(F.col("name").contains(".")).select(
        F.substring_index("name", ".", -1).alias("method"), "name", "file_path", "line_number")
    methods = methods.groupBy("method").agg(F.min_by("name", F.struct("file_path", "line_number")).alias("t_method"))
    # A plain call has no method; its key, which no method has, keeps such calls apart.
    method = F.when(F.col("call").contains("."), F.substring_index("call", ".", -1)).otherwise(F.concat(F.lit("."), "call"))
    # Each distinct call is resolved once, then joined back.
    known = calls.select("call").distinct().withColumn("method", method)
    known = known.join(exact, "call", "left").join(init, "call", "left").join(methods, "method", "left")
    known = known.select("call", F.coalesce("t_exact", "t_init", "t_method").alias("target"))
    return join_called(calls, known, "call", "left")


def join_called(calls: DataFrame, named: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Calls joined with ``named``, which holds a called name (``key``) once.

    A name that a share of all code calls, such as ``dumps``, would send its calls to one
    task. Names are counted first; those with more than ``HOT`` calls, at most one per
    ``HOT`` calls in all, meet their rows without a shuffle of the calls. These rows are
    joined by the name's number: Spark holds rows of any other key but one 64-bit number in
    pages of up to 64 MB, on the driver and on every executor, however few they are.
    """
    counts = calls.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    hot = [r[0] for r in counts.select(key).where(F.col(key).isNotNull()).collect()]
    if not hot:
        return calls.join(named, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    number = F.array_position(F.array(*map(F.lit, hot)), F.col(key)).alias("__hot")
    few = F.broadcast(named.where(is_hot).select("*", number).drop(key))  # as many rows as hot names at most
    met = calls.where(is_hot).select("*", number).join(few, "__hot", how).drop("__hot")
    return calls.where(~is_hot).join(named.where(~is_hot), key, how).unionByName(met)


def _context(same_file: Column, same_package: Column, linked: Column, ratio: Column) -> Column:
    score = F.when(same_file, SAME_FILE).otherwise(0.0) + F.when(same_package, SAME_PACKAGE).otherwise(0.0)
    score = score + F.when(linked, IMPORT_LINK).otherwise(0.0) + ratio * NAME_RATIO
    return F.least(score, F.lit(CONTEXT_CAP))


def _segment(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def context_scores(pairs: DataFrame, imports: DataFrame) -> DataFrame:
    """pairs(source, source_file, target, target_file) + ``score``.

    The import bonus asks whether the target's *path* is among the imports of
    the source file, as the target behaviour has it.
    """
    link = imports.select(F.col("file_path").alias("source_file"), F.col("import").alias("target_file"), F.lit(True).alias("__link"))
    out = pairs.join(link, ["source_file", "target_file"], "left")
    same_file = F.col("source_file") == F.col("target_file")
    same_package = _segment(F.col("source_file")) == _segment(F.col("target_file"))
    score = _context(same_file, same_package, F.col("__link").isNotNull(), match_ratio("target", "source"))
    return out.withColumn("score", score).drop("__link")


def _best_methods(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best five of a chunk of candidates for each call. The name ratio adds at
    most 0.1, so candidates that cannot reach the fifth place are not compared."""
    m = SequenceMatcher(None, "", "")
    for batch in batches:
        out = []
        for source, path, call, links, names, paths in zip(
            batch["source"], batch["source_file"], batch["call"], batch["links"], batch["names"], batch["paths"]
        ):
            seg, links = path.split("/")[0], set(links) if links is not None else set()
            low = source.lower()
            m.set_seq2(low)
            base = [
                (SAME_FILE if p == path else 0.0) + (SAME_PACKAGE if p.split("/")[0] == seg else 0.0)
                + (IMPORT_LINK if p in links else 0.0)
                for p in paths
            ]
            order = sorted(range(len(base)), key=lambda i: (-base[i], names[i]))
            best: list[tuple[float, str]] = []
            for i in order:
                if len(best) == BEST and base[i] + NAME_RATIO < -best[-1][0]:
                    break
                n = names[i].lower()
                m.set_seq1(n)
                if len(best) == BEST and base[i] + NAME_RATIO * m.real_quick_ratio() < -best[-1][0]:
                    continue
                score = min(base[i] + m.ratio() * NAME_RATIO, CONTEXT_CAP)
                best = sorted([*best, (-score, names[i])])[:BEST]
            out += [(source, call, n, -s) for s, n in best]
        yield pd.DataFrame(out, columns=["source", "call", "target", "confidence"])


def _method_matches(open_calls: DataFrame, functions: DataFrame, imports: DataFrame, chunk: int) -> DataFrame:
    """Calls ``x.m`` against all ``Class.m``: candidates are packed into chunks
    of bounded size and each (call, chunk) yields five rows at most, so a method
    name shared by a third of the corpus makes neither a huge list nor a row
    per pair.

    What lies in the caller's package or is imported by its file scores more than
    anything else can by its name. A call with five such candidates sees no others.
    """
    calls = open_calls.where(F.col("call").contains(".")).withColumns({
        "method_name": F.expr("substring(call, instr(call, '.') + 1)"), "seg": _segment(F.col("source_file"))})
    wanted = calls.select("method_name").distinct()
    cand = with_names(functions).where(F.col("method_name").isNotNull()).join(wanted.hint("merge"), "method_name", "left_semi")
    cand = cand.select("method_name", "name", "file_path", _segment(F.col("file_path")).alias("seg"))
    # Only links that name a file can ever count.
    linked = imports.join(functions.select(F.col("file_path").alias("import")).distinct(), "import", "left_semi")
    linked = linked.select(F.col("file_path").alias("source_file"), "import")
    links = linked.groupBy("source_file").agg(F.collect_set("import").alias("links"))
    calls = calls.join(links.hint("merge"), "source_file", "left")

    own = ["source", "source_file", "call"]
    there = cand.select("method_name", "name", F.col("file_path").alias("import"), F.col("seg").alias("there"))
    abroad = calls.select(*own, "method_name", "seg").distinct().join(linked.hint("merge"), "source_file")
    abroad = abroad.join(there.hint("merge"), ["method_name", "import"]).where("seg != there")
    abroad = abroad.groupBy(*own).agg(F.collect_list("name").alias("names"), F.collect_list("import").alias("paths"))
    counts = cand.groupBy("method_name", "seg").agg(F.count("*").alias("here"))
    calls = calls.join(counts.hint("merge"), ["method_name", "seg"], "left").join(abroad.hint("merge"), own, "left")
    near = F.coalesce("here", F.lit(0)) + F.when(F.col("names").isNotNull(), F.size("names")).otherwise(0)
    calls = stored(calls.withColumn("enough", near >= BEST))

    def packed(keys: list[str]) -> DataFrame:
        order = [F.col("file_path").asc(), F.col("name").asc()]
        lists = chunked_lists(cand.select("method_name", "seg", "name", "file_path"), keys, order, F.struct("name", "file_path"), chunk, "cands")
        return lists.select(*keys, F.col("cands.name").alias("names"), F.col("cands.file_path").alias("paths"))

    shape = lambda df: df.select(*own, "links", "names", "paths")
    bare = calls.drop("names", "paths")
    work = shape(bare.where("enough").join(packed(["method_name", "seg"]), ["method_name", "seg"])).unionByName(
        shape(calls.where("enough and names is not null"))).unionByName(
        shape(bare.where("not enough").join(packed(["method_name"]), "method_name")))
    best = spread(work).mapInPandas(_best_methods, "source string, call string, target string, confidence double")
    return best.withColumn("match_type", F.lit("method"))


def _fuzzy_matches(open_calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    names = ratio_join(open_calls.select(F.col("call").alias("name")), functions.select("name"), FUZZY_THRESHOLD)
    names = names.select(F.col("a").alias("call"), F.col("b").alias("target"), "ratio")
    place = functions.select(F.col("name").alias("target"), F.col("file_path").alias("target_file"))
    pairs = spread(open_calls.join(names, "call").join(place, "target"))
    scored = context_scores(pairs, imports)
    conf = F.col("ratio") * 0.7 + F.col("score") * 0.3
    ratio = F.format_string("%.2f", F.bround("ratio", 2)).alias("detail")
    return scored.select("source", "call", "target", conf.alias("confidence"), F.lit("fuzzy").alias("match_type"), ratio)


def _import_matches(open_calls: DataFrame, functions: DataFrame, imports: DataFrame, best: int | None = None) -> DataFrame:
    """Functions of the files that hold an import naming the call, all of them. With
    ``best`` only the first so many names per (call, import): all score the same, so
    that is enough for the first ``best`` targets of any caller."""
    own = open_calls.join(imports.withColumnRenamed("file_path", "source_file"), "source_file")
    own = own.where(F.col("import").contains(F.col("call")))
    keys = own.select("call", "import").distinct()
    holders = functions.select("name", "file_path").join(imports, "file_path")
    cand = keys.join(holders.hint("merge"), "import").where(F.col("name").contains(F.col("call")))
    cand = cand.select("call", "import", "name").distinct()
    if best is not None:
        w = Window.partitionBy("call", "import").orderBy("name")
        cand = cand.withColumn("r", F.row_number().over(w)).where(F.col("r") <= best).drop("r")
    out = own.join(cand.hint("merge"), ["call", "import"]).groupBy("source", "call", F.col("name").alias("target")).agg(F.min("import").alias("detail"))
    return out.select("source", "call", "target", F.lit(IMPORTED).alias("confidence"), F.lit("import").alias("match_type"), "detail")


def resolve_scored(functions: DataFrame, chunk: int = 1000) -> DataFrame:
    """Every call of every function to its best five targets:
    (source, call, target, confidence, match_type, detail, position). ``detail`` is
    the ratio of a fuzzy match and the least import that gives an import match.

    An exact name ends the search. Otherwise constructor, methods by context,
    fuzzy names if nothing scores 0.7 yet, and imports.
    """
    calls = functions.select(
        F.col("name").alias("source"), F.col("file_path").alias("source_file"), F.explode("calls").alias("call"))
    names, none = functions.select(F.col("name").alias("call")), F.lit(None).cast("string").alias("detail")
    direct = calls.join(names, "call", "left_semi").select(
        "source", "call", F.col("call").alias("target"), F.lit(1.0).alias("confidence"), F.lit("direct").alias("match_type"), none)
    open_calls = calls.join(names, "call", "left_anti")
    imports = import_table(functions)
    inits = functions.where(F.col("name").endswith(".__init__")).select(
        F.expr("left(name, length(name) - 9)").alias("call"), F.col("name").alias("target"))
    made = open_calls.join(inits, "call").select(
        "source", "call", "target", F.lit(CONSTRUCTOR).alias("confidence"), F.lit("constructor").alias("match_type"), none)
    methods = _method_matches(open_calls, functions, imports, chunk)
    early = stored(made.unionByName(methods.withColumn("detail", none).select(*made.columns)))  # read twice
    sure = early.where(F.col("confidence") >= FUZZY_BELOW).select("source", "call").distinct()
    fuzzy = _fuzzy_matches(open_calls.join(sure, ["source", "call"], "left_anti"), functions, imports)
    found = early.unionByName(fuzzy).unionByName(_import_matches(open_calls, functions, imports, BEST))
    rank = F.expr("array_position(array('constructor', 'method', 'fuzzy', 'import'), match_type)")
    w = Window.partitionBy("source", "call").orderBy(F.desc("confidence"), rank, "target")
    found = found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= BEST)
    return direct.withColumn("position", F.lit(1)).unionByName(found)


def reasoning() -> Column:
    """Text for a match row."""
    c, t = F.col("call"), F.col("target")
    return (
        F.when(F.col("match_type") == "direct", "Exact function name match")
        .when(F.col("match_type") == "constructor", F.concat(F.lit("Constructor call: "), c, F.lit("() -> "), t))
        .when(F.col("match_type") == "method", F.concat(F.lit("Method resolution: "), c, F.lit(" -> "), t))
        .when(F.col("match_type") == "fuzzy", F.concat(F.lit("Fuzzy match: "), c, F.lit(" ~= "), t, F.lit(" (sim: "), F.col("detail"), F.lit(")")))
        .otherwise(F.concat(F.lit("Import resolution: "), c, F.lit(" via "), F.col("detail")))
    )


def match_counts(matches: DataFrame) -> DataFrame:
    """(match_type, matches, calls, average_confidence): how calls were resolved."""
    return matches.groupBy("match_type").agg(
        F.count("*").alias("matches"), F.count_distinct("source", "call").alias("calls"), F.avg("confidence").alias("average_confidence"))
