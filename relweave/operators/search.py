"""Full-text matching and ranking, trigram similarity, keyword search.

Words are lower-cased runs of letters, digits and underscores; there is no
stemming.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relweave.functions.temporal import let

WORD = r"[\p{L}\p{N}_]+"
# Weight of the labels D, C, B, A.
WEIGHTS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}


def words(*cols: Column) -> Column:
    """Words of one or several columns in order; NULL counts as ''."""
    text = F.lower(F.concat_ws(" ", *cols))
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)


def postings(df: DataFrame, key: str, terms: list[str] | None = None, **weighted: tuple[str, ...]) -> DataFrame:
    """(key, token, position, weight) of columns given per label, for example
    ``A=("title",), D=("body",)``; positions run on from column to column.

    With ``terms`` only their postings are made: other words are dropped inside
    the text's array and never become rows.
    """
    parts = [F.transform(words(F.col(c)), _labelled(label)) for label, cols in sorted(weighted.items()) for c in cols]
    every = F.concat(*parts) if len(parts) > 1 else parts[0]
    placed = F.transform(every, lambda w, i: F.struct(w["token"].alias("token"), (i + 1).alias("position"), w["weight"].alias("weight")))
    if terms is not None:
        wanted = sorted({t.lower() for t in terms})
        placed = F.filter(placed, lambda w: w["token"].isin(wanted))
    return df.select(key, F.inline(placed))


def _labelled(label: str):
    return lambda t: F.struct(t.alias("token"), F.lit(label).alias("weight"))


# Search conditions over a column of words; combine them with & | ~.
def term(toks: Column, word: str) -> Column:
    return F.array_contains(toks, word.lower())


def plain(toks: Column, text: str) -> Column:
    """Every word of the text occurs."""
    wanted = sorted({w.lower() for w in re.findall(r"\w+", text)})
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), toks)) == 0


def phrase(toks: Column, text: str) -> Column:
    """The words occur one after the other."""
    run = " ".join(w.lower() for w in re.findall(r"\w+", text))
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")).contains(f" {run} ")


def websearch(toks: Column, text: str) -> Column:
    """Quoted phrases, OR between neighbours, leading minus for NOT; else AND."""
    parts = re.findall(r'-?"[^"]*"|\S+', text)
    groups: list[list[Column]] = []
    either = False
    for p in parts:
        if p.lower() == "or":
            either = True
            continue
        body = p.lstrip("-")
        cond = phrase(toks, body.strip('"')) if body.startswith('"') else plain(toks, body)
        cond = ~cond if p.startswith("-") else cond
        if either and groups:
            groups[-1].append(cond)
        else:
            groups.append([cond])
        either = False
    out = F.lit(True)
    for g in groups:
        some = g[0]
        for c in g[1:]:
            some = some | c
        out = out & some
    return out


def match_postings(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Keys that hold all terms, from a postings table."""
    wanted = sorted({t.lower() for t in terms})
    hit = index.where(F.col("token").isin(wanted)).groupBy(key).agg(F.count_distinct("token").alias("n"))
    return hit.where(F.col("n") == len(wanted)).select(key)


def rank(index: DataFrame, key: str, terms: list[str], weights: dict[str, float] | None = None, normalization: int = 0) -> DataFrame:
    """(key, rank): the j-th occurrence of a term adds weight / j^2; the sum is
    divided by pi^2 / 6 and the number of terms."""
    weights = WEIGHTS | (weights or {})
    wanted = sorted({t.lower() for t in terms})
    w = Window.partitionBy(key, "token").orderBy("position")  # one word of one text
    hits = index.where(F.col("token").isin(wanted)).withColumn("j", F.row_number().over(w))
    worth = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    part = F.element_at(worth, F.col("weight")) / (F.col("j") * F.col("j"))
    out = hits.groupBy(key).agg((F.sum(part) / (math.pi**2 / 6) / len(wanted)).alias("rank"))
    return _normalized(out, index, key, normalization)


def rank_cover(index: DataFrame, key: str, terms: list[str], normalization: int = 0) -> DataFrame:
    """(key, rank): sum over the smallest stretches that hold all terms of
    1 / length; texts without all terms have no row."""
    wanted = sorted({t.lower() for t in terms})
    hits = index.where(F.col("token").isin(wanted))
    upto = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    lasts = [F.max(F.when(F.col("token") == t, F.col("position"))).over(upto) for t in wanted]
    start = F.least(*lasts) if len(lasts) > 1 else lasts[0]
    full = F.lit(True)
    for last in lasts:
        full = full & last.isNotNull()
    spans = hits.select(key, "position", F.when(full, start).alias("start")).where(F.col("start").isNotNull())
    spans = spans.groupBy(key, "start").agg(F.min(F.col("position") - F.col("start") + 1).alias("span"))
    centre = F.col("start") + (F.col("span") - 1) / 2
    gap = centre - F.lag(centre).over(Window.partitionBy(key).orderBy("start"))  # stretches of one text
    spans = spans.withColumn("near", 1 / gap) if normalization & 4 else spans.withColumn("near", F.lit(None).cast("double"))
    out = spans.groupBy(key).agg(F.sum(1 / F.col("span")).alias("rank"), F.sum("near").alias("near"), F.count("*").alias("n"))
    out = out.select(key, _spaced("rank", F.col("near"), F.col("n")).alias("rank"))
    return _normalized(out, index, key, normalization)


def _normalized(ranks: DataFrame, index: DataFrame, key: str, flags: int) -> DataFrame:
    """Flags add up: 1 and 2 divide by text length (log, plain), 8 and 16 by
    distinct words (plain, log), 32 maps r to r / (r + 1). 4, the distance between
    stretches, counts in cover ranks only, which apply it themselves."""
    if flags & (1 | 2 | 8 | 16):
        size = index.groupBy(key).agg(F.count("*").alias("__n"), F.count_distinct("token").alias("__u"))
        ranks = ranks.join(size, key)
        r = F.col("rank")
        for bit, by in ((1, 1 + F.log("__n")), (2, F.col("__n")), (8, F.col("__u")), (16, 1 + F.log("__u"))):
            r = r / by if flags & bit else r
        ranks = ranks.withColumn("rank", r).drop("__n", "__u")
    if flags & 32:
        ranks = ranks.withColumn("rank", F.col("rank") / (F.col("rank") + 1))
    return ranks


def _placed(**weighted: tuple[str, ...]) -> Column:
    """Words of a row with label, in order; as in ``postings``, but kept in the row."""
    parts = [F.transform(words(F.col(c)), _labelled(label)) for label, cols in sorted(weighted.items()) for c in cols]
    every = F.concat(*parts) if len(parts) > 1 else parts[0]
    return F.transform(every, lambda w, i: F.struct(w["token"].alias("token"), (i + 1).alias("position"), w["weight"].alias("weight")))


def _is(token: str):
    return lambda x: x["token"] == token


def rank_texts(df: DataFrame, key: str, terms: list[str], weights: dict[str, float] | None = None,
               normalization: int = 0, **weighted: tuple[str, ...]) -> DataFrame:
    """``rank`` for texts not indexed: each text is one row, and nothing is shuffled."""
    weights = WEIGHTS | (weights or {})
    wanted = sorted({t.lower() for t in terms})
    worth = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    total = F.lit(0.0)
    for t in wanted:
        found = F.filter("__w", _is(t))
        parts = F.transform(found, lambda x, i: F.element_at(worth, x["weight"]) / ((i + 1) * (i + 1)))
        total = total + F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    rows = df.select(key, _placed(**weighted).alias("__w"))
    rows = rows.where(F.exists("__w", lambda x: x["token"].isin(wanted)))
    return _sized(rows.withColumn("rank", total / (math.pi**2 / 6) / len(wanted)), normalization).select(key, "rank")


def cover_rank_texts(df: DataFrame, key: str, terms: list[str], normalization: int = 0, **weighted: tuple[str, ...]) -> DataFrame:
    """``rank_cover`` for texts not indexed, by one fold over each text's matches.

    A stretch that holds all terms starts at the least of the terms' last places;
    the first match that sees a new start ends the smallest stretch from it.
    """
    wanted = sorted({t.lower() for t in terms})
    hits = F.filter("__w", lambda x: x["token"].isin(wanted))
    names = F.array(*[F.lit(t) for t in wanted])
    zero = F.struct(
        F.transform(names, lambda _: F.lit(0)).alias("last"), F.lit(0).alias("start"), F.lit(0.0).alias("sum"),
        F.lit(0).alias("n"), F.lit(0.0).alias("centre"), F.lit(0.0).alias("near"))

    def step(state, hit):
        last = F.zip_with(state["last"], names, lambda p, t: F.when(t == hit["token"], hit["position"]).otherwise(p))
        start = F.array_min(last)
        new, centre = (start > 0) & (start != state["start"]), (start + hit["position"]) / 2
        return F.struct(
            last.alias("last"), F.when(new, start).otherwise(state["start"]).alias("start"),
            F.when(new, state["sum"] + 1 / (hit["position"] - start + 1)).otherwise(state["sum"]).alias("sum"),
            (state["n"] + new.cast("int")).alias("n"), F.when(new, centre).otherwise(state["centre"]).alias("centre"),
            F.when(new & (state["n"] > 0), state["near"] + 1 / (centre - state["centre"])).otherwise(state["near"]).alias("near"))

    rows = df.select(key, _placed(**weighted).alias("__w"))
    rows = rows.withColumn("__f", F.aggregate(hits, zero, step)).withColumn("rank", F.col("__f.sum")).where("rank > 0")
    if normalization & 4:
        rows = rows.withColumn("rank", _spaced("rank", F.col("__f.near"), F.col("__f.n")))
    return _sized(rows, normalization).select(key, "rank")


def _spaced(rank: str, near: Column, n: Column) -> Column:
    """Rank over the harmonic mean of the distances between the centres of ``n`` stretches;
    ``near`` is the sum of 1 / distance."""
    return F.when(near > 0, F.col(rank) * near / n).otherwise(F.col(rank))


def _sized(rows: DataFrame, flags: int) -> DataFrame:
    """``_normalized`` for rows that hold their words; distinct words are counted only if asked for."""
    n, u, r = F.size("__w"), F.size(F.array_distinct(F.transform("__w", lambda x: x["token"]))), F.col("rank")
    for bit, by in ((1, 1 + F.log(n)), (2, n), (8, u), (16, 1 + F.log(u))):
        r = r / by if flags & bit else r
    return rows.withColumn("rank", r / (r + 1) if flags & 32 else r)


def headline(text: Column, terms: list[str], start: str = "<b>", stop: str = "</b>", max_words: int = 35, lead: int = 5) -> Column:
    """A stretch of ``max_words`` words from ``lead`` before the first match,
    matches wrapped in the markers."""
    rx = r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(re.escape(t) for t in terms) + r")(?![\p{L}\p{N}_])"
    parts = F.split(F.trim(text), r"\s+")
    first = F.array_position(F.transform(parts, lambda p: p.rlike(rx)), True).cast("int")
    piece = F.slice(parts, F.greatest(first - lead, F.lit(1)), F.lit(max_words))
    return F.regexp_replace(F.array_join(piece, " "), rx, f"{start}$1{stop}")


def headline_fragments(
    text: Column, terms: list[str], max_fragments: int = 2, max_words: int = 35, min_words: int = 15, short_word: int = 3,
    highlight_all: bool = False, start: str = "<b>", stop: str = "</b>", delimiter: str = " ... ",
) -> Column:
    """The fragments with most matches, in text order, matches wrapped in the markers.

    One fold over the matches cuts them into pieces of at most ``max_words`` words; the
    best have most matches, then fewest words, then come first. Each is stretched to
    ``max_words``, at most half-way to its neighbour, and does not begin or end with a
    word of ``short_word`` letters or fewer unless it matches. A text without a match
    gives its first ``min_words`` words; ``highlight_all`` gives the whole text. NULL
    stays NULL.
    """
    rx = r"(?iu)(?<![\p{L}\p{N}_])(" + "|".join(re.escape(t) for t in terms) + r")(?![\p{L}\p{N}_])"
    marked = lambda x: F.regexp_replace(x, rx, f"{start}$1{stop}")
    if highlight_all:
        return marked(text)
    piece = lambda s, e, n: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), n.cast("int").alias("n"))
    none = piece(F.lit(None), F.lit(None), F.lit(0))
    empty = F.struct(F.array().cast("array<struct<s:int,e:int,n:int>>").alias("done"), none.alias("cur"))
    closed = lambda st: F.when(st["cur"]["n"] > 0, F.concat(st["done"], F.array(st["cur"]))).otherwise(st["done"])

    def step(st: Column, h: Column) -> Column:
        cur = st["cur"]
        longer = F.struct(st["done"].alias("done"), piece(cur["s"], h, cur["n"] + 1).alias("cur"))
        fresh = F.struct(closed(st).alias("done"), piece(h, h, F.lit(1)).alias("cur"))
        return F.when((cur["n"] > 0) & (h < cur["s"] + max_words), longer).otherwise(fresh)

    def shown(parts: Column, all_best: Column, x: Column, i: Column) -> Column:
        room = F.lit(max_words) - (x["e"] - x["s"] + 1)
        before = F.when(i > 0, F.get(all_best, i - 1)["e"]).otherwise(F.lit(None))
        after = F.get(all_best, i + 1)["s"]
        # of the words between two fragments the former may take the lesser half
        low = F.greatest(x["s"] - F.floor(room / 2), F.coalesce(before + 1 + F.floor((x["s"] - before - 1) / 2), F.lit(0)))
        high = F.least(x["e"] + room - F.floor(room / 2), F.coalesce(x["e"] + F.floor((after - x["e"] - 1) / 2), F.size(parts) - 1))
        long_word = lambda j, own: (F.length(F.get(parts, j.cast("int"))) > short_word) | (j == own)
        first = F.array_min(F.filter(F.sequence(low.cast("int"), x["s"]), lambda j: long_word(j, x["s"])))
        last = F.array_max(F.filter(F.sequence(x["e"], high.cast("int")), lambda j: long_word(j, x["e"])))
        return marked(let(first, lambda at: F.array_join(F.slice(parts, at + 1, last - at + 1), " ")))

    def cut(parts: Column, hits: Column) -> Column:
        ranked = F.array_sort(F.transform(F.aggregate(hits, empty, step, closed), lambda x: F.struct(
            (-x["n"]).alias("less"), (x["e"] - x["s"]).alias("span"), x["s"].alias("s"), x["e"].alias("e"))))
        best = F.array_sort(F.transform(F.slice(ranked, 1, max_fragments), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
        found = let(best, lambda b: F.array_join(F.transform(b, lambda x, i: shown(parts, b, x, i)), delimiter))
        return F.when(F.size(hits) > 0, found).otherwise(F.array_join(F.slice(parts, 1, min_words), " "))

    matching = lambda parts: F.filter(F.transform(parts, lambda p, i: F.when(p.rlike(rx), i)), lambda i: i.isNotNull())
    # The text is split once, and its words are tested once.
    return let(F.split(F.trim(text), r"\s+"), lambda parts: let(matching(parts), lambda hits: cut(parts, hits)))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one after."""
    return F.array_distinct(_trigram_row(text))


def _trigram_row(text: Column) -> Column:
    """The same in order, repeats included."""
    return F.flatten(F.transform(words(text), _word_grams))


def _word_grams(w: Column) -> Column:
    p = F.concat(F.lit("  "), w, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(p, i, F.lit(3)))


def set_similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total > 0, both / total).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def distance(a: Column, b: Column) -> Column:
    return 1 - similarity(a, b)


def _best_extent(needle: Column, units: Column) -> Column:
    """Best similarity of the needle to an unbroken run of ``units`` (lists of trigrams).

    One fold over the units that share a trigram with the needle. The best run that
    ends with a unit starts where one of the needle's trigrams came last, since any
    longer run has no more of them; so the fold carries, per trigram of the needle, what
    the run from that place holds. A run is dropped once even all of the needle could not
    lift it over the best one found, so runs stay short however long the text is.
    """
    def fold(t: Column, u: Column) -> Column:
        hits = F.filter(F.transform(u, lambda x, i: F.when(F.arrays_overlap(t, x), i + 1)), lambda i: i.isNotNull())

        def step(s: Column, at: Column) -> Column:
            here = F.array_distinct(F.element_at(u, at))
            added = F.array_distinct(F.flatten(F.slice(u, s["at"] + 1, at - s["at"])))
            runs = let(added, lambda more: F.transform(t, lambda g, i: F.when(F.array_contains(here, g), here).otherwise(
                F.array_union(F.get(s["runs"], i), more))))
            return let(runs, lambda r: let(F.greatest(s["best"], F.array_max(F.transform(r, lambda e: set_similarity(t, e)))), lambda best: F.struct(
                at.alias("at"), F.transform(r, lambda e: F.when(F.size(e) * best < F.size(t), e)).alias("runs"), best.alias("best"))))

        none = F.transform(t, lambda g: F.lit(None).cast("array<string>"))
        start = F.struct(F.lit(0).alias("at"), none.alias("runs"), F.lit(0.0).alias("best"))
        return F.aggregate(hits, start, step, lambda s: s["best"])

    return F.coalesce(let(needle, lambda t: let(units, lambda u: fold(t, u))), F.lit(0.0))


def strict_word_similarity(needle: Column, text: Column) -> Column:
    """Best similarity of the needle to a run of whole words of the text."""
    return _best_extent(trigrams(needle), F.transform(words(text), _word_grams))


def word_similarity(needle: Column, text: Column) -> Column:
    """Best similarity of the needle to an unbroken extent of the text's trigrams."""
    return _best_extent(trigrams(needle), F.transform(_trigram_row(text), lambda g: F.array(g)))


def similarity_join(left: DataFrame, right: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs of distinct texts (a, b, similarity) at or above the threshold.

    Exact prefix filter: a text is listed under its n - ceil(t n) + 1 rarest
    trigrams, since a partner must share one of them; sizes must differ by at
    most the threshold. Copies of a text are joined once.
    """
    texts = lambda df: df.select(F.col("text").alias("t")).distinct().withColumn("g", trigrams(F.col("t"))).where(F.size("g") > 0)
    x, y = texts(left), texts(right)
    freq = y.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        keep = F.size("g") - F.ceil(F.size("g") * threshold - 1e-9) + 1
        rows = df.select(F.xxhash64("t").alias("id"), "t", F.size("g").alias("n"), keep.alias("keep"), F.explode("g").alias("gram"))
        rows = rows.join(freq, "gram", "left")
        w = Window.partitionBy("t").orderBy(F.coalesce("df", F.lit(0)), "gram")
        rows = rows.withColumn("r", F.row_number().over(w)).where("r <= keep")
        return rows.select("gram", F.col("t").alias(name), F.col("n").alias(f"n_{name}"))

    near = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9
    pairs = prefix(x, "a").join(prefix(y, "b"), "gram").where(near).select("a", "b").distinct()
    pairs = pairs.withColumn("similarity", similarity(F.col("a"), F.col("b")))
    return pairs.where(F.col("similarity") >= threshold)


def split_terms(text: str) -> list[str]:
    """Words of a search box; quoted runs stay together, without their quotes."""
    return [p[1:-1] if len(p) > 1 and p[0] == p[-1] and p[0] in "\"'" else p for p in re.findall(r'"[^"]*"|\'[^\']*\'|\S+', text)]


def keyword_condition(text: str, fields: list[str]) -> Column:
    """Every term matches some field. A field's first letter picks the test:
    ``^`` starts with, ``=`` equals, ``@`` whole words, else contains; case is
    ignored throughout."""
    cond = F.lit(True)
    for t in split_terms(text):
        some = F.lit(False)
        for f in fields:
            col, low = F.col(f.lstrip("^=@")), t.lower()
            if f[0] == "@":
                some = some | plain(words(col), t)
            else:
                low_col = F.lower(col)
                some = some | {"^": low_col.startswith(low), "=": low_col == low}.get(f[0], low_col.contains(low))
        cond = cond & some
    return cond
