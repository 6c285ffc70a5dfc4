"""Exact similarity joins on names.

The ratio is 2M / (a + b), M the characters matched by the longest-block
method. Two short names of a pair have a common subsequence of M characters,
so they meet under what is left of each when the others are deleted. Longer
ones, of which too much could be deleted, come from a prefix filter: each name
is listed under its rarest tokens only, as many as the threshold needs to miss
nothing.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave.runtime import cut_lineage, stored


@F.pandas_udf(T.DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of a to b, lower-cased. Not symmetric: keep the argument order."""
    m, last, out = SequenceMatcher(None, "", ""), None, []
    for x, y in zip(a, b):
        x, y = x.lower(), y.lower()
        if y != last:
            m.set_seq2(y)
            last = y
        m.set_seq1(x)
        out.append(m.ratio())
    return pd.Series(out, dtype="float64")


def common_characters(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, a bit for every character of ``a``;
    of pairs with over 63 characters on a side, the shorter length."""
    la, lb = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
    out = np.minimum(la, lb)
    some = np.flatnonzero((la > 0) & (lb > 0) & (np.maximum(la, lb) <= 63))
    if not len(some):
        return out
    wa, wb = int(la[some].max()), int(lb[some].max())
    x, y = (np.array([side[i] for i in some], dtype=f"<U{w}").view(np.uint32).reshape(len(some), w) for side, w in ((a, wa), (b, wb)))
    bits = np.where(np.arange(wa) < la[some, None], np.uint64(1) << np.arange(wa, dtype=np.uint64), np.uint64(0))
    left = np.full(len(some), ~np.uint64(0))
    for j in range(wb):
        hit = ((x == y[:, j, None]) & (j < lb[some, None])) * bits
        met = left & hit.sum(axis=1, dtype=np.uint64)
        left = (left + met) | (left - met)
    out[some] = np.bitwise_count(~left & bits.sum(axis=1, dtype=np.uint64))
    return out


@F.pandas_udf(T.DoubleType())
def match_ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """``match_ratio`` of the pairs that may reach ``least``, NULL for the others: matched
    characters form a common subsequence."""
    low_a, low_b = [x.lower() for x in a], [y.lower() for y in b]
    size = np.array([len(x) + len(y) for x, y in zip(low_a, low_b)])
    may = 2 * common_characters(low_a, low_b) >= (least.to_numpy() - 1e-9) * size
    m, last, out = SequenceMatcher(None, "", ""), None, np.full(len(size), np.nan)
    for i in np.flatnonzero(may).tolist():
        if low_b[i] != last:
            m.set_seq2(low_b[i])
            last = low_b[i]
        m.set_seq1(low_a[i])
        out[i] = m.ratio()
    return pd.Series(out).where(may, None)


def _occurrences(items: Column) -> Column:
    """Items of an array numbered per repeat, so that multisets become sets."""
    return F.transform(items, lambda x, i: F.concat(
        x, F.lit("\u0001"), F.size(F.filter(F.slice(items, 1, i), lambda y: y == x)).cast("string")))


def char_tokens(text: Column) -> Column:
    return _occurrences(F.split(text, ""))


def gram_tokens(text: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return _occurrences(pairs)


def _prefix(names: DataFrame, freq: DataFrame, tokens: Column, length: Column) -> DataFrame:
    """(n, token): the ``length`` rarest tokens of each name."""
    t = names.select("n", length.alias("keep"), F.explode(tokens).alias("token"))
    t = t.join(freq, "token", "left")
    w = Window.partitionBy("n").orderBy(F.coalesce("df", F.lit(0)), "token")
    return t.withColumn("r", F.row_number().over(w)).where("r <= keep").select("n", "token")


VARIANTS = 600  # ways to delete characters of a name that are always followed
MOST = 20_000  # and at most, where names are many
CELLS = 1 << 20  # characters of such variants hashed at once
ROUND_KEYS = 50_000_000  # variants that are shuffled at once
ROUNDS = 32  # and in how many goes at most
FEW_KEYS = 1_000_000  # up to so many variants no other way is looked for


def _halves(la: int, lb: int, m: int) -> tuple[set, set]:
    """What two names with a common subsequence of ``m`` characters share of their beginnings
    or ends: (side, k, la, start, stop), any ``k`` characters between ``start`` and ``stop``.

    Cut the first name in two, the second where the common subsequence passes the cut. Of the
    characters left out of both, at most half lie before the cut, or less than half after it.
    """
    da, db, h = la - m, lb - m, la // 2
    most = (da + db) // 2
    a, b = set(), set()
    for side, size, edits in ((1, h, most), (2, la - h, da + db - most - 1)):
        for x in range(min(da, edits, size - 1) + 1):
            k = size - x
            reach = min(lb, k + min(db, edits - x))
            a.add((side, k, la, 0, size) if side == 1 else (side, k, la, la - size, la))
            b.add((side, k, la, 0, reach) if side == 1 else (side, k, la, lb - reach, lb))
    if min(h, la - h) - min(da, most) < 1:
        return set(), set()  # nothing would be left to share
    return a, b


def _ways(spec: int | tuple, size: int) -> int:
    """Number of variants of a name: all of so many characters, or of a part of it."""
    return math.comb(size, spec) if isinstance(spec, int) else math.comb(spec[4] - spec[3], spec[1])


def _classes(left: dict[int, int], right: dict[int, int], threshold: float, alike: tuple[Callable, Callable] | None = None) -> tuple[dict, set, set]:
    """(variants of names by side and length, length pairs they find, other pairs that may reach the ratio),
    of the number of names of each length and of the share of pairs that have so many characters
    at the start, and at the end, in common."""
    keep: tuple[dict, dict] = ({}, {})
    done, rest = set(), set()
    for la, lb in sorted(itertools.product(left, right), key=lambda p: (-left[p[0]] * right[p[1]], p)):
        m = next((m for m in range(1, min(la, lb) + 1) if 2.0 * m / (la + lb) >= threshold), None)
        if m is None:
            continue
        ways = math.comb(la, m), math.comb(lb, m)
        # A pair of names costs about as much by tokens as one way; ways followed for other lengths cost nothing.
        more = lambda specs: sum(n * _ways(s, size) for n, size, i in ((left[la], la, 0), (right[lb], lb, 1))
                                 for s in specs[i] if s not in keep[i].get(size, ()))
        extra = more(({m}, {m}))
        cheaper = extra < left[la] * right[lb]
        whole = max(ways) <= (MOST if cheaper else VARIANTS)
        parts = _halves(la, lb, m) if alike and extra > FEW_KEYS and max(ways) > VARIANTS else (set(), set())
        if parts[0]:
            chance = sum(_ways(x, la) * _ways(y, lb) * alike[x[0] - 1](x[1])
                         for x in parts[0] for y in parts[1] if x[:2] == y[:2])
            if more(parts) + 2 * left[la] * right[lb] * chance < (extra if whole else left[la] * right[lb]):
                done.add((la, lb))
                keep[0].setdefault(la, set()).update(parts[0])
                keep[1].setdefault(lb, set()).update(parts[1])
                continue
        if not whole:
            rest.add((la, lb))
            continue
        done.add((la, lb))
        keep[0].setdefault(la, set()).add(m)
        keep[1].setdefault(lb, set()).add(m)
    return keep, done, rest


def _alike(sides: list[DataFrame], lengths: list[dict[int, int]], threshold: float) -> tuple[Callable, Callable]:
    """For starts and for ends of names: share of the pairs that have as many characters there in
    common. The larger of two guesses: characters of each place on their own, or all together."""
    pairs = [(la, lb, next((m for m in range(1, min(la, lb) + 1) if 2.0 * m / (la + lb) >= threshold), None)) for la, lb in itertools.product(*lengths)]
    sizes = sorted({x[1] for la, lb, m in pairs if m for x in _halves(la, lb, m)[0]})
    numbers = F.array(*map(F.lit, sizes)).cast("array<int>")

    def guess(text: Column) -> Callable:
        pieces = F.concat(
            F.transform(F.sequence(F.lit(1), F.least(F.length("n"), F.lit(max(sizes)))), lambda i: F.struct((-i).alias("at"), F.substring(text, i, F.lit(1)).alias("c"))),
            F.transform(F.filter(numbers, lambda k: k <= F.length("n")), lambda k: F.struct(k.alias("at"), F.substring(text, F.lit(1), k).alias("c"))))

        def counted(df: DataFrame, name: str) -> DataFrame:
            return df.select(F.explode(pieces).alias("p")).groupBy("p.at", "p.c").agg(F.count("*").alias(name))

        x, y = (counted(s, name) for s, name in zip(sides, "xy"))
        found = x.join(y.hint("merge"), ["at", "c"]).groupBy("at").agg(F.sum(F.col("x").cast("double") * F.col("y"))).collect()  # a row a place
        both = math.prod(sum(c.values()) for c in lengths)
        share = {at: n / both for at, n in found}
        return lambda k: max(math.prod(share.get(-i, 0.0) for i in range(1, k + 1)), share.get(k, 0.0))

    return tuple(guess(text) if sizes else lambda k: 1.0 for text in (F.col("n"), F.reverse("n")))


def _left_overs(names: DataFrame, keep: dict[int, set], go: tuple[int, int] = (0, 1)) -> DataFrame:
    """(n, key): a hash of each subsequence that ``keep`` holds for the name's length: all of so
    many characters, or of so many in a part of it. ``go`` (i, n): only the i-th of n shares of the hashes."""
    # The same for both sides of a join, whatever lengths they have.
    weights = np.random.default_rng(1).integers(1, 2**63, max(keep, default=0) + 1, dtype=np.uint64)
    share, shares = map(np.uint64, go)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = {}
        for size, specs in keep.items():
            specs = sorted((0, s, 0, 0, size) if isinstance(s, int) else s for s in specs)
            chosen[size] = [((la << 4) + side, np.array([*itertools.combinations(range(start, stop), k)])) for side, k, la, start, stop in specs]
        for batch in batches:
            names = batch.column(0)
            lengths = pc.utf8_length(names).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths).tolist():
                group = names.filter(pa.array(lengths == size))
                step = max(1, CELLS // sum(c.size for _, c in chosen[size]))
                for i in range(0, len(group), step):
                    part = group.slice(i, step)
                    codes = np.array(part.to_pylist(), dtype=f"<U{size}").view(np.uint32).reshape(len(part), size).astype(np.uint64)
                    keys = [(codes[:, c] * weights[1 : c.shape[1] + 1]).sum(axis=2) + weights[0] * np.uint64(c.shape[1] + (mark << 20)) for mark, c in chosen[size]]
                    keys = np.sort(np.concatenate(keys, axis=1), axis=1)
                    mine = (keys >> np.uint64(7)) % shares == share
                    mine[:, 1:] &= keys[:, 1:] != keys[:, :-1]
                    ends = np.concatenate([[0], np.cumsum(mine.sum(axis=1))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[mine].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([part, lists], names=["n", "keys"])

    found = spread(names.select("n").where(F.length("n").isin(*keep))).mapInArrow(run, "n string, keys array<bigint>")
    return found.select("n", F.explode("keys").alias("key"))


def ratio_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, ratio) of names with ratio >= threshold, for threshold > 2/3.

    With M >= t(a+b)/2 and at most a+b-2M gaps, the names share at least
    (1.5t-1)(a+b) - 1 two-letter grams. Where that promises none (short names),
    single characters are used instead. Variants are made and joined in several goes,
    each with a share of their hashes, so that only a share is on disk at a time.
    """
    if threshold <= 2 / 3:
        raise ValueError("the gram filter needs a threshold above 2/3")
    grow = threshold / (2 - threshold)  # shortest partner per length
    gain = (1.5 * threshold - 1) * (1 + grow)
    short = math.floor(1 / gain + 1e-9)  # up to here no shared gram is certain
    near_short = math.floor(short / grow + 1e-9)

    # Ratios ignore case, so spelling variants share one candidate search.
    sides = [stored(df.select(F.lower("name").alias("n")).where(F.length("n") > 0).distinct()) for df in (left, right)]
    n = F.col("n")
    size = F.length(n)
    la, lb = F.length("a"), F.length("b")
    close = (2 * F.least(la, lb) >= threshold * (la + lb) - 1e-9) & within_edits(F.col("a"), F.col("b"), F.lit(threshold))
    lengths = [dict(s.groupBy(size).count().collect()) for s in sides]  # a few numbers
    keep, done, rest = _classes(*lengths, threshold)
    total = lambda keep: sum(c[k] * _ways(s, k) for c, ks in zip(lengths, keep) for k, specs in ks.items() for s in specs)
    if total(keep) > FEW_KEYS:
        keep, done, rest = _classes(*lengths, threshold, _alike(sides, lengths, threshold))
    found = [left.select(F.lower("name").alias("a"), F.lower("name").alias("b")).where("false")]
    goes = min(ROUNDS, math.ceil(total(keep) / ROUND_KEYS)) if done else 0
    for i in range(goes):
        a, b = (_left_overs(s, k, (i, goes)).withColumnRenamed("n", c) for s, k, c in zip(sides, keep, "ab"))
        met = a.join(b.hint("merge"), "key").where(close).select("a", "b")
        found.append(met if goes == 1 else cut_lineage(met.distinct()))
    open_pair = F.concat_ws("-", la, lb).isin(*[f"{x}-{y}" for x, y in sorted(rest)])
    sides = [s.where(size.isin(*{p[i] for p in rest})) for i, s in enumerate(sides)]
    for kind in ("gram", "char") if rest else ():
        tokens = gram_tokens(n) if kind == "gram" else char_tokens(n)
        if kind == "gram":
            sure = F.ceil(size * gain - 1e-9) - 1
            keep = size - 1 - sure + 1
            parts = [s.where(size > short) for s in sides]
        else:
            sure = F.ceil(size * grow - 1e-9)
            keep = size - sure + 1
            parts = [s.where(size <= near_short) for s in sides]
        freq = parts[1].select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        a = _prefix(parts[0], freq, tokens, keep).withColumnRenamed("n", "a")
        b = _prefix(parts[1], freq, tokens, keep).withColumnRenamed("n", "b")
        pairs = a.join(b.hint("merge"), "token").where(open_pair & close)
        if kind == "char":
            pairs = pairs.where(F.least(la, lb) <= short)
        found.append(pairs.select("a", "b"))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    scored = spread(pairs).withColumn("ratio", match_ratio_from("a", "b", F.lit(threshold))).where(F.col("ratio") >= threshold)
    low = scored.withColumnsRenamed({"a": "low_a", "b": "low_b"})
    x = left.select(F.col("name").alias("a"), F.lower("name").alias("low_a")).distinct()
    y = right.select(F.col("name").alias("b"), F.lower("name").alias("low_b")).distinct()
    # names are many, whatever Spark expects of them: neither side of a join is sent whole
    return low.join(x.hint("merge"), "low_a").join(y.hint("merge"), "low_b").select("a", "b", "ratio")


def within_edits(a: Column, b: Column, ratio: Column) -> Column:
    """Cheap necessary test: M matched characters leave at most a + b - 2M edits."""
    return F.levenshtein(a, b) <= (1 - ratio) * (F.length(a) + F.length(b)) + 1e-9


def spread(df: DataFrame) -> DataFrame:
    """Even parts for heavy per-row work, which small byte sizes would put into
    one task: as many as the session plans for a shuffle. Not meant for the
    inputs of a join, whose exchanges Spark splits itself when a key is hot."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def parameters(signature: Column) -> Column:
    """Distinct parameter names of a signature without ``self``."""
    inner = F.regexp_extract(signature, r"\((.*?)\)", 1)
    names = F.transform(F.split(inner, ","), lambda p: F.trim(F.split_part(F.trim(p), F.lit(":"), F.lit(1))))
    return F.array_distinct(F.filter(names, lambda p: (p != "") & (p != "self")))


def similar_functions(functions: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of functions, earlier one first by (path, line), scored
    0.5 name ratio + 0.3 parameter overlap + 0.2 place (1 same file, 0.5 same
    package), above ``threshold``.

    What the place is worth bounds the rest, so three joins find all pairs:
    same file needs a common parameter (or none on both sides); at 0.7, same package
    needs a ratio over 0.6 and overlap over 1/3, elsewhere a ratio over 0.8 and
    overlap over 2/3.
    """
    if not 0.7 <= threshold < 1:
        raise ValueError("below 0.7 functions without a common parameter could pass, which no join here finds")
    alike = lambda place: (threshold - 0.3 - 0.2 * place) / 0.5  # noqa: E731  name ratio the other two parts leave
    seg = F.split_part("file_path", F.lit("/"), F.lit(1))
    f = functions.select(
        "name", "file_path", "line_number", seg.alias("seg"), F.lower("name").alias("low"), parameters(F.col("signature")).alias("params"))
    params = F.when(F.size("params") == 0, F.array(F.lit(""))).otherwise(F.col("params"))
    side = lambda df, mark: df.select(*[F.col(c).alias(f"{mark}_{c}") for c in df.columns])
    earlier = F.struct("x_file_path", "x_line_number", "x_name") < F.struct("y_file_path", "y_line_number", "y_name")

    same_file = f.withColumn("p", F.explode(params))
    x, y = side(same_file, "x"), side(same_file, "y")
    ratio_over = lambda r: 2 * F.least(F.length("x_low"), F.length("y_low")) > r * (F.length("x_low") + F.length("y_low"))
    a = x.join(y, (F.col("x_file_path") == F.col("y_file_path")) & (F.col("x_p") == F.col("y_p")) & earlier & ratio_over(alike(1.0)))

    # Same package: the rarest characters of the name, with a common parameter.
    t = alike(0.5)
    chars = char_tokens(F.col("low"))
    freq = f.select("seg", F.explode(chars).alias("token")).groupBy("seg", "token").agg(F.count("*").alias("df"))
    toks = f.withColumn("keep", F.length("low") - F.ceil(F.length("low") * (t / (2 - t)) - 1e-9) + 1)
    toks = toks.withColumn("token", F.explode(chars)).join(freq, ["seg", "token"])
    w = Window.partitionBy("name", "file_path", "line_number").orderBy("df", "token")
    toks = toks.withColumn("r", F.row_number().over(w)).where("r <= keep").drop("df", "r", "keep").withColumn("p", F.explode(params))
    x, y = side(toks, "x"), side(toks, "y")
    b = x.join(y, (F.col("x_seg") == F.col("y_seg")) & (F.col("x_token") == F.col("y_token")) & (F.col("x_p") == F.col("y_p"))
               & (F.col("x_file_path") != F.col("y_file_path")) & earlier & ratio_over(t))

    names = ratio_join(f.select("name"), f.select("name"), alike(0.0) - 1e-9)
    x, y = side(f, "x"), side(f, "y")
    c = names.join(x, F.col("a") == F.col("x_name")).join(y, F.col("b") == F.col("y_name"))
    c = c.where((F.col("x_seg") != F.col("y_seg")) & earlier)

    cols = [*x.columns, *y.columns]
    jaccard = F.size(F.array_intersect("x_params", "y_params")) / F.size(F.array_union("x_params", "y_params"))
    overlap = F.when((F.size("x_params") == 0) & (F.size("y_params") == 0), 1.0).when(
        (F.size("x_params") == 0) | (F.size("y_params") == 0), 0.0).otherwise(jaccard)
    place = F.when(F.col("x_file_path") == F.col("y_file_path"), 1.0).when(F.col("x_seg") == F.col("y_seg"), 0.5).otherwise(0.0)
    # The ratio the other two parts leave to be reached, then the cheap test.
    least = (threshold - F.col("overlap") * 0.3 - F.col("place") * 0.2) / 0.5
    scored = [
        df.select(*cols).withColumns({"overlap": overlap, "place": place}).where(
            (least < 1) & within_edits(F.col("x_low"), F.col("y_low"), least))
        for df in (a, b, c)
    ]
    keep = ["x_name", "y_name", "x_file_path", "x_line_number", "y_file_path", "y_line_number", "overlap", "place"]
    pairs = scored[0].unionByName(scored[1]).unionByName(scored[2]).select(*keep).distinct()
    score = match_ratio_from("x_name", "y_name", least) * 0.5 + F.col("overlap") * 0.3 + F.col("place") * 0.2
    pairs = spread(pairs)
    out = pairs.withColumn("similarity", score).where(F.col("similarity") > threshold)
    return out.select(F.col("x_name").alias("function"), F.col("y_name").alias("similar"), "similarity")
