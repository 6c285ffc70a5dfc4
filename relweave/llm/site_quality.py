"""Document quality by hierarchical empirical Bayes.

A logistic regression on counted traits of the whole text gives each document its
own evidence. Hosts and their paths collect that evidence by grouped aggregation;
a host's rate is shrunk towards the corpus rate and a path's rate towards its
host's, by strengths that the corpus itself shows (method of moments), so a site
with few documents says little. A document's posterior is its evidence moved, on
the logit scale, by how far its path stands from the corpus rate; its own share
of the site's evidence is left out of that.

Edge cases: NULL and empty texts have zero traits and are judged like any others;
NULL hosts and paths are groups of their own; labels that are NULL or name no
document are ignored, repeated labels count each; with no labels or one class
only the evidence is that class's rate (one half without any); an empty corpus
gives no rows; repeated documents count each; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.runtime import cut_lineage

TRAITS = (
    "log_words symbols shouts bars upper distinct long_words digits repeats"
    " dup_lines line_ends single_letters"
).split()
#: Bounds of a shrinkage strength, in documents.
STRENGTH = (1.0, 1e6)
_MARKS = re.compile(r"[!?]{2,}")
_DIGITS = re.compile(r"[0-9]+")


def traits_of(text: str | None) -> list[float]:
    """Traits of one text, in the order of TRAITS; rates per word or line, at most 3."""
    import math

    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(TRAITS)
    per = lambda count, of=n: min(3.0, count / of)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n),
        per(sum(map(text.count, "#*$%&<>"))),
        per(len(_MARKS.findall(text))),
        per(text.count("|")),
        per(sum(map(str.isupper, words))),
        len(set(words)) / n,
        min(3.0, (len(text) - n) / n / 10),
        per(len(_DIGITS.findall(text))),
        per(sum(map(str.__eq__, words, words[1:]))),
        (len(lines) - len(set(lines))) / len(lines),
        sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / len(lines),
        per(sum(map((1).__eq__, map(len, words)))),
    ]


def traits(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, x array<double>)."""
    measure = traits_of

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = pa.array([measure(t.as_py()) for t in batch.column(3)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), x], names=["doc_id", "host", "path", "x"])

    site = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))  # noqa: E731  NULL apart from ''
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), site(host).alias("host"), site(path).alias("path"), F.col("text").cast("string")
    )
    return rows.mapInArrow(run, "doc_id long, host string, path string, x array<double>")


def fit(measured: DataFrame, labels: DataFrame) -> tuple[list[float], float]:
    """Coefficients and intercept from all labelled documents (doc_id, quality 0/1)."""
    import math

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    known = labels.select(F.col("doc_id").alias("d"), F.col("quality").cast("double").alias("label")).dropna()
    rows = cut_lineage(measured.join(known, F.col("doc_id") == F.col("d")).select("label", array_to_vector("x").alias("features")))
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, n):
        rate = (good + 0.5) / (n + 1)
        return [0.0] * len(TRAITS), math.log(rate / (1 - rate))
    model = LogisticRegression(maxIter=40, regParam=1e-4).fit(rows)
    return [float(c) for c in model.coefficients], float(model.intercept)


def _logit(p: Column) -> Column:
    safe = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(safe / (1 - safe))


def _strength(groups: DataFrame, n: str, s: str, centre: Column) -> float:
    """Prior documents that the spread of group rates around ``centre`` speaks for."""
    rate = F.col(s) / F.col(n)
    spread, weight, noise, pairs = groups.where(F.col(n) > 1).agg(
        F.sum(F.col(n) * (rate - centre) ** 2), F.sum(n), F.sum(centre * (1 - centre)), F.sum(F.col(n) * centre * (1 - centre))
    ).first()
    if not weight or not pairs:
        return STRENGTH[1]
    between = (spread - noise) / weight  # variance beyond what counting alone gives
    if between <= 0:
        return STRENGTH[1]
    return min(STRENGTH[1], max(STRENGTH[0], pairs / weight / between - 1))


def posteriors(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, posterior, keep) of every document."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    measured = cut_lineage(traits(docs, host, path))
    weights, intercept = fit(measured, labels)
    z = F.lit(intercept)
    for i, w in enumerate(weights):
        z = z + F.lit(w) * F.col("x")[i]
    seen = cut_lineage(measured.select("doc_id", "host", "path", (1 / (1 + F.exp(-z))).alias("e")))
    paths = cut_lineage(seen.groupBy("host", "path").agg(F.count("*").alias("np"), F.sum("e").alias("sp")))
    hosts = paths.groupBy("host").agg(F.sum("np").alias("nh"), F.sum("sp").alias("sh"))
    n, s = paths.agg(F.sum("np"), F.sum("sp")).first()
    mean = s / n if n else 0.5
    by_host = _strength(hosts, "nh", "sh", F.lit(mean))
    sites = paths.join(hosts, "host")
    by_path = _strength(sites, "np", "sp", (by_host * mean + F.col("sh")) / (by_host + F.col("nh")))
    e = F.col("e")
    host_rate = (by_host * mean + F.greatest(F.lit(0.0), F.col("sh") - e)) / (by_host + F.col("nh") - 1)
    path_rate = (by_path * F.col("host_rate") + F.greatest(F.lit(0.0), F.col("sp") - e)) / (by_path + F.col("np") - 1)
    moved = _logit(e) + _logit(F.col("path_rate")) - _logit(F.lit(mean))
    return (
        seen.join(sites, ["host", "path"])
        .withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("posterior", 1 / (1 + F.exp(-moved)))
        .select("doc_id", e.alias("evidence"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= 0.5).alias("keep"))
    )
