"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import line_rules, mixing, passages, pieces, simhash
from relweave.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the line rules keep, without their failing lines."""
    judged = line_rules.cleaned(docs).where("q_kept")
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    kept = judged.select(*columns, F.col("q_text").alias("text"))
    return _in_order(kept, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles alike by 0.8 or more."""
    return simhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document of smaller id keeps."""
    return _in_order(passages.cleaned(docs), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, their digest and that of the decoded text."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


def _in_order(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars following the text."""
    size = F.length("text").cast("long")
    return changed.select(*[(size.alias(c) if c == "n_chars" else F.col(f"`{c}`")) for c in docs.columns])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix", mix),
    ("encode", encode),
]

#: No stage but the first counts is within SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
