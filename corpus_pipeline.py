"""Corpus cleaning in five stages: quality rules, line dedup, near-duplicate documents, secrets, packing.

Each stage takes the documents that its predecessor kept and returns documents with the same columns; the last returns
the pieces of the packed sequences. Null, empty and very long texts, repeated rows and empty tables have the results
that the stages' operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from captionforge.llm import jaccard, lines, packing, quality, secrets
from captionforge.llm.common import keep


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere before; those with no line left go."""
    return lines.dedup(docs, drop_emptied=True)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one(docs)


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with live secrets replaced by a mark."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.packed_digests(docs)


STAGES = [("quality rules", good), ("line dedup", fresh_lines), ("n-gram Jaccard join", distinct), ("secret scans", safe), ("packing", packed)]
ORACLE_SQL = None  # edit-distance groups and the tokenizer have no SQL; a test compares the whole with its stages in plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
