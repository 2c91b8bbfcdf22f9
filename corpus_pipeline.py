"""Corpus pipeline: toxic documents go, boilerplate lines go, one of each near-duplicate group stays, documents with benchmark
passages go, and what is left becomes token ids.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and but for the last returns the columns of
``documents``. Nulls, empty texts, repeated rows, empty tables and further columns are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crosslane.llm.bpe import encode_and_check, vocabulary_path
from crosslane.llm.common import scratch, table
from crosslane.llm.decontaminate import remove_contamination
from crosslane.llm.line_dedup import remove_boilerplate
from crosslane.llm.minhash import drop_near_duplicates
from crosslane.llm.toxicity import fit, remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the network learns from the labelled rows that are not held out."""
    return remove_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on five or more sources, counted over one copy of a page, are cut whatever their share; every document stays."""
    return remove_boilerplate(docs, max_share=None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the one with the smallest doc_id stays; other texts
    under the same id or none stay too."""
    return drop_near_duplicates(docs, one_per_id=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten benchmark words go."""
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text decoded from the ids."""
    return encode_and_check(docs, vocabulary_path())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# SQL cannot express the network of the first stage; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
