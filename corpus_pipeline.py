"""The corpus pipeline: quality rules, near copies, decontamination, secrets, mixing.

Every stage takes the whole output of the one before it; run() writes each as Parquet under the
shared work folder and reads it again. All stages but the last return the columns that they got.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlark.llm import decontam, mixing, ngram_join, quality_rules, secrets  # noqa: E402
from ledgerlark.llm.common import table  # noqa: E402
from ledgerlark.operators.common import stored  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, furniture lines removed and n_chars set anew where that changed the text."""
    return quality_rules.keep(docs, n_chars="n_chars")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies, that with the least id."""
    return ngram_join.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of a benchmark item."""
    return decontam.drop(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in the text and n_chars set anew where that changed it."""
    return secrets.redact(docs, n_chars="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with `copies`, how often."""
    return mixing.take(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_copies", near_copies),
    ("decontamination", clean),
    ("secret_scan", masked),
    ("mixing", mix),
]
#: near copies come from hashes that SQL does not have; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
