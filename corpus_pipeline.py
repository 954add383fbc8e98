"""From raw documents to a training mix, in stages that each run over what the last kept.

Every stage is written to the shared folder as Parquet and read back for the next. All
but the last return the columns of ``documents``; the last adds how often a document is
taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotwatch.llm.common import stage, table
from slotwatch.llm.decontaminate import clean
from slotwatch.llm.mixing import mixed_documents
from slotwatch.llm.near_dups import keep_one
from slotwatch.llm.pii import redact
from slotwatch.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the network calls toxic go; null and empty texts stay unless most labels are toxic."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; ``mix_copies`` says how often a document stands in the mix."""
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dups", near_dups),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("mixing", mix_sources),
]

# Hashing and trained models have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, make in STAGES[:-1]:
        docs = stage(make(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
