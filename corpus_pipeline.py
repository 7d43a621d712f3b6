"""A training corpus from raw documents, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirstats.llm import decontaminate, jaccard_join, mixing, quality_rules, secret_ledger
from dirstats.llm.queries import table
from dirstats.llm.scratch import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one row stays, that with the least doc_id; rows without an
    id are compared like all others."""
    return jaccard_join.distinct_texts(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean_of(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are overwritten; every document stays."""
    return secret_ledger.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, with the rate at which it does."""
    found = mixing.mix(docs, table(spark, sf_dir, "labels"), MIX)
    return mixing.draw(found, found.columns[-1])


#: Shares of the mix. The quality rules leave no poor documents from which a share could be drawn.
MIX = {"good": 0.95, "toxic": 0.05}

STAGES = [
    ("quality rules", rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("mixing to target weights", mixed),
]

#: Neither the link components nor the fitted rates can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
