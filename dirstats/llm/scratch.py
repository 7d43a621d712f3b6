"""Shared folder for tables that cut lineage, and sizes that decide how many blocks a job uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python task holds at a time.
BLOCK_BYTES = 12 * 1024 * 1024


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a folder given to
    setCheckpointDir, or on a single machine a temporary one of its own."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later steps start from its files, so a lost
    executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks of about block_bytes that the texts fill."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // block_bytes))
