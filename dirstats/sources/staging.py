"""Written intermediate tables.

A staged table cuts lineage the way ``checkpoint()`` does but stays columnar, so
later reads still prune columns and push filters. It lives in the shared folder
named by ``spark.checkpoint.dir``; only a local master without that setting gets
a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_lock = threading.RLock()
_local_root: str | None = None
_staged: dict[tuple[str, str], tuple[str, StructType]] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for staged tables, valid on every executor."""
    context = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="dirstats-")
    return _local_root


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/dirstats-{label}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table.

    The planner knows a written table's size, so joins with it are broadcast or
    shuffled by measured bytes.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_once(
    spark: SparkSession, key: str, label: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Like :func:`write_stage`, but a second call in one application reuses the table."""
    slot = (spark.sparkContext.applicationId, key)
    with _lock:
        if slot not in _staged:
            path = new_path(spark, label)
            built = build()
            built.write.mode("errorifexists").parquet(path)
            _staged[slot] = path, built.schema
        path, schema = _staged[slot]
    return spark.read.schema(schema).parquet(path)
