"""Files in the shared folder, and the size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.shared import new_path, remove, shared_dir, stage

__all__ = ["new_path", "remove", "shared_dir", "small_batches", "stage"]


def small_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Let Arrow batches hold at most `limit` bytes, so that a worker's memory does not follow its texts' lengths."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= limit:
        spark.conf.set(key, str(limit))
