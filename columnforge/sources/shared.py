"""Files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidError

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only in local mode, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise InvalidError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="columnforge-")
    return shared_dir.own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the program ends."""
    path = f"{shared_dir(spark)}/columnforge/{uuid.uuid4().hex}-{name}"
    if not _made:
        atexit.register(_clean)
    _made.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_made) if spark else ():
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already
            return
