"""Where a plan cuts its lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a session with a local master may go without and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or _own_folder()).rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, so that later steps don't repeat it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
