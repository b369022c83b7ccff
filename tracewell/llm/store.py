"""Where stages write what later stages read again."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    A local session without the setting (a test) gets a temporary folder of this
    process; on a cluster that would lose data, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (spark.conf.get("spark.master", None) or "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or _own_folder()).rstrip("/")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def free_name(columns: list[str], name: str) -> str:
    """name, or the first of name_1, name_2 ... that isn't among the columns (in any case of letters)."""
    taken, n, out = {c.lower() for c in columns}, 0, name
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: later stages don't repeat it, and lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
