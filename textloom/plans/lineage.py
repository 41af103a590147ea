"""Cutting lineage in driver loops, in a way that survives the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder is made only where the session names none, as in tests."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, removed at exit."""
    path = f"{_shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder.

    Unlike a checkpointed plan, it is planned by its true size: the estimates of plans that
    join with themselves round after round would grow without end."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Removes the table of a ``cut`` result that no pending plan reads."""
    path = getattr(df, "_textloom_path", None)
    if path:
        _remove(df.sparkSession, path)
