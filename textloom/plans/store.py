"""Tables that are built once from an input and read by many queries.

A build is written to the shared folder. It is known by the input's path, size and time of change and by its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans.lineage import cut, new_path

def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed at exit."""
    return new_path(spark, name)


_built: dict[tuple, DataFrame] = {}


def _version(spark: SparkSession, path: str) -> tuple[int, int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def _key(spark: SparkSession, source: str, name: str) -> tuple:
    return spark.sparkContext.applicationId, source, _version(spark, source), name


def built(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives for the input at ``source``, written at its first use."""
    key = _key(spark, source, name)
    if key not in _built:
        _built[key] = cut(build())
    return _built[key]


_facts: dict[tuple, bool] = {}


def fact(spark: SparkSession, source: str, name: str, find: Callable[[], bool]) -> bool:
    """What ``find`` says of the input at ``source``, asked once."""
    key = _key(spark, source, name)
    if key not in _facts:
        _facts[key] = find()
    return _facts[key]
