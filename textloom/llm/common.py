"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else.

    ``lower`` does just that on pure ASCII, which is where the lengths in code
    points and in bytes agree; other texts take the slower ``translate``.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fresh_names(wanted: tuple[str, ...], taken: list[str]) -> tuple[str, ...]:
    """The wanted column names, each with underscores before it as long as it is taken."""
    own = {x.lower() for x in taken}
    out = []
    for name in wanted:
        while name.lower() in own:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_textloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._textloom_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with this package importable in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder in order to cut lineage.

    A written table survives the loss of executors, unlike their local blocks.
    ``drop`` removes tables that no pending plan reads; the rest go at exit.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop, "")

    def path(self, label: str) -> str:
        return f"{self.base}/{label}"

    def keep(self, df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write df and return it as read back."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def drop(self, *labels: str) -> None:
        try:
            for label in labels:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(label).rstrip("/"))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; its shared folder goes with it
            if labels != ("",):
                raise


def row_marker() -> Column:
    """A long that no other row has. It is the same each time the input is read in the same partitions, as files and
    written tables are; an input that deals its rows anew each time must be written first."""
    return F.monotonically_increasing_id()


#: A group is hot if it has more than this part of all rows; so fewer groups than this can be.
HOT_PARTS, LEAST_HOT = 1000, 10_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows with the columns of their groups (one row per key; column ``size``: the number of rows that have it).

    The rows of hot groups stay where they are and the groups, ``HOT_PARTS`` at most, are broadcast; the other rows are
    shuffled by key. Both tables are read twice, so they should be written ones."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(LEAST_HOT, total // HOT_PARTS)
    hot = groups.filter(F.col(size) > least)
    if hot.isEmpty():
        return rows.join(groups, keys)
    one = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return one.unionByName(others.join(groups.filter(F.col(size) <= least), keys))


def bounded_sample(ids: DataFrame, id_col: str, most: int, group_col: str | None = None) -> DataFrame:
    """At most ``most`` distinct non-null ids (of each group), those of the smallest hashes: columns id, and group if asked for.

    A limit on the hash, from an approximate count of the distinct ids, leaves a few times ``most`` of them; only these
    are ranked, so that no task's rows grow with the table. The groups must be few enough for a row each to be broadcast, as
    languages are, of each of which the caller holds a model."""
    group = F.col(group_col) if group_col else F.lit(0)
    rows = ids.select(F.col(id_col).alias("id"), group.alias("group")).filter("id IS NOT NULL AND group IS NOT NULL")
    rows = rows.withColumn("at", F.xxhash64("id"))
    sizes = rows.groupBy("group").agg(F.approx_count_distinct("id").alias("n"))
    sizes = sizes.select("group", ((4.0 * most + 100) / F.col("n")).alias("share"))
    near = rows.join(F.broadcast(sizes), "group").filter((F.col("at") / 2.0**64 + 0.5) <= F.col("share"))
    first = Window.partitionBy("group").orderBy("at", "id")
    chosen = near.select("id", "group", "at").distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= most)
    return chosen.select("id", "group") if group_col else chosen.select("id")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
