"""Incremental corpus growth as a stream: pages are appended once per content hash and merged by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators.corpus import merge
from textloom.sources.io import _exists


def fresh_pages(pages: DataFrame, time_col: str, late: str = "1 day") -> DataFrame:
    """The first page of each content hash within the watermark; the state of older hashes is dropped."""
    hashed = pages.withColumn("content_hash", X.content_hash(F.col("text")))
    return hashed.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["content_hash"])


def merge_stream(pages: DataFrame, path: str, checkpoint: str, key: str = "id", once: bool = True) -> StreamingQuery:
    """Merges each micro-batch into the table at path; rows already there win, so a replayed batch changes nothing.

    A batch is merged into the next of two alternating folders and a pointer names the current one, as a
    table cannot be overwritten while it is read."""

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now, new = f"{path}/v{(batch_id + 1) % 2}", f"{path}/v{batch_id % 2}"
        whole = merge(spark.read.parquet(now), batch, key) if batch_id and _exists(spark, now) else merge(batch.limit(0), batch, key)
        whole.write.mode("overwrite").parquet(new)
        spark.createDataFrame([(f"v{batch_id % 2}",)], "current string").coalesce(1).write.mode("overwrite").json(f"{path}/pointer")

    writer = pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark, path: str) -> DataFrame:
    """The merged table."""
    return spark.read.parquet(f"{path}/{spark.read.json(f'{path}/pointer').first()['current']}")
