"""Combining relevance with link scores (survey V6-V9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_max(df: DataFrame, column: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """V7: scaled to 0..1 over the whole table (or per key); 0 throughout if the range is below 1e-12.

    The limits are an aggregate joined back, so no task sees all rows."""
    limits = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    joined = df.join(limits, list(keys)) if keys else df.crossJoin(F.broadcast(limits))
    width = F.col("_hi") - F.col("_lo")
    return joined.withColumn(out, F.when(width < 1e-12, 0.0).otherwise((F.col(column) - F.col("_lo")) / F.when(width < 1e-12, 1.0).otherwise(width))).drop("_lo", "_hi")


def blend(relevance: DataFrame, link: DataFrame, alpha: float = 0.7, keys: tuple[str, ...] = ()) -> DataFrame:
    """V6: doc_id, blended_score over the union of both sides; each is scaled over its own rows, a missing one is 0."""
    a = min_max(relevance, "relevance_score", "_rel", keys).select(*keys, "doc_id", "_rel")
    b = min_max(link, "link_score", "_link").select("doc_id", "_link")
    both = a.join(b, "doc_id", "full")
    return both.select(*keys, "doc_id", (alpha * F.coalesce("_rel", F.lit(0.0)) + (1 - alpha) * F.coalesce("_link", F.lit(0.0))).alias("blended_score"))


def rerank(results: DataFrame, link: DataFrame, alpha: float = 0.7, dp: int = 10) -> DataFrame:
    """V8: qid, doc_id, relevance_score, link_score_raw, blended_score, old_rank, new_rank, rank_change.

    Link scores are scaled over all documents, relevance over each query's results."""
    rel = min_max(results, "relevance_score", "_rel", ("qid",))
    scaled = min_max(link, "link_score", "_link")
    out = rel.join(scaled, "doc_id", "left").withColumn("blended_score", alpha * F.col("_rel") + (1 - alpha) * F.coalesce("_link", F.lit(0.0)))

    def place(column: str) -> Column:
        return F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(column), "doc_id"))

    ranked = out.withColumn("blended_score", F.round("blended_score", dp)).withColumn("old_rank", place("relevance_score")).withColumn("new_rank", place("blended_score"))
    return ranked.select("qid", "doc_id", "relevance_score", F.coalesce("link_score", F.lit(0.0)).alias("link_score_raw"), "blended_score", "old_rank", "new_rank", (F.col("old_rank") - F.col("new_rank")).alias("rank_change"))


def link_scores_by_doc(scores: DataFrame, pages: DataFrame) -> DataFrame:
    """V9: doc_id, link_score, summed over a document's URLs."""
    return pages.filter(F.col("doc_id").isNotNull()).select("url", "doc_id").join(scores.withColumnRenamed("node", "url"), "url").groupBy("doc_id").agg(F.sum("score").alias("link_score"))
