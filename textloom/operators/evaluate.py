"""Evaluation of ranked lists (survey E1-E10). All queries and methods are scored in one plan.

runs: method, qid, rank, doc_id. qrels: qid, doc_id. Metrics of a query without results are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.corpus import mentions_any

METRICS = ("precision", "recall", "f1", "precision_at_k", "recall_at_k", "average_precision", "reciprocal_rank", "ndcg_at_k")


def judgements(docs: DataFrame, seeds: list[tuple[str, str]], min_relevant: int = 3) -> DataFrame:
    """Qid, category, doc_id: a document of the query's category that contains any query term is relevant.

    One scan tests all seeds; queries with too few relevant documents are left out (F9)."""
    marks = F.array(*(F.when((F.col("category") == c) & mentions_any(F.col("text"), q.lower().split()), F.struct(F.lit(q).alias("qid"), F.lit(c).alias("category"))) for q, c in seeds))
    hits = docs.select("doc_id", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).select("m.qid", "m.category", "doc_id")
    enough = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_relevant).select("qid")
    return hits.join(F.broadcast(enough), "qid", "left_semi")


def evaluate(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Method, qid and the eight metrics, rounded to four places."""
    relevant = qrels.select("qid", "doc_id").distinct()
    sizes = relevant.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    judged = runs.join(relevant.withColumn("rel", F.lit(1)), ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    hits = F.sum("rel").over(Window.partitionBy("method", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    top = F.col("rank") <= k
    grouped = judged.withColumn("hits", hits).groupBy("method", "qid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rel").alias("tp"), F.count_if(top).alias("nk"), F.sum(F.when(top, F.col("rel")).otherwise(0)).alias("tpk"),
        F.sum(F.col("rel") * F.col("hits") / F.col("rank")).alias("ap"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(top, F.col("rel") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    every = runs.select("method").distinct().crossJoin(F.broadcast(sizes))
    x = every.join(grouped, ["method", "qid"], "left").na.fill(0, ["n", "tp", "nk", "tpk"]).na.fill(0.0, ["ap", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))
    p, r = safe(F.col("tp"), F.col("n")), safe(F.col("tp"), F.col("n_rel"))
    values = (p, r, safe(2 * p * r, p + r), safe(F.col("tpk"), F.col("nk")), safe(F.col("tpk"), F.col("n_rel")), F.col("ap") / F.col("n_rel"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)), F.col("dcg") / ideal)
    return x.select("method", "qid", *(F.round(v, 4).alias(name) for name, v in zip(METRICS, values, strict=True)))


def with_mean(scored: DataFrame) -> DataFrame:
    """A MEAN row per method."""
    return scored.unionByName(compare(scored).withColumn("qid", F.lit("MEAN")))


def compare(scored: DataFrame) -> DataFrame:
    """The mean of each metric per method."""
    return scored.groupBy("method").agg(*(F.round(F.avg(m), 4).alias(m) for m in METRICS))
