"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is a few aggregations and joins; its edges are written to the shared
folder, so lineage stays short and a lost executor costs a re-read. The driver sees
two numbers per round. A node's neighbours are never gathered: its smallest one is an
aggregate, joined back to the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch


def _smallest(edges: DataFrame) -> DataFrame:
    """u -> the smallest of its neighbours and itself."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it reaches), for the nodes of edges(u, v). Loops, repeats and nulls are harmless."""
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.keep(now, "round-0")
    seen = None
    for i in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = scratch.keep(after, f"round-{i}")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if i > 1:
            scratch.drop(f"round-{i - 2}")
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
