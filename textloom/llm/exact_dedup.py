"""Exact dedup by skew-safe combining, in DataFrame functions only.

Three stages of max/count aggregation, each grouping by the digest *and* the
whole normalised text, so that a digest alone never decides equality:

1. local: Spark's partial aggregation leaves one row per text and map task;
2. salted: rows meet by (salt, digest, text), the salt being the map task's
   number modulo ``salts``, so a hot text is spread over ``salts`` reducers and
   each of them gets one row per map task at most;
3. global: the salts' winners meet by (digest, text), ``salts`` rows at most each.

A group's winner is a row: the one with the largest id and, of rows that repeat it,
the largest row marker. The rows to keep are found by that marker alone. The verdict
of every row, the dropped ones too, is found by digest and a second, independent
fingerprint; the groups, formed by whole texts over all rows, show whether two texts
share both. If none do, equal keys are equal texts; the rows of keys that do are
joined by the whole text. Groups that hold a large part of all rows are broadcast (there
can only be few), so their rows stay where they are.

Edge cases: a null text counts as empty; the empty text is an ordinary text; a
null doc_id never wins against an id, and a group of null ids only has a null
keep_id; of rows that repeat both id and text one stays, and each counts in
group_size; an empty table gives an empty result; further columns of the input, of any
name, are ignored by ``exact_dedup`` and carried by ``keep_winners``. The input must come
in the same partitions each time it is read, as files do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, ascii_lower, fresh_names, join_groups, row_marker

SALTS = 16


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, marker, norm."""
    return docs.select(F.col(id_col).alias("id"), row_marker().alias("marker"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per distinct normalised text: digest, norm, keep_id, keep_marker, group_size."""
    rows = _normalised(docs, id_col, text_col).select("norm", F.struct("id", "marker").alias("row"), digest(F.col("norm")).alias("digest"))
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("salt", "digest", "norm")
        .agg(F.max("row").alias("row"), F.count(F.lit(1)).alias("n"))
    )
    merged = salted.groupBy("digest", "norm").agg(F.max("row").alias("row"), F.sum("n").alias("group_size"))
    return merged.select("digest", "norm", F.col("row.id").alias("keep_id"), F.col("row.marker").alias("keep_marker"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = _sha256, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact")
    key = ["digest", "fingerprint"]
    norm = F.col("norm")
    rows = _normalised(docs, id_col, text_col).select("id", "marker", digest(norm).alias("digest"), fingerprint(norm).alias("fingerprint"), _sha256(norm).alias("sha"))
    rows = scratch.keep(rows if digest is not _sha256 else rows.drop("sha"), "rows")
    own = exact_groups(docs, id_col, text_col, salts, digest)
    groups = scratch.keep(own.select("digest", fingerprint(norm).alias("fingerprint"), "keep_id", "keep_marker", "group_size"), "groups")
    shared = groups.groupBy(*key).agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select(*key)
    sha = F.col("digest") if digest is _sha256 else F.col("sha")
    if shared.isEmpty():
        found = join_groups(rows, groups, key, "group_size")
    else:
        shared = scratch.keep(shared, "shared")
        found = join_groups(rows.join(shared, key, "left_anti"), groups.join(shared, key, "left_anti"), key, "group_size")
        whole = _normalised(docs, id_col, text_col).select("id", "marker", "norm", digest(norm).alias("digest"), fingerprint(norm).alias("fingerprint"), _sha256(norm).alias("sha"))
        again = whole.join(shared, key, "left_semi").join(own, ["digest", "norm"])
        found = found.unionByName(again.select(*found.columns))
    kept = F.col("marker") == F.col("keep_marker")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex(sha)).alias("text_sha256"))


def keep_winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    (marker,) = fresh_names(("marker",), docs.columns)
    winners = exact_groups(docs, id_col, text_col, salts).select(F.col("keep_marker").alias(marker))
    return docs.withColumn(marker, row_marker()).join(winners.hint("shuffle_hash"), marker, "left_semi").select(*docs.columns)
