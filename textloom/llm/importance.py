"""Quality by importance resampling.

Two generative models over hashed word n-grams (1 and 2 words, ``BUCKETS`` buckets, add-one
smoothing): one of target text, the documents known to be good, and one of the raw text of
all documents. A document's log weight is the sum over its n-grams of log(target / raw). The
sample is drawn without replacement by the Gumbel trick: each document's key is its log
weight plus Gumbel noise from a hash of its id and the seed, and the k largest keys stay.

The raw model counts every document. The target model may be fitted on at most
``max_target`` good documents, the smallest by hash of their ids. The k-th key is found
exactly by four counting rounds over 16 bits each, with 65,536 counts at most per round; no
task sorts all keys. A document's score is the logistic of its mean log ratio per n-gram.

Edge cases: null, empty and wordless texts have log weight 0, score 0.5; a null id counts as
-1 in the noise; of equal keys (rows that repeat an id and a text, or lack an id) the first rows
stay, so that exactly k do; with no target every weight is 0 and the sample is uniform; an empty table
gives an empty result; k is round(fraction x rows), at least 1 where there are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, bounded_sample, map_arrow, row_marker
from textloom.llm.jaccard_join import Shingler, _spread

BUCKETS = 1 << 14
FRACTION = 0.85
SEED = 11
MAX_TARGET = 20_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def ngram_buckets(shingler: Shingler, text: bytes | None) -> np.ndarray:
    """The bucket of every word and every pair of neighbours."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    ids = shingler._ids(words)
    pairs = ids[:-1] * _P + ids[1:] * _Q
    return (_spread(np.concatenate([ids, pairs])) >> np.uint64(50)).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """bucket, n over all rows: each task sends one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total = Shingler(), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                total += np.bincount(ngram_buckets(shingler, text.as_py()), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return map_arrow(texts.select(text_col), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _model(counts: DataFrame) -> np.ndarray:
    """Log probabilities of the buckets."""
    found = counts.toPandas()  # BUCKETS rows at most
    n = np.ones(BUCKETS)
    n[found["bucket"].to_numpy(dtype=np.int64)] += found["n"].to_numpy(dtype=float)
    return np.log(n / n.sum())


def log_ratios(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_target: int = MAX_TARGET) -> np.ndarray:
    """log(target / raw) of every bucket; good has the ids of target documents."""
    chosen = bounded_sample(good, id_col, max_target).withColumnRenamed("id", id_col)
    target = bucket_counts(docs.join(F.broadcast(chosen), id_col, "left_semi"), text_col)
    raw = _model(bucket_counts(docs, text_col))
    known = _model(target)
    return known - raw if np.ptp(known) else np.zeros(BUCKETS)


def gumbel_noise(ids: np.ndarray, seed: int) -> np.ndarray:
    h = _spread(_spread(ids.astype(np.int64).view(np.uint64) + np.uint64(seed * int(_P) % 2**64)) + _Q)
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def _sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as longs of the same order, all of them >= 0."""
    bits = x.astype(np.float64).view(np.int64)
    return np.where(bits >= 0, (bits >> 1) + 2**62, 2**62 - 1 - ((bits & np.int64(2**63 - 1)) >> 1))


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, score, gumbel_key, place (the key as a long of the same order)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            weights, means = [], []
            for text in batch.column(1).cast(pa.binary()):
                own = shared.value[ngram_buckets(shingler, text.as_py())]
                weights.append(float(own.sum()))
                means.append(float(own.mean()) if len(own) else 0.0)
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            weight = np.array(weights, dtype=float)
            key = weight + gumbel_noise(ids, seed)
            columns = [batch.column(0), pa.array(weight), pa.array(1 / (1 + np.exp(-np.array(means, dtype=float)))), pa.array(key), pa.array(_sortable(key))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "log_weight", "score", "gumbel_key", "place"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), run, "doc_id long, log_weight double, score double, gumbel_key double, place long")


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The k-th largest value of a column of non-negative longs, and how many rows with it are among the k."""
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        own = rows.filter(F.shiftright(column, shift + 16) == prefix) if shift < 48 else rows
        digit = F.shiftright(column, shift).bitwiseAND(0xFFFF)
        for d, n in sorted(map(tuple, own.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
            if n >= left:
                prefix = prefix << 16 | d
                break
            left -= n
    return prefix, left


def resample(docs: DataFrame, good: DataFrame, fraction: float = FRACTION, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", max_target: int = MAX_TARGET) -> DataFrame:
    """doc_id, log_weight, score, gumbel_key, selected of every row."""
    rows = weigh(docs, log_ratios(docs, good, id_col, text_col, max_target), id_col, text_col, seed)
    rows = Scratch(docs.sparkSession, "importance").keep(rows.withColumn("marker", row_marker()), "weights")
    n = rows.count()
    selected = F.lit(True)
    if n:
        limit, among = kth_largest(rows, "place", max(1, round(fraction * n)))
        tied = rows.filter(F.col("place") == limit)
        k = tied.count()
        last = kth_largest(tied, "marker", k - among + 1)[0] if among < k else None  # the among-th smallest marker of the tied rows
        first = F.lit(True) if last is None else F.col("marker") <= last
        selected = (F.col("place") > limit) | ((F.col("place") == limit) & first)
    return rows.select("doc_id", "log_weight", "score", "gumbel_key", selected.alias("selected"))


def good_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", may_learn: Column | None = None) -> DataFrame:
    own = labels.filter(F.col(label_col) == 1)
    return (own if may_learn is None else own.filter(may_learn)).select(id_col)
