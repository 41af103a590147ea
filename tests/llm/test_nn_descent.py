"""Recall against brute force, exact ties, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import queries
from textloom.llm.nn_descent import nearest_neighbours


def brute(ids, x, query, k=10):
    d = np.sqrt(((x - x[np.flatnonzero(ids == query)[0]]) ** 2).sum(axis=1))
    other = ids != query
    order = np.lexsort((ids[other], d[other]))[:k]
    return list(zip(ids[other][order].tolist(), d[other][order].tolist()))


def test_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_nn_descent(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(np.float64)
    hits = 0
    for q in ids[ids % 100 == 0]:
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        want = brute(ids, x, q)
        assert [r["rank"] for r in own] == list(range(1, 11))
        hits += len({r.vec_id for r in own} & {v for v, _ in want})
        assert all(abs(r.score - np.sqrt(((x[ids == r.vec_id][0] - x[ids == q][0]) ** 2).sum())) < 1e-12 for r in own)
    assert hits >= 0.95 * len(rows)


def test_copies_and_invalid_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 60)] + [(i, rng.normal(size=3).astype(float).tolist()) for i in range(60, 130)]
    bad = [(200, None), (300, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (500, [float("nan"), 1.0, 1.0]), (600, [float("inf"), 1.0, 1.0]), (700, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    schema = "vec_id long, embedding array<double>, rank int"
    frame = spark.createDataFrame([(*r, 1) for r in rows + bad + [rows[0], rows[70]]], schema)
    found = nearest_neighbours(frame, lambda v: v % 100 == 0).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for q in (0, 100):
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        want = brute(ids, x, q)
        assert [r.vec_id for r in own] == [v for v, _ in want]
        assert np.allclose([r.score for r in own], [d for _, d in want])
    assert {r.query_id for r in found} == {0, 100}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    frame = spark.createDataFrame([(100 * i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
    found = nearest_neighbours(frame, lambda v: v % 100 == 0).collect()
    assert len(found) == n * max(0, n - 1)


def test_recall_with_split_leaves(spark, monkeypatch):
    """10,000 vectors in leaves of 128 at most, several shards: what the descent and the search find, not the first leaf."""
    monkeypatch.setattr("textloom.llm.nn_descent.LEAF", 256)
    monkeypatch.setattr("textloom.llm.nn_descent.SHARD_BYTES", 4 << 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(10_000, 16)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    rows = nearest_neighbours(frame, lambda v: v % 100 == 0).collect()
    hits = 0
    for q in range(0, 10_000, 100):
        own = {r.vec_id for r in rows if r.query_id == q}
        assert len(own) == 10
        hits += len(own & {v for v, _ in brute(np.arange(10_000), x.astype(np.float64), q)})
    assert hits >= 0.9 * len(rows)


def test_hot_vector_with_many_queries(spark, monkeypatch):
    monkeypatch.setattr("textloom.llm.common.LEAST_HOT", 3)
    rows = [(i, [1.0, 1.0]) for i in range(0, 2000, 10)] + [(5000 + i, [1.0, 2.0 + i]) for i in range(30)]
    found = nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 100 == 0, k=3).collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for q in (0, 100, 1900, 5000):
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in own] == [v for v, _ in brute(ids, x, q, 3)]
