"""Importance resampling and piece sampling: exact selection, exact shares, lossless decoding."""

import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textloom.llm import importance, queries
from textloom.llm.piece_sampling import MARK, Sampler, decode, decode_ids, encode, piece_model, span_keys

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return piece_model(public_tokenizers.path("piece_bpe_32k.model"), 1.0)


TEXTS = ["", " ", "a", "Hello  world\n\tx", f"mark {MARK} here", "日本語 😀 é", "x" * 100_000, " " * 5_000, "12 345 6", "\x00\x85\xa0"]


def test_lossless(model):
    found = Sampler(model).sample(TEXTS, np.arange(len(TEXTS)), 5)
    assert [decode_ids(model, x.tolist()).decode() for x in found] == TEXTS


def test_rows_do_not_depend_on_each_other(model, monkeypatch):
    texts = [f"some words number {i} here" for i in range(50)]
    keys = np.arange(50)
    whole = Sampler(model).sample(texts, keys, 5)
    monkeypatch.setattr("textloom.llm.piece_sampling._HELD_UNITS", 5)
    sampler = Sampler(model)
    for i in reversed(range(50)):
        assert sampler.sample([texts[i]], keys[i : i + 1], 5)[0].tolist() == whole[i].tolist()
    assert any(a.tolist() != b.tolist() for a, b in zip(whole, Sampler(model).sample(texts, keys, 6)))


def test_segmentations_come_with_their_shares(model):
    """Against all segmentations of a unit, weighed by the product of their pieces' weights."""
    unit = " the"

    def weight(piece):
        points = np.frombuffer(piece.encode("utf-32-le"), dtype=np.uint32)
        at = np.flatnonzero(model.keys == span_keys(points, len(piece))[0])
        return float(model.weights[at[0]]) if len(at) else 0.0

    want = {}
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(unit)]
        parts = tuple(unit[a:b] for a, b in zip(at, at[1:]))
        want[parts] = float(np.prod([weight(p) for p in parts]))
    total = sum(want.values())
    n = 40_000
    found = Counter(tuple(model.bytes_of[i].decode() for i in x) for x in Sampler(model).sample([unit] * n, np.arange(n), 1))
    for parts, w in want.items():
        p = w / total
        assert abs(found[parts] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_encode_and_decode(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (50, None, 1), (None, "void", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = encode(docs)
    assert {r.lossless for r in found.collect()} == {True}
    back = decode(found).collect()
    assert sorted((repr(r.doc_id), r.text) for r in back) == sorted((repr(d), t or "") for d, t, _ in rows)
    again = encode(docs.repartition(5)).select("doc_id", "ids_crc32")
    assert sorted(map(repr, map(tuple, again.collect()))) == sorted(map(repr, map(tuple, found.select("doc_id", "ids_crc32").collect())))
    assert encode(docs.limit(0)).collect() == []


def test_all_documents_are_lossless(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.op5_piece_sampling(spark, SF).join(docs.select("doc_id", F.sha2("text", 256).alias("h")), "doc_id")
    assert found.count() == docs.count() and found.filter("NOT lossless OR h <> decoded_sha256").count() == 0


def test_selection_is_the_top_k(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op2_importance(spark, SF).collect()
    k = round(importance.FRACTION * docs.count())
    best = sorted(rows, key=lambda r: (-r.gumbel_key, r.doc_id))[:k]
    assert {r.doc_id for r in rows if r.selected} == {r.doc_id for r in best}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    share = lambda q: np.mean([r.selected for r in rows if quality.get(r.doc_id) == q])
    assert share(1) > 0.93 and share(0) < share(1) - 0.5  # how many bad ones stay depends on k as well


def test_kth_largest(spark):
    values = [0, 5, 5, 5, 9, 2**62, 2**62, 70_000, 2**40]
    rows = spark.createDataFrame([(v,) for v in values], "x long")
    for k in range(1, len(values) + 1):
        limit, among = importance.kth_largest(rows, "x", k)
        assert limit == sorted(values, reverse=True)[k - 1] and among == k - sum(v > limit for v in values)


def test_sortable_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-300, 0.0, 1e-300, 3.0, 1e300, np.inf])
    assert (np.diff(importance._sortable(x)) > 0).all() and importance._sortable(x).min() >= 0


def test_importance_edge_cases(spark):
    rows = [(1, "good words here", 1), (2, None, 1), (3, "", 1), (4, "bad bad", 1), (4, "bad bad", 1), (None, "good words", 1), (5, "w " * 60_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    good = spark.createDataFrame([(1,), (None,), (77,)], "doc_id long")
    found = importance.resample(docs, good, 0.5).collect()
    assert len(found) == 7 and 3 <= sum(r.selected for r in found) <= 5
    assert all(r.log_weight == 0 and r.score == 0.5 for r in found if r.doc_id in (2, 3))
    assert importance.resample(docs.limit(0), good).collect() == []
    assert {r.log_weight for r in importance.resample(docs, good.limit(0)).collect()} == {0.0}


def test_ratios_against_plain_counts(spark):
    """log(target / raw) of every bucket, from n-grams counted in plain Python."""
    rows = [(i, ["good clear words here", "noise noise lower things", "Good words", None, ""][i % 5]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(0, 40, 5)], "doc_id long")
    shingler = importance.Shingler()
    counts = {"raw": np.ones(importance.BUCKETS), "target": np.ones(importance.BUCKETS)}
    for i, t in rows:
        for b in importance.ngram_buckets(shingler, (t or "").encode()).tolist():
            counts["raw"][b] += 1
            counts["target"][b] += i % 5 == 0
    want = np.log(counts["target"] / counts["target"].sum()) - np.log(counts["raw"] / counts["raw"].sum())
    assert np.allclose(importance.log_ratios(docs, good), want)
    grams = ["a", "b", "c", "a b", "b c"]
    assert len(importance.ngram_buckets(shingler, b"A b C")) == len(grams)


def test_exactly_k_rows_of_ties(spark):
    docs = spark.createDataFrame([(None, "same words")] * 50 + [(1, "same words")] * 50, "doc_id long, text string")
    for fraction in (0.01, 0.25, 0.5, 0.77, 1.0):
        found = importance.resample(docs, docs.select("doc_id").limit(0), fraction=fraction).collect()
        assert sum(r.selected for r in found) == max(1, round(100 * fraction))
