"""Language identification and toxicity: held-out accuracy, edge cases, the estimator itself."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import language_id, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_kneser_ney_sums_to_one():
    model = language_id.fit({"x": Counter("abra cadabra abba baba".split()), "y": Counter(["zzz", "zyz"])})
    symbols = "abrcd"
    for k, history in ((0, "ab"), (0, ""), (0, "q")):
        total = 0.0
        for c in [*symbols, "z", "y", chr(language_id.END)]:
            whole = history if ord(c) == language_id.END else history + c
            sums, _ = model.score([whole])
            # the chance of one more character is the ratio of two words' chances, the ends put aside
            total += float(np.exp(_prefix(model, whole, ord(c) == language_id.END)[k] - (_prefix(model, history, False)[k] if history else 0)))
        assert 0.8 < total <= 1.0 + 1e-6


def _prefix(model, word, closed):
    """Log probability of a word's characters, with or without its end."""
    points, starts, scored = language_id._padded([word])
    hashes = language_id._gram_hashes(points)
    at = starts[0] + np.arange(scored[0])
    p = np.broadcast_to(model.floor, (len(at), len(model.langs))).astype(float)
    before = None
    for n in range(language_id.ORDER):
        if n:
            p = p * model._rows(model.gammas[n - 1], model.grams[n - 1], before, 1.0)
        p = p + model._rows(model.alphas[n], model.grams[n], hashes[n][at], 0.0)
        before = hashes[n][at - 1]
    logs = np.log(p)
    return logs.sum(axis=0) if closed else logs[:-1].sum(axis=0)


def test_held_out_languages(spark):
    found = queries.op3_language_id(spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    row = found.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert row[0] >= 0.98 and 0 <= row[1] <= row[2] <= 1


def test_language_edge_cases(spark):
    rows = [(i, random.Random(i).choice(["the cat sat on the mat", "a dog and the bird"]) * 3, "en", "x") for i in range(40)] + [(100 + i, "der hund und die katze schlafen " * 2, "de", "x") for i in range(40)]
    rows += [(200, None, None, "x"), (201, "", "en", "x"), (202, "12 34 !?", "en", "x"), (203, "²³", "de", "x"), (204, "the cat " * 30_000, "en", "x"), (205, "Ω" * 300, None, "x"), (None, "the cat", "en", "x"), (1, "the cat", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.train(docs, ~language_id.in_fold("doc_id", 4, 2))
    found = {r.doc_id: r for r in language_id.identify(docs, model, names=("p", "s", "e", "rej")).collect()}
    assert all((found[i].p, found[i].s, found[i].rej) == ("und", 0.0, True) for i in (200, 201, 202, 203))
    assert found[204].p == "en" and not found[204].rej and found[204].score == "x"
    assert found[205].rej and found[None].p == "en" and found[100].p == "de"
    empty = language_id.identify(docs.limit(0), model, names=("p", "s", "e", "rej"))
    assert empty.collect() == []
    nothing = language_id.train(docs.limit(0), F.lit(True))
    assert {r.p for r in language_id.identify(docs, nothing, names=("p", "s", "e", "rej")).collect()} == {"und"}


def test_non_negative_risk_finds_positives():
    """From some positives and a mixture, without one negative label."""
    rng = np.random.default_rng(1)

    def doc(toxic):
        own = rng.choice(5000, size=80, replace=False) + 100
        return np.unique(np.r_[own, rng.choice(20, size=6, replace=False)] if toxic else own).astype(np.uint64)

    positive, unlabelled = [doc(True) for _ in range(300)], [doc(i % 8 == 0) for i in range(1600)]
    model = toxicity.fit(positive, unlabelled, 1 / 8)
    score = lambda d: model.bias + sum(model.weights.get(int(f), 0) for f in d)
    assert np.mean([score(doc(True)) > 0 for _ in range(200)]) > 0.97
    assert np.mean([score(doc(False)) > 0 for _ in range(200)]) < 0.03
    assert toxicity.fit([], unlabelled, 0.1).weights == {} and toxicity.fit(positive, [], 0.1).weights == {}


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op4_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n.get((1, 1), 0) >= 0.9 * (n.get((1, 1), 0) + n.get((1, 0), 0))
    assert n.get((0, 1), 0) <= 0.05 * (n.get((0, 0), 0) + n.get((0, 1), 0))  # 330 positives here; none wrong of 3,634 with 1,500


def test_toxicity_edge_cases(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i * 7919 % 10_000:04d}")  # noqa: E731  copies would count once
    docs = spark.createDataFrame([(i, ("you vile fool " if i % 4 == 0 else "a calm day at sea ") + word(i), 1.0, 2) for i in range(200)] + [(900, None, 1.0, 2), (901, "", 1.0, 2), (902, "calm sea " * 50_000, 1.0, 2), (None, "a calm day", 1.0, 2), (4, "you vile fool", 1.0, 2)], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(5000, 1), (7, None), (None, 1), (8, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    found = {r.doc_id: r for r in toxicity.score(docs, model, names=("s", "p")).collect()}
    assert found[900].s == found[901].s and found[900].p == 0 and found[902].p == 0 and found[0].p == 1 and found[0].predicted == 2
    assert toxicity.score(docs.limit(0), model, names=("s", "p")).collect() == []
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.p for r in toxicity.score(docs, none, names=("s", "p")).collect()} == {0}


def test_long_texts_teach(spark):
    """All texts are far longer than others' limits; a language of one document has a model; inner names may clash."""
    long = {"en": "the cat sat on a warm mat ", "de": "der hund und die katze schlafen "}
    rows = [(i, long[lang] * 1200, lang, "x") for i, lang in enumerate(["en", "de"] * 6)] + [(50, "el perro y los gatos duermen " * 3, "es", "x"), (51, "el gato duerme", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string")
    model = language_id.train(docs, F.lit(True))
    assert model.langs == ["de", "en", "es"]
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert found[0].lang_pred == "en" and found[1].lang_pred == "de" and found[50].lang_pred == found[51].lang_pred == "es" and found[0]._text == "x"
    toxic = spark.createDataFrame([(i, ("vile scum fool " if i % 3 == 0 else "") + f"calm sea wind {i * 7919} bird {i * 104729} " * 1200, "x") for i in range(60)], "doc_id long, text string, _text string")
    model = toxicity.train(toxic, toxic.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")), F.lit(True))
    assert model.weights and {r.doc_id for r in toxicity.score(toxic, model).collect() if r.predicted} == set(range(0, 60, 3))


def test_near_copies_share_a_weight_and_others_do_not():
    rng = np.random.default_rng(6)
    common = np.arange(3, dtype=np.uint64)  # the smallest features of all
    apart = [np.unique(np.r_[common, rng.integers(10, 2**60, 200).astype(np.uint64)]) for _ in range(50)]
    assert (toxicity.shared_weights(apart) == 1).all()
    copies = [np.r_[apart[0], np.uint64(2**61 + i)] for i in range(9)]
    weights = toxicity.shared_weights([apart[0], *copies, apart[1]])
    assert np.allclose(weights, [0.1] * 10 + [1.0])
    assert toxicity.shared_weights([]).tolist() == [] and toxicity.shared_weights([np.zeros(0, np.uint64)]).tolist() == [1.0]


def test_repeated_ids_are_one_example(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}", "en") for i in range(300)] + [(2, "other", "en"), (None, "nobody", "en")], "doc_id long, text string, lang string")
    rows = language_id.training_sample(docs, F.lit(True), "doc_id", "text", "lang", 10).collect()
    assert len(rows) == 2 and {"other"} in [set(r.words) for r in rows]
