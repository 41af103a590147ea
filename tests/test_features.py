"""The settings of a classification share the features of both kinds."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import mining


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "ab"[i % 2], "t", ["alpha beta beta", "gamma beta", "delta alpha alpha gamma", ""][i % 4] + f" word{i % 3}") for i in range(24)]
    return spark.createDataFrame(rows, "doc_id long, category string, title string, text string")


@pytest.mark.parametrize("kind", ["bow", "tfidf"])
def test_both_kinds_from_one_table(docs, kind):
    def rows(x):
        return sorted((r.doc_id, r.term, round(r.x, 12)) for r in x.collect())

    own = mining.labelled_features(docs, mining.stratified_split(docs, "category"), 5)
    assert rows(mining.feature_rows(own, kind)) == rows(mining.features(docs, kind, 5))


def test_settings_share_their_tables(spark, docs):
    kept = {}

    def keep(name, build):
        if name not in kept:
            kept[name] = build().localCheckpoint()
        return kept[name]

    assert {mining.classify(docs, feature_type=kind, keep=keep).count() for kind in ("bow", "tfidf")} == {6}
    assert len(kept) == 2  # the split, and the features of one normalization
    one = mining.classify(docs, feature_type="bow", keep=keep)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, mining.naive_bayes(mining.features(docs, "bow", 5000), mining.stratified_split(docs, "category")).collect()))
    assert one.agg(F.count("doc_id")).first()[0] == 6
