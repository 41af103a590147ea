"""Hand-traced values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize("word, expected", [("organization", "organize"), ("quickly", "quick"), ("prices", "pric"), ("bus", "bus")])
def test_stem(spark, word, expected):
    assert one(spark, X.stem, word) == expected == X.stem_word(word)


@pytest.mark.parametrize("word, expected", [("companies", "company"), ("stopping", "stop"), ("glass", "glas"), ("ties", "tie"), ("ing", "ing")])
def test_lemma_lab(spark, word, expected):
    assert one(spark, X.lemma_lab, word) == expected == X.lemma_word_lab(word)


@pytest.mark.parametrize("word, expected", [("stopping", "stopp"), ("glass", "glass"), ("matches", "match")])
def test_lemma_web(spark, word, expected):
    assert one(spark, X.lemma_web, word) == expected


@pytest.mark.parametrize("word, code", [("pfister", "P236"), ("ashcraft", "A261"), ("tymczak", "T522"), ("goverment", "G165"), ("honeyman", "H555"), ("123", "")])
def test_soundex(spark, word, code):
    assert one(spark, X.soundex, word) == code


@pytest.mark.parametrize("mode, tokens", [("split", ["long", "term"]), ("join", ["longterm"]), ("underscore", ["long_term"]), ("keep", ["long-term"])])
def test_hyphens(spark, mode, tokens):
    assert one(spark, lambda t: X.tokenize_lab(t, mode), "long-term") == tokens


@pytest.mark.parametrize("word, n", [("cake", 1), ("table", 1), ("the", 1), ("tree", 1), ("banana", 3)])
def test_syllables(spark, word, n):
    assert one(spark, X.syllables, word) == n


def test_ngrams_and_kgrams(spark):
    assert one(spark, lambda t: X.ngrams(F.split(t, " "), 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda t: X.ngrams(F.split(t, " "), 2), "a") == []
    assert one(spark, X.kgrams, "cat") == ["$ca", "cat", "at$"]


def test_null_text_is_empty(spark):
    for expression, empty in ((X.tokenize_web, []), (X.clean_text, ""), (X.flesch, 0.0), (X.word_count, 0), (X.preprocess_lab, [])):
        assert one(spark, expression, None) == empty


def test_snippet(spark):
    assert one(spark, lambda t: X.snippet(t, "cat"), "A Cat sat") == "A **Cat** sat"
    assert one(spark, lambda t: X.snippet(t, "zebra", 4), "A Cat sat") == "A Ca..."
