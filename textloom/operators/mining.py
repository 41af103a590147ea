"""Keywords, profiles and classification (survey V2, V10, M1-M5, A8g-A10g)."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import constants as C
from textloom.functions import text as X
from textloom.llm.common import map_arrow
from textloom.operators.index import SearchIndex, build_index, cap_vocabulary, ids_are_unique, norms, postings_of, vocabulary, weights, with_idf
from textloom.plans.lineage import cut


def top_keywords(weighted: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, rank, term, weight."""
    by = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term")
    return weighted.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n).select("doc_id", "rank", "term", F.round("weight", 4).alias("weight"))


def _best_phrases(n: int) -> Callable[[Iterator], Iterator]:
    """Arrow batches of (doc_id, texts in lower case) to doc_id, rank, phrase, score, a document at a time."""

    def run(batches):
        word = re.compile(C.WEB_TOKEN)
        stop = frozenset(C.WEB_STOPWORDS)
        for batch in batches:
            ids, ranks, phrases, scores = [], [], [], []
            for row, texts in enumerate(batch.column("texts").to_pylist()):
                first, times = {}, Counter()  # of each phrase: where it stands first, and how often it is there
                for text in texts:
                    place, own = 0, []
                    for token in word.findall(text):
                        if token not in stop:
                            own.append(token)
                        elif own:
                            phrase = tuple(own)
                            first[phrase] = min(first.get(phrase, place), place)
                            times[phrase] += 1
                            place, own = place + 1, []
                    if own:
                        phrase = tuple(own)
                        first[phrase] = min(first.get(phrase, place), place)
                        times[phrase] += 1
                mass, count = {}, {}
                for phrase, k in times.items():
                    size = k * len(phrase)
                    for token in phrase:
                        mass[token] = mass.get(token, 0) + size  # degree + frequency
                        count[token] = count.get(token, 0) + k
                own = {token: m / count[token] for token, m in mass.items()}
                # Added word by word, as SQL adds; sum() would make up for the rounding and differ in the third decimal.
                scored = ((-math.floor(reduce(add, map(own.__getitem__, phrase)) * 1000 + 0.5) / 1000, at, phrase) for phrase, at in first.items())
                for rank, (score, _, phrase) in enumerate(heapq.nsmallest(n, scored), 1):
                    ids.append(row)
                    ranks.append(rank)
                    phrases.append(" ".join(phrase))
                    scores.append(-score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(ranks, pa.int32()), pa.array(phrases, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "rank", "phrase", "score"])

    return run


def rake(docs: DataFrame, n: int = 8, unique: bool | None = None) -> DataFrame:
    """M1: doc_id, rank, phrase, score. A word scores (degree + frequency) / frequency in its document, a phrase the sum.

    A document is scored where it is, by Python on Arrow batches: nothing is shuffled or spilled. Only if ids repeat are
    their texts brought together."""
    low = F.lower(X.text_or_empty(F.col("text")))
    if ids_are_unique(docs) if unique is None else unique:
        own = docs.select("doc_id", F.array(low).alias("texts"))
    else:
        own = docs.groupBy("doc_id").agg(F.collect_list(low).alias("texts"))
    return map_arrow(own, _best_phrases(n), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, rank int, phrase string, score double")


def profiles(docs: DataFrame) -> DataFrame:
    """M2, A10g: the scalar part of a document's profile, without a shuffle."""
    words = X.tokenize_web(F.col("text"))
    own = docs.select("doc_id", "category", "text", words.alias("w"))
    n, u = F.size("w"), F.size(F.array_distinct("w"))
    return own.select(
        "doc_id", "category", n.alias("word_count"), u.alias("unique_words"),
        F.when(n > 0, F.round(u / F.nullif(n, F.lit(0)), 3)).otherwise(0.0).alias("lexical_diversity"), X.flesch(F.col("text"), F.col("w")).alias("readability_flesch"),
    )


def full_profiles(docs: DataFrame, weighted: DataFrame, n: int = 6) -> DataFrame:
    """M2 with both keyword lists."""

    def listed(rows: DataFrame, name: str, column: str) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", column))), lambda r: r[column]), ", ").alias(name))

    tfidf = listed(top_keywords(weighted, n), "top_keywords_tfidf", "term")
    phrases = listed(rake(docs, n), "top_keywords_rake", "phrase")
    return profiles(docs).join(tfidf, "doc_id", "left").join(phrases, "doc_id", "left")


def classes_of(docs: DataFrame, label: str, min_class_size: int = 2) -> DataFrame:
    """F8: rows of classes with enough members; smaller classes are dropped, not an error."""
    big = docs.groupBy(label).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= min_class_size).select(label)
    return docs.join(F.broadcast(big), label, "left_semi")


def stratified_split(docs: DataFrame, label: str, test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """M4: doc_id, label, test: of each class exactly round(test_size * n) rows, those first by a seeded hash of the id."""
    order = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))
    ids = docs.select("doc_id", F.col(label).alias("label"))
    sizes = ids.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    placed = ids.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(order)))
    return placed.join(F.broadcast(sizes), "label").select("doc_id", "label", (F.col("r") <= F.floor(F.col("n") * test_size + 0.5)).alias("test"))


def capped_vocabulary(posted: DataFrame, docs: DataFrame, max_features: int) -> DataFrame:
    """term, df, cf, idf of the most frequent terms of two characters or more."""
    return with_idf(cap_vocabulary(vocabulary(posted).filter(F.length("term") >= 2), max_features), docs.agg(F.count(F.lit(1)).alias("n")))


def labelled_features(docs: DataFrame, split: DataFrame, max_features: int, normalize: str = "none") -> DataFrame:
    """V1, V2 of both kinds: the columns of the split, term, tf, w: counts and TF-IDF weights, each document scaled to length 1.

    The rows of the capped vocabulary are written, so that texts are read twice only, and are shuffled once."""
    posted = postings_of(docs, X.preprocess_web(F.col("text"), True, normalize))
    vocab = F.broadcast(capped_vocabulary(posted, docs, max_features).select("term", "idf"))
    raw = cut(posted.join(vocab, "term").select("doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("w")))
    return raw.join(split.join(norms(raw), "doc_id"), "doc_id").select(*split.columns, "term", "tf", (F.col("w") / F.col("norm")).alias("w"))


def feature_rows(own: DataFrame, kind: str) -> DataFrame:
    """Labelled features with term, x of one kind: "bow" or "tfidf"."""
    others = [c for c in own.columns if c not in ("term", "tf", "w")]
    return own.select(*others, "term", (F.col("tf").cast("double") if kind == "bow" else F.col("w")).alias("x"))


def features(docs: DataFrame, kind: str, max_features: int, normalize: str = "none") -> DataFrame:
    """V1, V2: doc_id, term, x of the capped vocabulary: counts ("bow") or TF-IDF weights ("tfidf")."""
    posted = postings_of(docs, X.preprocess_web(F.col("text"), True, normalize))
    vocab = capped_vocabulary(posted, docs, max_features)
    if kind == "bow":
        return posted.join(F.broadcast(vocab.select("term")), "term").select("doc_id", "term", F.col("tf").cast("double").alias("x"))
    return weights(posted, vocab, small=True).select("doc_id", "term", F.col("weight").alias("x"))


def naive_bayes(x: DataFrame, split: DataFrame) -> DataFrame:
    """M3: doc_id, label, prediction of the test rows by multinomial naive Bayes: unsmoothed class priors, terms with
    one added. A class and term that were never seen together need no row: theirs is the class's default.

    Ties go to the class that sorts first. The term table has vocabulary x classes rows at most. Where x has the columns of
    the split, its rows stay where they are."""
    x = x if "test" in x.columns else x.join(split, "doc_id")
    train, test = split.filter(~F.col("test")), split.filter("test")
    priors = train.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    total = train.agg(F.count(F.lit(1)).alias("t"))
    size = x.select("term").distinct().agg(F.count(F.lit(1)).alias("v"))
    sums = x.filter(~F.col("test")).groupBy("label", "term").agg(F.sum("x").alias("s"))
    mass = sums.groupBy("label").agg(F.sum("s").alias("m"))
    classes = priors.join(mass, "label", "left").crossJoin(total).crossJoin(size)
    classes = classes.select(F.col("label").alias("c"), F.log(F.col("k") / F.col("t")).alias("prior"), F.log(F.coalesce("m", F.lit(0.0)) + F.col("v")).alias("norm"))
    own = x.filter("test")
    length = own.groupBy("doc_id").agg(F.sum("x").alias("len"))
    gains = own.select("doc_id", "term", "x").join(F.broadcast(sums.select(F.col("label").alias("c"), "term", F.log1p("s").alias("g"))), "term").groupBy("doc_id", "c").agg(F.sum(F.col("x") * F.col("g")).alias("gain"))
    every = test.select("doc_id", "label").crossJoin(F.broadcast(classes)).join(length, "doc_id", "left").join(gains, ["doc_id", "c"], "left")
    score = F.col("prior") + F.coalesce("gain", F.lit(0.0)) - F.coalesce("len", F.lit(0.0)) * F.col("norm")
    best = every.groupBy("doc_id", "label").agg(F.min(F.struct((-F.round(score, 9)).alias("s"), "c")).alias("b"))
    return best.select("doc_id", "label", F.col("b.c").alias("prediction"))


def logistic_regression(x: DataFrame, split: DataFrame, max_iter: int = 500) -> DataFrame:
    """M3: doc_id, label, prediction by pyspark.ml on sparse vectors of the capped vocabulary."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.linalg import SparseVector, VectorUDT

    terms = [r[0] for r in x.select("term").distinct().orderBy("term").collect()]  # the capped vocabulary
    place = x.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    size = max(1, len(terms))

    @F.udf(VectorUDT())
    def vector(pairs):
        found = {place.value[p["term"]]: p["x"] for p in pairs or []}
        return SparseVector(size, found)

    rows = split.join(x.groupBy("doc_id").agg(F.collect_list(F.struct("term", "x")).alias("p")), "doc_id", "left").select("doc_id", "label", "test", vector("p").alias("features"))
    indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    train = indexer.transform(rows.filter(~F.col("test")))
    model = LogisticRegression(labelCol="y", maxIter=max_iter, regParam=1.0 / max(1, train.count()), standardization=False).fit(train)
    label = F.array(*map(F.lit, indexer.labels))
    return model.transform(rows.filter("test")).select("doc_id", "label", F.element_at(label, F.col("prediction").cast("int") + 1).alias("prediction"))


def confusion(predictions: DataFrame) -> DataFrame:
    """A8g in long form: label, prediction, n of every pair of classes, those of no row with 0."""
    found = cut(predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")))  # a few rows, which are read several times
    names = found.select(F.col("label").alias("c")).union(found.select("prediction")).distinct()  # the classes
    every = names.withColumnRenamed("c", "label").crossJoin(F.broadcast(names.withColumnRenamed("c", "prediction")))
    return every.join(found, ["label", "prediction"], "left").na.fill(0, ["n"])


def quality(matrix: DataFrame) -> DataFrame:
    """A9g: accuracy, f1_macro (the mean of the classes' own F1), n_test of a confusion matrix."""
    hit = F.col("label") == F.col("prediction")
    actual = matrix.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("a"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    said = matrix.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("p"))
    f1 = 2 * F.coalesce("tp", F.lit(0)) / (F.coalesce("a", F.lit(0)) + F.coalesce("p", F.lit(0)))
    return actual.join(said, "c", "full").agg(
        F.round(F.sum("tp") / F.sum("a"), 4).alias("accuracy"), F.round(F.avg(f1), 4).alias("f1_macro"), F.sum("a").alias("n_test")
    )


def classify(docs: DataFrame, label: str = "category", feature_type: str = "tfidf", model_type: str = "nb", test_size: float = 0.25, normalize: str = "none", max_features: int = 5000, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, build: build()) -> DataFrame:
    """M3: doc_id, label, prediction of the held-out quarter. ``keep`` may write the split and the features, by their names, for reuse."""
    kept = classes_of(docs.filter(F.col(label).isNotNull()), label)
    split = keep(f"split {label} {test_size}", lambda: stratified_split(kept, label, test_size))
    own = keep(f"features {label} {test_size} {max_features} {normalize}", lambda: labelled_features(kept, split, max_features, normalize))
    x = feature_rows(own, feature_type)
    return naive_bayes(x, split) if model_type == "nb" else logistic_regression(x.select("doc_id", "term", "x"), split)


def comparative_analysis(docs: DataFrame, label: str = "category", keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, build: build()) -> DataFrame:
    """M5: normalization, feature_type, accuracy, f1_macro, n_test of six settings."""
    out = None
    for normalize in ("none", "stem", "lemma"):
        for kind in ("bow", "tfidf"):
            row = quality(confusion(classify(docs, label, kind, "nb", normalize=normalize, keep=keep))).select(F.lit(normalize).alias("normalization"), F.lit(kind.upper()).alias("feature_type"), "accuracy", "f1_macro", "n_test")
            out = row if out is None else out.unionByName(row)
    return out


def keyword_index(docs: DataFrame, max_features: int = 5000) -> SearchIndex:
    """The index that keyword lists are taken from: web tokens without stopwords."""
    return build_index(docs, X.preprocess_web(F.col("text")), max_features=max_features)
