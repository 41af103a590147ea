"""Toxicity by non-negative positive-unlabelled learning in numpy.

Training data are confirmed toxic documents (P) and unlabelled ones (U); no
document counts as confirmed clean. With class prior pi and logistic losses, the
risk is pi * Rp(+1) + max(0, Ru(-1) - pi * Rp(-1)): the U risk as negatives less
the share that positives among U cause, held at zero or more; where that part
falls below zero, the gradient step goes against it instead.

Features are hashed: each lower-cased word, and its prefixes of 3 to 6 characters;
a document has or lacks a feature. A likelihood-ratio test of P against U picks the
features of the linear model. A word's features depend on the word alone, so a
worker looks each distinct word up once.

Near copies would pass for a trait of their class, so documents of one class whose
feature sets have a Jaccard similarity of ``NEAR`` or more share the weight of one.

Bounds: at most ``max_positive`` P and ``max_unlabelled`` U documents, the smallest
by hash of their ids, each read whole; the prior is counted over all rows that may be
learned from. Features are taken from texts by the executors. Scoring reads every
whole text.

Edge cases: null, empty and wordless texts get the score of no feature; with no
toxic example the model is constant and predicts 0; an id that repeats is one example,
by the text of the smallest hash; null ids teach nothing; labels without a document,
repeated labels and null labels are harmless; an empty table gives an empty result;
further columns of any name are carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_sample, fresh_names, map_arrow, shuffle_partitions

PREFIXES = (3, 4, 5, 6)
_WORD = re.compile(r"\w+")
_CACHED_WORDS = 300_000
#: Documents at least this similar share a weight; estimates come from this many min-hashes.
NEAR, SIGNATURE = 0.75, 64


def word_features(word: str) -> list[int]:
    found = [xxhash.xxh3_64_intdigest("=" + word)]
    found += [xxhash.xxh3_64_intdigest(word[:n]) for n in PREFIXES if len(word) >= n]
    return found


class _WordFeatures(dict):
    def __missing__(self, word: str) -> list[int]:
        found = word_features(word)
        if len(word) <= 64:
            self[word] = found
        return found


def text_features(text: str | None, known: _WordFeatures | None = None) -> np.ndarray:
    """Sorted distinct features."""
    known = _WordFeatures() if known is None else known
    found: set[int] = set()
    for w in set(_WORD.findall((text or "").lower())):
        found.update(known[w])
    return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))


def shared_weights(docs: list[np.ndarray]) -> np.ndarray:
    """The weight of each document: one, shared among its near copies. A min-hash estimate picks the leaders to compare
    with, and the sets themselves decide."""
    odd = np.random.default_rng(3).integers(0, 2**63, size=(SIGNATURE, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    signatures = np.zeros((len(docs), SIGNATURE), dtype=np.uint32)  # of the leaders
    leaders: list[np.ndarray] = []
    group = np.zeros(len(docs), dtype=np.int64)
    for i, own in enumerate(docs):
        least = np.zeros(SIGNATURE, dtype=np.uint64)
        if len(own):
            least = np.min([(part * odd).min(axis=1) for part in np.array_split(own, 1 + len(own) // 10_000)], axis=0)
        least = (least >> np.uint64(32)).astype(np.uint32)
        alike = np.count_nonzero(signatures[: len(leaders)] == least, axis=1)
        group[i] = len(leaders)
        for k in np.flatnonzero(alike >= (NEAR - 0.2) * SIGNATURE):
            shared = len(np.intersect1d(own, leaders[k], assume_unique=True))
            if shared >= NEAR * (len(own) + len(leaders[k]) - shared):
                group[i] = k
                break
        else:
            signatures[len(leaders)] = least
            leaders.append(own)
    return 1.0 / np.bincount(group, minlength=1)[group]


class ToxicModel:
    """weights: feature -> weight of the chosen features."""

    def __init__(self, weights: dict[int, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, text: str | None, cache: dict[str, tuple[int, ...]]) -> float:
        if len(cache) > _CACHED_WORDS:
            cache.clear()
        found: set[int] = set()
        for w in set(_WORD.findall((text or "").lower())):
            own = cache.get(w)
            if own is None:
                own = tuple(f for f in word_features(w) if f in self.weights)
                if len(w) <= 64:
                    cache[w] = own
            if own:
                found.update(own)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in sorted(found)), -60, 60))))


def choose_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], most: int, weights: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """The features most over-represented in P, by the log-likelihood ratio of two binomials over weighted counts. Only features
    of P are counted, document by document, so that the driver holds little besides the documents themselves."""
    ids = np.zeros(0, np.uint64)
    for begin in range(0, len(positive), 100):
        ids = np.union1d(ids, np.concatenate(positive[begin : begin + 100]))
    if not len(ids):
        return []

    def counts(docs: list[np.ndarray], own: np.ndarray) -> np.ndarray:
        found = np.zeros(len(ids))
        for d, weight in zip(docs, own, strict=True):
            at = np.searchsorted(ids, d)
            at[at == len(ids)] = 0
            found[at[ids[at] == d]] += weight
        return found

    p, in_u = (counts(docs, own) for docs, own in zip((positive, unlabelled), weights, strict=True))
    rate_p, rate_u = (p + 0.5) / (weights[0].sum() + 1), (in_u + 0.5) / (weights[1].sum() + 1)
    gain = np.where((rate_p > 1.5 * rate_u) & (p >= 2), p * np.log(rate_p / rate_u), 0)
    best = np.lexsort((ids, -gain))[:most]
    return [int(ids[i]) for i in best if gain[i] > 9]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most_features: int = 1024, steps: int = 400, rate: float = 0.05, decay: float | None = None) -> ToxicModel:
    """Non-negative PU learning of a logistic model by Adam on the whole bounded sample; fewer examples, more weight decay."""
    shared = shared_weights(positive), shared_weights(unlabelled)
    chosen = choose_features(positive, unlabelled, most_features, shared) if positive and unlabelled else []
    if not chosen or not 0 < prior < 1:
        return ToxicModel({}, -2.0)
    decay = min(2e-3, 0.2 / shared[0].sum()) if decay is None else decay
    chosen.sort()
    features = np.array(chosen, dtype=np.uint64)

    def matrix(docs: list[np.ndarray]) -> np.ndarray:
        x = np.ones((len(docs), len(chosen) + 1), dtype=np.float32)
        for i, d in enumerate(docs):
            x[i, :-1] = np.isin(features, d)
        return x

    xp, xu = matrix(positive), matrix(unlabelled)
    ap, au = (x / x.sum() for x in shared)
    w = np.zeros(len(chosen) + 1)
    w[-1] = -1
    m, v, mean = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    keep = np.r_[np.full(len(chosen), decay), 0]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        zp, zu = xp @ w.astype(np.float32), xu @ w.astype(np.float32)
        sp, su = sigmoid(zp), sigmoid(zu)
        as_negative = au @ np.logaddexp(0, zu) - prior * (ap @ np.logaddexp(0, zp))
        g_positive = prior * (xp.T @ (ap * (sp - 1)).astype(np.float32))
        g_negative = xu.T @ (au * su).astype(np.float32) - prior * (xp.T @ (ap * sp).astype(np.float32))
        g = (g_positive + g_negative if as_negative >= 0 else -g_negative) + keep * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if 2 * step > steps:  # steps against a negative risk make w swing; its mean does not
            mean += w / (steps - steps // 2)
    return ToxicModel({f: float(x) for f, x in zip(chosen, mean, strict=False)}, float(mean[-1]))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordFeatures()
    for batch in batches:
        if len(known) > _CACHED_WORDS:
            known.clear()
        found = [text_features(t.as_py(), known).tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["p", "u", "features"])


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 1500, max_unlabelled: int = 4000) -> ToxicModel:
    """A model from the labels of rows where may_learn holds; U takes no label into account."""
    known = labels.filter(may_learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0]
    learned = docs.filter(may_learn & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    confirmed = known.filter("toxic = 1")
    yes, no = F.lit(1), F.lit(0)
    p = bounded_sample(confirmed, "id", max_positive).select("id", yes.alias("p"), no.alias("u"))
    u = bounded_sample(learned, "id", max_unlabelled).select("id", no.alias("p"), yes.alias("u"))
    chosen = p.unionByName(u).groupBy("id").agg(F.max("p").alias("p"), F.max("u").alias("u"))  # max_positive + max_unlabelled rows at most
    texts = learned.join(F.broadcast(chosen), "id").groupBy("id", "p", "u").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = texts.select("p", "u", "text").repartition(shuffle_partitions(docs.sparkSession))  # so that no few tasks get all
    rows = map_arrow(texts, _features_of, "p int, u int, features binary").collect()
    rows.sort(key=lambda r: r.features)  # one order, whatever the partitions
    positive, unlabelled = ([np.frombuffer(r.features, dtype=np.uint64) for r in rows if r[role]] for role in ("p", "u"))
    return fit(positive, unlabelled, prior or 0.0)


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text", keep: tuple[str, ...] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns ``keep`` (all if None) of every row, then the score and the prediction, under ``names``."""
    keep = tuple(docs.columns) if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (whole,) = fresh_names(("text",), [*keep, *names])
    rows = docs.select(*keep, F.col(text_col).alias(whole))
    added = f"`{names[0]}` double, `{names[1]}` int"
    names = [*keep, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in batches:
            scores = [own.score(t.as_py(), cache) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=names)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)])
    return map_arrow(rows, run, f"{fields}{added}")
