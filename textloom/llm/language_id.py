"""Language identification by interpolated Kneser-Ney character models.

Words are maximal runs of letters, lower-cased and padded (``^^^^word$``), so a
model's contexts end at word boundaries and a word's score depends on the word
alone: each Python worker scores a distinct word once and sums per document.

The n-grams of every order, over all languages, lie in one sorted array of 64-bit
hashes; parallel matrices (n-gram x language) hold the discounted probability of
the last character and the back-off weight of the n-gram as a context:
p_n(c|h) = alpha_n(hc) + gamma_n(h) * p_(n-1)(c|h'). Orders below the highest
count distinct left neighbours. A document gets the language of the lowest
cross-entropy per character; ties go to the language that sorts first.

Calibrated rejection: every fifth document of a language's sample is held back from
the counts; a document is rejected if its cross-entropy exceeds what the held-back
documents of its language show (mean plus 1.5 times their largest excess, 0.5 nats at
least, plus 8 standard deviations of a text of its length), or if it has no letter. A
language with fewer than ``LEAST_HELD`` held-back documents has no limit, so that of
its documents only those without letters are rejected.

Bounds: the models are fitted on at most ``sample_docs`` documents of each
language, the smallest by hash of their ids, each read whole; words are counted by the
executors. The models are broadcast. Prediction reads every whole text.

Edge cases: null and letterless texts get ``und``, score 0 and are rejected; rows
with a null text, lang or id train nothing; an id that repeats in a language is one
document, by the text of the smallest hash; a language with one document has a model;
with no training rows all texts are ``und``; an empty table gives an empty result;
further columns of any name are carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import bounded_sample, fresh_names, map_arrow

ORDER = 5
START, END = 2, 3
UND = "und"
#: Held-back documents that a language needs for a limit.
LEAST_HELD = 3
_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CACHED_WORDS, _CACHED_CHARS = 300_000, 8_000_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all padded words in a row; where each word's scored part starts; its length."""
    head, tail = chr(START) * (ORDER - 1), chr(END)
    joined = "".join(f"{head}{w}{tail}" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    scored = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
    starts = np.cumsum(scored + ORDER - 1) - scored
    return points, starts, scored


def _gram_hashes(points: np.ndarray) -> list[np.ndarray]:
    """For n = 1..ORDER, the hash of the n-gram that ends at each position (garbage where it would begin before the first)."""
    codes = _spread(points.astype(np.uint64) + np.uint64(1))
    out, h = [], np.zeros(len(points), dtype=np.uint64)
    for n in range(ORDER):
        shifted = np.zeros_like(codes)
        shifted[n:] = codes[: len(codes) - n] if n else codes
        h = h + shifted * (_MULTIPLIER ** np.uint64(n + 1))
        out.append(_spread(h + np.uint64(n)))
    return out


class LanguageModel:
    """Sorted hash arrays with their probabilities; score() gives nats per word and language."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], alphas: list[np.ndarray], gammas: list[np.ndarray], floor: np.ndarray) -> None:
        self.langs, self.grams, self.alphas, self.gammas, self.floor = langs, grams, alphas, gammas, floor
        self.mean = np.zeros(len(langs))
        self.margin = np.full(len(langs), np.inf)
        self.sigma = np.zeros(len(langs))

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words x languages) sums of log probabilities; characters scored, the word's end included."""
        points, starts, scored = _padded(words)
        hashes = _gram_hashes(points)
        at = np.repeat(starts - np.cumsum(scored) + scored, scored) + np.arange(scored.sum())
        p = np.broadcast_to(self.floor, (len(at), len(self.langs))).astype(np.float64)
        before = None
        for n in range(ORDER):
            table = self.grams[n]
            if n:
                p = p * self._rows(self.gammas[n - 1], table=self.grams[n - 1], hashes=before, missing=1.0)
            p = p + self._rows(self.alphas[n], table=table, hashes=hashes[n][at], missing=0.0)
            before = hashes[n][at - 1]
        ends = np.cumsum(scored) - scored
        return np.add.reduceat(np.log(np.maximum(p, 1e-12)), ends, axis=0), scored

    @staticmethod
    def _rows(values: np.ndarray, table: np.ndarray, hashes: np.ndarray, missing: float) -> np.ndarray:
        if not len(table):
            return np.full((len(hashes), values.shape[1]), missing)
        i = np.searchsorted(table, hashes)
        i[i == len(table)] = 0
        return np.where((table[i] == hashes)[:, None], values[i], missing)

    def entropies(self, texts: list[list[str]], cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents x languages) nats per character; characters of each. Documents come as word lists."""
        cache = {} if cache is None else cache
        new = list({w for words in texts for w in words if w not in cache})
        if new:
            sums, scored = self.score(new)
            cache.update((w, (*s, n)) for w, s, n in zip(new, sums.tolist(), scored.tolist(), strict=True))
        totals = np.array([np.sum([cache[w] for w in words], axis=0) if words else np.zeros(len(self.langs) + 1) for words in texts]).reshape(len(texts), len(self.langs) + 1)
        n = totals[:, -1]
        return -totals[:, :-1] / np.maximum(n, 1)[:, None], n

    def accepts(self, best: int, entropy: float, n: float) -> bool:
        return n > 0 and entropy <= self.mean[best] + self.margin[best] + 8 * self.sigma[best] / np.sqrt(n)


def _counts(words: Counter) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For n = 1..ORDER: the distinct n-grams' hashes, those of their contexts, and their counts (left neighbours below ORDER)."""
    vocabulary = list(words)
    points, starts, scored = _padded(vocabulary)
    at = np.repeat(starts - np.cumsum(scored) + scored, scored) + np.arange(scored.sum())
    weight = np.repeat(np.fromiter(words.values(), dtype=np.int64, count=len(words)), scored)
    hashes = _gram_hashes(points)
    grams, contexts, counts = [None] * ORDER, [None] * ORDER, [None] * ORDER
    for n in range(ORDER - 1, -1, -1):
        grams[n], first, inverse = np.unique(hashes[n][at], return_index=True, return_inverse=True)
        contexts[n] = hashes[n - 1][at[first] - 1] if n else np.zeros(len(first), dtype=np.uint64)
        counts[n] = np.bincount(inverse, weights=weight).astype(np.int64)
        at, weight = at[first], np.ones(len(first), dtype=np.int64)  # each distinct n-gram counts once for its suffix
    return grams, contexts, counts


def fit(words: dict[str, Counter]) -> LanguageModel:
    """Interpolated Kneser-Ney from the word counts of each language."""
    langs = sorted(lang for lang, found in words.items() if found)
    parts = {lang: _counts(words[lang]) for lang in langs}
    size = max(1, len(np.unique(np.concatenate([parts[x][0][0] for x in langs])))) + 1 if langs else 2
    tables = [np.unique(np.concatenate([np.concatenate([parts[x][0][n], parts[x][1][n + 1] if n + 1 < ORDER else parts[x][0][n]]) for x in langs])) if langs else np.zeros(0, np.uint64) for n in range(ORDER)]
    alphas = [np.zeros((len(t), len(langs)), dtype=np.float32) for t in tables]
    gammas = [np.ones((len(t), len(langs)), dtype=np.float32) for t in tables[:-1]]
    floor = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        grams, contexts, counts = parts[lang]
        for n in range(ORDER):
            ones, twos = np.count_nonzero(counts[n] == 1), np.count_nonzero(counts[n] == 2)
            discount = ones / (ones + 2 * twos) if ones else 0.5
            _, inverse = np.unique(contexts[n], return_inverse=True)
            total, kinds = np.bincount(inverse, weights=counts[n]), np.bincount(inverse)
            alphas[n][np.searchsorted(tables[n], grams[n]), k] = (counts[n] - discount) / total[inverse]
            weight = (discount * kinds / total)[inverse]
            if n:
                gammas[n - 1][np.searchsorted(tables[n - 1], contexts[n]), k] = weight
            else:
                floor[k] = weight[0] / size
    return LanguageModel(langs, tables, alphas, gammas, floor)


def calibrate(model: LanguageModel, held: dict[str, list[Counter]]) -> None:
    """Sets the rejection limits from the word counts of documents that the models' counts have not seen."""
    for k, lang in enumerate(model.langs):
        texts = [x for x in held.get(lang, []) if x]
        if len(texts) < LEAST_HELD:
            continue
        own, n = np.zeros(len(texts)), np.zeros(len(texts))
        for i, words in enumerate(texts):
            times = np.fromiter(words.values(), dtype=np.int64, count=len(words))
            sums, scored = model.score(list(words))
            n[i] = times @ scored
            own[i] = -(times @ sums[:, k]) / n[i]
        mean = np.average(own, weights=n)
        model.mean[k] = mean
        model.sigma[k] = np.sqrt(np.mean((own - mean) ** 2 * n))
        model.margin[k] = max(0.5, 1.5 * float(own.max() - mean))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Counter(words_of(t.as_py())) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], names=["lang", "at", "words", "times"])


def training_sample(docs: DataFrame, may_learn: Column, id_col: str, text_col: str, lang_col: str, sample_docs: int) -> DataFrame:
    """lang, at (the hash that orders them), words, times of a bounded sample of whole documents."""
    rows = docs.filter(may_learn & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("group"), F.col(text_col).alias("text"))
    chosen = bounded_sample(rows, "id", sample_docs, "group")
    texts = rows.join(F.broadcast(chosen), ["id", "group"])  # at most sample_docs rows per language
    texts = texts.groupBy("id", "group").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return map_arrow(texts.select("group", F.xxhash64("id"), "text"), _word_counts, "lang string, at long, words array<string>, times array<long>")


def train(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 500) -> LanguageModel:
    """Models of the languages in lang_col, from rows where may_learn holds."""
    rows = sorted(training_sample(docs, may_learn, id_col, text_col, lang_col, sample_docs).collect(), key=lambda r: (r.lang, r.at, r.words))
    counted: dict[str, Counter] = {}
    held: dict[str, list[Counter]] = {}
    place: Counter = Counter()
    for r in rows:
        words = Counter(dict(zip(r.words, r.times, strict=True)))
        place[r.lang] += 1
        if place[r.lang] % 5 == 0:  # never a language's first document
            held.setdefault(r.lang, []).append(words)
        else:
            counted.setdefault(r.lang, Counter()).update(words)
    model = fit(counted)
    calibrate(model, held)
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] | None = None, names: tuple[str, ...] = ("lang_pred", "score", "entropy", "rejected")) -> DataFrame:
    """The columns ``keep`` (all if None) of every row, then the language, score, entropy and rejection, under ``names``."""
    keep = tuple(docs.columns) if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (whole,) = fresh_names(("text",), [*keep, *names])
    rows = docs.select(*keep, F.col(text_col).alias(whole))
    added = ", ".join(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "double", "boolean"), strict=True))
    names = [*keep, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cache: dict = {}
        chars = 0
        for batch in batches:
            texts = batch.column(len(keep))
            preds: list[tuple] = []
            for begin in range(0, len(texts), 64):
                words = [[w for w in words_of(t or "") if w.isalpha() or any(map(str.isalpha, w))] for t in texts.slice(begin, 64).to_pylist()]
                size = len(cache)
                if size > _CACHED_WORDS or chars > _CACHED_CHARS:
                    cache.clear()
                    chars = size = 0
                entropy, n = own.entropies(words, cache) if own.langs else (np.zeros((len(words), 0)), np.zeros(len(words)))
                chars += 8 * (len(cache) - size) + sum(len(w) for ws in words for w in ws if len(w) > 64)
                for e, k in zip(entropy, n, strict=True):
                    if not k:
                        preds.append((UND, 0.0, None, True))
                        continue
                    best = int(np.argmin(e))
                    score = 1 / np.sum(np.exp((e[best] - e) * min(k, 50.0)))
                    preds.append((own.langs[best], float(score), float(e[best]), not own.accepts(best, e[best], k)))
            columns = [pa.array([p[i] for p in preds], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return map_arrow(rows, run, f"{fields}, {added}" if keep else added)


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, is fold."""
    return F.crc32(F.col(id_col).cast("string")) % folds == fold
