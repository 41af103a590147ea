"""Text functions as Column builders (survey T1-T26), in two profiles: "lab" and "web".

Everything here is a built-in expression, so it stays in the JVM and inside the scan's
stage. A null text counts as empty.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import constants as C

#: What \\s matches in a pattern.
WHITE_SPACE = " \t\n\x0b\f\r"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def tokenize_lab(text: Column, hyphen_mode: str = "split") -> Column:
    """Case is preserved; hyphens split, join, become underscores, or are kept within words."""
    text = text_or_empty(text)
    if hyphen_mode == "keep":
        return F.regexp_extract_all(text, F.lit(C.LAB_HYPHENATED_TOKEN), F.lit(0))
    by = {"split": " ", "join": "", "underscore": "_"}[hyphen_mode]
    return F.regexp_extract_all(F.replace(text, F.lit("-"), F.lit(by)), F.lit(C.LAB_TOKEN), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bare(text: Column) -> Column:
    """Tags and URLs off, lower case. A text without their first characters skips their patterns."""
    text = text_or_empty(text)
    untagged = F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, C.TAG, " ")).otherwise(text)
    linked = lambda t: F.contains(t, F.lit("http")) | F.contains(t, F.lit("www."))
    return F.lower(let(untagged, lambda t: F.when(linked(t), F.regexp_replace(t, C.URL, " ")).otherwise(t)))


def clean_text(text: Column) -> Column:
    """Tags and URLs off, lower case, letters a-z, digits, hyphens and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(_bare(text), r"[^a-z0-9\s-]", " "), r"\s+", " "))


def tokenize_web(text: Column) -> Column:
    """The tokens of the cleaned text. What the cleaning makes a space is no part of a token anyway."""
    return F.regexp_extract_all(_bare(text), F.lit(C.WEB_TOKEN), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased raw text."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(C.WEB_TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    """T4: the crawler's set of tokens, without cleaning."""
    return F.array_distinct(plain_tokens(text))


def remove_stopwords_lab(tokens: Column) -> Column:
    """T5: compares in lower case."""
    return F.filter(tokens, lambda t: ~F.lower(t).isin(C.LAB_STOPWORDS))


def remove_stopwords_web(tokens: Column) -> Column:
    """Single characters go as well."""
    return F.filter(tokens, lambda t: ~t.isin(C.WEB_STOPWORDS) & (F.length(t) > 1))


def _cut(w: Column, n: int, by: str = "") -> Column:
    """w without its last n characters, and something else in their place."""
    head = F.substring(w, F.lit(1), F.length(w) - n)
    return F.concat(head, F.lit(by)) if by else head


def _ends(w: Column, letters: str) -> Column:
    return F.substring(w, -1, 1).isin(*letters)


def _stem(w: Column) -> Column:
    found = None
    for suffix, by in C.SUFFIX_RULES.items():
        hit = (F.length(w) > len(suffix) + 2) & F.endswith(w, F.lit(suffix))
        found = F.when(hit, _cut(w, len(suffix), by)) if found is None else found.when(hit, _cut(w, len(suffix), by))
    return F.when(_ends(w, "".join(sorted({s[-1] for s in C.SUFFIX_RULES}))), found.otherwise(w)).otherwise(w)


def stem(word: Column) -> Column:
    """The first suffix rule that leaves more than two characters."""
    return _stem(F.lower(word))


def _irregular(w: Column, table: dict[str, str]) -> Column:
    found = None
    for base in dict.fromkeys(table.values()):
        forms = [k for k, v in table.items() if v == base]
        found = F.when(w.isin(forms), F.lit(base)) if found is None else found.when(w.isin(forms), F.lit(base))
    return F.when(w.isin(list(table)), found)  # one look-up for most words


def _lemma_lab(w: Column) -> Column:
    n = F.length(w)
    base = _cut(w, 3)
    undoubled = F.when((F.length(base) > 2) & (F.substring(base, -1, 1) == F.substring(base, -2, 1)), _cut(base, 1)).otherwise(base)
    rules = (
        F.when((n > 4) & F.endswith(w, F.lit("ies")), _cut(w, 3, "y"))
        .when((n > 5) & F.endswith(w, F.lit("ing")), undoubled)
        .when((n > 4) & (F.endswith(w, F.lit("ed")) | F.endswith(w, F.lit("es"))), _cut(w, 2))
        .when((n > 3) & F.endswith(w, F.lit("s")), _cut(w, 1))
        .otherwise(w)
    )
    return _irregular(w, C.LAB_LEMMAS).when(_ends(w, "dgs"), rules).otherwise(w)


def lemma_lab(word: Column) -> Column:
    """T8."""
    return _lemma_lab(F.lower(word))


def _lemma_web(w: Column) -> Column:
    n = F.length(w)
    rules = (
        F.when((n > 4) & F.endswith(w, F.lit("ies")), _cut(w, 3, "y"))
        .when((n > 5) & F.endswith(w, F.lit("ing")), _cut(w, 3))
        .when((n > 3) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), _cut(w, 1))
        .otherwise(w)
    )
    return _irregular(w, C.WEB_LEMMAS).when(_ends(w, "gs"), rules).otherwise(w)


def lemma_web(word: Column) -> Column:
    """T9."""
    return _lemma_web(F.lower(word))


def preprocess_lab(text: Column, lower: bool = True, stop: bool = True, hyphen_mode: str = "split", normalization: str = "lemmatization") -> Column:
    """T10."""
    tokens = tokenize_lab(F.lower(text) if lower else text, hyphen_mode)
    if stop:
        tokens = F.filter(tokens, lambda t: ~t.isin(C.LAB_STOPWORDS)) if lower else remove_stopwords_lab(tokens)
    if normalization == "none":
        return tokens
    tokens = tokens if lower else F.transform(tokens, F.lower)
    return F.transform(tokens, _stem if normalization == "stemming" else _lemma_lab)  # no rule leaves an empty word


def lab_terms(words: Column) -> Column:
    """T10 for a column of distinct lower-case tokens: the term, or null for a stopword."""
    return F.when(~words.isin(C.LAB_STOPWORDS), _lemma_lab(words))


def preprocess_web(text: Column, stop: bool = True, normalize: str = "none") -> Column:
    """T11."""
    tokens = tokenize_web(text)
    if stop:
        tokens = remove_stopwords_web(tokens)
    if normalize == "stem":
        tokens = F.transform(tokens, _stem)
    elif normalize == "lemma":
        tokens = F.transform(tokens, _lemma_web)
    return tokens


def joined(tokens: Column) -> Column:
    """T12."""
    return F.array_join(tokens, " ")


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Empty if there are fewer than n tokens. Shifted arrays are zipped; a lambda over positions would
    evaluate the tokens again for each of them. Give tokens as a column of their own where they are costly."""
    size = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), size)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(tokens, F.lit(k), size), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def snippet(text: Column, query: str, width: int = 260) -> Column:
    """A window around the first match of any query term, terms marked, longest first."""
    text = F.regexp_replace(text_or_empty(text), r"^\s+|\s+$", "")
    terms = list(dict.fromkeys(re.findall(C.LAB_TOKEN, query.replace("-", " "))))
    if not terms:
        return F.concat(F.substring(text, 1, width), F.when(F.length(text) > width, "...").otherwise(""))
    at = F.regexp_instr(text, F.lit("(?i)" + "|".join(terms)))
    start = F.greatest(F.lit(0), at - 1 - 90)
    shown = F.when(at == 0, F.substring(text, 1, width)).otherwise(F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, F.lit(width))))
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        shown = F.regexp_replace(shown, f"(?i)({term})", "**$1**")
    return F.concat(shown, F.when(F.length(shown) >= width, "...").otherwise(""))


def content_hash(text: Column) -> Column:
    """Of the trimmed, lower-cased text with single spaces, the first 16 hex digits of SHA-256."""
    plain = F.regexp_replace(F.lower(F.btrim(text_or_empty(text), F.lit(WHITE_SPACE))), rf"[{WHITE_SPACE}]{{2,}}|[{WHITE_SPACE[1:]}]", " ")  # a lone space stays as it is
    return F.substring(F.sha2(plain, 256), 1, 16)


def soundex(word: Column) -> Column:
    """Letters only; no letter, no code."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    return F.when(letters == "", F.lit("")).otherwise(F.soundex(letters))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def syllables(word: Column) -> Column:
    """T19."""
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit(C.VOWELS))
    return F.greatest(F.lit(1), groups - F.when((groups > 1) & F.endswith(w, F.lit("e")), 1).otherwise(0))


def flesch(text: Column, words: Column | None = None) -> Column:
    """0 without words; else held within 0 to 100, one decimal. The text is tokenized once, unless its words are given."""
    sentences = F.greatest(F.regexp_count(text_or_empty(text), F.lit(C.SENTENCE_END)), F.lit(1))

    def of_line(line: Column, n: Column) -> Column:
        # Over the joined words: all vowel groups, less one for each word that ends in e and has another group, and one for each word without any.
        silent = F.regexp_count(line, F.lit("[aeiouy][a-z0-9]*[b-df-hj-np-tv-xz0-9][aeiouy]*e "))
        spoken = F.regexp_count(line, F.lit(C.VOWELS)) - silent + F.regexp_count(line, F.lit(" [b-df-hj-np-tv-xz0-9]+ "))
        score = F.lit(206.835) - F.lit(1.015) * (n / sentences) - F.lit(84.6) * (spoken / F.nullif(n, F.lit(0)))
        return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1))

    def of_words(words: Column) -> Column:
        return let(F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" ")), lambda line: of_line(line, F.size(words)))

    return let(tokenize_web(text) if words is None else words, of_words)


def word_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(text_or_empty(text), F.lit(r"\S+"))


def kgrams(term: Column, k: int = 3) -> Column:
    """Of the term between two $."""
    padded = F.concat(F.lit("$"), term, F.lit("$"))
    spans = F.transform(F.sequence(F.lit(1), F.length(padded) - (k - 1)), lambda i: F.substring(padded, i, F.lit(k)))
    return F.when(F.length(padded) >= k, spans).otherwise(F.array().cast("array<string>"))


def query_kgrams(term: str, k: int = 3) -> list[str]:
    padded = f"${term.lower()}$"
    return [padded[i : i + k] for i in range(max(0, len(padded) - k + 1))]


def wildcard(term: Column, pattern: str) -> Column:
    """The whole term against a shell pattern in lower case."""
    return term.rlike("^" + fnmatch.translate(pattern.lower()).replace(r"\Z", "").replace(r"\z", "") + "$")


def posting_list(postings: Column, most: int = 15) -> Column:
    """T24: "doc:tf" of the first postings, an array of structs (doc_id, tf)."""
    return F.array_join(F.transform(F.slice(postings, 1, most), lambda p: F.concat(p["doc_id"].cast("string"), F.lit(":"), p["tf"].cast("string"))), ", ")


# The same functions over a driver-side query string, for plans that are built from it.


def stem_word(word: str) -> str:
    w = word.lower()
    hit = next((s for s in C.SUFFIX_RULES if len(w) > len(s) + 2 and w.endswith(s)), None)
    return w if hit is None else w.removesuffix(hit) + C.SUFFIX_RULES[hit]


def lemma_word_lab(word: str) -> str:
    w = word.lower()
    if w in C.LAB_LEMMAS:
        return C.LAB_LEMMAS[w]
    n = len(w)
    if n > 4 and w.endswith("ies"):
        return f"{w[:-3]}y"
    if n > 5 and w.endswith("ing"):
        return re.sub(r"(?<=.)(.)\1$", r"\1", w[:-3])
    if n > 4 and w.endswith(("ed", "es")):
        return w[:-2]
    return w[:-1] if n > 3 and w.endswith("s") else w


def query_tokens_lab(query: str, stop: bool = True, hyphen_mode: str = "split", normalization: str = "lemmatization") -> list[str]:
    by = {"split": " ", "join": "", "underscore": "_"}.get(hyphen_mode)
    tokens = re.findall(C.LAB_HYPHENATED_TOKEN if by is None else C.LAB_TOKEN, query.lower() if by is None else query.lower().replace("-", by))
    tokens = [t for t in tokens if not stop or t not in C.LAB_STOPWORDS]
    change = {"stemming": stem_word, "lemmatization": lemma_word_lab}.get(normalization, str)
    return [t for t in map(change, tokens) if t]


def query_tokens_web(query: str, stop: bool = True) -> list[str]:
    plain = re.sub(C.URL, " ", re.sub(C.TAG, " ", query)).lower()
    return [t for t in re.findall(C.WEB_TOKEN, plain) if not stop or (t not in C.WEB_STOPWORDS and len(t) > 1)]
