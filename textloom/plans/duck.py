"""DuckDB expressions for the oracles, written from the definitions and apart from the Spark builders."""

from __future__ import annotations

from textloom.functions import constants as C


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def lab_tokens(text: str, mode: str = "split") -> str:
    t = f"coalesce({text}, '')"
    if mode == "keep":
        return f"regexp_extract_all({t}, '{C.LAB_HYPHENATED_TOKEN}')"
    by = {"split": " ", "join": "", "underscore": "_"}[mode]
    return f"regexp_extract_all(replace({t}, '-', '{by}'), '{C.LAB_TOKEN}')"


def clean(text: str) -> str:
    bare = f"lower(regexp_replace(regexp_replace(coalesce({text}, ''), '{C.TAG}', ' ', 'g'), '{C.URL}', ' ', 'g'))"
    return rf"trim(regexp_replace(regexp_replace({bare}, '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


def web_tokens(text: str) -> str:
    return f"regexp_extract_all({clean(text)}, '{C.WEB_TOKEN}')"


def plain_tokens(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{C.WEB_TOKEN}')"


def without_lab_stopwords(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: lower(t) NOT IN ({quoted(C.LAB_STOPWORDS)}))"


def without_web_stopwords(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: length(t) > 1 AND t NOT IN ({quoted(C.WEB_STOPWORDS)}))"


def stem(w: str) -> str:
    rules = " ".join(f"WHEN length({w}) > {len(s) + 2} AND suffix({w}, '{s}') THEN left({w}, length({w}) - {len(s)}) || '{r}'" for s, r in C.SUFFIX_RULES.items())
    return f"CASE {rules} ELSE {w} END"


def _irregular(w: str, table: dict[str, str]) -> str:
    return " ".join(f"WHEN {w} = '{k}' THEN '{v}'" for k, v in table.items())


def lemma_lab(w: str) -> str:
    base = f"left({w}, length({w}) - 3)"
    return (
        f"CASE {_irregular(w, C.LAB_LEMMAS)} WHEN length({w}) > 4 AND suffix({w}, 'ies') THEN {base} || 'y' "
        f"WHEN length({w}) > 5 AND suffix({w}, 'ing') THEN CASE WHEN right({base}, 1) = left(right({base}, 2), 1) AND length({base}) > 2 THEN left({w}, length({w}) - 4) ELSE {base} END "
        f"WHEN length({w}) > 4 AND suffix({w}, 'ed') THEN left({w}, length({w}) - 2) WHEN length({w}) > 4 AND suffix({w}, 'es') THEN left({w}, length({w}) - 2) "
        f"WHEN length({w}) > 3 AND suffix({w}, 's') THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def lemma_web(w: str) -> str:
    return (
        f"CASE {_irregular(w, C.WEB_LEMMAS)} WHEN length({w}) > 4 AND suffix({w}, 'ies') THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN length({w}) > 5 AND suffix({w}, 'ing') THEN left({w}, length({w}) - 3) "
        f"WHEN length({w}) > 3 AND suffix({w}, 's') AND NOT suffix({w}, 'ss') THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def lab(text: str, normalization: str = "lemmatization", stop: bool = True) -> str:
    tokens = lab_tokens(f"lower({text})")
    tokens = without_lab_stopwords(tokens) if stop else tokens
    change = {"lemmatization": lemma_lab, "stemming": stem}.get(normalization)
    return f"list_filter(list_transform({tokens}, lambda w: {change('w')}), lambda t: t <> '')" if change else tokens


def web(text: str, normalize: str = "none") -> str:
    tokens = without_web_stopwords(web_tokens(text))
    change = {"stem": stem, "lemma": lemma_web}.get(normalize)
    return f"list_transform({tokens}, lambda w: {change('w')})" if change else tokens


def rows(tokens: str, table: str = "documents") -> str:
    """A query of doc_id, pos, term."""
    return f"SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS term FROM (SELECT doc_id, {tokens} AS w FROM {table})"


def postings(tokens: str, table: str = "documents") -> str:
    return f"SELECT term, doc_id, count(*)::BIGINT AS tf FROM ({rows(tokens, table)}) GROUP BY term, doc_id"


def syllables(w: str) -> str:
    n = f"len(regexp_extract_all({w}, '{C.VOWELS}'))"
    return f"greatest(1, {n} - CASE WHEN {n} > 1 AND suffix({w}, 'e') THEN 1 ELSE 0 END)"


def content_hash(text: str) -> str:
    return rf"left(sha256(regexp_replace(lower(regexp_replace(coalesce({text}, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')), 16)"


def flesch(text: str, words: str) -> str:
    n = f"len({words})"
    spoken = f"list_sum(list_transform({words}, lambda w: {syllables('w')}))"
    sentences = f"greatest(len(regexp_extract_all(coalesce({text}, ''), '{C.SENTENCE_END}')), 1)"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE round(greatest(0.0, least(100.0, 206.835 - 1.015 * ({n}::DOUBLE / {sentences}) - 84.6 * ({spoken}::DOUBLE / {n}))), 1) END"


def word_count(text: str) -> str:
    return rf"len(regexp_extract_all(coalesce({text}, ''), '\S+'))"


def ngrams(w: str, n: int = 2) -> str:
    return f"list_transform(range(1, greatest(len({w}) - {n - 1} + 1, 1)), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


def tfidf(tokens: str, max_features: int | None, min_chars: int = 2) -> str:
    """CTEs p (postings), n, v (term, df, cf, idf of the capped vocabulary), w (term, doc_id, weight)."""
    cap = f"LIMIT {max_features}" if max_features else ""
    return f"""p AS ({postings(tokens)}),
        n AS (SELECT count(*) AS n FROM documents),
        v0 AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM p WHERE length(term) >= {min_chars} GROUP BY term ORDER BY cf DESC, term {cap}),
        v AS (SELECT term, df, cf, ln((1 + n.n) / (1 + df)::DOUBLE) + 1 AS idf FROM v0, n),
        r AS (SELECT p.term, p.doc_id, p.tf * v.idf AS x FROM p JOIN v ON p.term = v.term),
        l AS (SELECT doc_id, sqrt(sum(x * x)) AS len FROM r GROUP BY doc_id),
        w AS (SELECT r.term, r.doc_id, r.x / l.len AS weight FROM r JOIN l ON r.doc_id = l.doc_id)"""


def query_values(queries: dict[str, list[str]]) -> str:
    out = [(q, t, ts.count(t)) for q, ts in queries.items() for t in dict.fromkeys(ts)]
    return "(VALUES " + ", ".join(f"({quoted([q])}, {quoted([t])}, {k})" for q, t, k in out) + ") AS q(qid, term, qtf)"


def scores(queries: dict[str, list[str]]) -> str:
    """CTEs after tfidf(): s (qid, doc_id, score)."""
    return f"""qw0 AS (SELECT q.qid, q.term, q.qtf * v.idf AS x FROM {query_values(queries)} JOIN v ON q.term = v.term),
        qw AS (SELECT qid, term, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS qw FROM qw0),
        s AS (SELECT qw.qid, w.doc_id, sum(w.weight * qw.qw) AS score FROM w JOIN qw ON w.term = qw.term GROUP BY qw.qid, w.doc_id)"""
