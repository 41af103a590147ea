"""One query per training-data operator, with production parameters, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import importance, language_id, packing, piece_sampling, toxicity
from textloom.llm.common import table
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.jaccard_join import jaccard_components, link_counts
from textloom.llm.language_id import in_fold
from textloom.llm.line_dedup import line_dedup
from textloom.llm.nn_descent import nearest_neighbours
from textloom.llm.warc import archive_round_trip


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), rule="common", min_docs=10, min_chars=1)


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return importance.resample(docs, importance.good_ids(table(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(in_fold("doc_id", 4, 2), F.lit(False))
    model = language_id.train(docs, ~held_out)
    found = language_id.identify(docs.select("doc_id", "text"), model, keep=("doc_id",))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(in_fold("doc_id", 5, 0), F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model, keep=("doc_id",)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents"), with_ids=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive_round_trip(table(spark, sf_dir, "pages"), min_dedup_bytes=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, k=10)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=5, threshold=75)


def op9_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"), words=5, threshold=75)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_importance": op2_importance,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_piece_sampling": op5_piece_sampling,
    "op6_warc": op6_warc,
    "op7_nn_descent": op7_nn_descent,
    "op8_packing": op8_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op9_jaccard_links": op9_jaccard_links,
    "op10_exact_dedup": op10_exact_dedup,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, p, string_split(coalesce(text, ''), chr(10))[p] AS line
            FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p FROM documents)
        ), keyed AS (
            SELECT doc_id, p, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines
        ), common AS (
            SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
        ), marked AS (
            SELECT keyed.doc_id, keyed.p, keyed.line, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k
        )
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
            SELECT page_id, payload, min(page_id) OVER (PARTITION BY payload) AS first,
                   list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: ('0x' || substr(h, 5 * i + 1, 5))::INT) AS parts
            FROM p
        )
        SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
               list_aggregate(list_transform(parts, lambda v: concat(
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32768) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 1024) % 32 + 1, 1),
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v // 32) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1))), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM d
    """,
    "op9_jaccard_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles
            FROM w
        ), e AS (
            SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), links AS (
            SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
        )
        SELECT s.doc_id, len(any_value(s.shingles))::BIGINT AS n_shingles, min(reach.other) AS component_id
        FROM s JOIN reach ON s.doc_id = reach.doc_id GROUP BY s.doc_id
    """,
    "op9_jaccard_links": rf"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingles
            FROM w
        ), c AS (
            SELECT doc_id, len(shingles) AS n, shingles, CASE WHEN len(shingles) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY shingles) END AS class_id FROM s
        ), e AS (
            SELECT doc_id, n, unnest(shingles) AS shingle FROM c WHERE doc_id = class_id
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), k AS (
            SELECT a, count(*) AS n_links FROM pairs GROUP BY a
        )
        SELECT c.doc_id, c.n::BIGINT AS n_shingles, c.class_id, coalesce(k.n_links, 0)::BIGINT AS n_links FROM c LEFT JOIN k ON c.class_id = k.a
    """,
    "op10_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWERED} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)
    """,
}
