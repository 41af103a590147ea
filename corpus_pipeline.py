"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents, and whatever further columns there are, of any name.

Edge cases: null texts and texts without letters go in the language stage; a null lang or
source changes nothing; rows with a null id stay in all stages but the exact dedup, where an
equal text with an id beats them; rows that repeat an id are told apart by their texts and
rows that repeat both are copies, of which the exact dedup keeps one; without toxic labels no
document is toxic, and without any lang none is known, so that all go; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, language_id, packing, toxicity
from textloom.llm.common import Scratch, fresh_names, table
from textloom.llm.jaccard_join import keep_one_each
from textloom.llm.language_id import in_fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts to be toxic go. It learns from labelled documents outside the held-out fold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~in_fold("doc_id", 5, 0))
    names = fresh_names(("score", "predicted"), docs.columns)
    return toxicity.score(docs, model, names=names).filter(F.col(names[1]) == 0).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those unlike every learned language, go."""
    model = language_id.train(docs, ~in_fold("doc_id", 4, 2))
    names = fresh_names(("lang_pred", "score", "entropy", "rejected"), docs.columns)
    return language_id.identify(docs, model, names=names).filter(~F.col(names[3])).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.keep_winners(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the row with the smallest id stays."""
    return keep_one_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, with the sequence of each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("packing", pack_sequences),
]

#: SQL can express neither the models nor the tokens; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
