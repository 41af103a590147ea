"""Collections: ids, metadata and content, merging, overviews (survey S14-S15, W1, C8, U1, A1g-A5g, F2-F9, J1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import text as X
from textloom.plans.lineage import cut

METADATA = {
    "id": "string", "url": "string", "source_type": "string", "category": "string", "title": "string", "depth": "int", "parent_url": "string",
    "discovered_at": "string", "content_hash": "string", "is_exact_duplicate": "int", "is_near_duplicate": "int", "duplicate_of": "string", "word_count": "int", "doc_id": "string",
}
CONTENT = {"id": "string", "raw_text": "string", "clean_text": "string"}


def collection(documents: DataFrame, category: str = "lang") -> DataFrame:
    """doc_id, category, title (the first line), text of a documents table."""
    title = F.substring_index(X.text_or_empty(F.col("text")), "\n", 1)
    return documents.select("doc_id", F.col(category).cast("string").alias("category"), title.alias("title"), "text")


def text_column(df: DataFrame) -> str | None:
    """S14: "text" if it is there, else the first string column that is not doc_id."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name != "doc_id"]
    return "text" if "text" in names else next(iter(names), None)


def synthesize_ids(df: DataFrame) -> DataFrame:
    """D0001 and on, in input order, where there is no doc_id: a row's number in its partition, and the rows of the
    partitions before it. The input is written first, so that both passes see the same partitions."""
    if "doc_id" in df.columns:
        return df
    placed = cut(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(before, "_part")
    number = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return numbered.select(*df.columns, F.format_string("D%04d", number).alias("doc_id"))


def repair_ids(df: DataFrame, order: Column) -> DataFrame:
    """Repeats of an id get _dup1, _dup2 and on, in the given order. Only repeated ids share a task."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1
    return df.withColumn("_n", nth).withColumn("doc_id", F.when(F.col("_n") > 0, F.concat(F.col("doc_id").cast("string"), F.lit("_dup"), F.col("_n").cast("string"))).otherwise(F.col("doc_id").cast("string"))).drop("_n")


def metadata(docs: DataFrame, source_type: str, url_prefix: str) -> DataFrame:
    """The 14 columns of a row that was not found by a crawl."""
    values = {
        "id": F.col("doc_id"), "url": F.concat(F.lit(url_prefix), F.col("doc_id").cast("string")), "source_type": F.lit(source_type), "category": F.col("category"), "title": F.col("title"),
        "depth": F.lit(0), "content_hash": X.content_hash(F.col("text")), "is_exact_duplicate": F.lit(0), "is_near_duplicate": F.lit(0), "word_count": X.word_count(F.col("text")), "doc_id": F.col("doc_id"),
    }
    return docs.select(*(values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in METADATA.items()))


def content(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("raw_text"), F.lit(None).cast("string").alias("clean_text"))


def base_corpus(dataset: DataFrame, api: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Metadata and content of the dataset and of the API's records (doc_id, category, title, text)."""
    meta, texts = metadata(dataset, "dataset", "dataset://bbc/"), content(dataset)
    if api is not None:
        meta, texts = meta.unionByName(metadata(api, "api", "api://mocknews/")), texts.unionByName(content(api))
    return meta, texts


def merge(base: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Both tables, one row per key; the base's rows win, so merging twice changes nothing."""
    both = base.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    by = Window.partitionBy(key).orderBy("_side")
    return both.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r", "_side")


def overview(docs: DataFrame, tokens: Column) -> DataFrame:
    """A2g: documents, vocabulary_size, avg_tokens_per_doc, missing_text."""
    own = docs.select(F.col("text").isNull().alias("missing"), tokens.alias("tokens"))
    sizes = own.agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg(F.size("tokens")), 2).alias("avg_tokens_per_doc"), F.count_if("missing").alias("missing_text"))
    terms = own.select(F.explode("tokens").alias("term")).agg(F.countDistinct("term").alias("vocabulary_size"))
    return sizes.crossJoin(terms).select("documents", "vocabulary_size", "avg_tokens_per_doc", "missing_text")


def dashboard(meta: DataFrame) -> DataFrame:
    """A3g."""
    return meta.agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("category").alias("categories"), F.countDistinct("source_type").alias("source_types"),
        F.sum("is_exact_duplicate").alias("exact_duplicates"), F.sum("is_near_duplicate").alias("near_duplicates"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A1g."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def length_histogram(docs: DataFrame, bins: int = 10) -> DataFrame:
    """A4g: bin (from 1), low, high, n: equal widths, closed to the right, over word counts. Rows without text do not count."""
    words = docs.filter(F.col("text").isNotNull()).select(X.word_count(F.col("text")).alias("words"))
    limits = words.agg(F.min("words").alias("lo"), F.max("words").alias("hi"))
    placed = words.crossJoin(F.broadcast(limits)).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    at = F.when(F.col("w") == 0, 1).otherwise(F.greatest(F.ceil((F.col("words") - F.col("lo")) / F.nullif(F.col("w"), F.lit(0.0))), F.lit(1))).cast("int")
    counted = placed.groupBy(at.alias("bin"), "lo", "w").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", F.round(F.col("lo") + (F.col("bin") - 1) * F.col("w"), 3).alias("low"), F.round(F.col("lo") + F.col("bin") * F.col("w"), 3).alias("high"), "n")


def action_times(log: DataFrame, action: str, seconds: str) -> DataFrame:
    """A5g: total per action of a log."""
    return log.groupBy(F.col(action).alias("action")).agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("total"))


def growth(log: DataFrame, time_col: str) -> DataFrame:
    """Day, added, documents (so far). One row per day is ordered."""
    days = log.groupBy(F.date_format(F.col(time_col), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("added"))
    return days.withColumn("documents", F.sum("added").over(Window.orderBy("day")))


def flagged(meta: DataFrame) -> DataFrame:
    """F2."""
    return meta.filter((F.col("is_exact_duplicate") == 1) | (F.col("is_near_duplicate") == 1))


def mentions_any(text: Column, terms: list[str]) -> Column:
    """a substring test on the lower-cased text, as the reference's relevance judgements are."""
    low = F.lower(X.text_or_empty(text))
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t))
    return out
