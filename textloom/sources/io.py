"""Collection sources and sinks (survey S1-S5, S13, K1-K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.corpus import CONTENT, METADATA

DATASET = "doc_id string, category string, title string, text string"

#: What the reader gives for a quoted empty field; by default it gives null, as for a bare one.
_EMPTY = "\x01textloom: empty\x01"

#: Records of the bundled article feed: two per category, in the shape of the API's JSON.
FEED = [
    ("A001", "business", "Harbour trade picks up", "Container traffic through the northern harbour rose for a third month as exporters cleared their spring backlog."),
    ("A002", "business", "Bakers face dearer flour", "Small bakeries said the price of flour had doubled within a year and that contracts now run for weeks, not months."),
    ("A003", "politics", "Council votes on night buses", "The city council agreed to fund night buses for two more years after a long debate about the cost of the service."),
    ("A004", "politics", "Minister sets out water plan", "The minister for the environment presented a plan to mend leaking water mains before the next dry summer."),
    ("A005", "sport", "Late goal settles the derby", "A header in the last minute gave the visitors their first win in the derby since the stadium was rebuilt."),
    ("A006", "sport", "Rowers name their eight", "The rowing club named the crew for the autumn regatta, with three newcomers in the boat."),
    ("A007", "tech", "Sensors watch the old bridge", "Engineers fixed two hundred sensors to the bridge and will publish its movements on an open website."),
    ("A008", "tech", "School builds its own network", "Pupils and parents laid cables through a village school and now run the network themselves."),
    ("A009", "entertainment", "Puppet theatre reopens", "The puppet theatre opened its doors again with a play about a lighthouse and a stubborn goat."),
    ("A010", "entertainment", "Choir records in a quarry", "A choir of miners recorded its new album in a disused quarry because of the long echo."),
]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header; types are inferred and quoted fields may span lines."""
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The dataset's four columns as strings, by name. A quoted empty field is an empty string, a bare one is null."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', schema=DATASET, enforceSchema=False, emptyValue=_EMPTY)
    return rows.select(*(F.when(F.col(c) == _EMPTY, "").otherwise(F.col(c)).alias(c) for c in rows.columns))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: one document per block between blank lines, numbered D001 and on over the files in the order of their names."""
    whole = spark.read.text(path, wholetext=True)
    blocks = whole.select(F.input_file_name().alias("file"), F.filter(F.transform(F.split("value", r"\n\s*\n"), lambda b: F.trim(F.regexp_replace(b, r"^\s+|\s+$", ""))), lambda b: b != "").alias("b"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    before = blocks.select("file", F.size("b").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = blocks.join(before, "file").select("before", F.posexplode("b").alias("i", "text"))
    return placed.select(F.format_string("D%03d", F.col("before") + F.col("i") + 1).alias("doc_id"), "text")


def fetch_articles(spark: SparkSession) -> DataFrame:
    """doc_id, category, title, text of the feed."""
    return spark.createDataFrame(FEED, DATASET)


def init_store(spark: SparkSession, path: str) -> None:
    """K2: both tables, empty, unless they exist."""
    if load_corpus(spark, path) is None:
        meta = spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in METADATA.items()))
        save_corpus(meta, spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in CONTENT.items())), path)


def save_corpus(meta: DataFrame, texts: DataFrame, path: str) -> None:
    """K1: the fixed columns of both tables, replacing what is there."""
    meta.select(*METADATA).write.mode("overwrite").parquet(f"{path}/metadata")
    texts.select(*CONTENT).write.mode("overwrite").parquet(f"{path}/content")


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Both tables, or None if one is missing."""
    parts = [f"{path}/metadata", f"{path}/content"]
    if not all(_exists(spark, p) for p in parts):
        return None
    return tuple(spark.read.parquet(p) for p in parts)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def store_size_kb(spark: SparkSession, path: str) -> float:
    """K3: the length of all files, in KB."""
    p, fs = _hadoop(spark, path)
    return round(fs.getContentSummary(p).getLength() / 1024, 1) if fs.exists(p) else 0.0


def write_csv(df: DataFrame, path: str) -> None:
    """K4, K5."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def summary_markdown(counts: DataFrame) -> str:
    """K6: a report from one row of counts."""
    row = counts.first().asDict()
    return "\n".join(["# Inference summary", "", *(f"- {k.replace('_', ' ')}: {v}" for k, v in row.items()), ""])


#: Components and where they live.
COMPONENTS = [
    ("workflow", "implemented", "textloom.plans.catalog"),
    ("preprocessing", "implemented", "textloom.functions.text"),
    ("inverted index", "implemented", "textloom.operators.index"),
    ("stemming and lemmatization", "implemented", "textloom.operators.retrieve"),
    ("phrase queries", "implemented", "textloom.operators.retrieve"),
    ("dictionary lookup", "implemented", "textloom.operators.retrieve"),
    ("tolerant retrieval", "implemented", "textloom.operators.retrieve"),
]


def components(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPONENTS, "component string, status string, evidence string")
