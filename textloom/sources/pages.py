"""Fields of fetched HTML pages (survey S8-S12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import constants as C


def absolute_links(html: Column, most: int = 15) -> Column:
    """The first distinct absolute links, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(C.ABSOLUTE_LINK), F.lit(1))), 1, most)


def all_links(html: Column, most: int = 15) -> Column:
    """S9 for relative links as well."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(C.ANY_LINK), F.lit(1))), 1, most)


def page_text(html: Column, most: int = 4000) -> Column:
    """Tags off, single spaces, the first characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), C.TAG, " "), r"\s+", " ")), 1, most)


def page_title(html: Column, url: Column) -> Column:
    """Of the title element, else the URL."""
    found = F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), C.TITLE, 1), C.TAG, ""))
    return F.when(found == "", url).otherwise(found)


def parse_pages(pages: DataFrame) -> DataFrame:
    """A table of fetched (url, html) as pages of the crawl's shape; what was not fetched has no row."""
    return pages.select(
        "url", page_title(F.col("html"), F.col("url")).alias("title"), page_text(F.col("html")).alias("text"), F.lit("live-web").alias("category"), F.lit("crawl").alias("source_type"),
        F.lit(False).alias("is_exact_duplicate"), F.lit(False).alias("is_near_duplicate"), F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("string").alias("doc_id"), absolute_links(F.col("html")).alias("outlinks"),
    )


def page_links(parsed: DataFrame) -> DataFrame:
    """src, dst, pos of parsed pages."""
    return parsed.select(F.col("url").alias("src"), F.posexplode("outlinks").alias("pos", "dst")).select("src", "dst", F.col("pos").cast("long").alias("pos"))
