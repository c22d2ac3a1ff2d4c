"""Article structure: reading view, table of contents, footnotes, breadcrumbs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import clean_text

PREAMBLES = ("Preamble", "Full Text")
LABEL = 50


def nonempty_articles(articles: DataFrame) -> DataFrame:
    """Articles that keep text after cleaning."""
    rows = articles.withColumn("clean", clean_text(F.col("text"))).where("clean <> ''")
    return rows.select("id", "document_id", "article_number", "clean", F.col("article_number").isin(*PREAMBLES).alias("is_preamble"))


def toc_entries(articles: DataFrame) -> DataFrame:
    """A label an article: its chapter, else the start of its text; blank labels go."""
    named = F.nullif(F.col("chapter"), F.lit(""))
    rows = articles.withColumn("clean", F.when(named.isNull(), clean_text(F.col("text"))))  # cleaned once, where it is shown
    clean = F.col("clean")
    start = F.when(F.length(clean) > LABEL, F.concat(F.rtrim(F.substring(clean, 1, LABEL)), F.lit("..."))).otherwise(clean)
    label = F.coalesce(named, start)
    number = F.when(F.col("article_number") != "Preamble", F.col("article_number"))
    return rows.select("id", "document_id", "sort_key", number.alias("number"), label.alias("label")).where(F.trim("label") != "")


def footnotes(articles: DataFrame) -> DataFrame:
    """A row a footnote: its number from 1 and its text; elements are strings or objects with text or content."""
    notes = articles.where("footnotes IS NOT NULL").select("id", F.posexplode(F.from_json("footnotes", "array<string>")).alias("pos", "note"))
    of = lambda key: F.get_json_object("note", f"$.{key}")
    text = F.when(F.col("note").startswith("{"), F.coalesce(of("text"), of("content"), F.lit(""))).otherwise(F.col("note"))
    return notes.select("id", (F.col("pos") + 1).alias("n"), text.alias("text"))


def breadcrumbs(articles: DataFrame) -> DataFrame:
    """The path where it says more than the chapter."""
    return articles.select("id", F.when(F.col("path").isNotNull() & ~F.col("path").eqNullSafe(F.col("chapter")), F.col("path")).alias("crumb"))
