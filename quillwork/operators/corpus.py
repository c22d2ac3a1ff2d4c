"""Searching and browsing a corpus of documents split into articles.

documents and articles are the relations of quillwork.sources. Filters on
documents sit below the join, column choices reach the scans; the search
predicate spans both tables and stays above the join. Pages order by a unique
last key. A shallow page plans as a top-k, a deep one is found by ranges (see pages).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import like_any
from quillwork.operators.pages import DEEP, deep_page, ordering

SEPARATOR = " — "
PER_PAGE, MOST_PER_PAGE, SUGGESTIONS = 20, 100, 10
SEARCHED = ["text", "article_number", "chapter", "title"]


def corpus_scan(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles with their document's fields: the columns that a search needs."""
    d = documents.select(F.col("id").alias("document_id"), "title", "language", "type", "group", "source_file")
    return articles.select("id", "document_id", "article_number", "text", "sort_key", "chapter", "path").join(d, "document_id")


def searchable_articles(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """Flat index records, with slug and depth where articles carry them; an article without a document keeps null document fields."""
    own = [c for c in ("slug", "depth") if c in articles.columns]
    d = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("language").alias("document_language"), F.col("type").alias("document_type"), F.col("group").alias("document_group"), "source_file")
    return articles.join(d, "document_id", "left").select("id", "document_id", "article_number", "text", "sort_key", "chapter", "path", *own, "document_title", "document_language", "document_type", "document_group", "source_file")


def searchable_documents(documents: DataFrame) -> DataFrame:
    return documents.select("id", "title", "language", "type", "group", "source_file")


def search_articles(documents: DataFrame, articles: DataFrame, query: str, language: str | None = None, type: str | None = None, fold: str = "unicode") -> DataFrame:
    """Articles whose text, number, chapter or title contains the query.

    A query of the form "title — number" also finds articles by that title.
    An empty query (also "0") finds nothing; empty filters filter nothing.
    """
    if query in ("", "0", None):
        return corpus_scan(documents, articles).limit(0)
    if language:
        documents = documents.where(F.col("language") == language)
    if type:
        documents = documents.where(F.col("type") == type)
    found = like_any(SEARCHED, query, fold)
    if SEPARATOR in query:
        found = found | like_any(["title"], query.split(SEPARATOR, 1)[0], fold)
    return corpus_scan(documents, articles).where(found)


def search_projection(found: DataFrame) -> DataFrame:
    """The fields of a search result by their public names."""
    return found.select("id", "document_id", "title", "article_number", F.col("text").alias("content"), F.col("group").alias("category"), F.col("type").alias("source_name"), "source_file", "path", "language", "chapter", "sort_key")


def page_of(rows: DataFrame, order: list[str], page: int, per_page: int) -> DataFrame:
    """A page of an order (' desc' behind a column that descends): a top-k plan, or from DEEP rows on by ranges."""
    if (page - 1) * per_page >= DEEP:
        return deep_page(rows, order, page, per_page)
    return rows.orderBy(*ordering(order)).offset((max(1, page) - 1) * per_page).limit(per_page)


def search_page(found: DataFrame, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One page of results in the order of sort_key, then id; at most 100 a page, 20 if none is asked."""
    size = min(per_page, MOST_PER_PAGE) if per_page > 0 else PER_PAGE
    return page_of(search_projection(found), ["sort_key", "id"], page, size)


def search_totals(found: DataFrame, query: str, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """One row: query, count, current_page, last_page, per_page."""
    size = min(per_page, MOST_PER_PAGE) if per_page > 0 else PER_PAGE
    last = F.greatest(F.lit(1), F.ceil(F.col("count") / size)).cast("long")
    return found.agg(F.count("*").alias("count")).select(F.lit(query).alias("query"), "count", F.lit(page).alias("current_page"), last.alias("last_page"), F.lit(size).alias("per_page"))


def suggestions(documents: DataFrame, articles: DataFrame, term: str, most: int = SUGGESTIONS) -> DataFrame:
    """Labels "title — number" for a term of at least two bytes."""
    rows = corpus_scan(documents, articles).where(like_any(["title", "article_number"], term))
    if len(term.encode()) < 2:
        rows = rows.limit(0)
    label = F.concat_ws(SEPARATOR, "title", "article_number")
    return rows.select("title", "sort_key", "id", label.alias("label"), F.lit("article").alias("kind")).orderBy("title", "sort_key", "id").limit(most).select("id", "label", "kind")


def assistant_top5(found: DataFrame) -> DataFrame:
    """The first five hits as "title — number", each with the count of all."""
    hits = search_page(found).limit(5).select("id", F.concat_ws(SEPARATOR, "title", "article_number").alias("hit"))
    return hits.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row


def corpus_totals(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """One row of counts."""
    one = documents.agg(F.count("*").alias("n_documents"))
    return articles.agg(F.count("*").alias("n_articles")).crossJoin(F.broadcast(one))  # one row each


def corpus_overview(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """Documents per group, each row with the totals and the number of groups."""
    groups = group_counts(documents)
    totals = corpus_totals(documents, articles).crossJoin(F.broadcast(groups.agg(F.count("*").alias("n_categories"))))
    return groups.withColumnRenamed("group", "category").crossJoin(F.broadcast(totals))


def language_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("language").agg(F.count("*").alias("n"))


def group_counts(documents: DataFrame) -> DataFrame:
    return documents.where("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("n"))


def browse_documents(documents: DataFrame, articles: DataFrame, language: str | None = None, group: str | None = None, page: int = 1, per_page: int = 12) -> DataFrame:
    """Documents by title with their article counts, zero kept."""
    if language:
        documents = documents.where(F.col("language") == language)
    if group:
        documents = documents.where(F.col("group") == group)
    shown = page_of(documents.select("id", "title", "language", "group"), ["title", "id"], page, per_page)
    wanted = F.broadcast(shown.select(F.col("id").alias("document_id")))  # a page of ids
    counts = articles.join(wanted, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("n"))
    rows = shown.join(F.broadcast(counts), shown["id"] == counts["document_id"], "left")
    return rows.select("id", "title", "language", "group", F.coalesce("n", F.lit(0)).alias("articles_count")).orderBy("title", "id")


def document_articles(articles: DataFrame, document_id) -> DataFrame:
    return articles.where(F.col("document_id") == document_id).orderBy("sort_key", "id")


# Native names of the interface's languages.
LANGUAGES = {"fr": "Français", "ar": "العربية", "en": "English"}

# Labels of the corpus categories.
CATEGORIES = {
    "banking": "Banking",
    "civil": "Civil law",
    "commercial": "Commercial law",
    "consumer": "Consumer protection",
    "criminal": "Criminal law",
    "education": "Education",
    "energy": "Energy",
    "environment": "Environment",
    "family": "Family law",
    "health": "Health",
    "insurance": "Insurance",
    "labor": "Labor",
    "public-procurement": "Public procurement",
    "real-estate": "Real estate",
    "tax": "Tax",
}


def _looked_up(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(table, key)


def language_label(code: Column) -> Column:
    return F.coalesce(_looked_up(LANGUAGES, code), F.upper(code))


def source_basename(path: Column) -> Column:
    """A file's name without its folders and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]+$", "")


def category_label(code: Column) -> Column:
    """The label, else the parts between dashes with capitals; null and '' are General."""
    code = F.when((code == "") | code.isNull(), "general").otherwise(code)
    parts = F.filter(F.split(code, "-"), lambda p: p != "")
    return F.coalesce(_looked_up(CATEGORIES, code), F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), " "))


def last_page(count: int, per_page: int) -> int:
    return max(1, math.ceil(count / per_page))
