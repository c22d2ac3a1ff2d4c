"""Queries of the corpus operators over the bound tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillwork.functions.text import clean_text, display_text
from quillwork.operators import articles as A
from quillwork.operators import corpus as C
from quillwork.operators import sync as Y
from quillwork.operators.grams import GramIndex
from quillwork.sources import bindings as B
from quillwork.sources.bindings import sql
from quillwork.streaming.jobs import shared_place

TERM, LABEL = "tion", "The — Article 2"
NOW = "2001-07-20"


def _both(f):
    return lambda s, d: f(B.documents(s, d), B.articles(s, d))


def _docs(f):
    return lambda s, d: f(B.documents(s, d))


def _arts(f):
    return lambda s, d: f(B.articles(s, d))


_JOINED = ", j AS (SELECT a.*, d.title, d.language, d.type, d.grp, d.source_file FROM arts a JOIN docs d ON a.document_id = d.id)"
_CLEAN = r"rtrim(ltrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)--+\s*(?:\d+\s*(?:PAGE|EGAP)|(?:PAGE|EGAP)\s*\d+)\s*--+', '', 'g'), '(?m)^---+$', '', 'g'), '(?m)^\s*-\d+-\s*$', '', 'g'), '(?m)(\S)\d{1,2}\s*$', '\1', 'g'), '[\x{F000}-\x{F8FF}]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(9) || chr(10) || chr(13) || chr(11)), chr(32) || chr(9) || chr(10) || chr(13) || chr(11))"
_CLEANED = f", c AS (SELECT *, {_CLEAN} AS clean FROM arts)"


def _hit(term: str) -> str:
    return "(" + " OR ".join(f"coalesce({c} ILIKE '%{term}%', false)" for c in ("text", "article_number", "chapter", "title")) + ")"


_RESULT = "id, document_id, title, article_number, text AS content, grp AS category, type AS source_name, source_file, path, language, chapter, sort_key"


def _search(query: str, **filters):
    return _both(lambda d, a: C.search_projection(C.search_articles(d, a, query, **filters)))


def _indexed(f, block_rows=2_000):
    """A query over an index of the table's articles, built under the shared folder."""

    def run(spark, sf_dir):
        index = GramIndex(spark, shared_place(spark, "grams")).build(B.articles(spark, sf_dir), block_rows)
        return f(index, B.documents(spark, sf_dir))

    return run


QUERIES = {
    "search_indexed": _indexed(lambda i, d: C.search_projection(i.search(d, TERM))),
    "search_indexed_label": _indexed(lambda i, d: C.search_projection(i.search(d, LABEL, language="en"))),
    "suggestions_indexed": _indexed(lambda i, d: i.suggestions(d, "the")),
    "corpus_scan": _both(C.corpus_scan),
    "searchable_articles": _both(C.searchable_articles),
    "searchable_documents": _docs(C.searchable_documents),
    "search_articles": _search(TERM),
    "search_label": _search(LABEL),
    "search_filtered": _search(TERM, language="fr", type="LAW"),
    "search_page": _both(lambda d, a: C.search_page(C.search_articles(d, a, TERM), page=2)),
    "search_totals": _both(lambda d, a: C.search_totals(C.search_articles(d, a, TERM), TERM, page=2)),
    "search_projection": _search("en"),
    "search_guard": _both(lambda d, a: C.search_totals(C.search_articles(d, a, "0"), "0")),
    "suggestions": _both(lambda d, a: C.suggestions(d, a, "th")),
    "assistant_top5": _both(lambda d, a: C.assistant_top5(C.search_articles(d, a, TERM))),
    "corpus_totals": _both(C.corpus_totals),
    "corpus_overview": _both(C.corpus_overview),
    "language_counts": _docs(C.language_counts),
    "group_counts": _docs(C.group_counts),
    "browse_documents": _both(lambda d, a: C.browse_documents(d, a, language="en", group="src3")),
    "document_articles": _arts(lambda a: C.document_articles(a, 7)),
    "language_labels": _docs(lambda d: d.select("id", C.language_label(F.col("language")).alias("label"))),
    "source_basename": _docs(lambda d: d.select("id", C.source_basename(F.col("source_file")).alias("basename"))),
    "category_labels": _docs(lambda d: d.select("id", C.category_label(F.when(F.col("id") % 3 == 0, "real-estate").when(F.col("id") % 3 == 1, F.concat(F.lit("new--"), F.col("group"), F.lit("-field")))).alias("label"))),
    "clean_text": _arts(lambda a: a.select("id", clean_text(F.col("text")).alias("clean"))),
    "display_text": _arts(lambda a: a.select("id", display_text(F.col("text")).alias("shown"))),
    "nonempty_articles": _arts(A.nonempty_articles),
    "toc_entries": _arts(A.toc_entries),
    "footnotes": _arts(A.footnotes),
    "breadcrumbs": _arts(A.breadcrumbs),
    "unsynced_articles": _arts(lambda a: Y.unsynced_articles(a).select("id", "document_id")),
    "sync_backlog": _arts(Y.sync_backlog),
    "sync_stamp": _arts(lambda a: Y.sync_stamp(a, F.lit(NOW).cast("timestamp_ntz")).select("id", "synced", "synced_at")),
}

SQL = {
    "corpus_scan": sql(f'{_JOINED} SELECT id, document_id, article_number, text, sort_key, chapter, path, title, language, type, grp AS "group", source_file FROM j', "docs", "arts"),
    "searchable_articles": sql("SELECT a.id, document_id, article_number, text, sort_key, chapter, path, slug, depth, title AS document_title, language AS document_language, type AS document_type, grp AS document_group, source_file FROM arts a LEFT JOIN docs d ON a.document_id = d.id", "docs", "arts"),
    "searchable_documents": sql('SELECT id, title, language, type, grp AS "group", source_file FROM docs', "docs"),
    "search_indexed": sql(f"{_JOINED} SELECT {_RESULT} FROM j WHERE {_hit(TERM)}", "docs", "arts"),
    "search_indexed_label": sql(f"{_JOINED} SELECT {_RESULT} FROM j WHERE language = 'en' AND ({_hit(LABEL)} OR title ILIKE '%The%')", "docs", "arts"),
    "suggestions_indexed": sql(f"{_JOINED} SELECT id, title || ' — ' || article_number AS label, 'article' AS kind FROM (SELECT * FROM j WHERE title ILIKE '%the%' OR article_number ILIKE '%the%' ORDER BY title, sort_key, id LIMIT 10)", "docs", "arts"),
    "search_articles": sql(f"{_JOINED} SELECT {_RESULT} FROM j WHERE {_hit(TERM)}", "docs", "arts"),
    "search_label": sql(f"{_JOINED} SELECT {_RESULT} FROM j WHERE {_hit(LABEL)} OR title ILIKE '%The%'", "docs", "arts"),
    "search_filtered": sql(f"{_JOINED} SELECT {_RESULT} FROM j WHERE {_hit(TERM)} AND language = 'fr' AND type = 'LAW'", "docs", "arts"),
    "search_page": sql(f"{_JOINED} SELECT {_RESULT} FROM j WHERE {_hit(TERM)} ORDER BY sort_key, id LIMIT 20 OFFSET 20", "docs", "arts"),
    "search_totals": sql(f"{_JOINED} SELECT '{TERM}' AS query, count(*) AS count, 2 AS current_page, CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS last_page, 20 AS per_page FROM j WHERE {_hit(TERM)}", "docs", "arts"),
    "search_projection": sql(f"{_JOINED} SELECT {_RESULT} FROM j WHERE {_hit('en')}", "docs", "arts"),
    "search_guard": sql("SELECT '0' AS query, CAST(count(*) AS BIGINT) AS count, 1 AS current_page, CAST(1 AS BIGINT) AS last_page, 20 AS per_page FROM docs WHERE false", "docs"),
    "suggestions": sql(f"{_JOINED} SELECT id, title || ' — ' || article_number AS label, 'article' AS kind FROM (SELECT * FROM j WHERE title ILIKE '%th%' OR article_number ILIKE '%th%' ORDER BY title, sort_key, id LIMIT 10)", "docs", "arts"),
    "assistant_top5": sql(f"{_JOINED}, h AS (SELECT * FROM j WHERE {_hit(TERM)}) SELECT id, title || ' — ' || article_number AS hit, (SELECT count(*) FROM h) AS total FROM (SELECT * FROM h ORDER BY sort_key, id LIMIT 5)", "docs", "arts"),
    "corpus_totals": sql("SELECT (SELECT count(*) FROM arts) AS n_articles, (SELECT count(*) FROM docs) AS n_documents", "docs", "arts"),
    "corpus_overview": sql("SELECT grp AS category, count(*) AS n, (SELECT count(*) FROM arts) AS n_articles, (SELECT count(*) FROM docs) AS n_documents, (SELECT count(DISTINCT grp) FROM docs) AS n_categories FROM docs WHERE grp IS NOT NULL GROUP BY grp", "docs", "arts"),
    "language_counts": sql("SELECT language, count(*) AS n FROM docs GROUP BY language", "docs"),
    "group_counts": sql('SELECT grp AS "group", count(*) AS n FROM docs WHERE grp IS NOT NULL GROUP BY grp', "docs"),
    "browse_documents": sql("SELECT id, title, language, grp AS \"group\", (SELECT count(*) FROM arts a WHERE a.document_id = d.id) AS articles_count FROM docs d WHERE language = 'en' AND grp = 'src3' ORDER BY title, id LIMIT 12", "docs", "arts"),
    "document_articles": sql("SELECT * FROM arts WHERE document_id = 7", "arts"),
    "language_labels": sql("SELECT id, CASE language WHEN 'fr' THEN 'Français' WHEN 'ar' THEN 'العربية' WHEN 'en' THEN 'English' ELSE upper(language) END AS label FROM docs", "docs"),
    "source_basename": sql("SELECT id, regexp_replace(list_last(string_split(source_file, '/')), '\\.[^.]+$', '') AS basename FROM docs", "docs"),
    "category_labels": sql("SELECT id, CASE WHEN id % 3 = 0 THEN 'Real estate' WHEN id % 3 = 1 AND grp IS NOT NULL THEN 'New ' || upper(grp[1]) || grp[2:] || ' Field' ELSE 'General' END AS label FROM docs", "docs"),
    "clean_text": sql(f"{_CLEANED} SELECT id, clean FROM c", "arts"),
    # display_text needs look-behind, which the oracle's patterns lack: literal cases in the tests
    "nonempty_articles": sql(f"{_CLEANED} SELECT id, document_id, article_number, clean, article_number IN ('Preamble', 'Full Text') AS is_preamble FROM c WHERE clean <> ''", "arts"),
    "toc_entries": sql(f"{_CLEANED}, t AS (SELECT id, document_id, sort_key, CASE WHEN article_number <> 'Preamble' THEN article_number END AS number, coalesce(nullif(chapter, ''), CASE WHEN length(clean) > 50 THEN rtrim(left(clean, 50)) || '...' ELSE clean END) AS label FROM c) SELECT * FROM t WHERE trim(label) <> ''", "arts"),
    "footnotes": sql(", e AS (SELECT id, unnest(CAST(footnotes AS JSON[])) AS f, generate_subscripts(CAST(footnotes AS JSON[]), 1) AS n FROM arts WHERE footnotes IS NOT NULL) SELECT id, CAST(n AS INTEGER) AS n, CASE WHEN json_type(f) = 'VARCHAR' THEN f ->> '$' ELSE coalesce(f ->> '$.text', f ->> '$.content', '') END AS text FROM e", "arts"),
    "breadcrumbs": sql("SELECT id, CASE WHEN path IS NOT NULL AND path IS DISTINCT FROM chapter THEN path END AS crumb FROM arts", "arts"),
    "unsynced_articles": sql("SELECT id, document_id FROM arts WHERE synced IS NULL", "arts"),
    "sync_stamp": sql(f"SELECT id, true AS synced, CASE WHEN synced IS NULL THEN TIMESTAMP '{NOW}' END AS synced_at FROM arts", "arts"),
    "sync_backlog": sql("SELECT count_if(synced IS NULL) AS pending, count_if(synced IS NOT NULL) AS synced FROM arts", "arts"),
}
