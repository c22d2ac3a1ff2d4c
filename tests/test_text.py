import pytest
from pyspark.sql import functions as F

from quillwork.functions.text import clean_text, display_text, like_any
from quillwork.operators import corpus as C
from quillwork.operators.articles import footnotes, toc_entries


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("a\n--- PAGE 12 ---\nb", "a\n\nb"),
        ("a -- 3 egap -- b", "a  b"),
        ("a\n---\nb", "a\n\nb"),
        ("a\n  -15-  \nb", "a\n\nb"),
        ("word12", "word"),
        ("x 2024", "x 20"),
        ("foo12\n\nbar", "foo\nbar"),
        ("Tunisie1.", "Tunisie1."),
        ("a\uf0b7b", "ab"),
        ("a\n\n\n\n\nb", "a\n\nb"),
        ("\0\x0b  a \t\r\n", "a"),
        ("\u00a0a", "\u00a0a"),
        ("a\u0085-1-\nb", "a\u0085-1-\nb"),
        (None, None),
        ("", ""),
    ],
)
def test_clean_text(spark, text, clean):
    assert one(spark, clean_text, text) == clean


@pytest.mark.parametrize(("text", "shown"), [("a\nb", "a b"), ("a\n\nb", "a\n\nb"), ("a\n  \nb", "a\n   b"), ("a\nb\n\nc\nd", "a b\n\nc d"), ("\na", " a")])
def test_display_text(spark, text, shown):
    assert one(spark, display_text, text) == shown


@pytest.mark.parametrize(
    ("text", "term", "fold", "hit"),
    [("L'ÉTAT", "état", "unicode", True), ("L'ÉTAT", "état", "ascii", False), ("ABC", "b", "ascii", True), ("a\\b", "a\\b", "unicode", True), ("axb", "a_b", "unicode", True), ("a--b", "a%b", "unicode", True), ("ab", "c", "unicode", False), (None, "a", "unicode", False)],
)
def test_like(spark, text, term, fold, hit):
    assert spark.createDataFrame([(text,)], "text string").select(like_any(["text"], term, fold).alias("x")).first().x is hit


def corpus(spark):
    d = spark.createDataFrame([(1, "Code", "fr", "LAW", None, "a/b.c.txt"), (2, "Other", "en", "NOTE", "tax", "x.txt")], "id long, title string, language string, type string, group string, source_file string")
    rows = [(f"1-{n}", 1, f"Article {n}", f"text {n}", n, None, None, None, None) for n in range(25)] + [("2-0", 2, "Article 0", "same text", 0, "Chapter", "p", '["a", {"text": "b"}, {"content": "c"}, {}]', True)]
    a = spark.createDataFrame(rows, "id string, document_id long, article_number string, text string, sort_key int, chapter string, path string, footnotes string, synced boolean")
    return d, a


def test_search(spark):
    d, a = corpus(spark)
    assert C.search_articles(d, a, "text").count() == 26
    assert C.search_articles(d, a, "0").count() == 0 and C.search_articles(d, a, "").count() == 0
    assert C.search_articles(d, a, "Code — Article 3").count() == 25
    assert C.search_articles(d, a, "text", language="en", type="NOTE").count() == 1
    found = C.search_articles(d, a, "text")
    assert [r.id for r in C.search_page(found, per_page=3).collect()] == ["1-0", "2-0", "1-1"]
    assert C.search_page(found, page=2).count() == 6
    assert C.search_page(found, per_page=0).count() == 20 and C.search_page(found, per_page=500).count() == 26
    assert C.search_totals(found, "text").first().last_page == 2
    assert C.search_totals(found.limit(0), "x").first().last_page == 1


def test_suggestions(spark):
    d, a = corpus(spark)
    assert [r.label for r in C.suggestions(d, a, "co").limit(1).collect()] == ["Code — Article 0"]
    assert C.suggestions(d, a, "c").count() == 0
    assert C.suggestions(d, a, "é").count() == 0  # two bytes, no hit


def test_articles(spark):
    d, a = corpus(spark)
    assert [(r.n, r.text) for r in footnotes(a).orderBy("n").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "")]
    assert C.browse_documents(d, a.where("document_id = 1")).collect()[1].articles_count == 0
    assert toc_entries(a).where("id = '2-0'").first().label == "Chapter"
    labels = d.select(C.source_basename(F.col("source_file")).alias("b"), C.category_label(F.col("group")).alias("c")).orderBy("b").collect()
    assert [(r.b, r.c) for r in labels] == [("b.c", "General"), ("x", "Tax")]
