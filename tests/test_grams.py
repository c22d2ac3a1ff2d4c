"""The gram index gives the rows of the scan, from fewer files."""

import pytest
from pyspark.sql import functions as F

from quillwork.operators import corpus
from quillwork.operators.grams import GramIndex, grams_of, needed_grams

ARTICLES = "id string, document_id long, article_number string, text string, sort_key int, chapter string, path string"
DOCUMENTS = "id long, title string, language string, type string, group string, source_file string"
WORDS = ["Contrat", "de travail", "ÉTAT civil", "İstanbul", "100% sûr", "a_b", "x\\y", "ΟΔΟΣ", "line\nbreak", "日本国憲法", "lone", "n° 12-90"]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(d, f"Titre {WORDS[d % 12]}" if d != 7 else None, "fr" if d % 2 else "en", "LAW", None, "f") for d in range(40)], DOCUMENTS)
    rows = [(f"{d}-{k}", d, f"Article {k}" if k else None, f"{WORDS[(d + k) % 12]} {WORDS[(d * k) % 12]}{k}" if (d + k) % 9 else None, k, WORDS[k % 12] if k % 3 else None, None) for d in range(41) for k in range(6)]
    return docs, spark.createDataFrame(rows, ARTICLES)


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    return GramIndex(spark, f"{tmp_path_factory.mktemp('grams')}/index").build(tables[1], block_rows=20, buckets=4)


TERMS = ["travail", "ÉTAT", "état", "TRAVAIL", "istanbul", "İSTANBUL", "100%", "a_b", "l_n", "l%e", "tra%ail", "x\\y", "ΟΔΟΣ", "οδος", "e\nb", "国憲法", "ne", "e", "", "0", "Titre Contrat — Article 2", "Article 3", "nowhere at all", "12-90", "%%%", "contrat de"]


@pytest.mark.parametrize("term", TERMS)
def test_same_rows_as_the_scan(tables, index, term):
    docs, articles = tables
    for language in (None, "fr"):
        want = sorted(map(str, corpus.search_articles(docs, articles, term, language).collect()))
        assert sorted(map(str, index.search(docs, term, language).collect())) == want


@pytest.mark.parametrize("term", ["Article 3", "titre", "ti", "t", "lone"])
def test_same_suggestions(tables, index, term):
    docs, articles = tables
    assert index.suggestions(docs, term).collect() == corpus.suggestions(docs, articles, term).collect()


def test_fewer_bytes(spark, tables, tmp_path):
    """A term in one document reads one block; a term that is nowhere reads none; a short one reads all."""
    docs, articles = tables
    odd = spark.createDataFrame([("odd", 3, "Article 9", "an unheard-of zyzzyva", 9, None, None)], ARTICLES)
    index = GramIndex(spark, f"{tmp_path}/index").build(articles.unionByName(odd), block_rows=20)
    read, whole = index.bytes_read(index.search(docs, "zyzzyva"))
    assert 0 < read < whole / 4 and [r.id for r in index.search(docs, "zyzzyva").collect()] == ["odd"]
    assert index.bytes_read(index.search(docs, "zyzzyvas"))[0] == 0
    assert index.bytes_read(index.search(docs, "zy"))[0] == whole


def test_grams(spark):
    rows = spark.createDataFrame([("ABC\nd",), ("ab",), (None,), ("𝒳yz𝒳",)], "t string").select(grams_of(F.col("t")).alias("g"))
    assert [r.g for r in rows.collect()] == [["abc", "bc\n", "c\nd"], [], [], ["𝒳yz", "yz𝒳"]]
    assert needed_grams(spark, "ABcd%e_fgh") == ["abc", "bcd", "fgh"] and needed_grams(spark, "ab%cd") == []


def test_postings_do_not_grow_with_the_articles_of_a_slice(spark, tmp_path):
    """Fifty times the articles with the same grams leave the same rows of postings, a number each, and the same rows are found."""
    docs = spark.createDataFrame([(d, f"Titre {d}", "fr", "LAW", None, "f") for d in range(8)], DOCUMENTS)
    rows = []
    for name, times in (("few", 1), ("many", 50)):
        articles = spark.createDataFrame([(f"{d}-{k}", d, "Article 1", f"{WORDS[d]} et cetera", k, None, None) for d in range(8) for k in range(times)], ARTICLES)
        index = GramIndex(spark, f"{tmp_path}/{name}").build(articles, block_rows=1000, buckets=2)
        postings = spark.read.parquet(f"{tmp_path}/{name}/postings")
        rows.append(postings.count())
        assert {c: t for c, t in postings.dtypes if c != "bucket"} == {"gram": "string", "block": "int", "word": "int", "mask": "bigint"}
        assert sorted(r.id for r in index.search(docs, "travail").collect()) == sorted(f"1-{k}" for k in range(times))
    assert rows[0] == rows[1]
