import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.operators import corpus, declared, dictionary


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, None), (6, [0.0, 0.0]), (50, [nan, nan])]
    got = declared.semantic_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1)]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>One&nbsp;&amp; two</p><p>three</p>", "One & two\nthree"),
        ("a<script>var x = '<b>';</script>b<STYLE>p {}</STYLE >c", "abc"),
        ("<!-- <p>gone</p> -->kept", "kept"),
        ("  x \t y <br> \n\n z ", "x y\nz"),
        ("&lt;tag&gt; &quot;q&quot; &#39;s&#39;", "<tag> \"q\" 's'"),
        ("", ""),
        (None, None),
    ],
)
def test_page_text(spark, html, text):
    rows = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert [r.text for r in declared.extract_pages(rows).collect()] == [text]


def test_references_are_those_of_the_text(spark):
    rows = spark.createDataFrame([(1, "Article 3 of law no. 12-90 of 3/11/2020, see artículo 7"), (2, "nothing")], "id long, text string")
    got = {(r.id, r.kind, r.n, r.value) for r in declared.parse_references(rows, "id").collect()}
    assert got == {(1, "article", 1, "3"), (1, "article", 2, "7"), (1, "law", 1, "12-90"), (1, "date", 1, "3/11/2020")}


def test_browse_counts_only_the_page(spark):
    docs = spark.createDataFrame([(i, f"t{i:02}", "en", "g") for i in range(30)], "id long, title string, language string, group string")
    arts = spark.createDataFrame([(f"{i}-{j}", i) for i in range(30) for j in range(i % 3)], "id string, document_id long")
    got = [(r.id, r.articles_count) for r in corpus.browse_documents(docs, arts, page=2).collect()]
    assert got == [(i, i % 3) for i in range(12, 24)]


def test_chunks_of_rows_that_share_an_id(spark):
    long = "a" * 1200
    rows = [(1, f"{long}\nb"), (1, "c\nd"), (None, "e"), (None, "f"), (2, "g"), (2, "g"), (3, ""), (4, None)]
    got = [(r.doc_id, r.chunk, r.text) for r in declared.chunk_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, 0, long), (1, 1, "b"), (1, 0, "c\nd"), (None, 0, "e"), (None, 0, "f"), (2, 0, "g"), (2, 0, "g"), (3, 0, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert declared.chunk_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_categories_of_given_keywords(spark):
    rows = spark.createDataFrame([(1, "Rent and rent, a loan"), (2, "Loan or rent"), (3, "nothing")], "doc_id long, text string")
    got = {(r.doc_id, r.category, r.score) for r in declared.categorize(rows, {"money": ("loan",), "home": ("rent",)}).collect()}
    assert got == {(1, "home", 2), (2, "home", 1)}


def vectors(n=300, width=9, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).round(1)
    x[10:20] = x[0]  # ties
    return x


@pytest.mark.parametrize("block", [7, 64, 4096])
@pytest.mark.parametrize("least,results", [(-1.0, 5), (0.3, 12), (0.99, 3)])
def test_blocks_give_what_all_pairs_give(spark, block, least, results):
    x = vectors()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(300, [1.0, 0.0]), (301, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in declared.semantic_topk(df, every=25, min_score=least, results=results, block=block).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = {}
    for q in range(0, 300, 25):
        scores = np.floor(unit @ unit[q] * 1e6 + 0.5) / 1e6
        best = sorted((-s, k) for k, s in enumerate(scores) if k != q and s >= least)[:results]
        if best:
            want[q] = [(n, k) for n, (_, k) in enumerate(best, 1)]
    if least < 1.0 / np.hypot(1.0, 0.1):
        want[300] = [(1, 301)]  # vectors of another length meet only each other
    assert {q: sorted(v) for q, v in got.items()} == want


def test_candidate_limit_bounds_results(spark):
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(vectors())], "vec_id long, embedding array<double>")
    assert {r.n for r in declared.semantic_topk(df, min_score=-1.0, candidate_limit=4).groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {4}


def test_the_plan_does_not_grow_with_the_queries(spark):
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(vectors())], "vec_id long, embedding array<double>")
    plans = [declared.semantic_topk(df, every=every, block=20)._jdf.queryExecution().optimizedPlan().toString() for every in (100, 1)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines()) and "Union" not in plans[1] and "Cross" not in plans[1]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("caf&#233; &eacute;t&#xE9; &mdash; &#X20AC;", "café été — €"),
        ("&amp;lt; &amp;#233; &#38;amp;", "&lt; &#233; &amp;"),  # escaped references stay references
        ("&Omega;&omega;&apos;&euro;", "Ωω'€"),
        ("&unknown; &; &#; &#x; & &lt", "&unknown; &; &#; &#x; & &lt"),
        ("&#0;&#xD800;&#x110000;&#99999999999999999999;", "����"),
        ("&#128;&#147;&#x97;&#129;", "€“—\x81"),  # code points of Windows-1252
        ("&#000000000065;&#x1F600;&#128512;", "A😀😀"),
        ("a&nbsp;&#160;b", "a b"),
        ("&lt;script&gt;kept&lt;/script&gt;", "<script>kept</script>"),
    ],
)
def test_character_references(spark, html, text):
    rows = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert [r.text for r in declared.extract_pages(rows).collect()] == [text]


def test_every_named_reference(spark):
    """All names of the table, in one text, as Python resolves them."""
    import html as python

    text = " ".join(f"[{n}]" for n in declared.NAMED)
    row = spark.createDataFrame([(text,)], "t string").select(declared.unescaped(F.col("t")).alias("t")).first()
    assert row.t == python.unescape(text) and len(declared.NAMED) > 250


def test_categories_of_a_dictionary(spark):
    """Phrases of several words, weights, languages, ties by name, two categories a text."""
    docs = spark.createDataFrame([(1, "The employment-contract of an EMPLOYEE, an employee.", "en"), (2, "Contrat de travail: contrat!", "fr"), (3, "bank loan", "en"), (4, None, "en"), (5, "tax", None), (6, "impôt", "en"), (7, "nothing here", "en")], "doc_id long, text string, lang string")
    rows = declared.categorize_by(docs, dictionary.bundled(spark).union(spark.createDataFrame([("tax", "tax", 2, None), ("here", "tax", -1, None), (None, "x", 1, None)], "phrase string, category string, weight int, language string")), most=2).collect()
    got = {(r.doc_id, r["rank"]): (r.category, r.score) for r in rows}
    assert got == {(1, 1): ("labor", 5), (1, 2): ("civil", 1), (2, 1): ("labor", 3), (2, 2): ("civil", 2), (3, 1): ("banking", 2), (5, 1): ("tax", 2)}
    assert {c for _, c, _, _ in dictionary.entries()} == set(corpus.CATEGORIES)
    assert len({(p, lang) for p, _, _, lang in dictionary.entries()}) > 100


def test_filter_before_a_join(spark):
    """Every row that the others hold stays, most others go; the filter is no shuffle of the rows, and null is in nothing."""
    rows = spark.range(20_000).selectExpr("concat('w', id) AS phrase").union(spark.createDataFrame([(None,)], "phrase string"))
    held = spark.range(0, 20_000, 100).selectExpr("concat('w', id) AS phrase")
    kept = declared.perhaps_in(rows, held, "phrase")
    found = {r.phrase for r in kept.collect()}
    assert {r.phrase for r in held.collect()} <= found and len(found) < 300
    assert {r.phrase for r in declared.perhaps_in(rows, held, "phrase", words=1).collect()} >= {r.phrase for r in held.collect()}
    docs = spark.createDataFrame([(1, "tax " + " ".join(f"w{k}" for k in range(5000)))], "doc_id long, text string")
    terms = spark.createDataFrame([("tax", "tax", 2), ("w7 w8", "x", 1)], "phrase string, category string, weight int")
    scored = declared.categorize_by(docs, terms, most=2)
    assert sorted(tuple(r)[2:] for r in scored.collect()) == [("tax", 2), ("x", 1)]
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1


def test_terms_beyond_those_held(spark, monkeypatch):
    """No run of a term that is broadcast is shuffled; terms that are not, and any mixture, give the same rows."""
    words = " ".join(f"w{k % 13}" for k in range(300))
    docs = spark.createDataFrame([(k, f"{words} w{k} w1", ("en", "fr", None)[k % 3]) for k in range(30)] + [(None, "w1 w2 w3", "en"), (31, None, "en"), (32, "w1", "fr")], "doc_id long, text string, lang string")
    rows = [(f"w{k} w{k + 1}", f"c{k % 4}", k % 5 - 1, (None, "en", "fr")[k % 3]) for k in range(20)] + [("w1", f"c{k}", 1, None) for k in range(5)] + [("w1", "c1", 1, None), ("w3", "c9", 7, "fr"), ("w2 w3 w4", "c8", 2, None), (" w1", "c7", 9, None), (" 32", "c7", 9, None), ("w1.w2", "c7", 9, None), ("", "c7", 9, None)]
    terms = spark.createDataFrame(rows, "phrase string, category string, weight int, language string")
    known = terms.where("phrase <> '' AND phrase NOT LIKE ' %' AND phrase NOT LIKE '%.%'")
    texts = {r.doc_id: (f" {r.text or ''} ", r.lang) for r in docs.collect()}
    expected = {}
    for i, (text, lang) in texts.items():
        tokens, sums = text.split(), {}
        for phrase, category, weight, language in rows:
            p = phrase.split(" ")
            if "" not in p and language in (None, lang):
                n = sum(tokens[a : a + len(p)] == p for a in range(len(tokens)))
                sums[category] = sums.get(category, 0) + n * weight
        expected |= {(i, k + 1): (c, v) for k, (c, v) in enumerate(sorted(((c, v) for c, v in sums.items() if v > 0), key=lambda x: (-x[1], x[0]))[:3])}
    for held in (0, 7, 20, 10**6):
        scored = declared.categorize_by(docs, terms, most=3, held=held)
        assert {(r.doc_id, r["rank"]): (r.category, r.score) for r in scored.collect()} == expected
        near, far, by_words = declared.near_and_far(known, held)
        assert near.count() <= held and by_words == {1: 7, 2: 20, 3: 1} and (near.count() + far.count() if far else near.count()) == len(rows) - 4
        shuffled = [x for x in scored._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x and "phrase" in x]
        assert bool(shuffled) == (held < len(rows) - 4)
    monkeypatch.setattr(declared, "FEW", 0)  # all runs of so many words are tried
    assert {(r.doc_id, r["rank"]): (r.category, r.score) for r in declared.categorize_by(docs, terms, most=3, held=7).collect()} == expected
    firsts = [r.phrase for r in declared.near_and_far(terms, 7)[0].collect()]
    assert firsts.count("w1") == 6  # with the most terms


def test_filter_of_many_values(spark):
    """A filter with a value for each two words lets about one in a thousand of the other rows pass."""
    held = spark.range(32_768).selectExpr("concat('h', id) AS phrase")
    rows = spark.range(100_000).selectExpr("concat('w', id) AS phrase")
    assert declared.perhaps_in(rows, held, "phrase", words=65_536).count() < 500
