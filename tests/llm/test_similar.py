"""Near copies by five-word similarity against brute force."""

import random

import corpus_pipeline
import duckdb
import numpy as np
import pytest

from quillwork.llm import similar, simhash

STAGE = dict(corpus_pipeline.STAGES)["near_duplicates"]
SCHEMA = "doc_id long, text string"


def jaccard(a, b):
    return len(a & b) / len(a | b)


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept(rows):
    """The smallest id of each component of links of similarity 0.8 or more."""
    sets = [five_words(t) for _, t in rows]
    labels = np.arange(len(rows))
    simhash.unite(labels, *np.nonzero([[jaccard(x, y) >= 0.8 for y in sets] for x in sets]))
    return [rows[i][0] for i in range(len(rows)) if labels[i] == i]


def test_stage_on_small_table(spark):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    got = [r.doc_id for r in STAGE(spark, spark.createDataFrame(rows, SCHEMA), None).collect()]
    assert sorted(got) == kept(rows)


def test_looser_copies(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for changed in (0, 1, 2, 4, 6, 12):
            copy = list(words)
            for at in rng.sample(range(200), changed):
                copy[at] = "other"
            rows.append((len(rows), " ".join(copy)))
    got = [r.doc_id for r in STAGE(spark, spark.createDataFrame(rows, SCHEMA), None).collect()]
    assert sorted(got) == kept(rows)


def test_same_line_is_not_a_copy(spark):
    line = "all rights reserved by the owner of this page "
    rows = [(i, line * 60 + " ".join(f"{i}x{j}" for j in range(40))) for i in range(6)]
    assert STAGE(spark, spark.createDataFrame(rows, SCHEMA), None).count() == 6


@pytest.mark.parametrize("most", [similar.MOST, 16])
def test_large_group(spark, monkeypatch, most):
    monkeypatch.setattr(similar, "MOST", most)
    words = [f"w{j}" for j in range(300)]
    rows = [(i, " ".join([*words[: i % 290], f"new{i}", *words[i % 290 + 1 :]])) for i in range(200)]
    assert [r.doc_id for r in STAGE(spark, spark.createDataFrame(rows, SCHEMA), None).collect()] == [0]


@pytest.mark.parametrize("ids,kept", [((None, None), [None]), ((5, 5, 6), [5]), ((None, 7, 7), [7]), ((3, None, 3, None), [3])])
def test_rows_that_share_an_id_or_have_none(spark, ids, kept):
    """One row of a group of near copies stays, whatever the ids; rows of other texts with the same ids stay too."""
    text = " ".join(f"word{k}" for k in range(200))
    others = [(i, " ".join(f"{n}other{k}" for k in range(60))) for n, i in enumerate(ids)]
    for find, end in ((simhash.near_duplicates, " "), (similar.near_copies, " "), (similar.near_copies, " end")):
        copies = [(i, text + end * n) for n, i in enumerate(ids)]
        rows = simhash.keep_one(spark.createDataFrame(copies + others, SCHEMA), find).collect()
        assert [r.doc_id for r in rows if r.text.startswith("word")] == kept
        assert sorted(r.text for r in rows if not r.text.startswith("word")) == sorted(t for _, t in others)
