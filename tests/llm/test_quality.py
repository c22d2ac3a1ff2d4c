"""The line field: sums over all labellings, held-out accuracy, defined edge cases."""

from itertools import product

import numpy as np
import pytest

from quillwork.llm import quality as Q

DOCS, LABELS = "doc_id long, text string, score string, held_out int", "doc_id long, quality int, toxic int"


def test_forward_backward_equals_all_labellings():
    """Marginals and pair counts of ragged chains equal sums over every labelling."""
    rng = np.random.default_rng(3)
    lengths = np.array([3, 1, 5, 2, 5])
    good, moves = rng.normal(size=lengths.sum()) * 2, rng.normal(size=(2, 2))
    p, pairs = Q.Chains(lengths).marginals(good, moves)
    want_p, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        weights, on, counts = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            w = np.exp(sum(good[at + t] for t in range(n) if y[t]) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            weights += w
            on += w * np.array(y)
            for a, b in zip(y, y[1:]):
                counts[a, b] += w
        want_p += (on / weights).tolist()
        want_pairs += counts / weights
        at += n
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs)


def test_neighbours_reach_the_features():
    """A line's cells hold its own buckets, those before and behind, and marks at the ends of its chain."""
    model = Q.Field(edges=[np.array([1.0, 2.0]), np.array([5.0])])
    numbers = np.array([[0, 9, 1], [1.5, 0, 1], [3, 9, 1]], float)
    cells = model.cells(numbers, Q.Chains(np.array([2, 1])))
    w, second = 2 * (Q.BUCKETS + 1), Q.BUCKETS + 1
    own = [[0, second + 1], [1, second], [2, second + 1]]
    assert cells[:, :2].tolist() == own
    assert cells[:, 2:4].tolist() == [[3 * w] * 2, [own[0][0] + w, own[0][1] + w], [3 * w] * 2]
    assert cells[:, 4:].tolist() == [[own[1][0] + 2 * w, own[1][1] + 2 * w], [3 * w + 1] * 2, [3 * w + 1] * 2]


def test_bad_lines_pull_by_their_length():
    clean, noise = "A plain line of ordinary words goes here.", "BUY!!! $$$ ### NOW!!! %%% &&&"
    rows = [(Q.line_numbers("\n".join([clean] * n)), 1) for n in range(1, 30)] + [(Q.line_numbers("\n".join([noise] * n)), 0) for n in range(1, 30)]
    model = Q.fit(rows)
    score = lambda text: float(model.scores(*(lambda x: (x, np.array([len(x)])))(Q.line_numbers(text)))[0])
    mixed = ["\n".join([clean] * (8 - k) + [noise] * k) for k in range(9)]
    scores = [score(m) for m in mixed]
    assert scores == sorted(scores, reverse=True) and scores[0] > 0.9 and scores[8] < 0.1


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.97), ("sf0.1", 0.985)])
def test_held_out_accuracy(spark, sf, least):
    """Accuracy on held-out labelled rows; bad ones are caught, good ones stay."""
    path = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = Q.op12_crf_quality(spark, path)
    assert rows.count() == docs.count()
    found = rows.where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").select("quality", "predicted", "score").collect()
    assert len(found) > 50 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert np.mean([r.quality == r.predicted for r in found]) >= least
    assert np.mean([r.predicted for r in found if r.quality]) >= 0.98
    assert np.mean([not r.predicted for r in found if not r.quality]) >= 0.9


def test_held_out_rows_teach_nothing(spark):
    """Changing the labels of held-out rows changes no score."""
    import zlib

    docs = spark.createDataFrame([(k, "word " * (k % 7 + 1) if k % 2 else "@@@ ### !!!", "x", 1) for k in range(60)], DOCS)
    held = [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(60)]
    one, other = ([(k, k % 2 if not held[k] else flip, 0) for k in range(60)] for flip in (0, 1))
    a, b = ([(r.doc_id, r.score) for r in Q.score_quality(docs, spark.createDataFrame(x, LABELS)).orderBy("doc_id").collect()] for x in (one, other))
    assert a == b
    assert [r.held_out for r in Q.score_quality(docs, spark.createDataFrame(one, LABELS)).orderBy("doc_id").collect()] == held


def test_edges(spark):
    """Null, empty, blank and very long texts, null ids, repeated rows, contradicting and null labels, clashing columns."""
    import zlib

    five, seven = [k for k in range(5, 50) if zlib.crc32(str(k).encode()) % 4 != 2][:2]
    rows = [(1, None, "x", 1), (1, None, "x", 1), (2, "", None, None), (None, "\n \t\n", "x", 0), (3, "a" * 1_000_000, "x", 0), (4, "line.\n" * 50_000, "x", 0), (five, "good words are here.", "x", 0), (seven, "### !!! $$$", "x", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(five, 1, 0), (five, 1, 0), (seven, 0, 0), (2, 1, 0), (2, 0, 0), (4, None, 1), (None, 1, 0)], LABELS)
    got = Q.score_quality(docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got if r.doc_id in (1, 2)}
    assert by_id[1] == by_id[2]  # null is empty
    none = Q.score_quality(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(1.0, 1)}
    assert {r.score for r in Q.score_quality(docs, labels.where(f"quality = 0 AND doc_id = {seven}")).collect()} == {0.0}
    assert Q.score_quality(docs.limit(0), labels).count() == 0
