"""Quotient filters against plain counters, collocations against SQL and brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import compare, connect

from quillwork.llm import collocations as C
from quillwork.llm.quotient import Filter, permuted, restored

KINDS = "doc_id long, text string, lang string, phrase long, id string, f int"


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("m", [0, 1, 2, 5, 3000])
def test_filter_counts_exactly(width, m):
    """Permuting is undone; filters cut, packed, unpacked and merged count as a plain counter does."""
    rng = np.random.default_rng(m + width)
    keys = rng.integers(0, 1 << 64, size=(m, width), dtype=np.uint64)
    keys[m // 2 :] = keys[: m - m // 2]
    counts = rng.choice([1, 2, 254, 255, 256, 1 << 40], size=m)
    assert (restored(permuted(keys)) == keys).all()
    want = Counter()
    for key, n in zip(keys.tolist(), counts.tolist()):
        want[tuple(key)] += n
    shards = defaultdict(list)
    for part in np.array_split(np.arange(m), 3):
        for s, f in Filter.of(keys[part], counts[part]).shards(5):
            shards[s].append(Filter.unpacked(f.packed()))
    found = {}
    for s, filters in shards.items():
        f = Filter.merged(filters)
        assert (np.diff(f.keys[:, 0].astype(object)) >= 0).all() and [s] == [x for x, _ in f.shards(5)]
        found |= {tuple(k): n for k, n in zip(f.plain().tolist(), f.counts.tolist())}
    assert found == want


def test_equal_first_words_do_not_share_a_counter():
    """Keys whose permuted first word is the same stay apart, in whatever order they come."""
    other = np.array([[5], [9], [5], [7], [9], [5]], np.uint64)
    keys = np.hstack([np.full((6, 1), 1234567, np.uint64), other])
    f = Filter._summed(keys, np.arange(1, 7))
    assert f.keys[:, 1].tolist() == [5, 7, 9] and f.counts.tolist() == [10, 4, 7]


def brute(rows, least, percent=80, most=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        big = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in big.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in big.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_edges_against_brute_force(spark, monkeypatch):
    """Null and blank texts, null languages, long texts over parts and chunks, letters beyond A-Z, odd spaces, ties, clashing columns."""
    monkeypatch.setattr(C, "PART", 7)
    monkeypatch.setattr(C, "CHUNK", 50)
    monkeypatch.setattr(C, "ENTRIES", 40)
    monkeypatch.setattr(C, "COUNTED", 5)
    long = " ".join(["alpha beta gamma delta", "beta gamma", "omega alpha beta"] * 40)
    texts = [(long, "en"), (long.upper() + "\x0b" + long, "fr"), (None, "en"), ("", None), (" \t\n", "de"), ("É é ß x  É\té. A,B;C:D!E?F\rG\x0cH", None), ("x y\tz, x y z. x\x1cy y", "en"), ("a b", "en"), ("a b", "en")]
    rows = [(k, t, lang) for k, (t, lang) in enumerate(texts)] * 2
    df = spark.createDataFrame([(*r, 1, "i", 2) for r in rows], KINDS).repartition(5)
    for least, most in ((1, 2000), (2, 5), (8, 2000)):
        assert got(C.collocations(df, least, most=most)) == brute([r[1:] for r in rows], least, most=most)
    assert C.collocations(df.limit(0)).count() == 0


def test_shared_ids_take_another_seed(spark, monkeypatch):
    """Ids that two words share under a seed, or that are zero, are not used."""
    real = C.word_id
    monkeypatch.setattr(C, "word_id", lambda lang, word, seed: (seed and real(lang, word, seed)) if word in (b"one", b"two") else real(lang, word, seed))
    df = spark.createDataFrame([(1, "one two three one two", "en", 1, "i", 2)], KINDS)
    words, seed = C.lossless_words(df)
    assert seed == 1 and {r.word: r.f for r in words.collect()} == {"one": 2, "two": 2, "three": 1}
    monkeypatch.setattr(C, "word_id", lambda lang, word, seed: 7)
    with pytest.raises(ValueError):
        C.lossless_words(df, 3)


def test_bitmap_holds_every_frequent_id(spark):
    ids = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 5000).tolist() + [-1, 1, (1 << 63) - 1, -(1 << 63)]
    bitmap, bits = C.frequent_bitmap(spark.createDataFrame([(i,) for i in ids], "id long"))
    slots = {i % (1 << 64) >> 64 - bits for i in ids}
    assert {int(s) for s in np.flatnonzero(np.unpackbits(bitmap, bitorder="little"))} == slots


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows_as_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    compare(spark, connect(path), C.op11_quotient_collocations, C.OP11_SQL, path)
