"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns."""

import hashlib
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillwork.llm import bpe, decontaminate, exactsubstr, langid, pii, sharding, simhash, tokenfile, topk, toxicity
from quillwork.llm.shared import shared_folder, spread

KINDS = "doc_id long, text string, lang string, print long, k1 string, found string, anchor int, tokens string, held_out string, part int, size string, key string"
LONG = "the cat sat on a mat near two dogs " * 9000


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, g, *[None] * 9) for i, t, g in rows], KINDS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(0, None, "en"), (1, "", "en"), (2, " \n\t", None), (3, "12 34", "en"), (4, LONG, "en"), (5, LONG, "en"), (5, LONG, "en"), (6, "le chat est sur la table et il dort bien", "fr"), (7, "the dog is on the table and it sleeps well", "en"), (None, "nobody knows this one", None), (None, None, None)]
    return documents(spark, *rows)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0, None), (6, 1, 1, None), (None, None, None, None)], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the cat sat on a mat near two dogs the cat sat", 0), (2, None, 0), (3, "", 0), (4, "short one", 0)], "item_id long, text string, doc_id long")


def each(docs, labels, items):
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    yield simhash.near_duplicates(docs), 11
    yield pii.find_pii(docs), 11
    yield toxicity.score_documents(docs, labels), 11
    yield sharding.assign_shards(docs), 11
    yield langid.identify(docs), 11
    yield bpe.round_trip_digests(docs, vocabulary), 11
    yield exactsubstr.repeated_bytes(docs), 11
    yield decontaminate.contaminated(docs, items), 2


def test_all_rows(docs, labels, items):
    for df, n in each(docs, labels, items):
        assert df.count() == n, df.columns


def test_empty_tables(docs, labels, items):
    none = docs.limit(0)
    for df, _ in each(none, labels.limit(0), items.limit(0)):
        assert df.count() == 0, df.columns
    for df, n in each(docs, labels.limit(0), items.limit(0)):
        assert df.count() == (n if n == 11 else 0)


def test_simhash_edges(docs):
    rows = simhash.near_duplicates(docs).collect()
    zero = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {0} and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(x for x in kept if x is not None) == [0, 3, 4, 6, 7] and kept.count(None) == 1


def test_language_edges(docs):
    got = {r.doc_id: (r.lang_pred, r.score, r.held_out) for r in langid.identify(docs).collect()}
    assert all(got[i][:2] == ("und", 0.0) for i in (0, 1, 2, 3))
    assert got[6][0] == "fr" or got[6][2] and got[7][2] is not None
    assert all(got[i][2] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(8))
    assert {r.doc_id for r in langid.keep_identified(docs).collect()} == {4, 5, 6, 7, None}
    assert langid.keep_identified(docs).columns == docs.columns


def test_toxicity_edges(docs, labels):
    rows = toxicity.score_documents(docs, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_labels_of_both_kinds_are_not_learned(spark):
    pool = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:30]
    table = documents(spark, *[(i, f"number {i} says so", "en") for i in pool])
    labels = spark.createDataFrame([*((i, 1) for i in pool[:20]), *((i, 0) for i in pool[10:]), (None, 1), (pool[0], None)], "doc_id long, toxic int")
    found = [sorted(toxicity.training_texts(table, labels, label, 100, 4000)) for label in (1, 0)]
    assert found == [sorted(f"number {i} says so" for i in ids) for ids in (pool[:10], pool[20:])]


def test_samples_of_long_texts_reach_their_ends(spark):
    text = "".join(chr(0x4E00 + i) for i in range(20000))
    rows = spark.createDataFrame([(text,), (text[:4000],), (None,), ("",)], "text string")
    long, short, null, empty = (r.s for r in rows.select(spread("text", 4000).alias("s")).collect())
    assert short == text[:4000] and null is None and empty == "" and len(long) <= 4000
    parts = long.split(" ")
    at = [text.index(p) for p in parts]
    assert len(parts) == 10 and at[0] == 0 and at[-1] + len(parts[-1]) == 20000 and max(b - a for a, b in zip(at, at[1:])) <= 2200


def test_toxicity_of_blank_texts(docs, labels):
    rows = toxicity.score_documents(docs, labels).collect()
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)


def test_personal_data_of_odd_texts(spark):
    table = documents(spark, (0, None, "en"), (1, "", None), (2, LONG + "me@site.org", "en"), (2, LONG + "me@site.org", "en"))
    rows = pii.find_pii(table).collect()
    rows = [(r.doc_id, [tuple(x) for x in r.found]) for r in pii.find_pii(table).orderBy("doc_id").collect()]
    there = [("email", len(LONG), len(LONG) + 11, False)]
    assert rows == [(0, []), (1, []), (2, there), (2, there)]


def test_ids_of_odd_texts(spark, docs):
    folder = f"{shared_folder(spark)}/odd-ids"
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenfile.write_tokens(docs, path, folder)
    library = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id IS NOT NULL").collect()}
    for r in tokenfile.read_tokens(spark, folder).where("doc_id IS NOT NULL").collect():
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))


def test_pieces_of_odd_texts(docs):
    rows = {r.doc_id: r for r in bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert all((rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (0, nothing, nothing) for i in (0, 1))
    assert rows[4].n_tokens > 80000 and rows[4].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert rows[4].ids_sha256 == rows[5].ids_sha256


def test_shards_of_one_id(spark):
    table = documents(spark, *[(None, f"text {i % 7}", "en") for i in range(500)])
    rows = sharding.assign_shards(table).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(500))
    crcs = [r.text_crc32 for r in sorted(rows, key=lambda r: r.slot)]
    assert crcs == sorted(crcs)


def test_sharding_edges(docs):
    rows = sharding.assign_shards(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (0, 1)} == {(1, 0)}


def test_repeats_edges(docs):
    rows = {r.doc_id: r for r in exactsubstr.repeated_bytes(docs).collect()}
    assert rows[0].n_bytes == rows[1].n_removed == 0 and rows[4].n_removed == rows[5].n_removed == len(LONG)


def test_decontamination_edges(docs, items):
    assert {r.doc_id: r.item_ids for r in decontaminate.contaminated(docs, items).collect()} == {4: "1", 5: "1"}
    assert decontaminate.keep_clean(docs, items).count() == 8


def test_redaction_edges(docs):
    rows = pii.redact(docs)
    assert rows.columns == docs.columns and rows.count() == 11 and {r.text for r in rows.where("doc_id = 0").collect()} == {None}


def test_tokens_edges(spark, docs):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    for table, n in ((docs, 11), (docs.limit(0), 0)):
        folder = f"{shared_folder(spark)}/edges-{n}"
        tokenfile.write_tokens(table, tokenizer, folder)
        rows = tokenfile.read_tokens(spark, folder).orderBy("start").collect()
        assert len(rows) == n
        at = 0
        for r in rows:
            assert r.start == at
            at += r.n_tokens
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))


def test_topk_edges(spark):
    v = spark.createDataFrame([(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, None, 1), (3, [], 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [-1.0, 0.1], 1), (7, [-1.0, 0.1], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in topk.top_inner_products(v).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 256 * 256 + 128 * 128), (0, 2, 7, -256 * 256 + 128 * 25), (0, 3, 7, -256 * 256 + 128 * 25)]
    assert topk.top_inner_products(v.limit(0)).count() == 0
