"""The operators against brute force, other libraries, exact round trips and held-out rows."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from functools import lru_cache
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from oracle import compare, connect
from quillwork.llm import bpe, decontaminate, exactsubstr, langid, pii, registry, sharding, simhash, suffixes, tokenfile, topk, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    compare(spark, connect(SF), registry.queries()[name], registry.oracle_sql()[name], SF)


# --- 1 ---


def components(prints, radius=3):
    labels = np.arange(len(prints))
    simhash.unite(labels, *np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius))
    return labels


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def test_simhash(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.queries()["op1_bitsliced_simhash"](spark, SF).collect()}
    prints = np.array([plain_fingerprint(t) for _, t in texts], np.uint64)
    labels = components(prints)
    assert got == {d: (f"{int(p):016x}", texts[at][0]) for (d, _), p, at in zip(texts, prints, labels)}


@pytest.mark.parametrize("n", [2, 3, 64, 65, 130, 900])
def test_bit_sliced_links(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, size=max(1, n // 8)).astype(np.uint64)
    prints = base[rng.integers(0, len(base), n)]
    for _ in range(4):
        prints = np.where(rng.random(n) < 0.6, prints ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), prints)
    prints = np.unique(prints)
    labels = np.arange(len(prints))
    simhash.link_large(prints, labels, 0)
    assert (labels == components(prints)).all()
    if len(prints) <= simhash.SMALL:
        labels = np.arange(len(prints))
        simhash.link_small(prints, np.zeros(len(prints), int), labels)
        assert (labels == components(prints)).all()


def test_dealt_buckets(spark, monkeypatch):
    """Buckets above the limit are compared in parts, with the same components."""
    monkeypatch.setattr(simhash, "MOST", 16)
    rng = np.random.default_rng(7)
    prints = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    prints = np.unique(prints)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    links = simhash.bucket_links(df).collect()
    labels = np.arange(len(prints))
    place = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    simhash.unite(labels, np.array([place[r.a] for r in links]), np.array([place[r.b] for r in links]))
    assert (labels == components(prints)).all()


# --- 2 ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_plain_emails():
    rng = random.Random(1)
    for _ in range(20000):
        text = "".join(rng.choice("ab.@-+1 é") for _ in range(rng.randint(0, 16)))
        assert [s[1:] for s in pii.plain_spans(text) if s[0] == "email"] == [m.span() for m in EMAIL.finditer(text)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail a.b@c-d.org, ip 1.2.3.4 and 1.2.3.256", [("email", "a.b@c-d.org"), ("ip", "1.2.3.4")]),
        ("0" * 5000 + "1.2.3.4 and " + "9" * 5000 + ".1.1.1", [("ip", "0" * 5000 + "1.2.3.4")]),
        ("card 4111 1111 1111 1111 or 4111 1111 1111 1112", [("card", "4111 1111 1111 1111")]),
        ("call +1 (456) 555-2186 now", [("phone", "+1 (456) 555-2186")]),
        ("jane [at] mail (dot) example [dot] com", [("email", "jane [at] mail (dot) example [dot] com")]),
        ("write jane at mail dot example dot com!", [("email", "jane at mail dot example dot com")]),
        ("plus four nine one five one two three four five six", [("phone", "plus four nine one five one two three four five six")]),
        ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", [("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ")]),
        ("j\u0430ne@ex\u0430mple.com", [("email", "j\u0430ne@ex\u0430mple.com")]),
        ("4111\u200b1111\u200b1111\u200b1111", [("card", "4111\u200b1111\u200b1111\u200b1111")]),
        ("one nine two dot one six eight dot zero dot one", [("ip", "one nine two dot one six eight dot zero dot one")]),
        ("we met at noon. one two three steps, polka dot dress", []),
        ("É é 12.5 + 3", []),
    ],
)
def test_disguises(text, found):
    got = [(k, text[a:b]) for k, a, b, _ in pii.find_spans(text)]
    assert set(found) <= set(got) and (found or not got)


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        ("email", "jane.doe at example.com"),
        ("email", "jane at mail.com"),
        ("email", "jane ( at ) mail.com"),
        ("email", "jane [ at ] mail.com"),
        ("email", "jane{@}mail.com"),
        ("email", "jane<@>mail.com"),
        ("email", "jane@mail . com"),
        ("email", "x@mail{.}com"),
        ("email", "jane@mail\u00b7com"),
        ("phone", "plus 49 151 2345678"),
        ("ip", "192.168.1.one"),
    ],
)
def test_disguise_alone(kind, text):
    around = f"Write or call, {text}, if you can"
    assert [(k, around[a:b], d) for k, a, b, d in pii.find_spans(around)] == [(kind, text, True)]


def test_lookalikes_are_rewritten():
    assert all(pii._EXOTIC.fullmatch(c) for c in [*pii.LOOKALIKES, *pii.INVISIBLE])


# --- 3, 7 ---


def test_toxicity_held_out(spark):
    labels = dict(duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall())
    rows = registry.queries()["op3_compression_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").collect()
    rows = [r for r in rows if r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows)
    caught = [r.predicted for r in rows if labels[r.doc_id]]
    assert right > 0.94 and sum(caught) / len(caught) > 0.6


def test_language_held_out(spark):
    langs = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    rows = registry.queries()["op7_ppm_language"](spark, "/root/testdata/sf0.01").where("held_out AND lang_pred <> 'und'").collect()
    assert sum(r.lang_pred == langs[r.doc_id] for r in rows) / len(rows) > 0.95


def plain_ppm(texts, text):
    """The bits of a text, by dictionaries of counts and sums over all 256 bytes."""
    counts = {}
    for t in texts:
        data = langid.BEFORE + t.encode()
        for i in range(3, len(data)):
            for order in range(4):
                counts.setdefault(data[i - order : i], Counter())[data[i]] += 1

    @lru_cache(maxsize=None)
    def row(context):
        if context is None:
            return [1 / 256] * 256
        low, c = row(context[1:] if context else None), counts.get(context)
        if not c:
            return low
        n, q = sum(c.values()), len(c)
        rest = sum(p for b, p in enumerate(low) if b not in c)
        return [c[b] / (n + q) if b in c else q / (n + q) * p / rest for b, p in enumerate(low)]

    data = langid.BEFORE + text.encode()
    return sum(-math.log2(row(data[i - 3 : i])[data[i]]) for i in range(3, len(data)))


def test_code_lengths_are_those_of_plain_ppm():
    rows = duckdb.sql("SELECT lang, list(text ORDER BY doc_id)[:4] FROM '/root/testdata/sf0.001/documents.parquet' WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang ORDER BY lang").fetchall()
    texts = {lang: found[:3] for lang, found in rows}
    model = langid.Model(texts)
    for text in [*(found[-1][:1500] for _, found in rows), "", "a", "zz 99 \u00e9\u4e16\u754c \U0001f600", "\n\n\nthe", "\x00\x01"]:
        plain = [plain_ppm(tuple(texts[lang]), text) for lang in model.languages]
        assert model.code_lengths(text) == pytest.approx(plain, rel=1e-5, abs=1e-4)


def test_ppm_is_a_distribution():
    model = langid.Model({"en": ["the cat and the dog", "a bird"], "fr": ["le chat et le chien"]})
    many = np.ones(model.size)
    many[-1] = 256 - model.size + 1
    for row in range(len(model.lower)):
        total = np.zeros(2)
        for symbol in range(model.size):
            bits, r = np.zeros(2), row
            while True:
                at, known = model.place(np.array([r * model.size + symbol]))
                if known[0]:
                    bits += model.costs[at[0]]
                    break
                bits += model.escapes[r]
                if r == 0:
                    bits += 8
                    break
                r = model.lower[r]
            total += many[symbol] * np.exp2(-bits)
        assert np.abs(total - 1).max() < 1e-5, row
    assert model.predict("the dog")[0] == "en" and model.predict("le chien")[0] == "fr" and model.predict("12")[0] == "und"


def test_every_language_is_learned(spark):
    words = [f"{a}{b}{c}o" for a in "bdfgk" for b in "aeiu" for c in "lmnrs"]
    rows = [(i, " ".join([w] * 9), f"lang{n:02d}") for n, w in enumerate(words) for i in range(n * 9, n * 9 + 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(table).select("doc_id", "lang_pred").join(table, "doc_id").collect()
    assert len({r.lang for r in got}) == 100 and all(r.lang_pred == r.lang for r in got)
    with pytest.raises(ValueError, match="most_languages"):
        langid.fit(table, most_languages=99)


def test_a_tie_goes_to_the_first_language():
    model = langid.Model({"b": ["same words here"], "a": ["same words here"]})
    assert model.predict("same words") == ("a", 0.5)


def test_the_table_holds_what_was_seen():
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id LIMIT 60").fetchall()]
    model = langid.Model({f"l{i:02d}": texts[i::20] for i in range(20)})
    seen = {(d[i - o : i], d[i]) for t in texts for d in [langid.BEFORE + t.encode()] for i in range(3, len(d)) for o in range(4)}
    assert len(model.costs) == len(seen) and len(model.escapes) <= len({c for c, _ in seen}) + model.size


# --- 4 ---


def test_topk_random(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 9)).astype(np.float32)
    x[100:200] = x[0]  # ties
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    ints = np.floor(256 * x.astype(float)).astype(np.int64)
    want = []
    for q in range(0, 700, 50):
        scores = ints @ ints[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_inner_products(df).collect()) == sorted(want)


# --- 5, 8 ---


def fuzz():
    rng = random.Random(2)
    alphabet = [*" \n\t ab'sé1.,\u00a0\u3000\x1c\x85\u200b漢", "🙂", "<|endoftext|>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + ["   a  b   ", "a ", " ", "x" * 3000, "don't  you're 's"]


def test_bpe_is_tiktoken():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(path)
    for text in fuzz():
        ids = codec.encode(text)
        assert ids == other.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_frames(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame(texts[:60], "doc_id long, text string")
    decoded = bpe.decode_documents(bpe.encode_documents(docs, path), path)
    assert {r.doc_id: bytes(r.decoded) for r in decoded.collect()} == {d: (t or "").encode() for d, t in texts[:60]}


def test_encoder_is_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = tokenfile.Encoder(path), Tokenizer.from_file(path)
    for text in fuzz():
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, []
    for d, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in registry.queries()["op5_bit_packed_tokens"](spark, SF).collect()) == want


@pytest.mark.parametrize("width", [1, 5, 16, 17, 31])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 10000).astype(np.uint32)
    segment = tokenfile.pack(ids, width)
    assert (tokenfile.unpack(segment) == ids).all()
    for a, b in ((0, 1), (4000, 8200), (4096, 8192), (9999, 10000), (5, 5)):
        assert (tokenfile.unpack(segment, a, b) == ids[a:b]).all()
    assert len(segment) < 10000 * width / 8 + 100
    with pytest.raises(ValueError):
        tokenfile.pack(np.array([1 << width], np.uint64), width)


# --- 6 ---


def test_shares_follow_weights(spark):
    keys = spark.range(20000).selectExpr("CAST(id AS STRING) AS k")
    tree = sharding.base_tree(8, weights={0: 3.0})
    shards = Counter(r.s for r in keys.select(sharding.shard_of(keys["k"], tree).alias("s")).collect())
    assert abs(shards[0] / 20000 - 0.3) < 0.02 and abs(shards[5] / 20000 - 0.1) < 0.02
    # a weight in one rack moves nothing between the shards of other regions' racks
    more = sharding.base_tree(8, weights={0: 3.0, 1: 2.0})
    moved = keys.select(sharding.shard_of(keys["k"], tree).alias("a"), sharding.shard_of(keys["k"], more).alias("b")).where("a <> b AND b > 3").count()
    assert moved == 0


def test_shards(spark, texts):
    rows = registry.queries()["op6_hash_tree_shards"](spark, SF).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"key"}
    sizes = {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts}
    assert all((r["size"], r.text_crc32) == sizes[r.doc_id] and r.grown_shard in (r.shard, 8) for r in rows)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


# --- 9 ---


def test_masks_miss_nothing():
    def hit(masks, length, bad):
        return any(not any(o + x in bad for x in m) for m in masks for o in range(length - m[-1]))

    for length in range(decontaminate.SHORTEST, 30):
        width = min(length, decontaminate.WINDOW)
        wrong = width - int(np.ceil(width * decontaminate.SHARE))
        masks = decontaminate.MASKS[:1] if length >= decontaminate.WINDOW else decontaminate.MASKS
        assert all(hit(masks, width, set(bad)) for bad in combinations(range(width), wrong))


def test_substitutions(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    words = item.split()
    texts = {1: f"before {item} after", 2: "x " + " ".join("zz" if n in (3, 9) else w for n, w in enumerate(words)) + " y", 3: " ".join("zz" if n % 3 == 0 else w for n, w in enumerate(words)), 4: "nothing here", 5: item.upper()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == {1, 2, 5}


def test_several_passes(spark, monkeypatch):
    whole = sorted(map(tuple, registry.queries()["op9_spaced_seeds"](spark, SF).collect()))
    monkeypatch.setattr(decontaminate, "SEEDS", 300)
    assert sorted(map(tuple, registry.queries()["op9_spaced_seeds"](spark, SF).collect())) == whole


# --- 10 ---


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(400):
        data = bytes(rng.randint(1, rng.choice([1, 2, 20])) for _ in range(rng.randint(0, 60))) * rng.randint(1, 3) + b"\0"
        want = sorted(range(len(data)), key=lambda i: data[i:])
        for text in (np.frombuffer(data, np.uint8), np.frombuffer(data, np.uint8).astype(np.int64)):
            assert suffixes.suffix_array(text).tolist() == want
        shared = suffixes.permuted_common_prefixes(np.frombuffer(data, np.uint8), np.array(want), 5)
        for a, b in zip(want, want[1:]):
            same = 0
            while same < 5 and max(a, b) + same < len(data) and data[a + same] == data[b + same]:
                same += 1
            assert min(5, shared[b]) == same


def plain_repeats(rows, length=400):
    """{doc_id: (bytes, removed, spans, digest of what stays)}, window by window."""
    counts = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, b in data:
        counts.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = {}
    for d, b in data:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def repeats_equal(spark, rows):
    got = exactsubstr.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain_repeats(rows)
    least, most = (plain_repeats(rows, n) for n in (exactsubstr.PASSAGE, exactsubstr.CORE))
    assert all((r.n_passage_bytes > 0) >= (least[r.doc_id][1] > 0) and r.n_passage_bytes <= most[r.doc_id][1] for r in got)


@pytest.mark.parametrize("most", [exactsubstr.MOST, 2])
def test_repeats(spark, texts, monkeypatch, most):
    monkeypatch.setattr(exactsubstr, "MOST", most)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(1500)) for _ in range(5)]
    rows = []
    for i in range(90):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            p = rng.randint(0, len(t) - 1)
            t = t[:p] + rng.choice(["X", "", "yy zz"]) + t[p + rng.randint(0, 3) :]
        a = rng.randint(0, 900)
        rows.append((1000 + i, t[a : a + rng.randint(200, 1500)]))
    rows += [(2000, None), (2001, ""), (2002, "a" * 1000), (2003, "ab" * 900), (2004, (base[1][:450] + "Q") * 3), (2005, base[0]), (2006, base[0]), (2007, "x" * 400), (2008, "x" * 399), (2009, "y" * 256), (2010, "y" * 255)]
    rows += texts[:120]
    repeats_equal(spark, rows)


@pytest.mark.parametrize("length", [255, 256, 300, 399, 400, 401, 700])
def test_shared_passages(spark, length, monkeypatch):
    """A passage in texts that share nothing else, shorter and longer than what is removed."""
    monkeypatch.setattr(exactsubstr, "MOST", 5)
    rng = random.Random(length)
    draw = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = draw(length)
    rows = [(i, draw(rng.randint(0, 300)) + f"{i}<" + passage + f">{i}" + draw(rng.randint(0, 300))) for i in range(40)] + [(50 + i, draw(900)) for i in range(5)]
    repeats_equal(spark, rows)


@pytest.mark.parametrize("shift", [20, 27, 30])
def test_large_components_are_exact(shift):
    rng = random.Random(shift)
    draw = lambda n: np.array([[rng.randint(-(1 << shift), 1 << shift) for _ in range(8)] for _ in range(n)], np.int64)
    queries, base = draw(4), draw(600)
    base[300:] = base[:300]
    base[300:, 0] += 1  # scores that differ by less than a double holds
    search = topk.Search(np.arange(1000, 1004), queries, 5)
    for a in range(0, 600, 200):
        search.read(np.arange(a, a + 200), base[a : a + 200])
    for q, best in zip(queries.tolist(), search.best):
        want = sorted((-sum(x * y for x, y in zip(q, c)), i) for i, c in enumerate(base.tolist()))
        assert best == want[:5]


def test_large_scores_do_not_wrap():
    search = topk.Search(np.array([9]), np.array([[1 << 33, 1 << 33]]), 1)
    search.read(np.array([1, 2]), np.array([[1 << 32, 0], [0, 1]]))
    assert search.best == [[(-(1 << 65), 1)]]
    with pytest.raises(OverflowError):
        search.result()


@pytest.mark.parametrize("text", ["7" * 1_000_000, "one " * 250_000, "1." * 500_000, "12345 " * 170_000, "\u0430" * 1_000_000, "a@b" + ".b" * 300_000, "+1" + "(" * 500_000], ids="digits spelled dots runs lookalikes labels phone".split())
def test_long_runs_take_seconds(text):
    """The search for personal data grows with the text, whatever it is made of."""
    began = time.perf_counter()
    pii.find_spans(text)
    assert time.perf_counter() - began < 20


def test_a_run_of_digits_is_one_try_of_an_address():
    """Leading digits belong to an address; what follows a match begins anew."""
    found = [(k, a, b) for k, a, b in pii.plain_spans("0001.2.3.4 999.1.1.1 5.6.7.8.9.10.11.12 x1.2.3.4") if k == "ip"]
    assert found == [("ip", 0, 10), ("ip", 21, 28), ("ip", 29, 39), ("ip", 41, 48)]
