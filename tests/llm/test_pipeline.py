"""The pipeline and its stages against versions that don't use the library.

The stage of near copies is compared with brute force, decontamination with the
operator's SQL in DuckDB, redaction with the contract's patterns (documents with
disguised spans aside, which have literal tests), ids with tiktoken.
"""

import base64
import hashlib
import re

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quillwork.llm import pii
from quillwork.llm.decontaminate import OP9_SQL
from quillwork.llm.shared import table

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def five_words(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def smallest_of_groups(rows):
    """The rows whose id is the smallest that links of similarity 0.8 or more reach."""
    sets, label = [five_words(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [r for i, r in enumerate(rows) if root(i) == i]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    )
    found = [(m.start(), n, m.end(), kind) for n, (kind, pattern, good) in enumerate(rules) for m in re.finditer(pattern, text) if good(m[0])]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def redacted(text, spans):
    out, end = "", 0
    for kind, a, b in spans:
        if a >= end:
            out += text[end:a] + f"[{kind}]"
        end = max(end, b)
    return out + text[end:]


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def test_pipeline(spark, rows):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    leaks = {r[0] for r in con.sql(OP9_SQL).fetchall()}
    stay = smallest_of_groups([(d, t) for d, t in rows if t and any(c.isalpha() for c in t)])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want, disguised = {}, 0
    for d, t in stay:
        if d not in leaks:
            spans = base_spans(t)
            if any(s[3] for s in pii.find_spans(t)):
                disguised += 1
                spans = [s[:3] for s in pii.find_spans(t)]
            clean = redacted(t, spans)
            ids = encoding.encode_ordinary(clean)
            want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and leaks and disguised < 0.1 * len(want)


def test_base_spans_of_a_whole_table(spark):
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    from quillwork.llm import registry

    got = {r.doc_id: r for r in registry.queries()["op2_deobfuscated_pii"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        spans = base_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        r = got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


CLASHES = "doc_id long, text string, lang string, _doc_id long, _text_hash long, marked_id long, Marked_Text string, leak_id int, leak_text int, _leak_doc_id int, wanted_id int, wanted_text int, wanted_node int, row int, node int, root int, label int"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_with_clashing_names(spark, name):
    item = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet' WHERE length(text) > 100 LIMIT 1").fetchall()[0][0]
    plain = ["the cat sat on the mat and looked at the birds outside of the window", "a long walk by the river ends where the old bridge begins to rise again"]
    rows = [(1, plain[0], "en"), (2, plain[0], "en"), (None, item, "en"), (None, plain[1], "en"), (5, f"{item} {plain[1]}", "en"), (5, "an honest text with no such passage in it at all, only its own words", "en")]
    docs = spark.createDataFrame([(*r, *[None] * 14) for r in rows], CLASHES)
    got = STAGES[name](spark, docs, SF)
    assert got.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text) for r in got.collect())
    gone = {"near_duplicates": {1}, "decontaminate": {2, 4}}.get(name, set())
    assert left == sorted((d or 0, t) for n, (d, t, _) in enumerate(rows) if n not in gone)


def test_language_rejects_what_was_not_learned(spark, rows):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    other = [(9001, "\u0441\u044a\u0435\u0448\u044c \u0436\u0435 \u0435\u0449\u0451 \u044d\u0442\u0438\u0445 \u043c\u044f\u0433\u043a\u0438\u0445 \u0431\u0443\u043b\u043e\u043a", None), (9002, "12 34", None), (9003, "\u6f22\u5b57\u4eee\u540d\u4ea4\u3058\u308a\u6587", None), (9004, None, None)]
    docs = spark.createDataFrame([(d, t, langs[d]) for d, t in rows] + other, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in STAGES["language"](spark, docs, SF).collect()}
    assert kept == {d for d, t in rows if t and any(c.isalpha() for c in t)}
