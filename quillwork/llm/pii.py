"""Personal data, plain and disguised, with offsets into the source text.

Plain identifiers are found by fixed patterns. Disguised ones are found on a
tape: transducers rewrite look-alike characters, invisible characters, spelled
digits and "at" / "dot" / "plus" in their various brackets, and every character
of the tape keeps the source span that it came from. The same patterns run on
the tape; a match that covers a rewritten place is mapped back to the source.

Edge cases: a null or empty text has no spans; texts are read whole; repeated
rows stay; an empty table gives no rows; other columns pass by. A disguised
span that overlaps a plain one of its kind is not added.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.shared import table, texts_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of IP begins where a run of digits does: from within the run it would be the same match, cut. So each run is tried once.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: list[int]) -> bool:
    """Whether the digits pass the Luhn check."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(odd) + sum(d * 2 - 9 * (d > 4) for d in even)) % 10 == 0


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: each runs from the first local character of the run before an @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; end exclusive, in code points."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


# Look-alikes of ASCII characters that compatibility forms don't cover.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ց": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "ı": "i", "ɡ": "g", "․": ".", "。": ".", "｡": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "⁃": "-",
}
INVISIBLE = frozenset("­​‌‍⁠﻿᠎")
NUMBERS = {word: str(n) for n, word in enumerate("zero one two three four five six seven eight nine".split())}
#: Top-level domains that let a bare "at ... dot ..." count as an address.
TOP_LEVEL = "com|org|net|edu|gov|io|info|biz|co|us|uk|de|fr|es|example|test"

_WORD = "(?:" + "|".join(NUMBERS) + ")"
_SPELLED = re.compile(rf"\b{_WORD}(?:[\x20,-]{{1,2}}{_WORD})*\b", re.I)
_AT = re.compile(r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?", re.I)
_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?", re.I)
_BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(\s(?:at|@)\s|@)[A-Za-z0-9-]+((?:(?:\sdot\s|\s?\.\s?)[A-Za-z0-9-]+)*)(\sdot\s|\s?\.\s?|\.)(?:{TOP_LEVEL})\b", re.I)
_BARE_DOT = re.compile(r"\sdot\s", re.I)
_SPACED_DOT = re.compile(r"(?<=[0-9])\s?dot\s?(?=[0-9])", re.I)
_PLUS = re.compile(r"\bplus\s?(?=[0-9])", re.I)
_EXOTIC = re.compile("[^\x00-\xac\xae-\xb6\xb8-\xff]")
# Each holds wherever the patterns above match: the first for _AT and _DOT, the second for _BARE.
_BRACKETED = re.compile(r"[\[({<]\s?(?:at|@|dot|\.)\s?[\])}>]", re.I)
_ANY_AT = re.compile(r"@|\sat\s", re.I)


class Tape:
    """A rewritten text whose characters know their source span and whether they were rewritten; nine bytes a character."""

    def __init__(self, text: str):
        self.text = text
        self.start = self.end = self.new = None  # arrays from the first rewrite on

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces tape spans, given in order, by strings; each new character spans its whole source."""
        if not edits:
            return
        if self.new is None:
            self.start = np.arange(len(self.text), dtype=np.int32)
            self.end = self.start + 1
            self.new = np.zeros(len(self.text), bool)
        text, at = [], 0
        for a, b, by in edits:
            text += [self.text[at:a], by]
            at = b
        text.append(self.text[at:])
        begin, stop, n = (np.array(x, np.int64) for x in zip(*((a, b, len(by)) for a, b, by in edits)))
        # pieces in turn: what stays, what is put in, ..., what stays
        first, length, step = np.zeros((3, 2 * len(edits) + 1), np.int64)
        first[2::2], first[1::2] = stop, begin
        length[:-1:2], length[-1], length[1::2] = begin - first[:-1:2], len(self.text) - stop[-1], n
        step[::2] = 1
        place = np.cumsum(length) - length
        put_in = np.repeat(step == 0, length)
        source = np.repeat(first, length) + (np.arange(length.sum()) - np.repeat(place, length)) * np.repeat(step, length)
        last = source.copy()
        last[put_in] = np.repeat(stop - 1, n)
        self.text = "".join(text)
        self.start, self.end, self.new = self.start[source], self.end[last], self.new[source] | put_in
        before = place[1::2][n == 0] - 1  # the character that stands before what was taken out
        self.new[before[before >= 0]] = True


def _look_alike(c: str) -> str:
    if c in INVISIBLE:
        return ""
    plain = LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else c


def homoglyphs(tape: Tape) -> None:
    edits = ((m.start(), m.end(), _look_alike(m[0])) for m in _EXOTIC.finditer(tape.text))
    tape.rewrite([e for e in edits if e[2] != tape.text[e[0] : e[1]]])


def spelled_digits(tape: Tape) -> None:
    """Runs of at least two spelled digits, or one beside a digit or a dot, become digits."""
    low, edits = tape.text.lower(), []
    for m in _SPELLED.finditer(tape.text) if any(word in low for word in NUMBERS) else ():
        words = re.findall("[a-z]+", m[0].lower())
        if len(words) > 1 or re.search(r"(?:[0-9.]|dot)\s?\Z", tape.text[max(0, m.start() - 5) : m.start()], re.I) or re.match(r"\s?(?:[0-9.]|dot)", tape.text[m.end() : m.end() + 5], re.I):
            word = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer("[A-Za-z]+", m[0])]
            for n, (a, b) in enumerate(word):
                edits.append((a, word[n + 1][0] if n + 1 < len(word) else b, NUMBERS[tape.text[a:b].lower()]))
    tape.rewrite(edits)


def at_and_dot(tape: Tape) -> None:
    if _BRACKETED.search(tape.text):
        tape.rewrite([(m.start(), m.end(), "@") for m in _AT.finditer(tape.text)])
        tape.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(tape.text)])
    edits = []
    for m in _BARE.finditer(tape.text) if _ANY_AT.search(tape.text) else ():
        if m[1] != "@" or _BARE_DOT.search(m[0]) or " . " in m[0]:
            edits.append((m.start(1), m.end(1), "@"))
            edits += [(m.start(2) + x.start(), m.start(2) + x.end(), ".") for x in re.finditer(r"\sdot\s|\s?\.\s?", m[2], re.I)]
            edits.append((m.start(3), m.end(3), "."))
    tape.rewrite([e for e in edits if tape.text[e[0] : e[1]] != e[2]])
    low = tape.text.lower()
    if "dot" in low:
        tape.rewrite([(m.start(), m.end(), ".") for m in _SPACED_DOT.finditer(tape.text)])
    if "plus" in low:
        tape.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)])


def find_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised) of a text, by start, then kind."""
    plain = plain_spans(text)
    found = [(a, KINDS.index(k), b, False) for k, a, b in plain]
    if text:
        tape = Tape(text)
        homoglyphs(tape)
        spelled_digits(tape)
        at_and_dot(tape)
        if tape.new is not None and tape.new.any():
            for kind, a, b in plain_spans(tape.text):
                start, end = int(tape.start[a]), int(tape.end[b - 1])
                if tape.new[a:b].any() and not any(k == kind and s < end and start < e for k, s, e in plain):
                    found.append((start, KINDS.index(kind), end, True))
    return [(KINDS[k], a, b, d) for a, k, b, d in sorted(found)]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))
SCHEMA = "doc_id long, found array<struct<kind string, start int, end int, disguised boolean>>"


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id, found: the spans of every text, by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [[dict(zip(("kind", "start", "end", "disguised"), s)) for s in find_spans(text)] for text in texts_of(rows)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, SPANS)], names=["doc_id", "found"])

    return documents.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, SCHEMA)


def redact(documents: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans merge.

    n_chars, where the table has it, follows the text.
    """
    columns, schema = documents.columns, documents.schema
    at = columns.index("text")

    def clean(text: str | None) -> str | None:
        spans = find_spans(text) if text else []
        if not spans:
            return text
        out, end = [], 0
        for kind, a, b, _ in spans:
            if a >= end:
                out += [text[end:a], f"[{kind}]"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = pa.array((clean(t.as_py()) for t in rows.column(at)), rows.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(rows.columns)], names=rows.schema.names)

    cleaned = documents.mapInArrow(run, schema)
    if "n_chars" in columns:
        cleaned = cleaned.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(schema["n_chars"].dataType))
    return cleaned


def op2_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    plain = F.filter("found", lambda s: ~s["disguised"])

    def count(kind: str) -> Column:
        return F.size(F.filter("plain", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return (
        find_pii(table(spark, sf_dir, "documents"))
        .withColumn("plain", plain)
        .select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("plain")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), (F.size("found") - F.size("plain")).cast("long").alias("n_disguised"))
    )
