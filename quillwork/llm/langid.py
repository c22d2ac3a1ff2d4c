"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to 3 with frozen counts. In a
context seen n times with q different next bytes, a byte seen c times costs
-log2(c / (n + q)); others escape with q / (n + q) to the next shorter context,
whose probabilities are renormalised over the bytes not seen here; below order
0 all bytes are equally likely. So every context gives a full distribution and
a text's code length under a language is exact.

The statistics are frozen, so the table holds what training saw and no more: a
row of costs, one a language, for each (context, next byte) that any language
saw, and a row of escape costs for each context. A byte that no language saw
in a context costs that context's escape and what the shorter context asks. A
bit set with counts before each word gives the row of a (context, byte).

Training reads, of the documents whose crc32(doc_id) mod 3 is not 1, at most
`per_language` different texts a language (those of the smallest hash) and
`per_text` characters of each, in stretches spread evenly over the whole text:
the documented bound of the fit. Prediction reads whole texts. A language with
fewer texts is learned from what it has. More than `most_languages` values of
lang are an error, as no bounded model holds them; none is left out.

Edge cases: null and empty texts, and texts without a letter, are 'und' with
score 0; a null lang is not learned from; ties go to the first language by
name; without any training text everything is 'und'; repeated rows stay; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwork.llm.shared import batch, id_check, spread, table, texts_of

UNKNOWN, FOLDS, HELD_OUT = "und", 3, 1
#: Values of lang that one model learns at most.
MOST_LANGUAGES = 128
#: Bits a byte above which a text is in none of the languages: theirs cost 2 to 4, noise of their bytes up to 9, scripts not learned 15 and more.
MOST_BITS, LEAST_SHARE = 10.0, 0.5
#: What is taken to stand before a text: the context of its first bytes.
BEFORE = b"\n\n\n"
ASCII_LETTER = re.compile("[A-Za-z]")
CHUNK = 1 << 16


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(c.isalpha() for c in text)


class Model:
    """Code lengths of bytes in their contexts under each language.

    Contexts are rows: the empty one, those of one byte, then those of two and
    three bytes that training saw. `lower` is a row's next shorter context.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        coded = {k: [BEFORE + t.encode("utf-8", "replace") for t in texts[k]] for k in self.languages}
        streams = {k: np.frombuffer(b"".join(coded[k]), np.uint8) for k in self.languages}
        seen = np.zeros(256, bool)
        for s in streams.values():
            seen[s] = True
        used = np.flatnonzero(seen)
        self.size = a = len(used) + 1  # the last symbol stands for every byte never seen
        self.symbol = np.full(256, a - 1, np.int32)  # a**3 stays far below 2**31 for the bytes of UTF-8
        self.symbol[used] = np.arange(len(used))
        keys, following = {}, {}
        for k in self.languages:
            s, lengths = self.symbol[streams[k]], np.array([len(t) for t in coded[k]])
            # a text's own bytes are counted, not those before it
            v = np.flatnonzero(np.arange(len(s)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= len(BEFORE))
            keys[k] = s[v - 1], s[v - 2] * a + s[v - 1], (s[v - 3] * a + s[v - 2]) * a + s[v - 1]
            following[k] = s[v].astype(np.int64)
        all2, all3 = (np.unique(np.concatenate([keys[k][i] for k in self.languages])) for i in (1, 2))
        n2, n3 = len(all2), len(all3)
        edges = np.cumsum([0, 1, a, n2, n3])
        self.row2 = np.tile(1 + np.arange(a, dtype=np.int32), a)
        self.row2[all2] = edges[2] + np.arange(n2)
        self.pair = np.zeros(a * a, np.int32)
        self.pair[all2] = 1 + np.arange(n2)
        self.row3 = np.zeros((n2 + 1, a), np.int32)
        self.row3[1:] = self.row2[(all2 % a)[:, None] * a + np.arange(a)]
        self.row3[self.pair[all3 // a], all3 % a] = edges[3] + np.arange(n3)
        self.lower = np.concatenate([np.zeros(1 + a, np.int32), 1 + all2 % a, self.row2[all3 % (a * a)]]).astype(np.int32)

        def entries(k: str) -> np.ndarray:
            """row * a + next byte of each counted byte in each of its four contexts."""
            one, two, three = keys[k]
            rows = np.zeros(len(one), np.int64), 1 + one, edges[2] + np.searchsorted(all2, two), edges[3] + np.searchsorted(all3, three)
            return np.concatenate([r * np.int64(a) + following[k] for r in rows])

        counted = {k: np.unique(entries(k), return_counts=True) for k in self.languages}
        every = np.unique(np.concatenate([e for e, _ in counted.values()]))
        self._index(every, edges[-1] * a)
        self.costs = np.empty((len(every), len(self.languages)), np.float32)
        self.escapes = np.empty((edges[-1], len(self.languages)), np.float32)
        rows = every // a
        shorter = self.place(self.lower[rows] * np.int64(a) + every % a)[0]
        for at, k in enumerate(self.languages):
            counts = np.zeros(len(every), np.int64)
            counts[self.place(counted[k][0])[0]] = counted[k][1]
            p, leaves = self._blend(counts, rows, shorter, edges)
            self.costs[:, at], self.escapes[:, at] = -np.log2(p), -np.log2(leaves)

    @staticmethod
    def _blend(counts: np.ndarray, rows: np.ndarray, shorter: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the probability of each entry, what a row's escape makes of the shorter context's probabilities)."""
        n = np.bincount(rows, counts, edges[-1])
        q = np.bincount(rows, counts > 0, edges[-1])
        p, leaves = np.empty(len(rows)), np.ones(edges[-1])
        bounds = np.searchsorted(rows, edges)
        for first, last, a, b in zip(edges, edges[1:], bounds, bounds[1:]):
            own, of, low = counts[a:b], rows[a:b], p[shorter[a:b]] if first else np.full(b - a, 1 / 256)
            left = 1 - np.bincount(of - first, np.where(own > 0, low, 0.0), last - first)
            m, r = n[first:last], q[first:last]
            leaves[first:last] = np.where(m > 0, r / np.maximum(m + r, 1) / left, 1.0)
            p[a:b] = np.where(own > 0, own / np.maximum(n[of] + q[of], 1), leaves[of] * low)
        return p, leaves

    def _index(self, entries: np.ndarray, most: int) -> None:
        flags = np.zeros(-(-most // 64) * 64, bool)
        flags[entries] = True
        self.words = np.packbits(flags, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))[:-1]]

    def place(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many known entries are smaller, whether it is known) of each entry."""
        at, bit = entry >> 6, (entry & 63).astype(np.uint64)
        word, one = self.words[at], np.uint64(1)
        return self.before[at] + np.bitwise_count(word & ((one << bit) - one)), (word >> bit & one).astype(bool)

    def code_lengths(self, text: str) -> np.ndarray:
        """The bits that the whole text costs under each language."""
        s = self.symbol[np.frombuffer(BEFORE + text.encode("utf-8", "replace"), np.uint8)]
        a, total = self.size, np.zeros(len(self.languages))
        for start in range(3, len(s), CHUNK):
            x = s[start - 3 : start + CHUNK]
            first, following = self.pair[x[:-3] * a + x[1:-2]], x[3:]
            rows = np.where(first > 0, self.row3[first, x[2:-1]], self.row2[x[1:-2] * a + x[2:-1]])
            while len(rows):
                at, known = self.place(rows * np.int64(a) + following)
                total += np.ones(int(known.sum()), np.float32) @ self.costs[at[known]]
                rows, following = rows[~known], following[~known]
                total += np.ones(len(rows), np.float32) @ self.escapes[rows]
                longer = rows > 0
                total += 8.0 * (len(rows) - int(longer.sum()))  # one byte of 256
                rows, following = self.lower[rows[longer]], following[longer]
        return total

    def judged(self, text: str) -> tuple[str, float, float]:
        """(language, its share of the probability among the languages, bits a byte under it)."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, 8.0
        bits = self.code_lengths(text)
        best = int(bits.argmin())
        share = float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())
        return self.languages[best], share, float(bits[best]) / len(text.encode("utf-8", "replace"))

    def predict(self, text: str) -> tuple[str, float]:
        return self.judged(text)[:2]


#: Hashes are ordered by this many low bits; candidates are some times as many as are wanted.
ORDER_BITS, SPARE = 30, 4


def training_texts(documents: DataFrame, per_language: int, per_text: int, most_languages: int = MOST_LANGUAGES) -> dict[str, list[str]]:
    """Different texts of each language, those whose hashes come first.

    An estimate of each language's different texts gives a bound below which
    SPARE times as many hashes lie as are wanted; only those are ranked, so the
    ranking's input does not grow with the table.
    """
    rows = documents.where((id_check("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("h"), "text")
    place = F.pmod("h", F.lit(1 << ORDER_BITS))
    many = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("many")).withColumnRenamed("lang", "of")
    languages = many.limit(most_languages + 1).collect()
    if len(languages) > most_languages:
        raise ValueError(f"lang has more than most_languages = {most_languages} values: raise it, or clean the column")
    many = documents.sparkSession.createDataFrame(languages, many.schema)
    bound = F.least(F.lit(1.0), F.lit(float(SPARE * per_language)) / F.col("many")) * (1 << ORDER_BITS)
    first = Window.partitionBy("lang").orderBy(place, "h")
    near = rows.select("lang", "h").join(F.broadcast(many), F.col("lang") == F.col("of")).where(place <= bound)
    chosen = near.select("lang", "h").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).drop("n")
    found = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", spread("text", per_text).alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    texts: dict[str, list[str]] = {}
    for r in found.orderBy("lang", "h").collect():  # at most per_language rows a language
        texts.setdefault(r.lang, []).append(r.text)
    return texts


def fit(documents: DataFrame, per_language: int = 150, per_text: int = 8000, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """The model of all values of lang, None without a text."""
    texts = training_texts(documents, per_language, per_text, most_languages)
    return Model(texts) if texts else None


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(documents: DataFrame, per_language: int = 150, per_text: int = 8000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, per_language, per_text))  # bounded by the fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [model.value.predict(t) if model.value else (UNKNOWN, 0.0) for t in texts_of(rows)]
            yield batch({"doc_id": (rows.column(0), pa.int64()), "held_out": (rows.column(2), pa.bool_()), "lang_pred": ([x for x, _ in found], pa.string()), "score": ([s for _, s in found], pa.float64())})

    held = (id_check("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held).mapInArrow(run, SCHEMA)


def keep_identified(documents: DataFrame, per_language: int = 150, per_text: int = 8000, languages: frozenset[str] | None = None, most_bits: float = MOST_BITS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The documents in a known language.

    A document goes if it has no letter, if its best language is none of
    `languages` (None: any learned one), has less than `least_share` of the
    probability, or codes it in more than `most_bits` bits a byte, as it does
    texts of languages that were not learned and noise.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, per_language, per_text))
    at, schema = documents.columns.index("text"), documents.schema

    def known(text: str) -> bool:
        if model.value is None:
            return False
        language, share, bits = model.value.judged(text)
        return language != UNKNOWN and (languages is None or language in languages) and share >= least_share and bits <= most_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield rows.filter(pa.array([known(t.as_py() or "") for t in rows.column(at)], pa.bool_()))

    return documents.mapInArrow(run, schema)


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
