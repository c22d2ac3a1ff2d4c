"""Toxicity by compression distance to zstandard dictionaries.

A window of words costs fewer bytes under a dictionary that holds its phrases.
One dictionary is trained on ordinary text. Two are trained on what toxic text
has beyond it: words with n-grams that ordinary text never has, and words with
n-grams that it has far less often. Each of these carries the ordinary
dictionary behind, so that lengths differ only where toxic phrases help. The
gain of a window is the difference of its compressed lengths. Of a text's
gains, the mean, the greatest, the mean excess and how many windows exceed
fixed numbers of bytes go through a logistic curve, fitted on labelled rows
that the dictionaries have not seen, to a score from 0 to 1.

Training reads labelled rows that are not held out, at most `toxic` and
`ordinary` of them and `per_text` characters of each, in stretches spread
evenly over the whole text (the documented bound of the fit); the ordinary
dictionary is trained on `base_texts` of the ordinary rows. Scoring reads whole
texts. What toxic text has beyond ordinary text
is found by how many different (previous word, word) pairs hold a character
n-gram, which repeated rows and copies do not raise.

Edge cases: a null, empty or blank text scores as no gain; a null doc_id is
held out or not as the text ''; labels that are null, of a null doc_id or of
both kinds for one document are not learned from; without a label of either kind every score is the share of toxic labels (0.0
without any); repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.shared import batch, id_check, spread, table, texts_of

#: Words a window: short windows show single phrases, long ones their sum.
WINDOWS, NGRAM, LEVEL = (12, 32), 5, 9
ORDINARY_BYTES = 65536
#: Standard deviations above chance that make an n-gram toxic.
DEVIATIONS = 8.0
#: (bytes, times as common, contexts allowed in ordinary text for each in toxic text) of the toxic dictionaries.
TOXIC = ((2048, 8.0, 0.0), (6144, 3.0, 1.0))
MOST_GAIN, SOME, MUCH = 12, 3, 4
FOLDS = 5


def windows(text: str, size: int) -> list[bytes]:
    """The text's words in lower case, `size` at a time."""
    words = text.lower().split()
    return [" ".join(words[a : a + size]).encode("utf-8", "replace") for a in range(0, len(words), size)]


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(samples)[-size:]


def _ngrams(word: str) -> set[str]:
    word = f" {word} "
    return {word[a : a + NGRAM] for a in range(len(word) - NGRAM + 1)}


def _contexts(texts: list[str], memory: dict[str, set[str]]) -> tuple[Counter, int]:
    """In how many different (previous word, word) pairs each n-gram occurs."""
    pairs: set[tuple[str, str]] = set()
    for text in texts:
        words = text.lower().split()
        pairs.update(zip(["", *words], words))
    per_word = Counter(word for _, word in pairs)
    found: Counter = Counter()
    for word, n in per_word.items():
        for g in memory.setdefault(word, _ngrams(word)):
            found[g] += n
    return found, len(pairs)


def toxic_samples(toxic: list[str], ordinary: list[str]) -> list[list[bytes]]:
    """For each of TOXIC, the words of each toxic text that hold an n-gram commoner there."""
    memory: dict[str, set[str]] = {}
    (there, n), (here, m) = _contexts(toxic, memory), _contexts(ordinary, memory)
    k = n / max(1, m)
    found = []
    for _, ratio, allowed in TOXIC:
        marked = {g for g, c in there.items() if c > ratio * k * (here[g] + 1) and k * here[g] <= allowed * c and c - k * here[g] > DEVIATIONS * math.sqrt(k * here[g] + 1)}
        keep = {word for word, grams in memory.items() if grams & marked}
        kept = ([word for word in text.lower().split() if word in keep] for text in toxic)
        found.append([f" {' '.join(words)} ".encode("utf-8", "replace") for words in kept if words])
    return found


@dataclass
class Classifier:
    """The ordinary dictionary, the toxic ones, and the calibration of their differences."""

    dictionaries: list[bytes] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in self.dictionaries:
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=256, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            if content:
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=p)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
            else:
                made.append(zstandard.ZstdCompressor(compression_params=p))
        return made

    def features(self, text: str, compressors: list[zstandard.ZstdCompressor]) -> list[float]:
        """Five numbers of the gains for each size of windows and toxic dictionary."""
        out: list[float] = []
        for size in WINDOWS:
            cut = windows(text, size)
            lengths = [np.array([len(c.compress(w)) for w in cut] or [0]) for c in compressors]
            for other in lengths[1:]:
                gain = lengths[0] - other
                out += [gain.mean(), min(gain.max(), MOST_GAIN), np.maximum(gain - 1, 0).mean(), (gain >= SOME).mean(), math.log1p((gain >= MUCH).sum())]
        return out

    def score(self, text: str, compressors: list[zstandard.ZstdCompressor]) -> float:
        z = self.bias
        if self.weights:
            z += float(np.dot(self.weights, self.features(text, compressors)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(toxic: list[str], ordinary: list[str], base_texts: int = 800) -> Classifier:
    """Two thirds of the rows train the dictionaries, the others calibrate them."""
    model = Classifier()
    if not toxic or not ordinary:
        share = len(toxic) / max(1, len(toxic) + len(ordinary))
        model.bias = 60.0 if share else -60.0
        return model
    learn_t, learn_o = toxic[: max(1, len(toxic) * 2 // 3)], ordinary[: max(1, len(ordinary) * 2 // 3)]
    base = _dictionary(ORDINARY_BYTES, [w for t in learn_o[:base_texts] for w in windows(t, WINDOWS[-1])])
    samples = toxic_samples(learn_t, learn_o)
    model.dictionaries = [base, *[_dictionary(size, found) + base for (size, _, _), found in zip(TOXIC, samples)]]
    compressors = model.compressors()
    rest_t, rest_o = toxic[len(learn_t) :] or toxic, ordinary[len(learn_o) :] or ordinary
    y = np.array([1.0] * len(rest_t) + [0.0] * len(rest_o))
    x = np.array([model.features(t, compressors) for t in [*rest_t, *rest_o]], float)
    scale = x.std(axis=0) + 1e-9
    x = np.column_stack([x / scale, np.ones(len(x))])
    ridge = np.diag([0.5] * (x.shape[1] - 1) + [1e-3])
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge
        step = np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights, model.bias = (w[:-1] / scale).tolist(), float(w[-1])
    return model


def training_texts(documents: DataFrame, labels: DataFrame, label: int, most: int, per_text: int) -> list[str]:
    """At most `most` texts with a label, of documents not held out, by hashed id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (id_check("doc_id", FOLDS) != 0))
    chosen = known.groupBy("doc_id").agg(F.min("toxic").alias("least"), F.max("toxic").alias("most"))
    chosen = chosen.where((F.col("least") == label) & (F.col("most") == label)).select("doc_id")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # at most `most` ids
    rows = rows.select("doc_id", spread("text", per_text).alias("text"))
    return [r.text for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).collect()]


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_documents(documents: DataFrame, labels: DataFrame, toxic: int = 1000, ordinary: int = 2000, per_text: int = 4000, base_texts: int = 800) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    texts = [training_texts(documents, labels, label, most, per_text) for label, most in ((1, toxic), (0, ordinary))]
    model = fit(*texts, base_texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for rows in batches:
            scores = [model.score(text, compressors) for text in texts_of(rows)]
            yield batch({"doc_id": (rows.column(0), pa.int64()), "held_out": (rows.column(2), pa.bool_()), "score": (scores, pa.float64()), "predicted": ([int(s >= 0.5) for s in scores], pa.int32())})

    held = (id_check("doc_id", FOLDS) == 0).alias("held_out")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held).mapInArrow(run, SCHEMA)


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
