"""Document quality by a linear-chain conditional random field over lines.

A document is the chain of its lines. Each line is described by numbers (length,
shares of capitals, digits, symbols and short words, repetition) put into
buckets whose edges are quantiles over the training lines. The score of "good" is
the sum of learned weights of the line's own buckets and of those of the lines
before and behind it; labels of neighbours have transition weights. Forward-
backward sums give each line's probability of being good, and their mean,
weighted by the lines' bytes, is the document's share of good text. A logistic
curve, fitted on the same rows, makes that share the score.

Labels are known for documents only. Training begins with every line labelled
as its document, then takes lines of bad documents that the field finds good,
where they are the smaller part of the text, as good, and fits again. It reads at most
`good` and `bad` labelled rows that are not held out (the documented bound of
the fit), each over its whole text; what is gathered of them are the lines'
numbers, computed where the texts are. Scoring reads whole texts.

Edge cases: a null text is empty; an empty text is one empty line; a null
doc_id is held out or not as the text ''; null labels and ids with
contradicting labels are not learned from; without a label of either kind every
score is the share of good labels (1.0 without any); repeated rows stay; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.shared import batch, id_check, slices, table, texts_of

FOLDS, HELD_OUT = 4, 2
BUCKETS, ROUNDS, STEPS, RIDGE = 16, 3, 100, 0.1
#: Training cuts chains at so many lines; scoring never does.
CHAIN = 64
THRESHOLD = 0.7

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = b"0123456789"
POINT = b".,;:'\"()-"
MARK = bytes(c for c in range(33, 127) if c not in UPPER + LOWER + DIGIT + POINT)
HIGH = bytes(range(128, 256))
NUMBERS = 15


def line_numbers(text: str) -> np.ndarray:
    """A row of numbers a line; the last column is the line's bytes and one."""
    seen: set[bytes] = set()
    out = []
    for line in text.encode("utf-8", "replace").split(b"\n"):
        words = line.split()
        n, size, w = len(words), len(line), max(1, len(words))
        s = max(1, size)
        upper, lower, digit, mark, high = (size - len(line.translate(None, c)) for c in (UPPER, LOWER, DIGIT, MARK, HIGH))
        point = size - len(line.translate(None, POINT))
        again = line in seen
        seen.add(line)
        out.append((
            math.log1p(size), math.log1p(n), upper / max(1, upper + lower), mark / s, digit / s, point / w, high / s,
            sum(map(len, words)) / w, sum(len(x) < 4 for x in words) / w, len(set(words)) / w, sum(map(eq, words, words[1:])) / w,
            (line.count(b"!") + line.count(b"?")) / w, float(line[-1:] in (b".", b"!", b"?")), float(again), size + 1.0,
        ))
    return np.array(out, np.float32)


@dataclass
class Chains:
    """Lines of several chains one behind the other, walked in steps over all chains at once."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        starts = np.cumsum(self.lengths) - self.lengths
        self.order = np.argsort(-self.lengths, kind="stable")
        self.starts = starts[self.order]
        ranked = self.lengths[self.order]
        self.active = np.searchsorted(-ranked, -np.arange(ranked[0] if len(ranked) else 0), side="left").tolist()
        self.first = np.zeros(int(self.lengths.sum()), bool)
        self.first[starts] = True

    def marginals(self, good: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and the expected counts of the label pairs (bad, good) x (bad, good)."""
        n = len(good)
        shift = np.maximum(good, 0)
        emit = np.exp(np.column_stack([-shift, good - shift]))
        a = np.exp(moves)
        ahead, behind = np.empty((n, 2)), np.ones((n, 2))
        now = np.full((len(self.starts), 2), 0.5)
        for t, k in enumerate(self.active):
            at = self.starts[:k] + t
            now = (now[:k] @ a if t else now[:k]) * emit[at]
            now /= now.sum(1, keepdims=True)
            ahead[at] = now
        pairs = np.zeros((2, 2))
        for t in range(len(self.active) - 2, -1, -1):
            at = self.starts[: self.active[t + 1]] + t
            rest = emit[at + 1] * behind[at + 1]
            back = rest @ a.T
            behind[at] = back / back.sum(1, keepdims=True)
            both = ahead[at][:, :, None] * a * rest[:, None, :]
            pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        p = ahead * behind
        return p[:, 1] / p.sum(1), pairs


@dataclass
class Field:
    """Bucket edges, weights [offset][number][bucket] of "good", transition weights, and the curve of the score."""

    edges: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 0.0
    bias: float = 0.0

    def cells(self, numbers: np.ndarray, chains: Chains) -> np.ndarray:
        """Which weights each line takes: its own, those of the line before, those of the line behind."""
        own = np.column_stack([np.searchsorted(e, numbers[:, k], side="right") for k, e in enumerate(self.edges)]) + np.arange(len(self.edges)) * (BUCKETS + 1)
        width = len(self.edges) * (BUCKETS + 1)
        none = np.full(len(self.edges), 3 * width)  # beyond an end of the chain
        before, behind = np.roll(own, 1, axis=0) + width, np.roll(own, -1, axis=0) + 2 * width
        before[chains.first] = none
        behind[np.roll(chains.first, -1)] = none + 1
        return np.hstack([own, before, behind])

    def share(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The good share of each document's bytes."""
        chains = Chains(lengths)
        good = self.weights[self.cells(numbers, chains)].sum(1)
        p, _ = chains.marginals(np.clip(good, -40, 40), self.moves)
        size, starts = numbers[:, -1].astype(float), np.cumsum(lengths) - lengths
        return np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts)

    def scores(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(lengths), self.bias)
        return 1 / (1 + np.exp(-(self.slope * self.share(numbers, lengths) + self.bias)))


def _fit_lines(model: Field, cells: np.ndarray, chains: Chains, y: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Gradient steps on the likelihood of the lines' labels; gives P(good) of each line."""
    here = np.flatnonzero(~chains.first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[here - 1].astype(int), y[here].astype(int)), 1.0)
    flat = cells.ravel()
    n, m = len(y), np.zeros(len(model.weights) + 4)
    v = np.zeros_like(m)
    for step in range(1, STEPS + 1):  # Adam
        p, pairs = chains.marginals(np.clip(model.weights[cells].sum(1), -40, 40), model.moves)
        g = np.bincount(flat, np.repeat((y - p) * trust, cells.shape[1]), len(model.weights)) - RIDGE * model.weights
        g = np.concatenate([g, (seen - pairs - RIDGE * model.moves).ravel()]) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model.weights = model.weights + move[:-4]
        model.moves = model.moves + move[-4:].reshape(2, 2)
    return chains.marginals(np.clip(model.weights[cells].sum(1), -40, 40), model.moves)[0]


def _edges(values: np.ndarray) -> np.ndarray:
    """At most BUCKETS edges: half are quantiles of the values, half of the different values, so rare ones count too."""
    at = np.arange(1, BUCKETS // 2 + 1) / (BUCKETS // 2 + 1)
    return np.unique(np.concatenate([np.quantile(values, at), np.quantile(np.unique(values), at)]))


def fit(rows: list[tuple[np.ndarray, int]]) -> Field:
    """rows: the numbers of a document's lines, and its label."""
    model = Field()
    labels = np.array([label for _, label in rows], float)
    if not len(rows) or labels.min() == labels.max():
        model.bias = float(labels.mean()) if len(rows) else 1.0
        return model
    numbers, lengths = np.vstack([x for x, _ in rows]), np.array([len(x) for x, _ in rows])
    cuts = [min(CHAIN, n - a) for n in lengths.tolist() for a in range(0, n, CHAIN)]
    model.edges = [_edges(numbers[:, k]) for k in range(NUMBERS - 1)]
    chains = Chains(np.array(cuts))
    model.weights = np.zeros(3 * len(model.edges) * (BUCKETS + 1) + 2)
    cells = model.cells(numbers, chains)
    doc = np.repeat(np.arange(len(rows)), lengths)
    y = labels[doc].copy()
    trust = np.where(y == 1, 1.0, max(1.0, (y == 1).sum() / max(1, (y == 0).sum())))  # both labels weigh the same
    size = numbers[:, -1].astype(float)
    for _ in range(ROUNDS):
        p = _fit_lines(model, cells, chains, y, trust)
        good_part = np.bincount(doc, size * (p > 0.5)) / np.bincount(doc, size)
        y = np.where((labels[doc] == 0) & (p > 0.5) & (good_part[doc] < 0.5), 1.0, labels[doc])
    share = model.share(numbers, lengths)
    x, w = np.column_stack([share, np.ones(len(share))]), np.zeros(2)
    for _ in range(50):  # Newton's method
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (q * (1 - q) + 1e-9)[:, None]) + 1e-2 * np.eye(2)
        w += np.linalg.solve(h, x.T @ (labels - q) - 1e-2 * w)
    model.slope, model.bias = float(w[0]), float(w[1])
    return model


def training_rows(documents: DataFrame, labels: DataFrame, good: int, bad: int) -> list[tuple[np.ndarray, int]]:
    """The lines' numbers of at most so many labelled rows that are not held out, by hashed id."""
    known = labels.where(F.col("quality").isin(0, 1) & (id_check("doc_id", FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other").select("doc_id", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            found = [line_numbers(text).tobytes() for text in texts_of(rows)]
            yield rows.drop_columns(["text"]).append_column("numbers", pa.array(found, pa.binary()))

    out = []
    for label, most in ((1, good), (0, bad)):
        ids = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")
        rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most `most` ids
        rows = rows.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("t"), "text")
        numbers = rows.mapInArrow(run, "h long, id string, t long, numbers binary")  # texts stay where they are
        out += [(np.frombuffer(r.numbers, np.float32).reshape(-1, NUMBERS), label) for r in numbers.orderBy("h", "id", "t").limit(most).collect()]
    return out


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_quality(documents: DataFrame, labels: DataFrame, good: int = 4000, bad: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(training_rows(documents, labels, good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            numbers = [line_numbers(text) for text in texts_of(rows)]
            scores = model.scores(np.vstack(numbers), np.array([len(x) for x in numbers]))
            yield batch({"doc_id": (rows.column(0), pa.int64()), "held_out": (rows.column(2), pa.bool_()), "score": (scores, pa.float64()), "predicted": ((scores >= THRESHOLD).astype(np.int32), pa.int32())})

    held = (id_check("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held).mapInArrow(run, SCHEMA)


def op12_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
