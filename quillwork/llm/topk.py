"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each block of candidates keeps one list a dimension, sorted by component. A
query reads every list from the end that favours it (the top for a positive
weight, the bottom for a negative one), the same depth in all lists at a time.
What was read gives a candidate's partial score; the list's frontier bounds
what was not read from above. Candidates whose upper bound lies below the k-th
score already certain are outsiders and are left; reading stops when few are
left, whose scores are then resolved. The k-th certain score comes from the
lower bounds of the candidates read whole before, so it tightens from block to
block. Many queries read a block together: "read at depth t" is a mask over
the block, and the partial sums of all queries are matrix products with it.

Scores are integers; sums of products are exact in doubles below 2**53, which
is checked for every block (larger ones are scored in Python integers, without
pruning; a score among the k best that no long holds is an error).

Edge cases: vectors that are null, empty or hold a null or non-finite
component take no part; vectors are compared only with those of the same
length; ties go to the smaller vec_id; identical vectors share one list entry;
repeated ids are separate candidates but never candidates of a query with
their own id; an empty table gives no rows; fewer candidates than k give all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwork.llm.shared import batch, table

#: Candidates and queries that meet in one task; both bound its memory.
CANDIDATES, QUERIES = 8192, 1024
#: Candidates that form one set of sorted lists, and the share of a list read at each step.
BLOCK, DEPTHS = 2048, (0.5, 0.65, 0.8)
#: Reading stops when at most this share of the pairs is undecided.
FEW = 0.05
SCHEMA = "query_id long, vec_id long, score long"


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id."""
    return np.lexsort((ids, -scores))[:k]


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows as int64."""
    return np.einsum("ij,ij->i", q, c)


def _largest(vectors: np.ndarray) -> int:
    """The largest magnitude of a component, as a Python integer."""
    return max(int(vectors.max()), -int(vectors.min()))


class Search:
    """The running top k of a block of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.up, self.down = np.maximum(vectors, 0).astype(float), np.minimum(vectors, 0).astype(float)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), sorted
        self.certain = np.full(len(ids), -np.inf)

    def read(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Reads one block's sorted lists."""
        n, d = vectors.shape
        if _largest(self.vectors) * _largest(vectors) * d >= 2**53:
            self._resolve_exactly(ids, vectors)
            return
        values = vectors.astype(float)
        order = np.argsort(values, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], (n, d)), axis=0)
        lists = np.take_along_axis(values, order, axis=0)
        active = np.arange(len(self.ids))
        left = np.ones((len(active), n), bool)
        if n > self.k and np.isfinite(self.certain).any():
            for share in DEPTHS:
                t = min(n - 1, int(share * n))
                top, low = rank >= n - t, rank < t  # read from the top, from the bottom
                high_edge, low_edge = lists[n - 1 - t], lists[t]
                upper = self.up @ np.where(top, values, high_edge).T + self.down @ np.where(low, values, low_edge).T
                left = upper >= self.certain[:, None]
                if left.mean() <= FEW:
                    break
        at_q, at_c = np.nonzero(left)
        step = max(1, 4_000_000 // d)
        for a in range(0, len(at_q), step):
            self._resolve(at_q[a : a + step], at_c[a : a + step], ids, vectors)

    def _resolve(self, at_q: np.ndarray, at_c: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = _exact(self.vectors[at_q], vectors[at_c])
        found = ids[at_c]
        keep = (self.ids[at_q] != found) & (scores >= self.certain[at_q])
        at_q, scores, found = at_q[keep], scores[keep], found[keep]
        order = np.lexsort((found, -scores, at_q))
        at_q, scores, found = at_q[order], scores[order], found[order]
        first = np.searchsorted(at_q, at_q)
        keep = np.arange(len(at_q)) - first < self.k
        for q, s, i in zip(at_q[keep].tolist(), scores[keep].tolist(), found[keep].tolist()):
            self.best[q].append((-s, i))
        for q in np.unique(at_q).tolist():
            self.best[q] = sorted(self.best[q])[: self.k]
            if len(self.best[q]) == self.k:
                self.certain[q] = -self.best[q][-1][0]

    def _resolve_exactly(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Scores a whole block in Python integers, where doubles and int64 could round or wrap."""
        names, rows = ids.tolist(), vectors.astype(object)
        for q, (own, vector) in enumerate(zip(self.ids.tolist(), self.vectors.astype(object))):
            found = [(-s, i) for s, i in zip((rows @ vector).tolist(), names) if i != own]
            self.best[q] = sorted(self.best[q] + found)[: self.k]
            if len(self.best[q]) == self.k:
                self.certain[q] = -self.best[q][-1][0]

    def result(self) -> pa.RecordBatch:
        rows = [(q, i, -s) for q, best in zip(self.ids.tolist(), self.best) for s, i in best]
        return batch({name: ([r[at] for r in rows], pa.int64()) for at, name in enumerate(("query_id", "vec_id", "score"))})


def _few_of_each(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of identical vectors, those with the k + 1 smallest ids: no other can be among a top k."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.ones(len(ids), bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    # rows of one id count once here, so those of k + 1 different ids stay
    fresh = np.ones(len(ids), bool)
    fresh[1:] = new[1:] | (ids[1:] != ids[:-1])
    nth = np.cumsum(fresh)
    keep = nth - nth[start] <= k
    return ids[keep], vectors[keep]


def _vectors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.combine_chunks()
    ids = rows.column("id").to_numpy()
    flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        empty = batch({n: ([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        if not queries.num_rows or not candidates.num_rows:
            return pa.Table.from_batches([empty])
        ids, vectors = _vectors(candidates)
        ids, vectors = _few_of_each(ids, vectors, k)
        mixed = np.argsort(np.bitwise_xor(ids * np.int64(2654435761) % np.int64(1 << 31), ids % 8191), kind="stable")
        ids, vectors = ids[mixed], vectors[mixed]
        search = Search(*_vectors(queries), k)
        start, size = 0, 256  # a small first block makes scores certain
        while start < len(ids):
            search.read(ids[start : start + size], vectors[start : start + size])
            start, size = start + size, BLOCK
        return pa.Table.from_batches([search.result()])

    return run


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """id, vector (array<long> of floor(scale * x)) of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return embeddings.where(usable).select(F.col("vec_id").alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v)).alias("vector"))


def top_inner_products(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query.

    Queries are the vectors whose id is divisible by `every`. Queries and
    candidates are dealt to blocks by hash; each pair of blocks is one group,
    so a task holds QUERIES + CANDIDATES vectors at any size of the table.
    """
    vectors = integer_vectors(embeddings, scale).withColumn("dim", F.size("vector"))
    queries = vectors.where(F.col("id") % every == 0)
    n, m = vectors.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    parts, groups = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    spread = F.xxhash64(F.col("id"), F.lit(4))
    left = queries.select("dim", F.pmod(spread, F.lit(groups)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("cb"), "id", "vector")
    right = vectors.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("qb"), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("cb"), "id", "vector")
    keys = ["dim", "qb", "cb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.vector) + 1), lambda i: q.vector[i] * c.vector[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vector) = len(c.vector)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
