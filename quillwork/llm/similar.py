"""Near copies: SimHash of five-word shingles, compared in bit planes, verified by exact similarity.

A document's node is its set of five-word shingles. A node's fingerprint has
BITS bits, each 1 if set in over half of its shingles' hashes. For sets of
similarity 0.8 a bit differs with probability 0.15, so their distance is 39 of
256 on average and RADIUS lies three standard deviations above (one pair in
900 of exactly 0.8 lies beyond it); for unrelated sets it is 128, nine
deviations above the radius.

Candidates: ORDERS orders of the bits are cut into parts of PART bits; each part
is a table of buckets (63 in all), and a pair of similarity 0.8 shares no
bucket in one of 12,000 cases. In a bucket the planes of all fingerprints are
compared with carry-save counters, as in `simhash`. First each node names the
nearest neighbour within the radius that comes before it in the bucket's order,
which spans what the bucket links; these links are verified on the whole shingle
sets and joined to components. Then every pair within the radius that these
components don't join is tried too, if sketches of SKETCH bits of both (which
only nodes with neighbours get) are at most FAR apart, 3.5 standard deviations
above what 0.8 gives. So the members of a large group cost a link a node and
bucket, and only pairs near 0.8 that nothing else joins cost one each. Only
pairs of a Jaccard similarity of LEAST or more are linked. A bucket above MOST
nodes is dealt into parts that meet pairwise.

Edge cases: null, empty and blank texts are one node; texts of fewer words than
a shingle are one shingle; a null doc_id names a component only where no other
document is in it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.components import connected
from quillwork.llm.shared import batch, texts_of, unused, written
from quillwork.llm.simhash import SMALL, keeper, large_hits, shingle_hashes, small_hits

SHINGLE, LEAST = 5, 0.8
BITS, PART, ORDERS, RADIUS = 256, 12, 3, 56
SKETCH, FAR = 1024, 195
#: Nodes of a bucket that one group takes, rows compared together, and pairs whose bits are unfolded together.
MOST, TOGETHER, STEP = 4096, 50_000, 20_000
_RANDOM = np.random.default_rng(42)
_MIX = _RANDOM.integers(0, 1 << 64, SKETCH // 64, np.uint64) | np.uint64(1)
#: The bits of each table's part.
PARTS = np.concatenate([_RANDOM.permutation(BITS)[: BITS // PART * PART].reshape(-1, PART) for _ in range(ORDERS)])


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def fingerprint(shingles: np.ndarray, size: int = BITS) -> np.ndarray:
    """`size` bits as 0 or 1, each 1 if set in over half of the shingles' hashes; a longer one begins with the shorter."""
    counts = np.zeros(size, np.int64)
    for a in range(0, len(shingles), 4096):
        x = shingles[a : a + 4096, None] * _MIX[: size // 64]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (counts * 2 > len(shingles)).astype(np.uint8)


def keys_of(bits: np.ndarray) -> np.ndarray:
    """The bucket of a fingerprint in each table; no two tables share one."""
    return bits[PARTS] @ (1 << np.arange(PART)) + (np.arange(len(PARTS)) << PART)


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether the Jaccard similarity of two sorted sets is `least` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (len(both) - common)


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (a hash of the shingle set), print, keys (none of an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            nodes, prints, keys = [], [], []
            for text in texts_of(rows):
                shingles = shingle_set(text)
                bits = fingerprint(shingles)
                nodes.append(_node(shingles) - (1 << 63))
                prints.append(np.packbits(bits, bitorder="little").tobytes())
                keys.append(keys_of(bits) if len(shingles) else [])
            yield batch({"doc_id": (rows.column(0), pa.int64()), "text_hash": (rows.column(2), pa.int64()), "node": (nodes, pa.int64()), "print": (prints, pa.binary()), "keys": (keys, pa.list_(pa.int64()))})

    rows = documents.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text", "xxhash64(text) AS text_hash")
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, print binary, keys array<long>")


def bucket_pairs(prints: np.ndarray, bucket: np.ndarray, labels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the radius, for rows sorted by bucket.

    Without labels each row's nearest earlier neighbour, or its nearest later
    one if it has none and no other row names it. With labels, where prints are
    sketches, every neighbour of another label whose sketch is near, in the
    first table that the two share.
    """
    n, short = len(prints), prints[:, : BITS // 64]
    nothing, row = np.iinfo(np.int64).max, (1 << 40) - 1
    before, after = np.full(n, nothing), np.full(n, nothing)  # distance, then row
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def take(a: np.ndarray, b: np.ndarray) -> None:
        if labels is not None:
            apart = labels[a] != labels[b]
            a, b = a[apart], b[apart]
        for k in range(0, len(a), STEP):
            x, y = a[k : k + STEP], b[k : k + STEP]
            if labels is None:
                far = np.bitwise_count(short[x] ^ short[y]).sum(axis=1, dtype=np.int64) << 40
                np.minimum.at(before, y, far | x)
                np.minimum.at(after, x, far | y)
                continue
            close = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1) <= FAR
            x, y = x[close], y[close]
            differ = np.unpackbits((short[x] ^ short[y]).view(np.uint8), axis=1, bitorder="little")
            first = np.argmin(differ[:, PARTS].any(axis=2), axis=1) == bucket[x] >> 24 + PART
            found.append((x[first], y[first]))

    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    rows = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    if len(rows):
        for a, b in small_hits(short[rows], bucket[rows], RADIUS):
            take(rows[a], rows[b])
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        for a, b in large_hits(short[start : start + size], RADIUS):
            take(start + a, start + b)
    if labels is None:
        b = np.flatnonzero(before < nothing)
        named = before < nothing
        named[before[b] & row] = True
        a = np.flatnonzero(~named & (after < nothing))
        return np.r_[before[b] & row, a], np.r_[b, after[a] & row]
    return tuple(np.concatenate([p[i] for p in found] or [np.zeros(0, np.int64)]) for i in (0, 1))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes of the buckets of a partition sorted by bucket and part: bucket, node, print and maybe root."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        bucket, node = (rows.column(i).to_numpy() for i in (0, 1))
        prints = np.frombuffer(b"".join(rows.column(2).to_pylist()), "<u8").reshape(len(node), -1)
        a, b = bucket_pairs(prints, bucket, rows.column(3).to_numpy() if rows.num_columns > 3 else None)
        a, b = node[a], node[b]
        once = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
        return batch({"a": (once[:, 0], pa.int64()), "b": (once[:, 1], pa.int64())})

    held: list[pa.RecordBatch] = []
    n = 0
    for rows in batches:
        held.append(rows)
        n += rows.num_rows
        if n >= TOGETHER:
            whole = pa.Table.from_batches(held)
            bucket = whole.column(0).to_numpy()
            cut = int(np.argmax(bucket == bucket[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield pairs(whole.slice(0, cut))
            held, n = whole.slice(cut).to_batches(), len(bucket) - cut
    if n:
        yield pairs(pa.Table.from_batches(held))


def candidates(nodes: DataFrame) -> DataFrame:
    """a, b: distinct pairs of nodes (node, print, keys and maybe root) that meet in a bucket within the radius.

    keys names each table's bucket. Rows of a large bucket are dealt to its
    pairs of parts, which are buckets of their own.
    """
    more = ["root"] if "root" in nodes.columns else []
    keyed = nodes.select("node", "print", *more, F.explode("keys").alias("key"))
    large = nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.ceil(F.count("*") / MOST).cast("int").alias("s")).where("s > 1")
    rows = keyed.join(written(large, "similar-large"), "key", "left")
    own = F.pmod(F.xxhash64("node"), F.col("s")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("s") - 1), lambda j: j != F.col("own"))
    pair = F.transform(others, lambda j: F.least(j, F.col("own")) * F.col("s") + F.greatest(j, F.col("own")) + 1)
    part = F.explode(F.when(F.col("s") > 1, pair).otherwise(F.array(F.lit(0))))
    dealt = rows.withColumn("own", own).select("key", part.alias("part"), "node", "print", *more)
    dealt = dealt.select((F.col("key") * F.lit(1 << 24) + F.col("part")).alias("bucket"), "node", "print", *more)
    return dealt.repartition("bucket").sortWithinPartitions("bucket", F.xxhash64("node", "bucket")).mapInArrow(_pairs, "a long, b long").distinct()


def shingle_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles (the sorted set as bytes) of the wanted nodes: node, doc_id, text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sets = [shingle_set(t).tobytes() for t in texts_of(rows)]
            yield batch({"node": (rows.column(0), pa.int64()), "shingles": (sets, pa.binary())})

    doc, text, node = (unused(documents, name) for name in ("wanted_id", "wanted_text", "wanted_node"))
    ids = wanted.select(F.col("node").alias(node), F.col("doc_id").alias(doc), F.col("text_hash").alias(text))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & F.xxhash64("text").eqNullSafe(F.col(text))
    return documents.join(ids, same).select(node, "text").mapInArrow(run, "node long, shingles binary")


def sketches(sets: DataFrame) -> DataFrame:
    """node, sketch of every node of `shingle_sets`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            bits = [fingerprint(np.frombuffer(s.as_buffer(), np.uint64), SKETCH) for s in rows.column(1)]
            yield batch({"node": (rows.column(0), pa.int64()), "sketch": ([np.packbits(b, bitorder="little").tobytes() for b in bits], pa.binary())})

    return sets.mapInArrow(run, "node long, sketch binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x, y = (rows.column(i) for i in (2, 3))
            hit = pa.array([similar(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(x, y)], pa.bool_())
            yield rows.select([0, 1]).filter(hit)

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_copies(documents: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of the component), text_hash, stays (it is the one row of its component)."""
    prints = written(signatures(documents), "similar-prints")
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("first"), one, F.any_value("print").alias("print"), F.any_value("keys").alias("keys"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = prints.select("node", "doc_id", "text_hash").join(named, "node", "left_semi").groupBy("node").agg(one).select("node", "one.*")
        return written(shingle_sets(documents, wanted), "similar-sets")

    pairs = written(candidates(nodes), "similar-pairs")
    sets = sets_of(pairs)  # of all nodes that have neighbours
    joined = written(connected(verified(pairs, sets)), "similar-joined")
    near = nodes.select("node", "keys").join(sketches(sets), "node").join(joined, "node", "left")
    near = written(near.select("node", F.col("sketch").alias("print"), "keys", F.coalesce("root", "node").alias("root")), "similar-near")
    rest = verified(written(candidates(near), "similar-rest"), sets)
    roots = connected(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(rest))
    rooted = prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(keeper()).alias("keeper")).join(roots, "node", "left").select("node", "first", "keeper", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.min("keeper").alias("keeper"))
    component = rooted.select("node", "root").join(named, "root").select("node", "component_id", "keeper")
    return prints.join(component, "node").select("doc_id", "component_id", "text_hash", (keeper() == F.col("keeper")).alias("stays"))
