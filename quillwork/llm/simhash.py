"""SimHash near-dedup with bit-sliced comparison.

Fingerprints at most RADIUS bits apart are linked. Cutting 64 bits into five
parts, two fingerprints at most three bits apart agree on two parts at least,
so each pair of parts makes a table of buckets, and every link lies in a bucket
of one of the ten tables. Distinct fingerprints stand for all their documents.

Within buckets, fingerprints are stored vertically: plane p holds bit p of 64
fingerprints a word. The planes of two sets are XORed and added into carry-save
counters (ones, twos, and a sticky bit for four and more), 64 distances at a
time; words whose distances all exceed the radius are abandoned every eight
planes. Small buckets are compared together, each row with the rows d places
on; larger ones a tile of 64 rows against all later rows. A bucket gives the
spanning links of its components, not its pairs. A bucket above MOST rows is
dealt into parts that meet pairwise, so no task holds more than two parts.

Edge cases: null, empty and blank texts have fingerprint zero and are linked
with each other (and with anything within the radius); texts of fewer words
than a shingle are one shingle; repeated rows share a component; a null doc_id
never names a component unless all its documents have none; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.components import connected
from quillwork.llm.shared import batch, table, texts_of, unused, written

SHINGLE, SEED, RADIUS = 3, 42, 3
#: The parts of a fingerprint: (first bit, bits).
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Rows of a bucket that one group takes, rows compared together, and the largest bucket compared by shifting.
MOST, TOGETHER, SMALL = 8192, 200_000, 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `size` words, of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[a : a + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _bits_of(prints: np.ndarray) -> np.ndarray:
    """A row a fingerprint (one word or several), a column a bit."""
    return np.unpackbits(np.ascontiguousarray(prints, "<u8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")


def planes_of(prints: np.ndarray) -> np.ndarray:
    """The bit planes; bit i of a plane's words is that bit of fingerprint i. One word more than needed, zero."""
    bits = _bits_of(prints)
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    out = np.zeros((bits.shape[1], (len(prints) + 63) // 64 * 8 + 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def near(differ, valid: np.ndarray, planes: int = 64, radius: int = RADIUS) -> np.ndarray:
    """Which lanes of the words differ in at most `radius` planes.

    differ(p, at) gives the XOR of plane p for the words `at`; lanes not set in
    valid are out. The carry-save counters start at what lacks of a power of
    two, so that the carry out of the last one says that a lane is over.
    """
    at = np.flatnonzero(valid)
    over = ~valid[at]
    out = np.zeros(len(valid), np.uint64)
    places = radius.bit_length()
    begin = (1 << places) - 1 - radius
    counters = [np.full(len(at), FULL if begin >> c & 1 else 0, np.uint64) for c in range(places)]
    for start in range(0, planes, 8):
        for p in range(start, start + 8, 2):
            x, y = differ(p, at), differ(p + 1, at)
            u = counters[0] ^ x
            carry = (counters[0] & x) | (u & y)
            counters[0] = u ^ y
            for c in range(1, places):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over |= carry
        alive = over != FULL
        if not alive.all():
            if not alive.any():
                return out
            at, over, counters = at[alive], over[alive], [c[alive] for c in counters]
    out[at] = ~over
    return out


def _lanes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lane) of every set bit."""
    at = np.flatnonzero(words)
    bits = np.unpackbits(words[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    return at[row], lane


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the components of linked rows; every label stays its component's smallest row."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels[:] = further


def _words(mask: np.ndarray, words: int) -> np.ndarray:
    packed = np.zeros(words * 8, np.uint8)
    bits = np.packbits(mask, bitorder="little")
    packed[: len(bits)] = bits
    return packed.view("<u8")


def small_hits(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within groups of at most SMALL consecutive rows, all groups together."""
    planes = planes_of(prints)
    words = planes.shape[1] - 1
    for d in range(1, SMALL):
        same = group[:-d] == group[d:]
        if len(same) == 0 or not same.any():
            return
        r, l = np.uint64(d), np.uint64(64 - d)
        hit = near(lambda p, at: planes[p, at] ^ ((planes[p, at] >> r) | (planes[p, at + 1] << l)), _words(same, words), len(planes), radius)
        word, lane = _lanes(hit)
        yield word * 64 + lane, word * 64 + lane + d


def large_hits(prints: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within one group, a tile of 64 rows against all later ones."""
    planes, bits, n = planes_of(prints), _bits_of(prints).T, len(prints)
    words = planes.shape[1] - 1
    for tile in range(0, n, 64):
        rows = np.arange(tile, min(n, tile + 64))
        since = tile // 64
        width = words - since
        later = np.repeat(_words(np.ones(n, bool), words)[None, since:], len(rows), axis=0)
        # of a row's own word, only the lanes after it
        later[:, 0] &= ~((np.uint64(2) << np.arange(len(rows), dtype=np.uint64)) - np.uint64(1))
        masks = np.where(bits[:, rows], FULL, np.uint64(0))
        hit = near(lambda p, at: planes[p, since + at % width] ^ masks[p, at // width], later.ravel(), len(planes), radius)
        word, lane = _lanes(hit)
        yield tile + word // width, (since + word % width) * 64 + lane


def link_small(prints: np.ndarray, group: np.ndarray, labels: np.ndarray) -> None:
    """Links within small groups."""
    for a, b in small_hits(prints, group):
        unite(labels, a, b)


def link_large(prints: np.ndarray, labels: np.ndarray, first: int) -> None:
    """Links within one group; labels are those of all rows, the group's begin at `first`."""
    for a, b in large_hits(prints):
        unite(labels, first + a, first + b)


def spanning(prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group: (fingerprint, the first one of its component), where they differ."""
    labels = np.arange(len(prints))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    if small.any():
        rows = np.flatnonzero(small)
        own = np.arange(len(rows))
        link_small(prints[rows], group[rows], own)
        labels[rows] = rows[own]
    for a, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        link_large(prints[a : a + size], labels, a)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return prints[moved], prints[labels[moved]]


def fingerprints(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, print (the fingerprint's 64 bits as a signed long), text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = np.array([fingerprint(shingle_hashes(t, size)) for t in texts_of(rows)], np.uint64).view(np.int64)
            yield batch({"doc_id": (rows.column(0), pa.int64()), "print": (found, pa.int64()), "text_hash": (rows.column(2), pa.int64())})

    rows = documents.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text", "xxhash64(text) AS text_hash")
    return rows.mapInArrow(run, "doc_id long, print long, text_hash long")


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of the buckets of a partition sorted by (t, key, part)."""

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        t, key, part, prints = rows
        new = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        a, b = spanning(prints.view(np.uint64), np.cumsum(np.r_[0, new]))
        return batch({"a": (a.view(np.int64), pa.int64()), "b": (b.view(np.int64), pa.int64())})

    held: list[list[np.ndarray]] = []
    n = 0
    for rows in batches:
        held.append([np.asarray(c) for c in rows.columns])
        n += rows.num_rows
        if n >= TOGETHER:
            whole = [np.concatenate(c) for c in zip(*held)]
            t, key, part, _ = whole
            last = (t == t[-1]) & (key == key[-1]) & (part == part[-1])
            cut = int(np.argmax(last))  # the last bucket may go on in the next batch
            if cut:
                yield links([c[:cut] for c in whole])
            held, n = [[c[cut:] for c in whole]], len(t) - cut
    if n:
        yield links([np.concatenate(c) for c in zip(*held)])


def bucket_links(prints: DataFrame) -> DataFrame:
    """a, b: spanning links of every bucket of distinct fingerprints."""
    tables = list(combinations(PARTS, 2))
    masks = [sum(((1 << bits) - 1) << first for first, bits in pair) for pair in tables]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = prints.select("print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("t", "key"))
    counts = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rows = keyed.join(counts, ["t", "key"])
    spread = F.ceil(F.col("n") / MOST).cast("int")
    own = F.pmod(F.xxhash64("print"), F.col("s")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("s") - 1), lambda j: j != F.col("own"))
    pair = F.transform(others, lambda j: F.least(j, F.col("own")) * F.col("s") + F.greatest(j, F.col("own")))
    part = F.explode(F.when(F.col("s") > 1, pair).otherwise(F.array(F.lit(-1))))
    dealt = rows.withColumn("s", spread).withColumn("own", own).select("t", "key", part.alias("part"), "print")
    dealt = dealt.repartition("t", "key", "part").sortWithinPartitions("t", "key", "part")
    return dealt.select(F.col("t").cast("long"), "key", F.col("part").cast("long"), "print").mapInArrow(_bucket_links, "a long, b long")


def keeper() -> Column:
    """Orders the rows of a component: the smallest doc_id first, none last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")


def near_duplicates(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id of the component), text_hash, stays (it is the one row of its component)."""
    prints = written(fingerprints(documents, size), "simhash-prints")
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.min(keeper()).alias("keeper"))
    roots = connected(bucket_links(distinct.select("print")))
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "first", "keeper", F.coalesce("root", "print").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.min("keeper").alias("keeper"))
    component = rooted.select("print", "root").join(named, "root").select("print", "component_id", "keeper")
    text = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return prints.join(component, "print").select("doc_id", text.alias("fingerprint"), "component_id", "text_hash", (keeper() == F.col("keeper")).alias("stays"))


def keep_one(documents: DataFrame, find: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """The documents, one row of each component: that of the smallest doc_id, of several the smallest text hash.

    find gives doc_id, text_hash and stays of every row. Rows repeated in id and
    text are kept once; a row without an id stays only where no other of its
    component has one. So rows that share an id, or have none, are near copies
    like any others.
    """
    found = find(documents)
    doc, text = (unused(documents, name) for name in ("marked_id", "marked_text"))
    marked = written(found.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), "stays"), "simhash-marks")
    gone, kept = marked.where("NOT stays"), marked.where("stays")
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.xxhash64("text").eqNullSafe(F.col(text))
    rows = documents.join(gone.drop("stays"), same, "left_anti")
    if kept.count() == kept.distinct().count():
        return rows
    return rows.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).select(*documents.columns)


def op1_bitsliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("stays")
