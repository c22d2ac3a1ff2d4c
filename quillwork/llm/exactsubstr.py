"""Removal of repeated 400-byte strings by suffix arrays over content-dealt shards.

Strings are dealt so that equal ones meet. In every window of PASSAGE bytes the
place of the smallest K-byte hash is its anchor; equal windows have equal
anchors, and an anchor serves a run of consecutive windows. Anchors that occur
once can't lie in a repeated window. The runs of the others are cut into cells
of CELL windows by their distance from the anchor. All windows of a cell hold
the same CORE bytes; cells with equal anchors, places and cores form a class,
whose name is a 128-bit hash of these. Equal windows lie in one class.

Within a class, windows of LENGTH bytes that are equal also agree in the next
LENGTH - PASSAGE bytes; cells that do form a family. A cell's spelling is what
is left of the core and right of those bytes. If a family has one spelling, its
windows are repeated or not by count. Where spellings differ, they go, with the
family's number in place of what they share, to the suffix array of a shard
(induced sorting), whose permuted common prefixes tell which windows occur
twice. Equal spellings are one row before any task gathers a class, so what
many texts share costs as many rows as it has different surroundings; a class
of more than MOST spellings can't be one array, and its windows are counted,
each as a row.

What a family shares is compared by 128 and 64 bits of hash, the rest byte by
byte. The removed bytes follow from LENGTH alone. n_passage_bytes also shows
repeated passages that LENGTH doesn't reach: it counts the bytes in repeated
cores, of which every repeated string of PASSAGE bytes (less than some 50
words) holds one, and which are themselves repeated strings of CORE bytes.

Edge cases: null and empty texts have no bytes; texts below LENGTH bytes keep
all; equal texts of LENGTH bytes or more are removed whole, as every string of
theirs starts elsewhere too; overlapping repeats within one text count;
repeated rows are equal texts; a null doc_id stays null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.shared import batch, table, written
from quillwork.llm.suffixes import permuted_common_prefixes, suffix_array

LENGTH, PASSAGE, K, CELL = 400, 256, 32, 64
CORE = PASSAGE - CELL + 1
#: Bytes that UTF-8 never uses: digits of a class's number, and what ends a spelling.
DIGITS, END = bytes([0xC0, 0xC1, *range(0xF5, 0xFF)]), b"\xff"
PLACES = 5
#: Bytes that all windows of LENGTH bytes of a family share.
SHARED = CORE + LENGTH - PASSAGE
#: Symbols of one suffix array, and the spellings of a class that go to one.
SHARD, MOST = 1 << 20, 8192
#: Bytes whose anchors are sought at once; position bits of a hash.
PIECE, BITS = 1 << 19, 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes at every place."""
    x = _mix(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel())
    width = 8
    while width < K:
        x = _mix(x[:-width] * np.uint64(3) + x[width:])
        width *= 2
    return x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, windows) of each anchor, in order."""
    parts = []
    windows = len(text) - PASSAGE + 1
    span = PASSAGE - K + 1
    data = np.frombuffer(text, np.uint8)
    for start in range(0, windows, PIECE):
        count = min(PIECE, windows - start)
        x = _hashes(data[start : start + count + PASSAGE - 1])
        keyed = (x >> np.uint64(BITS) << np.uint64(BITS)) | np.arange(len(x), dtype=np.uint64)
        blocks = np.full(-(-len(x) // span) * span, ~np.uint64(0))
        blocks[: len(x)] = keyed
        blocks = blocks.reshape(-1, span)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[:count], before[span - 1 : span - 1 + count])
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        place = (least[first] & np.uint64((1 << BITS) - 1)).astype(np.int64)
        parts.append((x[place].view(np.int64), place + start, first + start, np.diff(np.r_[first, count])))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(p) for p in zip(*parts))


def _digits(number: int) -> bytes:
    out = bytearray()
    for _ in range(PLACES):
        number, digit = divmod(number, len(DIGITS))
        out.append(DIGITS[digit])
    return bytes(out)


class Shard:
    """Spellings that wait for one suffix array."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.marks: list[tuple[int, list]] = []  # (bytes left of the core, what to mark)
        self.size = self.families = 0

    def add(self, spellings: list[tuple[bytes, bytes, list]]) -> None:
        """One family: (bytes left of what it shares, bytes right of it, marks) of each spelling."""
        name = _digits(self.families)
        self.families += 1
        for left, right, marks in spellings:
            self.parts.append(left + name + right + END)
            self.marks.append((len(left), marks))
            self.size += len(self.parts[-1])

    def full(self) -> bool:
        return self.size >= SHARD or self.families >= len(DIGITS) ** PLACES - 1

    def resolve(self) -> None:
        """Adds to each spelling's marks the first and the last window that occurs twice, counted from the core."""
        if self.parts:
            data = np.frombuffer(b"".join(self.parts), np.uint8)
            used = np.unique(data)
            rank = np.zeros(256, np.uint8)
            rank[used] = np.arange(1, len(used) + 1)
            text = np.r_[rank[data], np.uint8(0)]
            order = suffix_array(text)
            window = LENGTH - SHARED + PLACES
            shared = permuted_common_prefixes(text, order, window) >= window
            twice = shared.copy()
            twice[order[:-1]] |= shared[order[1:]]  # also the predecessor of each
            start = 0
            for part, (left, marks) in zip(self.parts, self.marks):
                starts = min(left + 1, len(part) - window)
                hit = np.flatnonzero(twice[start : start + starts]) if starts > 0 else ()
                if len(hit):
                    marks[:] = int(hit[0]) - left, int(hit[-1]) - left
                start += len(part)
        self.__init__()


def mark_family(spellings: list[tuple[bytes, bytes, int, list]], shard: Shard) -> None:
    """Finds the repeated windows of one family's spellings: (left, right, count, marks)."""
    for left, right, count, marks in spellings:
        last = SHARED + len(right) - LENGTH
        if count > 1 and last >= -len(left):
            marks[:] = -len(left), min(0, last)
    if len(spellings) > 1:
        shard.add([(left, right, [] if count > 1 else marks) for left, right, count, marks in spellings])
        if shard.full():
            shard.resolve()


CELLS = "c1 long, c2 long, s1 long, s2 long, k1 long, k2 long, core long, family long, left binary, right binary"
MARKS = "c1 long, c2 long, s1 long, s2 long, first int, last int"
NAME = ["c1", "c2", "s1", "s2"]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each candidate anchor's run; a spelling that this task has sent before goes without its bytes.

    Cells that no window of LENGTH bytes fits into all have the spelling 0, 0.
    """
    sent: set[bytes] = set()
    previous = None
    keys: list[bytes] = []
    rows_out: list[tuple] = []
    nothing = bytes(16)

    def out() -> pa.RecordBatch:
        numbers = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 4)
        columns = {name: (pa.array(np.ascontiguousarray(numbers[:, i])), pa.int64()) for i, name in enumerate(NAME)}
        for name, kind, values in zip(("k1", "k2", "core", "family", "left", "right"), (pa.int64(),) * 4 + (pa.binary(),) * 2, zip(*rows_out)):
            columns[name] = (values, kind)
        keys.clear()
        rows_out.clear()
        return batch(columns)

    for rows in batches:
        for k1, k2, text, found in zip(*((x.as_py() for x in rows.column(i)) for i in range(4))):
            if (k1, k2) == previous:  # another row of the same text
                continue
            previous = (k1, k2)
            data = text.encode("utf-8", "surrogatepass")
            for c in found:
                anchor, place, first, last = c["anchor"], c["place"], c["first"], c["first"] + c["windows"] - 1
                for cell in range((place - last) // CELL, (place - first) // CELL + 1):
                    core = place - cell * CELL  # the cell's windows hold the CORE bytes from here
                    begin, end = max(first, core - CELL + 1), min(last, core)
                    key = xxhash.xxh3_128_digest(data[core : core + CORE], (anchor * 0x9E3779B1 + cell) & 0xFFFFFFFFFFFFFFFF)
                    family = left = right = None
                    if begin + LENGTH <= len(data) and core + SHARED <= len(data):
                        family = xxhash.xxh3_64_intdigest(data[core + CORE : core + SHARED]) - (1 << 63)
                        left, right = data[begin:core], data[core + SHARED : end + LENGTH]
                        key += xxhash.xxh3_128_digest(left + END + right, family & 0xFFFFFFFFFFFFFFFF)
                    else:
                        key += nothing
                    if key in sent:
                        left = right = None
                    else:
                        if len(sent) >= 300_000:
                            sent.clear()
                        sent.add(key)
                    keys.append(key)
                    rows_out.append((k1, k2, core, family, left, right))
                if len(rows_out) >= 20_000:
                    yield out()
        if rows_out:
            yield out()


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of the spellings of a partition sorted by class: a row for each spelling of a class that occurs twice."""
    shard = Shard()
    waiting: list[tuple] = []
    own: list[tuple] = []
    name = None

    def results() -> Iterator[pa.RecordBatch]:
        shard.resolve()
        out = [(*key, *(marks or (None, None))) for key, marks in waiting]
        waiting.clear()
        if out:
            kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2
            yield batch({n: (c, t) for n, t, c in zip((*NAME, "first", "last"), kinds, zip(*out))})

    def close() -> None:
        if len(own) > 1 or own and own[0][4] > 1:
            families: dict[int, list] = {}
            for row in own:
                marks: list[int] = []
                waiting.append((row[:4], marks))
                if row[5] is not None:
                    families.setdefault(row[5], []).append((row[6], row[7], row[4], marks))
            for spellings in families.values():
                mark_family(spellings, shard)
        own.clear()

    for rows in (x for x in batches if x.num_rows):
        # classes of one row that occurs once, by far the most, are left out; those at an edge may go on
        c1, c2, n = (np.asarray(rows.column(i)) for i in (0, 1, 4))
        same = (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1])
        stay = np.r_[True, same] | np.r_[same, True] | (n > 1)
        rows = rows.filter(pa.array(stay))
        for row in zip(*(rows.column(i).to_pylist() for i in range(8))):
            if row[:2] != name:
                close()
                name = row[:2]
                if len(waiting) >= 50_000:
                    yield from results()
            own.append(row)
    close()
    yield from results()


def counted_windows(spellings: DataFrame) -> DataFrame:
    """The marks of the spellings of large classes: every window is a row, equal ones are counted."""
    longest, around = F.length("left"), F.lit(LENGTH - SHARED)
    least = F.greatest(F.lit(0), around - F.length("right"))

    def window(a: Column) -> Column:
        parts = F.substring("left", longest - a + 1, a), F.substring("right", F.lit(1), around - a)
        return F.struct(*[F.xxhash64(F.lit(seed), "c1", "c2", "family", a, *parts).alias(f"w{seed}") for seed in (1, 2)], (-a).alias("at"))

    windows = F.when(least <= longest, F.transform(F.sequence(least, longest), window)).otherwise(F.array())
    each = spellings.select(*NAME, "n", F.explode(windows).alias("w")).select(*NAME, "n", "w.*")
    twice = each.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2")
    marks = each.join(twice, ["w1", "w2"]).groupBy(*NAME).agg(F.min("at").cast("int").alias("first"), F.max("at").cast("int").alias("last"))
    return spellings.select(*NAME).join(marks, NAME, "left")


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies each text's removed stretches."""
    for rows in batches:
        out = []
        for doc, text, found, copies in zip(*((x.as_py() for x in rows.column(i)) for i in range(4))):
            data = (text or "").encode("utf-8", "surrogatepass")
            if (copies or 1) > 1 and len(data) >= CORE:
                passages = [(0, len(data))]
            else:
                passages = _merged([(x["core"], x["core"] + CORE) for x in found or ()])
            if (copies or 1) > 1 and len(data) >= LENGTH:
                stretches = [(0, len(data))]
            else:
                stretches = _merged([(x["core"] + x["first"], x["core"] + x["last"] + LENGTH) for x in found or () if x["first"] is not None])
            kept, at = hashlib.sha256(), 0
            for a, b in stretches:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out.append((doc, len(data), sum(b - a for a, b in stretches), len(stretches), kept.hexdigest(), sum(b - a for a, b in passages)))
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")
        kinds = (pa.int64(),) * 4 + (pa.string(), pa.int64())
        yield batch({n: (list(c), t) for n, t, c in zip(names, kinds, zip(*out) if out else ((),) * 6)})


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two longs that name a text: its XXH64, and its CRC-32 with its length."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    return F.xxhash64(data), F.crc32(data) * F.lit(1 << 31) + F.octet_length(data)


def repeated_bytes(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes of every document.

    Texts are shuffled once, by key: cutting the cells and applying the results
    read the same exchange. What meets texts or anchors in a join is a written
    table, so that Spark can split the rows of a hot key.
    """
    k1, k2 = text_keys(F.col("text"))
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", k1.alias("k1"), k2.alias("k2"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [anchors((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in rows.column(2)]
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int64() if i == 0 else pa.int32())) for i in range(4)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], names=["k1", "k2", "anchor", "place", "first", "windows"])

    per_text = keyed.select("k1", "k2", "text").mapInArrow(find, "k1 long, k2 long, anchor array<long>, place array<int>, first array<int>, windows array<int>")
    per_text = written(per_text, "repeat-anchors")
    copies = per_text.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    once = per_text.where(F.size("anchor") > 0).groupBy("k1", "k2").agg(F.first(F.struct("anchor", "place", "first", "windows")).alias("a"))
    single = once.select("k1", "k2", F.explode(F.arrays_zip("a.anchor", "a.place", "a.first", "a.windows")).alias("a")).select("k1", "k2", "a.*")
    often = written(single.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeat-often")
    runs = single.join(often, "anchor").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "place", "first", "windows")).alias("found"))
    runs = written(runs, "repeat-runs")

    # doc_id goes along unused: with the same columns both joins read one exchange
    cells = keyed.join(runs, ["k1", "k2"]).select("k1", "k2", "text", "found", "doc_id").mapInArrow(_cells, CELLS)
    cells = written(cells, "repeat-cells")
    spellings = cells.groupBy(*NAME).agg(F.count("*").alias("n"), F.max("family").alias("family"), F.max("left").alias("left"), F.max("right").alias("right"))
    spellings = written(spellings, "repeat-spellings")
    large = written(spellings.groupBy("c1", "c2").agg(F.count("*").alias("m")).where(F.col("m") > MOST).select("c1", "c2"), "repeat-large")
    arrays = spellings.join(large, ["c1", "c2"], "left_anti").repartition("c1", "c2").sortWithinPartitions("c1", "c2")
    marks = arrays.mapInArrow(_repeats, MARKS).unionByName(counted_windows(spellings.join(large, ["c1", "c2"], "left_semi")))
    stretches = cells.select(*NAME, "k1", "k2", "core").join(written(marks, "repeat-marks"), NAME)
    stretches = stretches.groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "first", "last")).alias("found"))
    known = written(stretches.join(copies, ["k1", "k2"], "full"), "repeat-known")
    whole = keyed.join(known, ["k1", "k2"], "left")
    return whole.select("doc_id", "text", "found", "copies").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))
