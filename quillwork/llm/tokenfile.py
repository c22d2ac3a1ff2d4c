"""Token ids in bit-packed segments with block offsets.

A segment holds the ids of consecutive documents, each id in the fewest bits
that the vocabulary needs, least significant bit first:

    magic 'QWT1', width u32, block u32, reserved u32, n u64, blocks u64,
    blocks x u64 byte offsets, packed ids

Every block but the last holds `block` ids and begins on a byte, so any slice
is read by unpacking only the blocks that it touches, each as one numpy
operation. Segments are the `payload` of a Parquet table in the shared folder
(Spark's writer and committer, so a lost executor leaves no half file); beside
each are its documents' ids and lengths, the index for random access.

Edge cases: a null or empty text holds just the end id; texts of any length are
encoded whole; rows with the same doc_id follow each other in the order of a
hash of their ids; a null doc_id comes first; an empty table gives an empty
file set; other columns pass by. The folder of segments and the encoded ids
that it is made from stay until their owner, the caller, removes them.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwork.llm.pretokens import BatchEncoder, byte_strings, mapped
from quillwork.llm.shared import batch, shared_folder, slices, table, written

MAGIC, HEAD = b"QWT1", struct.Struct("<4sIIIQQ")
#: Ids a block, and the ids at which a segment is closed.
BLOCK, SEGMENT = 4096, 1 << 20
END = 2


def width_of(vocabulary: int) -> int:
    """The bits that hold any id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def _pack_block(ids: np.ndarray, width: int) -> bytes:
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids[:, None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack_block(data: bytes, n: int, width: int) -> np.ndarray:
    if width == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def pack(ids: np.ndarray, width: int, block: int = BLOCK) -> bytes:
    """A segment of ids."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError("an id needs more bits than the vocabulary has")
    parts = [_pack_block(ids[a : a + block], width) for a in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, parts)])[:-1] if parts else np.zeros(0)
    return HEAD.pack(MAGIC, width, block, 0, len(ids), len(parts)) + offsets.astype("<u8").tobytes() + b"".join(parts)


def unpack(segment: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from start to stop of a segment, reading only their blocks."""
    magic, width, block, _, n, blocks = HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    offsets = np.frombuffer(segment, "<u8", blocks, HEAD.size)
    data = HEAD.size + 8 * blocks
    first, last = start // block, (stop - 1) // block
    ends = [*offsets[1:].tolist(), len(segment) - data]
    parts = [_unpack_block(segment[data + int(offsets[b]) : data + ends[b]], min(block, n - b * block), width) for b in range(first, last + 1)]
    return np.concatenate(parts)[start - first * block : stop - first * block]


class Encoder:
    """The tokenizers library, with the ids of pieces between spaces remembered."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.split = self.library.model, regex.compile(pattern).findall
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.parts: dict[str, list[int]] = {}
        self.batch = BatchEncoder(self.piece, self.letters, self.alone)

    def part(self, text: str) -> list[int]:
        """The ids of a pre-token; those of short ones are remembered for words with other marks around them."""
        found = self.parts.get(text)
        if found is None:
            found = [token.id for token in self.model.tokenize(mapped(text))]
            if len(text) <= 16:
                if len(self.parts) >= 200_000:
                    self.parts = {}
                self.parts[text] = found
        return found

    def piece(self, text: str) -> bytes:
        ids = array("I")
        for part in self.split(text):
            ids.extend(self.part(part))
        return ids.tobytes()

    def letters(self, words: list[str], before: str) -> list[bytes]:
        tokenize, space = self.model.tokenize, mapped(before)
        return [array("I", [t.id for t in tokenize(space + chars)]).tobytes() for chars in byte_strings(words)] if words else []

    def alone(self, text: str) -> bytes | None:
        """The ids of a text that holds a special token."""
        if any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return None

    def encode(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text]))[0]

    @property
    def vocabulary(self) -> int:
        return self.library.get_vocab_size()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder: what it remembers serves all tasks that the worker runs."""
    return Encoder(path)


SEGMENTS = "part long, seq long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encoded(documents: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id, ids (16-bit numbers where the vocabulary allows it, else 32-bit ones) of every document, its end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        kind = "<u2" if width_of(max(codec.vocabulary, end + 1)) <= 16 else "<u4"
        for rows in slices(batches, "text"):
            ids, lengths = codec.batch(rows.column(1))
            with_end = np.insert(ids.astype(kind), np.cumsum(lengths), end)
            offsets = np.r_[0, np.cumsum(lengths + 1)] * with_end.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(with_end)])
            yield batch({"doc_id": (rows.column(0), pa.int64()), "ids": (packed.cast(pa.binary()), pa.binary())})

    return documents.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def write_tokens(documents: DataFrame, tokenizer: str, folder: str, end: int = END) -> None:
    """Writes the ids of all documents, in ascending doc_id, to segments in a folder.

    Texts are encoded where they are read; only ids are shuffled. Rows of one
    doc_id are ordered by a hash of their ids, then dealt by row, so that no
    doc_id has to lie in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, bits = TaskContext.get().partitionId(), 0, width_of(max(encoder(tokenizer).vocabulary, end + 1))
        kind = "<u2" if bits <= 16 else "<u4"
        ids, docs, lengths, total = [], [], [], 0

        def closed() -> pa.RecordBatch:
            every = np.frombuffer(b"".join(ids), kind)
            return batch({"part": ([part], pa.int64()), "seq": ([seq], pa.int64()), "n_ids": ([total], pa.int64()), "doc_ids": ([docs], pa.list_(pa.int64())), "lengths": ([lengths], pa.list_(pa.int32())), "payload": ([pack(every, bits)], pa.binary())})

        for rows in batches:
            for doc, packed in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                n = len(packed) // np.dtype(kind).itemsize
                ids.append(packed)
                docs.append(doc)
                lengths.append(n)
                total += n
                if total >= SEGMENT:
                    yield closed()
                    seq, ids, docs, lengths, total = seq + 1, [], [], [], 0
        if docs:
            yield closed()

    keyed = written(encoded(documents, tokenizer, end).withColumn("tie", F.xxhash64("ids")), "token-ids").withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    ordered.select("doc_id", "ids").mapInArrow(run, SEGMENTS).write.option("compression", "zstd").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a folder of segments.

    Only the counts of the segments are summed, first within a written part,
    then over the parts; the payloads are unpacked where they are read.
    """
    segments = spark.read.schema(SEGMENTS).parquet(folder)
    counts = segments.select("part", "seq", "n_ids")
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("seq_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, seq, docs, lengths, payload in zip(*(rows.column(i).to_pylist() for i in range(5))):
                ids = unpack(payload).astype("<u4")
                ends = np.cumsum(lengths)
                checks = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths)]
                k = len(docs)
                yield batch({"part": ([part] * k, pa.int64()), "seq": ([seq] * k, pa.int64()), "doc_id": (docs, pa.int64()), "at": ((ends - lengths).tolist(), pa.int64()), "n_tokens": (lengths, pa.int64()), "ids_crc32": (checks, pa.int64())})

    checked = segments.select("part", "seq", "doc_ids", "lengths", "payload").mapInArrow(run, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return checked.join(starts, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_tokens(spark, folder)
