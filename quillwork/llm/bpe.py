"""Byte-level BPE through a sentencepiece model made from the vocabulary.

The model is written straight in the model file's wire format: each token's
bytes as their printable characters, scored by negative rank, so that
sentencepiece's merges (best score first, leftmost on ties) are those of the
ranks; normalisation is the identity, with no dummy prefix and no white-space
escaping. A text's pre-tokens are encoded one by one, a pre-token that is
itself a token directly. Decoding maps ids back to their bytes.

Edge cases: a null or empty text has no ids; texts of any length are encoded
whole; repeated rows stay; an empty table gives no rows; other columns pass by.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from quillwork.llm.pretokens import BatchEncoder, byte_chars, byte_strings, mapped
from quillwork.llm.shared import batch, slices, table

#: Bytes of text that are encoded at once: lists of their words and ids take some thirty times as much.
AT_ONCE = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes, a varint or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the tokens' ranks."""
    normal, unknown, bpe = 1, 2, 2
    chars = byte_chars()
    out = bytearray()
    for rank, token in enumerate(tokens):
        text = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, text) + _field(2, -float(rank)) + _field(3, normal))
    out += _field(1, _field(1, "⁇unk".encode()) + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    trainer += b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # no bos, eos, pad
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.tokens = read_ranks(path)
        self.whole = {token: rank for rank, token in enumerate(self.tokens)}
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.batch = BatchEncoder(self.piece, self.letters, most=60_000)

    def piece(self, text: str) -> bytes:
        ids = array("I")
        for token in self.split(text):
            rank = self.whole.get(token.encode())
            if rank is None:
                ids.extend(self.model.encode(mapped(token), out_type=int))
            else:
                ids.append(rank)
        return ids.tobytes()

    def letters(self, words: list[str], before: str) -> list[bytes]:
        ranks = [self.whole.get((before + word).encode()) for word in words]
        found = [None if rank is None else array("I", (rank,)).tobytes() for rank in ranks]
        long = [at for at, rank in enumerate(ranks) if rank is None]
        if long:
            space = mapped(before)
            spelled = [space + chars for chars in byte_strings([words[at] for at in long])]
            for at, ids in zip(long, self.model.encode(spelled, out_type=int, num_threads=1)):
                found[at] = array("I", ids).tobytes()
        return found

    def encode(self, text: str) -> list[int]:
        return self.batch(pa.array([text]))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """A worker's codec: what it remembers serves all tasks that the worker runs."""
    return Codec(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array<int>) of every text: the operator's own output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for rows in slices(batches, "text", AT_ONCE):
            ids, lengths = codec.batch(rows.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield batch({"doc_id": (rows.column(0), pa.int64()), "ids": (lists, lists.type)})

    return documents.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, decoded (binary) of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = read_ranks(vocabulary)
        for rows in batches:
            decoded = [b"".join(map(tokens.__getitem__, ids or ())) for ids in rows.column(1).to_pylist()]
            yield batch({"doc_id": (rows.column(0), pa.int64()), "decoded": (decoded, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip_digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to.

    Ids are encoded and decoded in one pass over the texts and never leave the
    task, so the cost is that of the scan and of the tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        written = [str(i) for i in range(len(codec.tokens))]
        for rows in slices(batches, "text", AT_ONCE):
            every, counts = codec.batch(rows.column(1))
            of_ids, of_bytes, at = [], [], 0
            for n in counts.tolist():
                ids = every[at : at + n].tolist()
                at += n
                of_ids.append(hashlib.sha256(" ".join(map(written.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield batch({"doc_id": (rows.column(0), pa.int64()), "n_tokens": (counts, pa.int64()), "ids_sha256": (of_ids, pa.string()), "decoded_sha256": (of_bytes, pa.string())})
            del every, counts
        pa.default_memory_pool().release_unused()

    return documents.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, SCHEMA)


def op8_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
