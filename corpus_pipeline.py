"""Corpus pipeline: language ID, near-dedup, decontamination, PII, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes
every stage's result as Parquet in the shared folder and gives it, read again,
to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillwork.llm import bpe, decontaminate, langid, pii, similar, simhash
from quillwork.llm.shared import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is known ('und' goes)."""
    return langid.keep_identified(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word similarity 0.8 or more) the document of the smallest doc_id."""
    return simhash.keep_one(docs, similar.near_copies)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that overlap no benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, plain or disguised, by its kind in brackets."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the texts: doc_id, n_tokens and the digests of both."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("decontaminate", without_benchmark),
    ("personal_data", without_personal_data),
    ("bpe_tokens", tokens),
]

#: No SQL: prediction by partial matching and byte-pair merges are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
