"""Helpers of the corpus operators: tables in the shared folder, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a local session names none a temporary one is set; on a cluster,
    where hosts don't share it, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillwork-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back.

    Cuts the lineage: what was computed survives the loss of any executor. The
    tables stay until the owner of the shared folder removes them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Characters of one stretch of a text that is too long for a training sample.
STRETCH = 400


def spread(column: str, most: int) -> Column:
    """A text of at most `most` characters, or that many in stretches at even distances over the whole text."""
    text, n = F.col(column), max(2, most // STRETCH)
    stretch = max(1, most // n - 1)  # a space follows each
    step = (F.length(text) - F.lit(stretch)) / F.lit(n - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substr(text, (F.floor(i * step) + 1).cast("int"), F.lit(stretch)))
    return F.when(F.length(text) > most, F.array_join(cut, " ")).otherwise(text)


def id_check(column: str, modulus: int):
    """crc32 of an id written as text, modulo `modulus`; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from {name: (values, type)}."""
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def texts_of(rows: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch, one at a time; null becomes ''."""
    return (x.as_py() or "" for x in rows.column(rows.schema.get_field_index(column)))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a part holds about `most` bytes of a column or one row."""
    for rows in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(rows.column(rows.schema.get_field_index(column))), 0)).astype(np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield rows.slice(a, b - a)
